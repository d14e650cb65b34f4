"""Every stage of the pipeline against a brute-force version on the stage's own input."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_pairs import DOCS, WORDS, brute_components, shingle_set

from ledgerline.llm.line_dedup import PRIOR_PAGES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    found.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    return found


def test_language_id_keeps_rows_as_they_are(steps):
    before, after = steps[0], steps[1]
    assert not Counter(after) - Counter(before)
    with_letters = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert not [r for r in after if not any(c.isalpha() for c in r.text or "")]
    assert len(after) >= 0.95 * len(with_letters)


def test_line_dedup_drops_the_lines_above_the_ratio(steps):
    before, after = steps[1], steps[2]
    pages = Counter(r.source for r in before)
    on_pages = Counter((r.source, x) for r in before for x in {y.strip(" ") for y in (r.text or "").split("\n")} if x)
    gone = {k for k, n in on_pages.items() if 100 * (n - 1) > corpus_pipeline.STAGE_PERCENT * (pages[k[0]] + PRIOR_PAGES)}
    want = Counter()
    for r in before:
        text = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in gone)
        want[r.doc_id, text, r.lang, r.source, None if text is None else len(text)] += 1
    assert Counter(tuple(r) for r in after) == want


def test_near_dedup_keeps_the_least_of_each_group(steps):
    before, after = steps[2], steps[3]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert Counter(after) == Counter(r for r in before if groups[r.doc_id][2])
    assert len(after) < len(before)


def test_decontamination_drops_what_contains_an_item(spark, steps):
    before, after = steps[3], steps[4]
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    sets = [shingle_set(r.text, 5) for r in before]
    leaks = [any(x and 100 * len(x & s) >= 80 * len(x) for x in items) for s in sets]
    assert Counter(after) == Counter(r for r, leak in zip(before, leaks, strict=True) if not leak)
    assert any(leaks)


def test_mixing_meets_its_targets(steps):
    before, after = steps[4], steps[5]
    words = lambda r: len(WORDS.findall(r.text or ""))
    size = Counter()
    for r in before:
        size[r.source] += words(r)
    weight = dict(zip(sorted(size, key=lambda x: (x is None, x or "")), [3, 1, 2] * len(size), strict=False))
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = [x for x in open_ if share[x] > 2 * size[x]]
        target |= share if not full else {x: 2 * size[x] for x in full}
        left -= sum(2 * size[x] for x in full)
        open_ = open_ - set(full) if full else set()
    taken = Counter()
    for r in after:
        taken[r.source] += words(r)
    largest = max(words(r) for r in before)
    assert all(abs(taken[x] - target[x]) <= max(largest, 0.02 * target[x]) for x in size)
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 2
    assert {r.copy for r in after} <= {1, 2}
    assert set(copies) <= {r.doc_id for r in before}


def test_run_applies_all_stages_and_takes_an_empty_table(spark, steps, tmp_path):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r.doc_id for r in steps[5])
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 0


def test_stages_take_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    names = ["_text", "size", "target", "source_size", "copies", "_h", "_of", "host", "clean_text", "row", "component_id", "score", "lang_pred"]
    rows = [(i, f"several words {i % 7} of document {i} make it one of its own kind " * 3, "aa", "s" if i % 3 else None, 9) for i in range(30)]
    rows += [rows[1], (None, None, None, None, None), (77, None, "aa", "s", 0), (78, "", "aa", "s", 0), (79, "word " * 40_000, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(1, "never to be found in here at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + ["copy"] * (name == "mixing"), name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= {r[0] for r in rows} and len(kept) > (5 if name in ("MinHash near-dedup", "mixing") else 25), name
        assert all(r[n] == n for r in out.collect() for n in names), name
