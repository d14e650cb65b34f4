"""The line stage of the pipeline takes boilerplate away, and nothing else."""

from collections import Counter

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_planted_lines_go_and_prose_stays(spark):
    rows = []
    for i in range(600):
        lines = [f"own line {i}"] + ["menu | home"] * (i % 10 == 0) + ["a common short line"] * (i % 40 == 0)
        rows.append((i, "\n".join(lines), "aa", "large", 0))
    rows += [(1000 + i, f"menu | home\nsmall {i}", "aa", "small", 0) for i in range(2)]
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert out[10].text == "own line 10" and out[10].n_chars == len("own line 10")
    assert out[40].text == "own line 40\na common short line"
    assert out[1000].text == "small 0"  # 2 of 2: 100 * 1 > 5 * 11
    assert len(out) == len(rows)


def test_stage_drops_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = docs.collect(), {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    pages, on = Counter(r.source for r in before), Counter()
    for r in before:
        on.update({(r.source, x.strip(" ")) for x in (r.text or "").split("\n") if x.strip(" ")})
    gone = {k for k, n in on.items() if 100 * (n - 1) > 5 * (pages[k[0]] + 9)}
    assert gone
    for r in before:
        want = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in gone)
        assert after[r.doc_id] == want
