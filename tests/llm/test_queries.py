"""Every query of the subpackage over its whole small table: against SQL, brute force or its contract."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from test_pairs import WORDS, brute_components

from ledgerline.llm import registry
from ledgerline.llm.spans import PRIVATE_KINDS, SECRET_KINDS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name):
    return registry.QUERIES[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = sorted(c[0] for c in cur.description)
    want = sorted(str(tuple(dict(zip([c[0] for c in cur.description], r, strict=True))[c] for c in columns)) for r in cur.fetchall())
    got = registry.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want and want


def test_near_duplicates_of_documents(spark, docs):
    want = brute_components([(i, r.text) for i, r in docs.items()], 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op5_minhash_near_dedup")} == want


def test_mix_of_documents(spark, docs):
    out = rows(spark, "op6_mix_sources")
    assert Counter(map(str, out)) == Counter(map(str, rows(spark, "op6_mix_sources")))
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        assert r.size == len(WORDS.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        taken[docs[r.doc_id].source] += r.taken
        size[docs[r.doc_id].source] += r.size
        target[docs[r.doc_id].source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in size)


@pytest.mark.parametrize(("name", "kinds"), [("op3_private_data", PRIVATE_KINDS), ("op10_secrets", SECRET_KINDS)])
def test_spans_of_documents(spark, docs, name, kinds):
    """Base spans are found in the spans column, their digest and counts agree with it."""
    out = rows(spark, name)
    assert len(out) == len(docs)
    key = (lambda k, a, b: (k, a)) if name.startswith("op3") else (lambda k, a, b: (a, k))
    for r in out:
        spans = [(kinds.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: key(*x)) and all(0 <= a < b <= len(docs[r.doc_id].text or "") for _, a, b in spans)
        n = [r[f"n_{k}"] for k in kinds]
        assert all(sum(x[0] == i for x in spans) >= c for i, c in enumerate(n))
        if len(spans) == sum(n):
            assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert any(r.spans for r in out) or name.startswith("op10")  # the small table holds no secrets
    assert re.fullmatch("[0-9a-f]{64}", out[0].base_sha256)
