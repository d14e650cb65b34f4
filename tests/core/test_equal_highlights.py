"""Highlights that are equal in start and length."""

import random

from ledgerline.operators import findings as O


def test_equal_highlights_are_numbered_as_one(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(40), rng.randrange(1, 7)) for k in range(60) for _ in range(rng.randrange(1, 8))]
    rows += rng.choices(rows, k=200) + [(99, 15, 2), (99, 22, 6), (99, 22, 6)]
    rng.shuffle(rows)
    merged = O.merged_highlights(spark.createDataFrame(rows, "pfile_fk long, start int, len int"))
    want: list[list[int]] = []
    for k, s, n in sorted(rows):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], s + n)
        else:
            want.append([k, s, s + n])
    assert sorted(list(r) for r in merged.collect()) == want
    # No number depends on which of two equal rows a window has first.
    assert "RowFrame, unboundedpreceding$(), currentrow$()" not in merged._jdf.queryExecution().optimizedPlan().toString()
