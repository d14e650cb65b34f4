"""Files of several trees that share folder and name."""


def test_one_row_for_each_name_of_many_trees(spark, tmp_path):
    from ledgerline.plans import QUERIES

    spark.range(1, 4100).selectExpr("id s_suppkey", "cast(id % 4 as int) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = QUERIES["many_trees"](spark, str(tmp_path)).collect()
    assert len({(r.folder, r["name"]) for r in rows}) == len(rows)
    assert len({i for r in rows for i in (r.item_1, r.item_2, r.item_3) if i is not None}) < 4099
