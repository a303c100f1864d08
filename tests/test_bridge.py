"""The derived alignment against its SQL."""

from blockloom.plans import bridge


def test_alignment_is_that_of_its_sql(spark, tmp_path, monkeypatch):
    """Over several shards, with keys below zero, gaps between keys and missing values."""
    monkeypatch.setattr(bridge, "SHARD", 7)
    rows = [(k, n, (k * 7 + n * 3) % 11, (k + n) % 9, 100 * n, "2020-01-01") for k in (-9, -1, 0, 1, 2, 3, 6, 7, 8, 20, 21, 4999, 5000, 5001, 12000) for n in range(1, 2 + k % 5)]
    rows += [(None, 1, 5, 5, 1, "2020-01-01"), (30, 1, None, 5, 1, "2020-01-01"), (30, 2, None, 5, 1, "2020-01-01"), (31, 2, 3, None, 1, "2020-01-01"), (31, 1, 3, None, 1, "2020-01-01")]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice long, l_shipdate string").write.parquet(path)
    got, want = bridge.alignment(spark, str(tmp_path)), spark.sql("with " + bridge.SQL.format(lineitem=f"parquet.`{path}`", string="string") + " select * from aln")
    assert got.schema.simpleString() == want.schema.simpleString() and got.count() == len(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_alignment_orders_no_whole_sequence(spark, tmp_path):
    """Rows are ordered inside shards; windows over sequences see one record per shard."""
    rows = [(k, 1, 1, 1, 1, "2020-01-01") for k in range(9)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice long, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "Window" not in bridge.alignment(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
