"""Dense id allocation across partitions."""

from pyspark.sql import functions as F

from matchfold.operators.ids import assign_dense_ids


def test_dense_ids_global_order(spark):
    df = spark.range(0, 1000).select(
        F.col("id").alias("k"), ((F.col("id") * 7919) % 1000).alias("o"), (F.col("id") % 3 == 0).alias("need")
    )
    out = assign_dense_ids(df, F.col("need"), [F.col("o"), F.col("k")], start=41, out_col="nid", num_partitions=7)
    rows = out.collect()
    assert len(rows) == 1000
    got = sorted((r.o, r.k, r.nid) for r in rows if r.need)
    assert [x[2] for x in got] == list(range(42, 42 + 334))
    assert all(r.nid is None for r in rows if not r.need)


def test_no_rows_need_ids(spark):
    df = spark.range(0, 50).select(F.col("id").alias("k"))
    out = assign_dense_ids(df, F.lit(False), [F.col("k")], start=5, out_col="nid", num_partitions=3)
    assert out.count() == 50 and out.where("nid IS NOT NULL").count() == 0


def test_skewed_order(spark):
    # one order value shared by a third of the rows: ties broken by the second key
    df = spark.range(0, 300).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("o")
    )
    out = assign_dense_ids(df, F.lit(True), [F.col("o"), F.col("k")], start=0, out_col="nid", num_partitions=5)
    ranked = [r.nid for r in out.orderBy("o", "k").collect()]
    assert ranked == list(range(1, 301))
