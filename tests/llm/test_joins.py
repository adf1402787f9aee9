"""The salted join: equal to a plain one, its heavy keys dealt to several tasks."""

import contextlib
import io

from pyspark.sql import functions as F

from windrift.llm.common import join_salted


def test_salted_join_equals_a_plain_one(spark):
    rows = [("hot", k) for k in range(400)] + [(f"key{k % 30}", k) for k in range(300)] + [("left only", 1), (None, 2)]
    left = spark.createDataFrame(rows, "key string, n int")
    pays = [("hot", "x" * 5000), ("hot", "second"), *[(f"key{k}", "y") for k in range(0, 30, 2)], ("right only", "z")]
    weights = left.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    right = spark.createDataFrame(pays, "key string, pay string").join(weights, "key")
    want = sorted((k, n, p) for k, n in rows for j, p in pays if j == k)
    for slices in (1, 4, 500):
        got = join_salted(left, right, ["key"], "w", ["n"], slices)
        assert got.columns == ["key", "n", "pay", "w"]
        assert sorted((r.key, r.n, r.pay) for r in got.collect()) == want
    assert join_salted(left, right.limit(0), ["key"], "w", ["n"]).count() == 0


def test_salted_join_broadcasts_names_of_keys_only(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("w")).withColumn("pay", F.repeat(F.col("key"), 1000))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = join_salted(left, right, ["key"], "w", ["id"], 50)
        with contextlib.redirect_stdout(io.StringIO()) as text:
            got.explain()
        plan = text.getvalue()
        assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 1
        # most rows of the shuffled sides that one partition gets
        most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert most < 700 and got.count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
