"""Copies of a table made for a join don't pass through the driver, however small Spark takes them for."""

from pyspark.sql import functions as F

from tallycell.llm.common import attach


def test_copies_are_not_broadcast(spark):
    left = spark.range(3000).select((F.col("id") % 700).alias("k"), "id")
    right = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    for how, n in (("left", 3000), ("inner", 2600)):
        joined = attach(left, right, ["k"], [F.col("id")], how)
        rows = joined.collect()
        assert len(rows) == n and all(r.twice == (2 * r.k if r.k < 600 else None) for r in rows)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
