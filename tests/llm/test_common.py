import collections

from pyspark.sql import functions as F

from reportloom.llm.common import join_counted, written


def test_join_counted_gives_the_inner_join_with_nulls_equal(spark):
    rows = [("hot", 1, k) for k in range(900)] + [(None, 1, k) for k in range(200)] + [(f"k{k % 40}", None, k) for k in range(120)] + [("alone", 5, 1)]
    left = spark.createDataFrame(rows, "a string, b int, v int").repartition(5)
    right = left.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("v").alias("total")).where("a is null or a <> 'alone'")
    got = collections.Counter(tuple(r) for r in join_counted(left, right, ["a", "b"], "n", 8).collect())
    totals = collections.Counter()
    for a, b, v in rows:
        totals[a, b] += v
    assert got == collections.Counter((a, b, v, totals[a, b]) for a, b, v in rows if a != "alone")
    assert join_counted(left.limit(0), right.limit(0), ["a", "b"], "n", 8).count() == 0


def test_written(spark):
    df = spark.range(10).select("id", F.array(F.struct(F.lit(None).cast("string").alias("x"))).alias("s"))
    again = written(df, "test")
    assert again.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert "Range" not in again._jdf.queryExecution().optimizedPlan().toString()
