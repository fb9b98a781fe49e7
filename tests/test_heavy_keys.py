"""Per-key results are the same whichever way keys take."""

from datetime import date

from pyspark.sql import functions as F

from tradeloom.operators.heavy_keys import Measure, aggregate_by_key, heavy_keys

SCHEMA = "k string, x double, d date, k__ string, salt__ string"
MEASURES = [Measure("n", "count"), Measure("sum", "sum", "x"), Measure("first", "min", "d"), Measure("last", "max", "d"), Measure("known", "count", "x")]


def rows():
    out = [("hot", float(i % 7), date(2020, 1, 1 + i % 28), "c", "c") for i in range(900)] + [(None, 1.0, None, "c", "c")] * 300
    return out + [(f"k{i % 40}", None if i % 5 == 0 else float(i), date(2021, 1, 1), None, None) for i in range(200)]


def plainly(df):
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.min("d").alias("first"), F.max("d").alias("last"), F.count("x").alias("known"))


def test_same_as_plain_aggregation(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    assert heavy_keys(df, "k", 0.05) == ["hot", None]
    for share in (0.05, 0.3, 5.0):
        assert sorted(map(str, aggregate_by_key(df, "k", MEASURES, share=share).collect())) == sorted(map(str, plainly(df).collect()))


def test_attributes_by_both_ways(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    side = spark.createDataFrame([("hot", "H", 1), ("k1", "L", 2), ("unused", "U", 3)], "key string, name string, k int")
    got = {r["k"]: r["name"] for r in aggregate_by_key(df, "k", MEASURES, side, "key", ["name"], share=0.05).collect()}
    assert got["hot"] == "H" and got["k1"] == "L" and got[None] is None and got["k2"] is None and len(got) == 42


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df, "k") == [] and aggregate_by_key(df, "k", MEASURES).count() == 0
