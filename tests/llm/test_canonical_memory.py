"""Small tables whose rows explode are not sent to the driver to be broadcast."""

from tradeloom.llm.canonical import map_values, repairs


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_exploded_rows(spark):
    tokens = spark.createDataFrame([(t,) for t in ("industires", "tresury", "trsy", "growthfund", "pharma")], "token string")
    vocabulary = spark.createDataFrame([("industries", 6, False), ("treasury", 7, False), ("growth", 5, False), ("fund", 9, False), ("pharmaceuticals", 5, False), ("3.0%", 2, True)], "term string, df long, fixed boolean")
    found = repairs(tokens, vocabulary)
    assert "BroadcastHashJoin" not in final_plan(found)
    assert {("industires", "industries"), ("tresury", "treasury"), ("trsy", "treasury"), ("growthfund", "growth"), ("pharma", "pharmaceuticals")} <= {(r["token"], r["term"]) for r in found.collect()}
    reference = spark.createDataFrame([(1, "Hinzailron Industries Growth", "HNZ", None)], "asset_id long, canonical_name string, ticker string, former_ticker string")
    assert "BroadcastHashJoin" not in final_plan(map_values(spark.createDataFrame([(1, "Hinzailron Industires")], "line_no long, t string"), "line_no", "t", reference))
