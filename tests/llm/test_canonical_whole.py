"""Every entry competes for every value, whatever its first word, its rare words and the number of its words."""

import random

import pytest
from pyspark.sql import functions as F

from tradeloom.llm.canonical import map_values, read_values, score_pairs

COLUMNS = "asset_id long, canonical_name string, ticker string, former_ticker string"
REFERENCE = [
    (1, "Zimmdorf Observatory", None, None), (2, "Mobility Pumps Company", "MOPU", None), (3, "Quaxtor Mobility Lanterns", None, None), (4, "Ulbrecht Harbour Canal Lighthouse Ferry Dredging Tug", None, None),
    (5, "Harbour Cranes", None, None), (6, "Canal Barges", None, None), (7, "Lighthouse Lamps", None, None), (8, "Ferry Tickets", None, None), (9, "Vondruk Notes 4.0% due 2031", None, None), (10, "Vondruk Notes 4.5% due 2031", None, None),
]
CASES = {"Observatory": 1, "Mobility Lanterns": 3, "Harbour Canal Lighthouse Ferry Dredging Tug": 4, "Notes 4.5% due 2031": 10, "Mobility Pumps": 2, "Xerblatt Observatory": 0}


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, t string")


def test_entries_without_their_first_word(spark):
    got = {r["line_no"]: r["asset_id"] for r in map_values(lines_of(spark, CASES), "line_no", "t", spark.createDataFrame(REFERENCE, COLUMNS)).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_all_pairs(spark, seed):
    """The result is that of scoring all values with all entries."""
    draw = random.Random(seed)
    general = "growth income equal weight treasury energy foods motors index fund etf inc corp notes revenue commission".split()
    leads = ["".join(draw.choice("bdgklmnprstvz") + draw.choice("aeiou") for _ in range(4)) for _ in range(25)]
    slots = ["3.0%", "4.5%", "2031", "2034", "class a", "class b"]
    entries = [(i, " ".join([draw.choice(leads + general[:6]), *draw.sample(general, draw.randint(1, 5)), *draw.sample(slots, draw.choice((0, 0, 1, 2)))]), draw.choice((None, f"q{i}x")), None) for i in range(1, 81)]
    garble = lambda w: draw.choice((w, w, w, w[:4], w[1:], w.replace("e", ""), w + "s", w[::-1]))
    texts = [" ".join(map(garble, draw.sample([*general, *general, *leads, "common", "shares", "zuqo", "q7x"], draw.randint(1, 12)))) + draw.choice(("", " 3.0% 2031", " class b", " 2034")) for _ in range(250)]
    reference = spark.createDataFrame(entries, COLUMNS)
    got = {r["line_no"]: (r["asset_id"], r["score"]) for r in map_values(lines_of(spark, texts), "line_no", "t", reference, threshold=1e-6).collect()}
    values, terms, built, weights = read_values(spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "value string"), reference)
    held = terms.groupBy("entry").agg(F.collect_set(F.when(F.col("anchor"), F.col("term"))).alias("anchors"))
    pairs = built.crossJoin(held).select("v", "entry", F.arrays_overlap(F.transform("flat", lambda c: c["term"]), "anchors").alias("anchored"))
    best = {}
    for r in score_pairs(pairs, built, weights).join(values.select("v", "value"), "v").collect():
        best[r["value"]] = max(best.get(r["value"], (0, 0)), (round(r["score"], 9), -r["entry"]))
    want = {i: (-best[t][1], best[t][0]) if t in best else (0, 0) for i, t in enumerate(texts)}
    wrong = {texts[i]: (got[i], want[i]) for i in want if got[i][0] != want[i][0] or abs(got[i][1] - want[i][1]) > 2e-9}
    assert got.keys() == want.keys() and not wrong, wrong
