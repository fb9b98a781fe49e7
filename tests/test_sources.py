"""Parsers, files, copies and streams on small inputs."""

from datetime import date, datetime

from tradeloom.operators import dedup as D
from tradeloom.operators import reconcile as R
from tradeloom.sources import parsers as P
from tradeloom.sources import tables as T
from tradeloom.streaming import disclosures as W

REPORT = """ID OWNER ASSET TRANSACTION

SP Alpha Systems Inc. Common
Stock (ALPH) [ST] S (partial) 01/02/2024 02/03/2024 $1,001 -
$15,000
FILING STATUS: New

Beta Fund P 03/04/2024 03/05/2024 $15,001 - $50,000
(BETA) [MF]

Gamma Note E 05/06/2024 06/07/2024 Over $50,000,000
"""


def test_report():
    a, b, c = P.parse_report(REPORT)
    assert (a["owner"], a["asset"], a["ticker"], a["kind"], a["operation"], a["amount"]) == ("SP", "Alpha Systems Inc. Common Stock", "ALPH", "ST", "Sale (Partial)", "$1,001 - $15,000")
    assert (b["owner"], b["asset"], b["ticker"], b["kind"], b["operation"]) == (None, "Beta Fund", "BETA", "MF", "Purchase")
    assert (c["asset"], c["operation"], c["amount"]) == ("Gamma Note", "Exchange", "Over $50,000,000")
    assert P.parse_report(None) == [] and P.parse_report("x" * 100_000) == []


AWKWARD = """Clerk of the House
Filing ID #20001
ID Owner Asset Transaction Type Date
JT Gamma Pipelines LP - Limited Partner Interests
(NYSE: GPL) S 01/02/2019 01/09/2019 $1,001 -
[sT] $15,000
Sold @ $31.50, 100 shares
Delta Class-B Holdings P 02/03/2019 02/04/2019 $15,001 -
(DEL-B) [sT] $50,000
Description: bought before the split
sp Epsilon Water - Common P 03/04/2019 03/05/2019 $50,001 -
- EPW [ST] $100,000
Zeta Growth and Income
Portfolio Class R
Institutional E 04/05/2019 04/06/2019 $1,000,001 - $5,000,000
Shares [MF]
Eta (partial) Interest S (full) 05/06/2019 05/07/2019 $50,000,001+
"""


def test_awkward_reports():
    rows = P.parse_report(AWKWARD)
    got = [(r["owner"], r["asset"], r["ticker"], r["kind"], r["operation"], r["amount"]) for r in rows]
    assert got[0] == ("JT", "Gamma Pipelines LP - Limited Partner Interests", "GPL", "ST", "Sale", "$1,001 - $15,000")
    assert got[1] == (None, "Delta Class-B Holdings", "DEL-B", "ST", "Purchase", "$15,001 - $50,000")
    assert got[2] == ("SP", "Epsilon Water - Common", "EPW", "ST", "Purchase", "$50,001 - $100,000")
    assert got[3][1:] == ("Zeta Growth and Income Portfolio Class R Institutional", None, None, "Exchange", "$1,000,001 - $5,000,000")
    assert got[4][1:] == ("Eta Interest", None, None, "Sale (Full)", "$50,000,001+")
    assert len(got) == 5


def test_operations_in_plain_words():
    assert [P.plain_operation(x) for x in ("purchase", "Sale (Partial)", "sale - full", "SALE", "Exchange", "Other", None)] == ["Purchase", "Sale (Partial)", "Sale (Full)", "Sale", "Exchange", "Other", None]


def test_pairs_like_a_plain_search():
    import random

    import pandas as pd

    rng = random.Random(8)
    for _ in range(60):
        o = [(rng.randrange(60) * rng.choice([1, 7]), i, rng.choice([None, 5.0, 9.0])) for i in range(rng.randrange(1, 25))]
        v = [(rng.randrange(60) * rng.choice([1, 7]), 100 + i, rng.choice([None, 6.0, 50.0])) for i in range(rng.randrange(1, 25))]
        frame = lambda rows: pd.DataFrame([("m", "T", "P", 0, *r) for r in rows], columns=["member", "tk", "s", "run", "d", "id", "f"])
        free, wanted = sorted(v, key=lambda x: x[:2]), []
        for d, i, _ in sorted(o, key=lambda x: x[:2]):
            near = min(((abs(d - x[0]), k) for k, x in enumerate(free)), default=(999, 0))
            if near[0] <= R.PAIR_DAYS:
                wanted.append((i, free.pop(near[1])[1], near[0]))
        assert R._greedy(frame(o), frame(v))[["txn_id", "vendor_no", "gap"]].values.tolist() == [list(w) for w in wanted]


def test_tables_in_any_order():
    html = "<p>x</p><table><tr><th>Asset Name</th><th>Transaction Date</th><th>Type</th></tr><tr><td>A &amp; B</td><td>01/02/2024</td><td>Purchase</td></tr><tr><td>--</td></tr></table>"
    (row,) = P.parse_tables(html)
    assert (row["asset"], row["transaction_date"], row["operation"], row["ticker"]) == ("A & B", "01/02/2024", "Purchase", None)
    assert P.parse_tables("<table><tr><td>1</td></tr></table>") == [] and P.parse_tables(None) == []


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b\nc", None), ("2", "d", "2020")], "id string, text string, year string")
    T.write_csv(df.coalesce(1), f"{tmp_path}/c")
    assert {r["id"]: r["text"] for r in T.read_csv(spark, f"{tmp_path}/c", ["id", "text", "year"]).collect()} == {"1": "a,b\nc", "2": "d"}
    T.write_table(df, f"{tmp_path}/p", ["year"])
    T.write_table(df.where("year = '2020'").withColumn("text", D.F.lit("new")), f"{tmp_path}/p", ["year"])
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/p").collect()) == ["a,b\nc", "new"]
    (tmp_path / "i.xml").write_text("<R><Member><Last>A</Last><FilingType>P</FilingType><FilingDate>1/2/2024</FilingDate><DocID>7</DocID></Member><Member><FilingType>X</FilingType></Member></R>")
    assert [r["DocID"] for r in T.read_index(spark, f"{tmp_path}/i.xml", "2024-01-01", "2024-12-31").collect()] == ["7"]
    assert {r["FilingType"]: r["count"] for r in T.index_types(spark, f"{tmp_path}/i.xml").collect()} == {"P": 1, "X": 1}
    assert "| id | text |" in T.markdown(df.select("id", "text")) and T.add_once(df, "id", D.F.lit(1)) is df
    assert df.select(T.first_column(df, ["nope", "text"]).alias("x")).collect() == df.select(D.F.col("text").alias("x")).collect()
    assert T.markdown(df, 1).endswith("(the first 1 rows)")
    (tmp_path / "p.yaml").write_text('- {"id": {"bioguide": "A1"}, "name": {"first": "Ann"}, "terms": [{"type": "sen", "start": "2020-01-03", "end": "2026-01-03"}, {"type": "rep", "start": "2018-01-03"}]}\n- {"id": {"bioguide": "B2"}, "name": {}}\n')
    assert sorted((r["bioguide_id"], r["chamber"], r["start"], r["end"]) for r in T.read_people(spark, f"{tmp_path}/p.yaml").collect()) == [("A1", "rep", "2018-01-03", None), ("A1", "sen", "2020-01-03", "2026-01-03")]
    (tmp_path / "prices" / "ticker=AB").mkdir(parents=True)
    (tmp_path / "prices" / "ticker=AB" / "x.csv").write_text("date,close\n2024-01-02,10.5\n2024-01-03,\n")
    assert [(r["ticker"], r["close"]) for r in T.read_prices(spark, f"{tmp_path}/prices", ["AB", "NONE"]).collect()] == [("AB", 10.5)]


def test_dedup_is_idempotent(spark):
    rows = [("k", 0, date(2020, 1, 1), 1), ("k", 0, date(2021, 1, 1), 2), ("k", 0, None, 3), ("k", 1, None, 4), (None, 0, None, 5)]
    df = spark.createDataFrame(rows, "key string, occ int, d date, id int")
    once = D.keep_latest(df, ["key", "occ"], "d", ["id"])
    assert sorted(r["id"] for r in once.collect()) == [2, 4, 5]
    assert sorted(r["id"] for r in D.keep_latest(once, ["key", "occ"], "d", ["id"]).collect()) == [2, 4, 5]


def test_one_to_one(spark):
    o = "member string, tk string, s string, d date, txn_id long, disclosure_date date"
    v = "member string, tk string, s string, d date, vendor_no long, filed date"
    day = lambda m, x: date(2020, m, x)
    ours = [("m", "T", "P", day(1, 1), 1, day(2, 1)), ("m", "T", "P", day(1, 1), 2, day(2, 1)), ("m", "T", "P", day(3, 1), 3, day(4, 1)), ("m", "T", "P", day(5, 20), 4, day(6, 1)), ("m", "T", "P", None, 5, None)]
    vendor = [("m", "T", "P", day(1, 1), 11, day(2, 1)), ("m", "T", "P", day(3, 2), 12, day(4, 2)), ("m", "T", "P", day(7, 1), 13, day(6, 2)), ("m", "T", "P", date(2023, 1, 1), 14, None)]
    got = sorted((r["txn_id"], r["vendor_no"], r["gap"], r["same_filing"], r["kind"]) for r in R.one_to_one(spark.createDataFrame(ours, o), spark.createDataFrame(vendor, v)).collect())
    assert (2, 11, 0, None, "exact") in got and (4, 13, 42, True, "candidate") in got
    assert (1, 12, 61, False, "candidate") in got and 3 not in {g[0] for g in got}
    assert len({g[0] for g in got}) == len(got) and len({g[1] for g in got}) == len(got) and all(g[2] <= R.PAIR_DAYS for g in got)


def test_streams_take_up_only_what_is_new(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    rows = [(i % 3, datetime(2024, 1, 1, i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, value double")
    df.write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    W.run_available(W.without_copies(read(), ["k"], "ts"), out, f"{tmp_path}/ck")
    assert spark.read.parquet(out).count() == 3
    W.run_available(W.without_copies(read(), ["k"], "ts"), out, f"{tmp_path}/ck")
    assert spark.read.parquet(out).count() == 3
    W.merge_batches(read(), f"{tmp_path}/m", f"{tmp_path}/ck2", ["k"], ["ts"])
    spark.createDataFrame([(0, datetime(2023, 1, 1), 9.0)], df.schema).write.mode("append").parquet(src)
    W.merge_batches(read(), f"{tmp_path}/m", f"{tmp_path}/ck2", ["k"], ["ts"])
    assert {r["k"]: r["value"] for r in W.read_merged(spark, f"{tmp_path}/m", df.schema).collect()} == {0: 9.0, 1: 1.0, 2: 2.0}
    cache = spark.createDataFrame([("a", "v1", "ok"), ("b", "v1", "failed"), ("c", "v0", "ok")], "doc_id string, version string, status string")
    assert sorted(r["doc_id"] for r in W.not_cached(cache.select("doc_id"), cache, "v1").collect()) == ["b", "c"]


def test_year_ranges():
    from tradeloom.functions.scalars import year_range

    assert year_range("2020-2022, 2025,2021") == [2020, 2021, 2022, 2025] and year_range("") == []
