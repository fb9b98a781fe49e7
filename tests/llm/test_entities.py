"""Matching without keys on a few trades, and belief propagation against enumeration."""

import itertools
import math
from datetime import date

import pytest

from tradeloom.llm.entities import match_trades, propagate, resolve_names

V = "vendor_no long, bioguideid string, name string, ticker string, transaction string, traded date, filed date, trade_size_usd double, member string, asset string, n__ string"
O = "txn_id long, bioguide_id string, declarant_name string, ticker string, asset_description string, operation_type string, transaction_date date, disclosure_date date, amount_range string, amount_midpoint double, class string"
M = "bioguide_id string, first_name string, nickname string, last_name string"
A = "asset_id long, canonical_name string, ticker string, former_ticker string"
D, FILED = date(2020, 3, 9), date(2020, 4, 1)


def members(spark):
    return spark.createDataFrame([("A000001", "Anna", "Annie", "Alder"), ("B000002", "Bert", None, "Birch"), ("C000003", "Bart", None, "Birch")], M)


def match(spark, vendor, ours):
    ref = spark.createDataFrame([(1, "Alpha Systems Inc", "ALP.A", "OLD"), (2, "Beta Foods Ltd", "BET", None)], A)
    got = match_trades(spark.createDataFrame([(*v, "x", "y", "z") for v in vendor], V), spark.createDataFrame([(*o, "c") for o in ours], O), members(spark), ref)
    return {(r["vendor_no"], r["txn_id"]): r["confidence"] for r in got.collect()}


def ours(i, member="A000001", name="Anna Alder", ticker="BET", text="Beta Foods Ltd", op="Purchase", on=D, filed=FILED, amount="$1,001 - $15,000"):
    return (i, member, name, ticker, text, op, on, filed, amount, 8000.5)


def vendor(i, member="A000001", name="Anna Alder", ticker="BET", op="Buy", on=D, filed=FILED, size=1001.0):
    return (i, member, name, ticker, op, on, filed, size)


def test_ways_in_which_records_differ(spark):
    v = [
        vendor(1, member=" a-1", ticker="bet US"), vendor(2, member=None, name="ALDER, Annie", on=date(2020, 3, 11)), vendor(3, ticker="$OLD*", on=date(2021, 9, 3)), vendor(4, ticker=None, on=date(2020, 7, 1)),
        vendor(5, op="Sold"), vendor(6, on=date(2020, 4, 20), filed=date(2020, 5, 20)), vendor(7, member=None, name=None), vendor(8, member="B000002", name=None),
    ]
    o = [ours(1), ours(1), ours(2, ticker="ALP.A", text="Alpha Systems Inc", on=date(2021, 3, 9)), ours(3, ticker=None, text="Beta Foods Ltd - Common Stock", on=date(2020, 7, 1))]
    got = match(spark, v, o)
    assert {k for k, p in got.items() if k[0] == 1} == {(1, 1)}  # nearer in time than vendor 2, which then has no partner
    assert (3, 2) in got and (4, 3) in got and not {5, 6, 7, 8} & {k[0] for k in got}


def test_repeats_on_either_side(spark):
    got = match(spark, [vendor(1), vendor(2, filed=None, size=None)], [ours(1), ours(2, filed=date(2020, 9, 9))])
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and len(set(got.values())) == 1


def test_repeats_that_lost_something(spark):
    v = [vendor(1), vendor(2, on=None), vendor(3, op=None), vendor(4, ticker=None)]
    o = [ours(1), ours(2, on=None), ours(3, op=None), ours(4, on=None, amount="$500,001 - $1,000,000"), ours(5, ticker=None, text="Any County GO Bonds 5.0% due 2045"), ours(6, ticker=None, text=None)]
    got = match(spark, v, o)
    assert set(got) == set(itertools.product((1, 2, 3, 4), (1, 2, 3, 6)))
    # two dated classes that it could belong to: it joins neither
    got = match(spark, [vendor(1), vendor(2, on=date(2020, 3, 23)), vendor(3, on=None)], [ours(1), ours(2, on=date(2020, 3, 23))])
    assert {(1, 1), (2, 2)} <= set(got) and not {(1, 2), (2, 1)} & set(got) and len([x for x in got if x[0] == 3]) <= 1


def test_other_dates_of_what_was_filed_together(spark):
    far = date(2019, 11, 20)
    v = [vendor(1, on=FILED), vendor(2, member="B000002", name=None, on=far), vendor(3, member="C000003", name=None, on=date(2021, 3, 12), filed=None), vendor(4, ticker="OLD", on=far, size=60_000.0), vendor(5, ticker="ALP.A", op="Sell", on=far, filed=date(2020, 4, 20))]
    o = [ours(1), ours(2, member="B000002", name="Bert Birch"), ours(3, member="C000003", name="Bart Birch"), ours(4, ticker="ALP.A"), ours(5, ticker="ALP.A", op="Sale")]
    got = match(spark, v, o)
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and got[1, 1] > 0.9 > got[2, 2]


def test_nulls_and_empty_tables(spark):
    nothing, none = (1, *[None] * 7), (1, *[None] * 9)
    assert match(spark, [nothing], [none]) == {} and match(spark, [], [ours(1)]) == {} and match(spark, [vendor(1)], []) == {}


@pytest.mark.parametrize("edges", [[(1, 1, 2.0), (1, 2, 1.0)], [(1, 1, 2.0), (2, 1, 2.0), (2, 2, 0.5)], [(1, 1, 0.3), (5, 5, 3.0)]])
def test_marginals_of_trees_are_exact(spark, edges):
    df = spark.createDataFrame(edges, "i long, j long, score double")
    got = {(r["i"], r["j"]): r["p"] for r in propagate(df).collect()}
    total, each = 0.0, {(i, j): 0.0 for i, j, _ in edges}
    for n in range(len(edges) + 1):
        for some in itertools.combinations(edges, n):
            if len({i for i, _, _ in some}) == n == len({j for _, j, _ in some}):
                w = math.exp(sum(s for *_, s in some))
                total += w
                for i, j, _ in some:
                    each[i, j] += w
    assert all(abs(got[k] - w / total) < 1e-3 for k, w in each.items())


def test_names(spark):
    names = ["Hon. Anna Alder", "Alder, A.", "ANNIE ALDER Jr.", "Anna A1der", "Bert Birch", "B. Birch", "Nobody Else", "", "x" * 5000]
    got = {r["name"]: r["member"] for r in resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), members(spark)).collect()}
    assert {got.get(n) for n in names[:4]} == {"A000001"} and got["Bert Birch"] == "B000002" and not {"B. Birch", "Nobody Else", ""} & got.keys()
