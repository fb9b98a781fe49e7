"""Reconciliation of our transactions with a vendor's: keys at several grains, verdicts, agreement by field, and pairing one to one.

Membership in a set of keys is a join with the distinct keys, so no row is multiplied; dates compare null-safe (two missing dates agree), a
missing member or amount agrees with nothing.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.session import partitions

N = lambda: F.count(F.lit(1))
CLOSE_DAYS, PAIR_DAYS, FILING_DAYS = 10, 90, 3


def our_keys(df: DataFrame) -> DataFrame:
    """Adds member, tk, d, s and low to our transactions."""
    return df.withColumns({
        "member": F.col("bioguide_id"), "tk": S.match_ticker(F.col("ticker")), "d": F.col("transaction_date"), "s": S.match_sense(F.col("operation_type")),
        "low": S.amount_low(F.col("amount_range")), "ocr": F.coalesce(F.col("provenance").contains("ocr"), F.lit(False)),
    })


def vendor_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "member": F.col("bioguideid"), "tk": S.match_ticker(F.col("ticker")), "d": F.col("traded"), "s": S.match_sense(F.col("transaction")), "low": F.col("trade_size_usd"),
    })


def flagged(df: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with a flag: is there such a key among keys?"""
    other = keys.select(*[F.col(c).alias(f"{c}__") for c in columns]).distinct().withColumn(f"{name}__", F.lit(True))
    on = None
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"{c}__")) if c == "d" else F.col(c) == F.col(f"{c}__")
        on = same if on is None else on & same
    return df.join(other, on, "left").withColumn(name, F.coalesce(f"{name}__", F.lit(False))).drop(*[f"{c}__" for c in columns], f"{name}__")


def match_classes(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Our transactions with class: non_equity, exact_match, date_mismatch or no_match."""
    x = flagged(flagged(ours, vendor, ["member", "tk", "d", "s"], "exact"), vendor, ["member", "tk", "s"], "undated")
    return x.withColumn("class", F.when(F.col("tk") == "", "non_equity").when(F.col("exact"), "exact_match").when(F.col("undated"), "date_mismatch").otherwise("no_match"))


def match_breakdown(ours: DataFrame, vendor: DataFrame, by: Column, name: str) -> DataFrame:
    x = match_classes(ours, vendor).groupBy(by.alias(name)).agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("exact_match", "date_mismatch", "no_match", "non_equity")], N().alias("total"))
    had = F.col("exact_match") + F.col("date_mismatch")
    return x.withColumn("vendor_has", F.try_divide(had.cast("double"), had + F.col("no_match")))


def our_verdicts(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Our transactions with verdict: structural, ticker_gap, agreed, date_gap or ours_only."""
    x = flagged(flagged(flagged(ours, vendor, ["member", "tk", "d", "s"], "exact"), vendor, ["member", "tk", "s"], "undated"), vendor, ["member", "d", "s"], "untickered")
    stock = F.lower(F.trim(F.coalesce("asset_type", F.lit("")))) == "stock"
    v = F.when(F.col("tk") == "", F.when(stock & F.col("untickered"), "ticker_gap").otherwise("structural"))
    return x.withColumn("verdict", v.when(F.col("exact"), "agreed").when(F.col("undated"), "date_gap").when(F.col("untickered"), "ticker_gap").otherwise("ours_only"))


def common_members(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    return ours.select("member").where("member IS NOT NULL").distinct().join(vendor.select("member").distinct(), "member", "left_semi")


def vendor_verdicts(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """The vendor's distinct keys of common members that we lack, with verdict: date_gap, ticker_gap, unlisted, on_paper or missing."""
    keys = vendor.where("tk <> ''").select("member", "tk", "d", "s").distinct().join(common_members(ours, vendor), "member", "left_semi")
    x = flagged(keys, ours, ["member", "tk", "d", "s"], "exact").where(~F.col("exact"))
    x = flagged(flagged(flagged(x, ours, ["member", "tk", "s"], "undated"), ours, ["member", "d", "s"], "untickered"), ours.where("ocr"), ["member"], "paper")
    v = F.when(F.col("undated"), "date_gap").when(F.col("untickered"), "ticker_gap").when(S.untradeable(F.col("tk")), "unlisted").when(F.col("paper"), "on_paper").otherwise("missing")
    return x.select("member", "tk", "d", "s", v.alias("verdict"))


def reconcile_metrics(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """(metric, value): common members, keys of either side, matched and left over, and the coverage of the vendor's keys."""
    both = common_members(ours, vendor)
    key = ["member", "tk", "d", "s"]
    o = ours.where("tk <> ''").join(both, "member", "left_semi").select(*key).distinct().withColumn("o", F.lit(1))
    v = vendor.where("tk <> ''").join(both, "member", "left_semi").select(*key).distinct().withColumn("v", F.lit(1))
    sides = o.unionByName(v, allowMissingColumns=True).groupBy(*key).agg(F.max("o").alias("o"), F.max("v").alias("v"))
    n = sides.agg(F.count("o").alias("ours"), F.count("v").alias("vendor"), F.count_if(F.col("o").isNotNull() & F.col("v").isNotNull()).alias("matched"))
    n = n.crossJoin(F.broadcast(both.agg(N().alias("common_members"))))  # one row each
    only = {"only_vendor": F.col("vendor") - F.col("matched"), "only_ours": F.col("ours") - F.col("matched"), "coverage": F.try_divide(F.col("matched").cast("double"), F.col("vendor"))}
    names = ["common_members", "ours", "vendor", "matched", "only_vendor", "only_ours", "coverage"]
    n = n.withColumns(only).select(*[F.col(c).cast("double").alias(c) for c in names])
    return n.unpivot([], names, "metric", "value")


def scoped_metrics(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Matched keys and the coverage of the vendor's keys for each scope of ours: digital, ocr and both, in one pass."""
    key = ["member", "tk", "d", "s"]
    scopes = F.when(F.col("ocr"), F.array(F.lit("ocr"), F.lit("both"))).otherwise(F.array(F.lit("digital"), F.lit("both")))
    o = ours.where("tk <> '' AND member IS NOT NULL").select(*key, F.explode(scopes).alias("scope")).distinct()
    v = vendor.where("tk <> '' AND member IS NOT NULL").select(*key).distinct()
    total = v.agg(N().alias("vendor"))
    return flagged(o, v, key, "hit").groupBy("scope").agg(N().alias("ours"), F.count_if("hit").alias("matched")).crossJoin(F.broadcast(total)).withColumn("coverage", F.col("matched") / F.col("vendor"))


def field_agreement(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Over pairs of the same member, ticker and day, all multiplicities kept: share that agree on direction and on the lower bound."""
    o = ours.where("tk <> '' AND d IS NOT NULL").select("member", "tk", "d", "s", "low")
    v = vendor.where("tk <> '' AND d IS NOT NULL").select("member", "tk", "d", F.col("s").alias("vs"), F.col("low").alias("vlow"))
    j = o.join(v, ["member", "tk", "d"])
    return j.agg(N().alias("pairs"), F.avg((F.col("s") == F.col("vs")).cast("int")).alias("sense"), F.avg(F.coalesce(F.col("low") == F.col("vlow"), F.lit(False)).cast("int")).alias("amount"))


def date_agreement(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Over matched keys (member, ticker, direction): how many there are, and the share whose days of trade, and whose filing days, meet on both sides."""
    key = ["member", "tk", "s"]
    days = lambda x, d, f, p: x.where("tk <> '' AND member IS NOT NULL").groupBy(*key).agg(F.collect_set(d).alias(f"{p}d"), F.collect_set(f).alias(f"{p}f"))
    j = days(ours, "d", "disclosure_date", "o").join(days(vendor, "d", "filed", "v"), key)  # a key has no more days than the calendar
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return j.agg(N().alias("keys"), share(F.arrays_overlap("od", "vd")).alias("date_traded"), share(F.arrays_overlap("of", "vf")).alias("date_filed"))


def disagreements(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Our rows in cells (member, ticker, day) that the vendor has as well, with kind: agreed (direction and lower bound), amount or sense, and what the vendor has."""
    cell = ["member", "tk", "d"]
    o = ours.where("tk <> '' AND d IS NOT NULL AND member IS NOT NULL")
    v = vendor.where("tk <> '' AND d IS NOT NULL AND member IS NOT NULL").groupBy(*cell).agg(F.array_sort(F.collect_set("s")).alias("senses"), F.array_sort(F.collect_set(F.struct("s", "low"))).alias("pairs"))
    x = o.join(v, cell)
    agreed = F.exists("pairs", lambda p: (p["s"] == F.col("s")) & (p["low"] == F.col("low")))
    kind = F.when(F.coalesce(agreed, F.lit(False)), "agreed").when(F.array_contains("senses", F.col("s")), "amount").otherwise("sense")
    return x.select("txn_id", kind.alias("kind"), F.array_join("senses", ",").alias("vendor_senses"))


def document_drift(ours: DataFrame, baseline: DataFrame, document: str) -> DataFrame:
    """Per document the rows of either side and state: equal, superset (all of the baseline's and more), missing, added or drift (fewer)."""
    n = lambda x, name: x.where(F.col(document).isNotNull()).groupBy(document).agg(N().alias(name))
    j = n(ours, "ours").join(n(baseline, "baseline"), document, "full_outer").fillna(0, ["ours", "baseline"])
    a, b = F.col("ours"), F.col("baseline")
    return j.withColumn("state", F.when(a == b, "equal").when(b == 0, "added").when(a == 0, "missing").when(a > b, "superset").otherwise("drift"))


def cell_agreement(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per shared cell (member, ticker, day) whether the sets of directions meet, and the directions that either side has."""
    o = ours.where("tk <> ''").groupBy("member", "tk", "d").agg(F.array_sort(F.collect_set("s")).alias("ours"))  # few directions exist
    v = vendor.where("tk <> ''").groupBy(F.col("member").alias("vm"), F.col("tk").alias("vt"), F.col("d").alias("vd")).agg(F.array_sort(F.collect_set("s")).alias("vendor"))
    j = o.join(v, (F.col("member") == F.col("vm")) & (F.col("tk") == F.col("vt")) & F.col("d").eqNullSafe(F.col("vd")))
    return j.select("member", "tk", "d", F.array_join("ours", ",").alias("ours"), F.array_join("vendor", ",").alias("vendor"), F.arrays_overlap("ours", "vendor").alias("agree"))


def ticker_sets(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per common member the sizes of both sets of tickers, their overlap and differences, and the vendor's own ones as a list."""
    tagged = ours.where("tk <> ''").select("member", "tk", F.lit(1).alias("o")).unionByName(vendor.where("tk <> ''").select("member", "tk", F.lit(1).alias("v")), allowMissingColumns=True)
    each = tagged.join(common_members(ours, vendor), "member", "left_semi").groupBy("member", "tk").agg(F.max("o").alias("o"), F.max("v").alias("v"))
    both, alone = F.col("o").isNotNull() & F.col("v").isNotNull(), F.col("o").isNull()
    return each.groupBy("member").agg(
        F.count("o").alias("ours"), F.count("v").alias("vendor"), F.count_if(both).alias("shared"), F.count_if(F.col("v").isNull()).alias("ours_only"), F.count_if(alone).alias("vendor_only"),
        F.array_join(F.array_sort(F.collect_set(F.when(alone, F.col("tk")))), ",").alias("vendor_only_list"),
    )


def member_deltas(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per member rows of either side, their difference, our rows without ticker and from scans, and a verdict."""
    o = ours.where("member IS NOT NULL").groupBy("member").agg(N().alias("o"), F.count_if(F.col("tk") == "").alias("t"), F.count_if("ocr").alias("c"))
    v = vendor.where("member IS NOT NULL").groupBy("member").agg(N().alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    j = o.join(v, "member", "full_outer").select("member", zero("o").alias("ours"), zero("v").alias("vendor"), zero("t").alias("no_ticker"), zero("c").alias("ocr")).withColumn("delta", F.col("ours") - F.col("vendor"))
    return j.withColumn("verdict", F.when(F.col("vendor") == 0, "not_at_vendor").when(F.col("ours") == 0, "absent").when(F.col("delta") == 0, "equal").when(F.col("delta") > 0, "more").otherwise("fewer"))


def inclusion(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Per chamber the vendor's (member, ticker, direction) that we have, and why the rest is missing, the first reason that holds."""
    v = vendor.where("tk <> ''").withColumn("chamber", F.when(F.col("chamber").startswith("S"), "Senate").otherwise("House")).join(common_members(ours, vendor), "member", "left_semi")
    v = v.select("chamber", "member", "tk", "s").distinct()
    o = ours.where("tk <> ''")
    x = flagged(v, o, ["chamber", "member", "tk", "s"], "have")
    x = flagged(x, ours.where("ocr"), ["chamber", "member"], "paper")
    two = o.where(F.col("tk").contains(" ")).select("chamber", "member", F.explode(S.legs(F.col("tk"))).alias("tk"))
    x = flagged(x, two, ["chamber", "member", "tk"], "leg")
    other = ours.select(F.when(F.col("chamber") == "House", "Senate").otherwise("House").alias("chamber"), "member")
    x = flagged(x, other, ["chamber", "member"], "crossed")
    why = F.when(F.col("have"), "included").when(F.col("paper"), "on_paper").when(S.untradeable(F.col("tk")), "unlisted").when(F.col("leg"), "two_legs").when(F.col("crossed"), "other_chamber").otherwise("missing")
    kinds = ("included", "on_paper", "unlisted", "two_legs", "other_chamber", "missing")
    return x.withColumn("why", why).groupBy("chamber").agg(N().alias("vendor"), *[F.count_if(F.col("why") == k).alias(k) for k in kinds])


def nearest_signed(ours: DataFrame, vendor: DataFrame, days: int = 3) -> DataFrame:
    """For each of ours the vendor's nearest day of the same member, ticker and direction within `days`, the earlier on ties, and the difference.

    The days of the vendor are copied to the days around them, so the join is on equality.
    """
    v = vendor.where("tk <> '' AND d IS NOT NULL").select("member", "tk", "s", F.col("d").alias("vd")).distinct()
    v = v.select("*", F.explode(F.sequence(F.date_sub("vd", days), F.date_add("vd", days))).alias("d"))
    j = ours.where("tk <> ''").select("txn_id", "member", "tk", "s", "d").join(v, ["member", "tk", "s", "d"]).withColumn("delta", F.datediff("vd", "d"))
    near = j.groupBy("txn_id").agg(F.min(F.struct(F.abs("delta").alias("a"), F.col("delta").alias("delta"))).alias("m")).select("txn_id", F.col("m.delta").alias("delta"))
    return near.withColumn("status", F.when(F.col("delta") == 0, "same_day").when(F.col("delta") < 0, "vendor_earlier").otherwise("vendor_later"))


GROUP = ["member", "tk", "s"]


def one_to_one_exact(ours: DataFrame, vendor: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of equal day by multiplicity, (ours, vendor rows) left over on either side; the first rows of a day stay for later.

    n ours and m of the vendor's on one day make min(n, m) pairs; the last min(n, m) rows in order of id are paired.
    """
    o, v = ours.select(*GROUP, "d", F.col("txn_id").alias("id"), F.col("disclosure_date").alias("f")), vendor.select(*GROUP, "d", F.col("vendor_no").alias("id"), F.col("filed").alias("f"))
    o, v = o.where("tk <> '' AND d IS NOT NULL AND member IS NOT NULL"), v.where("tk <> '' AND d IS NOT NULL AND member IS NOT NULL")
    w = Window.partitionBy(*GROUP, "d").orderBy(F.desc("id"))
    o, v = o.withColumn("rn", F.row_number().over(w)), v.withColumn("rn", F.row_number().over(w))
    key = [*GROUP, "d", "rn"]
    pairs = o.join(v.select(*key, F.col("id").alias("vendor_no")), key).select(F.col("id").alias("txn_id"), "vendor_no")
    return pairs, o.join(v, key, "left_anti"), v.join(o, key, "left_anti")


def _root(up: list[int], i: int) -> int:
    """The end of a chain of links, which are shortened on the way."""
    end = i
    while up[end] != end:
        end = up[end]
    while up[i] != end:
        up[i], i = end, up[i]
    return end


def _greedy(ours: pd.DataFrame, vendor: pd.DataFrame) -> pd.DataFrame:
    """Pairs within each run of a bucket of many; rows come as numbers of days.

    Free rows of the vendor are found by bisection and by links over the taken ones to the next free row on either side, in near constant time.
    """
    sides: dict[tuple, tuple[list, list]] = {}
    for k, df in enumerate((ours, vendor)):
        for *key, d, i, f in zip(*(df[c].tolist() for c in (*GROUP, "run", "d", "id", "f"))):
            sides.setdefault(tuple(key), ([], []))[k].append((d, i, f))
    out = []
    for o, v in sides.values():
        o.sort(key=lambda x: x[:2])
        v.sort(key=lambda x: x[:2])
        days, n = [x[0] for x in v], len(v)
        after, before = list(range(n + 1)), list(range(n + 1))  # before[i + 1] stands for row i, 0 for none
        for d, i, f in o:
            at = bisect_left(days, d)
            right, left = _root(after, at), _root(before, at) - 1
            if left >= 0:
                left = _root(after, bisect_left(days, days[left]))  # the first free row of that day
            gaps = [(abs(d - days[x]), x) for x in (left, right) if 0 <= x < n]
            if not gaps or min(gaps)[0] > PAIR_DAYS:
                continue
            gap, x = min(gaps)
            after[x], before[x + 1] = x + 1, x
            _, j, g = v[x]
            out.append((i, j, gap, not (pd.isna(f) or pd.isna(g)) and abs(f - g) <= FILING_DAYS))
    return pd.DataFrame(out, columns=["txn_id", "vendor_no", "gap", "same_filing"])


def one_to_one(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """(txn_id, vendor_no, gap, same_filing, kind): each row at most once. Equal days first, then ours in order of day, each the nearest left.

    kind is exact, close (up to 10 days) or candidate (up to 90). A gap of more than 90 days without any row cuts a group, as no pair can span it, so
    a hot group is spread over many small tasks.
    """
    pairs, o, v = one_to_one_exact(ours, vendor)
    both = o.withColumn("side", F.lit(0)).unionByName(v.withColumn("side", F.lit(1)))
    epoch = F.lit("1970-01-01").cast("date")
    both = both.withColumns({"d": F.datediff("d", epoch), "f": F.datediff("f", epoch)})  # days as numbers: far-off years are days like others
    w = Window.partitionBy(*GROUP).orderBy("d", "side", "id")
    cut = (F.col("d") - F.lag("d").over(w) > PAIR_DAYS).cast("int")
    both = both.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sides = both.groupBy(*GROUP, "run").agg(F.countDistinct("side").alias("n")).where("n = 2").drop("n")
    both = both.join(sides, [*GROUP, "run"], "left_semi").select(*GROUP, "run", "d", "f", "id", "side")
    # many small runs share a task
    both = both.withColumn("bucket", F.pmod(F.xxhash64(*GROUP, "run"), F.lit(4 * partitions(ours.sparkSession))).cast("int"))
    left, right = both.where("side = 0").groupBy("bucket"), both.where("side = 1").toDF(*both.columns).groupBy("bucket")
    near = left.cogroup(right).applyInPandas(_greedy, "txn_id long, vendor_no long, gap int, same_filing boolean")
    near = near.withColumn("kind", F.when(F.col("gap") <= CLOSE_DAYS, "close").otherwise("candidate"))
    return pairs.select("txn_id", "vendor_no", F.lit(0).alias("gap"), F.lit(None).cast("boolean").alias("same_filing"), F.lit("exact").alias("kind")).unionByName(near)
