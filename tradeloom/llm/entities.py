"""Matching of records of two sources that share no identifier.

Repeats on either side first fall together into classes of records that say the same, or the same but for one thing that a repeat lacks. Classes meet through blocking keys (member, asset and a
span of days, with the ways in which a date goes wrong, or of filing days), and every candidate pair gets odds from how its attributes agree. A class on one side
can be at most one class on the other: loopy belief propagation with these one-to-one factors passes messages along the candidate pairs,
each round joining the messages at both ends, until they settle, and gives each pair its marginal probability. Pairs without a rival are settled
at once; only contested ones take part in the rounds. Matched classes then give all their records.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.ids import member_id
from tradeloom.llm.canonical import plain
from tradeloom.session import checkpointed

#: Log odds from which their estimation starts, by field and level; what the data don't show keeps them.
BASE = -2.0
START = {
    "date": {"unknown": 0.0, "off 0": 4.0, "off 1": 4.0, "off 2": 3.5, "off 3 to 5": 3.0, "swapped": 2.5, "year": 1.5, "about a year": 0.5, "as filed": -0.5, "other": -2.75},
    "filing": {"unknown": 0.0, "same": 3.0, "close": 2.5, "other": -1.5, "other, far": -4.0},
    "amount": {"unknown": 0.0, "fits": 1.0, "clashes": -2.0},
    "side": {"unknown": 0.0, "same": 1.0, "other": -6.0},
    "asset": {"same": 0.0, "open": -3.5},
    "named": {"id": 0.0, "name": -0.5},
}
#: Days by which a date may be inexact, and the width of the spans of days used as blocking keys.
SLACK, SPAN = 5, 8
#: Titles and suffixes of names.
TITLES = r"\b(hon|mr|mrs|ms|dr|sen|rep|jr|sr|ii|iii|iv)\b"


def direction(c: Column) -> Column:
    """b, s or e for the many wordings of purchase, sale and exchange; null for others."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike(r"^(p$|b$|buy|bought|purchase)"), "b").when(s.rlike(r"^(s$|sale|sell|sold|partial sale)"), "s").when(s.rlike(r"^(e$|exch)"), "e")


def symbol_key(c: Column) -> Column:
    """A symbol without exchange, country, option and punctuation: letters and digits in upper case; null if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^[A-Z]+:", ""), r"\s+(US|PUT|CALL)$", "")
    s = F.regexp_replace(s, r"[^A-Z0-9]+", "")
    return F.when(~s.isin("", "NAN", "NONE", "NA"), s)


def name_parts(c: Column) -> Column:
    """(first, last) of a name in any style, plain letters in lower case; digits read as the letters they stand for."""
    s = F.translate(plain(c), "015", "ols")
    turned = F.when(s.contains(","), F.concat_ws(" ", F.substring_index(s, ",", -1), F.substring_index(s, ",", 1))).otherwise(s)
    suffix = s.rlike(r",\s*(jr|sr|ii|iii|iv)\.?\s*$")
    ts = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.when(suffix, s).otherwise(turned), r"[^a-z]+", " "), TITLES, " "), r"\s+"), lambda x: x != "")
    return F.when(F.size(ts) >= 2, F.struct(F.get(ts, F.lit(0)).alias("first"), F.element_at(ts, -1).alias("last")))


def resolve_names(names: DataFrame, members: DataFrame) -> DataFrame:
    """(name, member) for the distinct names that mean exactly one member: by first name, nickname or initial with the last name, else with
    one of the two parts off by up to two letters, if a single member is nearest. Ambiguous and unknown names give no row."""
    m = members.select(member_id(F.col("bioguide_id")).alias("member"), plain(F.trim("first_name")).alias("f"), plain(F.trim("nickname")).alias("k"), plain(F.trim("last_name")).alias("l"))
    m = m.withColumn("l", F.element_at(F.split(F.regexp_replace("l", "[^a-z ]+", ""), " "), -1)).where("member IS NOT NULL AND l <> ''")
    calls = m.select("member", "l", F.explode(F.array_distinct(F.filter(F.array("f", "k", F.substring("f", 1, 1)), lambda x: x.isNotNull()))).alias("f")).distinct()
    n = names.select("name", name_parts(F.col("name")).alias("p")).where("p IS NOT NULL").select("name", "p.first", "p.last")
    straight = n.join(calls, (F.col("first") == F.col("f")) & (F.col("last") == F.col("l"))).select("name", "member", F.lit(0).alias("d"))
    by_first = n.where(F.length("first") > 1).join(calls, (F.col("first") == F.col("f")) & (F.abs(F.length("last") - F.length("l")) <= 2))
    by_first = by_first.select("name", "member", F.levenshtein("last", "l").alias("d"))
    by_last = n.join(calls.where(F.length("f") > 1), (F.col("last") == F.col("l")) & (F.abs(F.length("first") - F.length("f")) <= 2))
    by_last = by_last.select("name", "member", F.levenshtein("first", "f").alias("d"))
    near = by_first.unionByName(by_last).where("d BETWEEN 1 AND 2")
    best = straight.unionByName(near).groupBy("name", "member").agg(F.min("d").alias("d"))
    ranked = best.groupBy("name").agg(F.min(F.struct("d", "member")).alias("b"), F.collect_set(F.struct("d", "member")).alias("all"))
    alone = F.size(F.filter("all", lambda x: x["d"] == F.col("b.d"))) == 1
    return ranked.where(alone).select("name", F.col("b.member").alias("member"))


def _spread_nulls(key: Column, by: Column) -> Column:
    """A join key that no row of the other side has in place of null, else all rows without a key would meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\n"), F.xxhash64(by).cast("string")))


def with_member(rows: DataFrame, id_column: str, name_column: str, members: DataFrame) -> DataFrame:
    """rows with member and by_name: from the id however it is spelt, else from the name."""
    rows = rows.withColumn("own__", member_id(F.col(id_column)))
    asked = rows.where(F.col("own__").isNull() & F.col(name_column).isNotNull()).select(F.col(name_column).alias("name")).distinct()
    found = resolve_names(asked, members).select(F.col("name").alias("n__"), F.col("member").alias("m__"))
    lookup = _spread_nulls(F.when(F.col("own__").isNull(), F.col(name_column)), F.col(rows.columns[0]))
    rows = rows.join(found, lookup == F.col("n__"), "left")
    return rows.withColumn("member", F.coalesce("own__", "m__")).withColumn("by_name", F.col("own__").isNull()).drop("own__", "n__", "m__")


def asset_names(reference: DataFrame) -> DataFrame:
    """(alias, asset): current and former symbols and names of the listed assets, those that mean exactly one."""
    asset = symbol_key(F.col("ticker"))
    aliases = F.array(asset, symbol_key(F.col("former_ticker")), F.concat(F.lit("name:"), asset_phrase(F.col("canonical_name"))))
    each = reference.select(asset.alias("asset"), F.explode(aliases).alias("alias")).where("asset IS NOT NULL AND alias IS NOT NULL")
    return each.groupBy("alias").agg(F.min("asset").alias("asset"), F.max("asset").alias("other")).where("asset = other").drop("other")


def asset_phrase(c: Column) -> Column:
    """The name in a description, without symbol, kind of asset and common stock."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s*[\[(][^\])]*[\])]\s*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s-]+common stock$", ""), r"[^a-z0-9]+", " ")
    return F.trim(s)


def with_asset(rows: DataFrame, symbol: str, description: str | None, reference: DataFrame) -> DataFrame:
    """rows with asset: the symbol's current form; without a symbol that of the listed name or the symbol in the description."""
    known = asset_names(reference)
    own = symbol_key(F.col(symbol))
    alias = own
    if description is not None:
        code = symbol_key(F.regexp_extract(F.col(description), r"\(([A-Z][A-Z0-9.]{0,6})\)\s*$", 1))
        alias = F.coalesce(own, code, F.concat(F.lit("name:"), asset_phrase(F.col(description))))
    rows = rows.withColumn("a__", _spread_nulls(alias, F.col(rows.columns[0]))).join(known.select(F.col("alias").alias("k__"), F.col("asset").alias("c__")), F.col("a__") == F.col("k__"), "left")
    return rows.withColumn("asset", F.coalesce("c__", F.when(~F.col("a__").startswith("name:") & ~F.col("a__").startswith("\n"), F.col("a__")))).drop("a__", "k__", "c__")


def _days(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of rows (id, member, by_name, asset, side, day, filed, low, high) that say the same, and (class, id)."""
    undated = F.when(F.col("day").isNull(), F.struct("filed", "low", "high"))  # what an amended repeat changes tells undated rows only
    same = F.xxhash64("member", F.coalesce("asset", F.lit("")), F.coalesce("side", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit("")), undated)
    rows = _completed(rows.where("member IS NOT NULL").withColumn("class", same))
    classes = rows.groupBy("class").agg(
        F.first("member").alias("member"), F.max("asset").alias("asset"), F.max("side").alias("side"), F.max("day").alias("day"), F.min("by_name").alias("by_name"),
        F.collect_set("filed").alias("filed"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return classes, rows.select("class", "id")


def _completed(rows: DataFrame) -> DataFrame:
    """rows (with class) where one that lacks its day, side or asset, but no other of these, has the class of the complete rows that agree with it
    in the other two, member and filing day, if they are of a single class and no amount contradicts. unlisted marks rows without an asset whose description names another thing."""
    told = ("asset", "side", "day")
    lacking = F.concat(*[F.when(F.col(c).isNull(), F.lit(c)).otherwise("") for c in told])
    key = lambda c: F.xxhash64(F.lit(c), "member", "filed", *[x for x in told if x != c])
    open_ = lacking.isin(*told) & F.col("filed").isNotNull() & ~F.col("unlisted")
    full = rows.where((lacking == "") & F.col("filed").isNotNull())
    full = full.select(F.explode(F.array(*[key(c) for c in told])).alias("k__"), F.col("class").alias("c__"), F.col("low").alias("l__"), F.col("high").alias("h__"))
    full = full.groupBy("k__").agg(F.min("c__").alias("c__"), F.max("c__").alias("other__"), F.min("l__").alias("l__"), F.max("h__").alias("h__")).where("c__ = other__")
    part = rows.where(open_).withColumn("p__", F.coalesce(*[F.when(lacking == c, key(c)) for c in told]))
    clash = (F.col("low") > F.col("h__")) | (F.col("high") < F.col("l__"))
    part = part.join(full, F.col("p__") == F.col("k__"), "left")
    part = part.withColumn("class", F.when(F.col("c__").isNotNull() & ~F.coalesce(clash, F.lit(False)), F.col("c__")).otherwise(F.col("class")))
    return rows.where(~open_).unionByName(checkpointed(part.select(*rows.columns)))


def _swapped(day: Column) -> Column:
    """The day with day and month exchanged, null where that is no other date."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), day)
    return F.when((F.dayofmonth(d) <= 12) & (F.dayofmonth(d) != F.month(d)), _days(F.make_date(F.year(d), F.dayofmonth(d), F.month(d))))


def _year_off(day: Column, by: int) -> Column:
    return _days(F.add_months(F.date_add(F.lit("1970-01-01").cast("date"), day), 12 * by))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, date, filing, amount, side, asset, named) for the pairs of classes that some blocking key brings together: how they agree, level by level.

    Dated classes with an asset meet by member, asset and span of days, or of filing days. A class without an asset that has a day meets those of
    its member by filing day and span of days; without both it could match nothing, whatever else agreed.
    """
    span = lambda d: F.floor(d / F.lit(SPAN)).cast("int")
    key = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    no = F.lit(None).cast("long")
    day, dated = F.col("day"), F.col("day").isNotNull() & F.col("asset").isNotNull()
    at = lambda d: F.when(dated & d.isNotNull(), key("day", F.col("member"), F.col("asset"), span(d)))
    years = [_year_off(day, y) + b for y in (1, -1) for b in (-SLACK, 0, SLACK)]
    ways = [day - SLACK, day, day + SLACK, _swapped(day), *years]
    on = lambda f, d: key("filed", F.col("member"), f, span(d))
    filed = lambda days, by=(0,): F.flatten(F.transform("filed", lambda f: F.array(*[F.when(d.isNotNull(), on(f + b, d)) for b in by for d in days])))
    # whatever the days, records of one asset that were filed together meet
    together = lambda by=(0,): F.flatten(F.transform("filed", lambda f: F.array(*[key("together", F.col("member"), F.col("asset"), span(f + b)) for b in by])))
    none = F.array().cast("array<bigint>")
    listed, unfiled = F.col("asset").isNotNull(), F.size("filed") == 0
    # a year off without a filing day on either side; with one on both they meet through it
    left_keys = F.concat(
        F.array(at(day - SLACK), at(day), at(day + SLACK), at(_swapped(day))), F.when(unfiled, F.array(*[at(y) for y in years])).otherwise(none),
        F.when(listed, together((-2, 2))).otherwise(filed(ways, (-2, -1, 0, 1, 2))),
    )
    right_keys = F.concat(
        F.array(F.coalesce(at(day), no)), F.when(unfiled, F.array(at(_year_off(day, 1)), at(_year_off(day, -1)))).otherwise(none), filed([day]), F.when(listed, together()).otherwise(none)
    )
    tidy = lambda ks: F.explode(F.array_distinct(F.filter(ks, lambda k: k.isNotNull())))
    kept = lambda d, p, ks: d.select(
        tidy(ks).alias(f"{p}key"), F.col("class").alias(p), F.xxhash64("member").alias(f"{p}member"), F.when(F.col("asset").isNotNull(), F.xxhash64("asset")).alias(f"{p}asset"),
        *[F.col(c).alias(p + c) for c in ("side", "day", "by_name", "filed", "low", "high")],
    )
    p = kept(left, "i", left_keys).join(kept(right, "j", right_keys), F.col("ikey") == F.col("jkey"))
    both = F.col("iasset").isNotNull() & F.col("jasset").isNotNull()
    # a left record without an asset may mean any; a right one without a listed asset means none that the left names
    p = p.where((F.col("imember") == F.col("jmember")) & (F.col("iasset").isNull() | (F.col("iasset") == F.col("jasset"))))
    gap = F.abs(F.col("iday") - F.col("jday"))
    mid = _swapped(F.col("iday")) == F.col("jday")
    year = F.least(*[F.abs(_year_off(F.col("iday"), y) - F.col("jday")) for y in (1, -1)])
    as_filed = F.array_contains("ifiled", F.col("iday")) | F.array_contains("jfiled", F.col("jday"))  # the filing day written as the day of the trade
    date = F.when(gap.isNull(), "unknown").when(gap <= 1, F.concat(F.lit("off "), gap.cast("string"))).when(gap == 2, "off 2").when(gap <= SLACK, "off 3 to 5").when(mid, "swapped")
    date = date.when(year == 0, "year").when(year <= SLACK, "about a year").when(both & as_filed, "as filed").when(both, "other")
    lag = F.array_min(F.flatten(F.transform("ifiled", lambda a: F.transform("jfiled", lambda b: F.abs(a - b)))))
    filing = F.when(lag.isNull(), "unknown").when(lag == 0, "same").when(lag <= 2, "close").when(gap <= SLACK, "other").otherwise("other, far")
    fits = (F.col("ilow") <= F.col("jhigh")) & (F.col("ihigh") >= F.col("jlow"))
    amount = F.when(fits, "fits").when(fits.isNull(), "unknown").otherwise("clashes")
    side = F.when(F.col("iside") == F.col("jside"), "same").when(F.col("iside").isNull() | F.col("jside").isNull(), "unknown").otherwise("other")
    asset = F.when(both, "same").otherwise("open")
    named = F.when(F.col("iby_name") | F.col("jby_name"), "name").otherwise("id")
    levels = {"date": date, "filing": filing, "amount": amount, "side": side, "asset": asset, "named": named}
    return p.select("i", "j", *[c.alias(n) for n, c in levels.items()]).where("date IS NOT NULL").dropDuplicates(["i", "j"])


def log_odds(patterns: Sequence[tuple[tuple[str, ...], int]], rounds: int = 50, prior: float = 20.0) -> dict[str, dict[str, float]]:
    """Log odds of each level of each field, and under "base" those of a pair, by expectation maximisation over the counts of patterns of agreement.

    Fields are taken as independent given whether a pair is true. The start values stand for `prior` pairs of each kind, so a level that the
    data hardly show keeps about its start value; unknown says nothing.
    """
    names = list(START)
    odds = {"base": {"": BASE}, **{f: dict(START[f]) for f in names}}
    counts = np.array([n for _, n in patterns], float)
    if not counts.sum():
        return odds
    for _ in range(rounds):
        score = np.array([odds["base"][""] + sum(odds[f][v] for f, v in zip(names, p)) for p, _ in patterns])
        true = counts / (1 + np.exp(-score))
        new = {"base": {"": float(np.log((true.sum() + prior) / ((counts - true).sum() + prior)))}}
        for k, f in enumerate(names):
            known = np.array([p[k] != "unknown" for p, _ in patterns])
            m_all, u_all, new[f] = (true * known).sum(), ((counts - true) * known).sum(), {v: 0.0 for v in START[f] if v == "unknown"}
            for v in START[f]:
                if v == "unknown":
                    continue
                at = np.array([p[k] == v for p, _ in patterns])
                # the start value as prior: so many pairs, split between true and others as its odds say
                half = prior / (1 + np.exp(-START[f][v]))
                m, u = ((true * at).sum() + half) / (m_all + prior), (((counts - true) * at).sum() + prior - half) / (u_all + prior)
                new[f][v] = float(np.clip(np.log(m / u), -8, 8))
        settled = max(abs(new[f][v] - odds[f][v]) for f in new for v in new[f]) < 1e-6
        odds = new
        if settled:
            break
    return odds


def scored(pairs: DataFrame, hopeless: float = -4.0) -> DataFrame:
    """(i, j, score): the log odds of each pair by how it agrees, estimated from all pairs. Pairs below `hopeless`, which can't weigh on others, are left out."""
    found = pairs.groupBy(*START).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each pattern of levels: fewer than 5,000
    odds = log_odds([(tuple(r[f] for f in START), r["n"]) for r in sorted(found, key=str)])
    score = F.lit(odds["base"][""])
    for f in START:
        score = score + F.coalesce(*[F.when(F.col(f) == v, F.lit(w)) for v, w in odds[f].items()])
    return pairs.select("i", "j", score.alias("score")).where(F.col("score") > hopeless)


def propagate(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-4, damped_after: int = 10) -> DataFrame:
    """(i, j, p): marginal probabilities of the edges (i, j, score) when every node has at most one true edge.

    Messages are odds: a node tells an edge 1 / (1 + the sum over its other edges of their odds and the other end's message). score is the log
    odds of the edge on its own. In each round what comes in at a node is summed and joined back to its edges, first at one end, then at the
    other, and the round is checkpointed; later rounds go half the way, so that messages that swing settle. Rounds end when no message changes by more
    than the tolerance; if `rounds` pass before that, a warning says how far the last round moved.
    """
    e = edges.select("i", "j", F.exp(F.least("score", F.lit(20.0))).alias("r"))
    many = lambda c: e.groupBy(c).agg(F.count(F.lit(1)).alias(f"n{c}"))
    counted = checkpointed(e.join(many("i"), "i").join(many("j"), "j"))
    alone = (F.col("ni") == 1) & (F.col("nj") == 1)
    settled = counted.where(alone).select("i", "j", (F.col("r") / (1 + F.col("r"))).alias("p"))
    m = counted.where(~alone).select("i", "j", "r", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))

    def told(m: DataFrame, end: str, heard: str, says: str, share: float) -> DataFrame:
        came = m.groupBy(end).agg(F.sum(F.col("r") * F.col(heard)).alias("all__"))
        new = 1 / (1 + F.greatest(F.col("all__") - F.col("r") * F.col(heard), F.lit(0.0)))
        return m.join(came, end).withColumn(f"{says}2", share * new + (1 - share) * F.col(says)).drop("all__")

    moved = None
    for k in range(rounds):
        share = 1.0 if k < damped_after else 0.5
        n = told(told(m, "i", "b", "a", share), "j", "a2", "b", share)
        n = checkpointed(n.select("i", "j", "r", F.col("a2").alias("a"), F.col("b2").alias("b"), F.greatest(F.abs(F.col("a2") - F.col("a")), F.abs(F.col("b2") - F.col("b"))).alias("moved")))
        moved = n.agg(F.max("moved")).first()[0]
        m = n.drop("moved")
        if moved is None or moved <= tolerance:
            break
    else:
        warnings.warn(f"messages not settled after {rounds} rounds: the last moved by {moved}", stacklevel=2)
    odds = F.col("r") * F.col("a") * F.col("b")
    return settled.unionByName(m.select("i", "j", (odds / (1 + odds)).alias("p")))


def match_trades(vendor: DataFrame, ours: DataFrame, members: DataFrame, reference: DataFrame, least: float = 0.5) -> DataFrame:
    """(vendor_no, txn_id, confidence) for every pair of a vendor row and one of ours that describe the same trade, repeats included.

    Rows whose member neither id nor name tells match nothing. Missing dates, assets, amounts, filing dates and directions are no evidence either
    way. members and reference are small tables of names. Empty inputs give no rows; extra columns are ignored.
    """
    vendor = vendor.select("vendor_no", "bioguideid", "name", "ticker", "transaction", "traded", "filed", "trade_size_usd")
    ours = ours.select("txn_id", "bioguide_id", "declarant_name", "ticker", "asset_description", "operation_type", "transaction_date", "disclosure_date", "amount_range", "amount_midpoint")
    v = with_asset(with_member(vendor, "bioguideid", "name", members), "ticker", None, reference)
    size = F.col("trade_size_usd").cast("double")
    v = v.select(
        F.col("vendor_no").cast("long").alias("id"), "member", "by_name", "asset", direction(F.col("transaction")).alias("side"), _days(F.col("traded")).alias("day"),
        _days(F.col("filed")).alias("filed"), size.alias("low"), size.alias("high"), F.lit(False).alias("unlisted"),
    )
    d = with_asset(with_member(ours, "bioguide_id", "declarant_name", members), "ticker", "asset_description", reference)
    bounds = F.regexp_extract_all("amount_range", F.lit(r"\$([\d,]+)"), 1)
    bound = lambda i: F.regexp_replace(F.get(bounds, F.lit(i)), ",", "").cast("double")
    d = d.select(
        F.col("txn_id").cast("long").alias("id"), "member", "by_name", "asset", direction(F.col("operation_type")).alias("side"), _days(F.col("transaction_date")).alias("day"),
        _days(F.col("disclosure_date")).alias("filed"), F.coalesce(bound(0), F.col("amount_midpoint").cast("double")).alias("low"),
        F.coalesce(bound(1), F.when(bound(0).isNotNull(), F.lit(1e12)), F.col("amount_midpoint").cast("double")).alias("high"),
        (F.col("asset").isNull() & (F.coalesce(asset_phrase(F.col("asset_description")), F.lit("")) != "")).alias("unlisted"),
    )
    (vc, vi), (dc, di) = _classes(checkpointed(v)), _classes(checkpointed(d))
    p = propagate(checkpointed(scored(checkpointed(candidate_pairs(vc, dc))))).where(F.col("p") >= least)
    vi, di = vi.select(F.col("class").alias("i"), F.col("id").alias("vendor_no")), di.select(F.col("class").alias("j"), F.col("id").alias("txn_id"))
    return p.join(vi, "i").join(di, "j").select("vendor_no", "txn_id", F.col("p").alias("confidence"))
