"""Enrichment cascades: who filed, which symbol, which sector, each with the source that gave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.operators.dedup import mode_smallest


def name_keys(members: DataFrame) -> DataFrame:
    """(last, first, priority, bioguide_id): the names under which a member may file, the plainest first."""
    p = S.plain_name
    each = F.array(
        F.struct(F.lit(1).alias("priority"), p(F.col("first_name")).alias("first")), F.struct(F.lit(2).alias("priority"), p(F.col("nickname")).alias("first")),
        F.struct(F.lit(3).alias("priority"), p(F.col("middle_name")).alias("first")), F.struct(F.lit(4).alias("priority"), p(F.concat_ws(" ", "first_name", "middle_name")).alias("first")),
    )
    return members.select("bioguide_id", "chamber", p(F.col("last_name")).alias("last"), F.explode(each).alias("k")).select("bioguide_id", "chamber", "last", "k.*").where("first <> ''")


def match_filers(filers: DataFrame, members: DataFrame, filer_id: str, last: str, first: str, overrides: DataFrame | None = None) -> DataFrame:
    """(filer_id, bioguide_id, how): manual override, then first, nick, middle or both names with the last name, then a last name that is unique.

    A way that leads to several members decides nothing; filers whom no way tells give a row with nulls.
    """
    f = filers.select(F.col(filer_id).alias("id__"), S.plain_name(F.col(last)).alias("last"), S.plain_name(F.col(first)).alias("first"))
    keys = name_keys(members)
    by_name = f.join(keys, ["last", "first"]).select("id__", "bioguide_id", "priority")
    lone = members.groupBy(S.plain_name(F.col("last_name")).alias("last")).agg(F.count(F.lit(1)).alias("n"), F.min("bioguide_id").alias("bioguide_id")).where("n = 1")
    ways = by_name.unionByName(f.join(lone, "last").select("id__", "bioguide_id", F.lit(5).alias("priority")))
    if overrides is not None:
        ways = ways.unionByName(f.join(overrides.select(F.col(filer_id).alias("id__"), "bioguide_id"), "id__").select("id__", "bioguide_id", F.lit(0).alias("priority")))
    told = ways.groupBy("id__", "priority").agg(F.min("bioguide_id").alias("bioguide_id"), F.countDistinct("bioguide_id").alias("n")).where("n = 1")
    best = told.groupBy("id__").agg(F.min(F.struct("priority", "bioguide_id")).alias("b"))
    names = F.get(F.array(*[F.lit(x) for x in ("override", "first", "nickname", "middle", "both", "last")]), F.col("b.priority"))
    return filers.select(F.col(filer_id).alias("id__")).join(best, "id__", "left").select(F.col("id__").alias(filer_id), F.col("b.bioguide_id").alias("bioguide_id"), names.alias("how"))


def match_in_chamber(filers: DataFrame, members: DataFrame, filer_id: str, last: str, first: str, chamber: str) -> DataFrame:
    """(filer_id, bioguide_id) by last name: the filer's chamber before the other, then those whose first name starts alike in three letters; only if one is left."""
    f = filers.select(F.col(filer_id).alias("id__"), S.plain_name(F.col(last)).alias("l__"), S.plain_name(F.col(first)).alias("f__"), F.col(chamber).alias("c__"))
    m = members.select("bioguide_id", S.plain_name(F.col("last_name")).alias("l2"), S.plain_name(F.col("first_name")).alias("f2"), F.col("chamber").alias("c2"))
    w = Window.partitionBy("id__")
    x = f.join(m, F.col("l__") == F.col("l2")).withColumn("home", (F.col("c__") == F.col("c2")).cast("int"))
    x = x.withColumn("most", F.max("home").over(w)).where("home = most OR home IS NULL").withColumn("alike", (F.substring("f__", 1, 3) == F.substring("f2", 1, 3)).cast("int"))
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("n") == 1) | (F.col("alike") == 1))
    only = x.groupBy("id__").agg(F.min("bioguide_id").alias("bioguide_id"), F.countDistinct("bioguide_id").alias("n")).where("n = 1").drop("n")
    return filers.select(F.col(filer_id).alias("id__")).join(only, "id__", "left").withColumnRenamed("id__", filer_id)


def ticker_dictionary(df: DataFrame, description: str = "asset_description", ticker: str = "ticker") -> DataFrame:
    """(name, ticker): the most frequent symbol of each normalised description."""
    named = df.where(S.nonblank(F.col(ticker))).select(S.asset_name(F.col(description)).alias("name"), F.col(ticker).alias("t")).where("name <> ''")
    return mode_smallest(named, "name", "t").select("name", F.col("t_mode").alias("ticker"))


def resolve_tickers(lines: DataFrame, dictionary: DataFrame, line_id: str, description: str) -> DataFrame:
    """(line_id, ticker, source): the symbol stated in the text, else the whole text if it is one, else the dictionary's, else none."""
    d = dictionary.select(F.col("name").alias("n__"), F.col("ticker").alias("d__"))
    c = F.col(description)
    explicit, whole = S.explicit_ticker(c), S.name_is_ticker(c)
    x = lines.select(line_id, explicit.alias("e"), whole.alias("w"), F.nullif(S.asset_name(c), F.lit("")).alias("n")).join(d, F.col("n") == F.col("n__"), "left")
    source = F.when(F.col("e").isNotNull(), "explicit").when(F.col("w").isNotNull(), "asset_name").when(F.col("d__").isNotNull(), "dictionary").otherwise("none")
    return x.select(line_id, F.coalesce("e", "w", "d__").alias("ticker"), source.alias("source"))


def implied_source(ticker: Column, source: Column) -> Column:
    """The stated source, or explicit or none by whether there is a ticker."""
    return F.when(S.nonblank(source), source).when(S.nonblank(ticker), "explicit").otherwise("none")


def resolve_sectors(df: DataFrame, sectors: DataFrame, overrides: DataFrame, key: str = "ticker") -> DataFrame:
    """df with sector, fund and sector_from. An override counts even where it says null on purpose, so its presence is flagged, not its value."""
    s = sectors.select(F.col(key).alias("k1"), F.col("sector").alias("s1"))
    o = overrides.select(F.col(key).alias("k2"), F.col("sector").alias("s2"), F.lit(True).alias("has"))
    x = df.join(s, F.col(key) == F.col("k1"), "left").join(o, F.col(key) == F.col("k2"), "left")
    funds = F.create_map(*[F.lit(v) for kv in S.SECTOR_FUNDS.items() for v in kv])
    x = x.withColumn("sector", F.when(F.col("has"), F.col("s2")).otherwise(F.col("s1")))
    x = x.withColumn("sector_from", F.when(F.col("has"), "manual").when(F.col("s1").isNotNull(), "table").otherwise("none"))
    return x.withColumn("fund", F.try_element_at(funds, F.coalesce("sector", F.lit("")))).drop("k1", "s1", "k2", "s2", "has")


def fixed_dates(df: DataFrame, everywhere: DataFrame, scoped: DataFrame, date: str, document: str, ticker: str) -> DataFrame:
    """df with misread dates replaced: by document, ticker and date where such a fix is known, else by date alone. Both tables of fixes are small.

    everywhere: (wrong, right); scoped: (doc_id, ticker, wrong, right). Documents compare without a trailing .0.
    """
    doc = F.regexp_replace(F.col(document), r"\.0$", "")
    e = F.broadcast(everywhere.select(F.col("wrong").alias("w1"), F.col("right").alias("r1")))
    s = F.broadcast(scoped.select(F.col("doc_id").alias("d2"), F.col("ticker").alias("t2"), F.col("wrong").alias("w2"), F.col("right").alias("r2")))
    x = df.join(e, F.col(date) == F.col("w1"), "left").join(s, (doc == F.col("d2")) & (F.col(ticker) == F.col("t2")) & (F.col(date) == F.col("w2")), "left")
    return x.withColumn(date, F.coalesce("r2", "r1", date)).drop("w1", "r1", "d2", "t2", "w2", "r2")
