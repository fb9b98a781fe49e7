"""Data quality of the transaction table: coherence, delays, coverage, mixes, amounts and concentration.

Each report is one or two aggregations over the table, with the dimension as a grouping key instead of a loop over its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.operators.ranks import ranked

def N() -> Column:
    return F.count(F.lit(1))


def with_lag(df: DataFrame) -> DataFrame:
    """Adds lag_days and txn_year, and file_year as the year of the filing."""
    t, f = F.col("transaction_date"), F.col("disclosure_date")
    return df.withColumns({"lag_days": S.lag_days(t, f), "txn_year": F.year(t), "file_year": F.year(f)})


def date_coherence(df: DataFrame, by: str) -> DataFrame:
    lag, y = F.col("lag_days"), F.col("txn_year")
    return with_lag(df).groupBy(by).agg(
        N().alias("n"), F.count("lag_days").alias("dated"), F.count_if(lag >= 0).alias("coherent"), F.count_if(lag < 0).alias("incoherent"),
        F.count_if((y > F.col("file_year")) | (y < S.FIRST_YEAR)).alias("implausible_year"), F.count_if(lag.isNull()).alias("undated"),
    )


def delay_buckets(df: DataFrame, by: str) -> DataFrame:
    lag = F.col("lag_days")
    return with_lag(df).where("lag_days IS NOT NULL").groupBy(by).agg(
        N().alias("n"), F.count_if(lag.between(0, S.LEGAL_DELAY)).alias("legal"), F.count_if((lag > S.LEGAL_DELAY) & (lag <= S.WINDOW_DELAY)).alias("late"),
        F.count_if(lag > S.WINDOW_DELAY).alias("very_late"), F.count_if(lag < 0).alias("negative"), F.floor(F.median(F.when(lag >= 0, lag))).cast("long").alias("median_days"),
    )


def delay_outliers(df: DataFrame, over: int = 365, top: int = 15) -> DataFrame:
    """The filings that came last after their trade; ties go to the smaller txn_id."""
    return with_lag(df).where(F.col("lag_days") > over).orderBy(F.desc("lag_days"), "txn_id").limit(top).select("txn_id", "declarant_name", "lag_days", "ticker", "operation_type")


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation of a sample, extremes and exact quantiles with linear interpolation."""
    c = F.col(value)
    q = lambda p: F.percentile(c, F.lit(p))
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.mean(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"),
        q(0.9).alias("p90"), F.max(c).alias("max"),
    )


def top_by_volume(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k groups of the largest sum; ties go by key."""
    return df.groupBy(*keys).agg(F.sum(value).alias("volume"), F.count(value).alias("n_trades")).orderBy(F.desc_nulls_last("volume"), *keys).limit(k)


def coverage_per_member(df: DataFrame) -> DataFrame:
    """Per member and chamber: rows by channel, share of scans, documents, years with trades, and how the filer can be checked."""
    ocr = F.col("provenance").contains("ocr")
    out = with_lag(df).where("bioguide_id IS NOT NULL").groupBy("bioguide_id", "chamber").agg(
        N().alias("total"), F.count_if(ocr).alias("scanned"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("txn_year").alias("years"), F.min("txn_year").alias("first_year"),
        F.max("txn_year").alias("last_year"),
    )
    status = F.when(F.col("scanned") == 0, "electronic").when(F.col("scanned") == F.col("total"), "scanned_only").otherwise("mixed")
    return out.withColumns({"scanned_share": F.col("scanned") / F.col("total"), "status": status})


def eligible_members(coverage: DataFrame, least: int = 10, years: int = 3) -> DataFrame:
    enough = F.col("total") >= least
    return coverage.agg(N().alias("members"), F.count_if(enough).alias("eligible"), F.count_if(enough & (F.col("years") >= years)).alias("eligible_in_years"))


def mix(df: DataFrame, by: str, kind: Column, kinds: Sequence[str]) -> DataFrame:
    """Shares of the kinds per value of by, a column for each kind; one pass, no pivot over unknown values."""
    return df.withColumn("kind__", kind).groupBy(by).agg(N().alias("n"), *[(F.count_if(F.col("kind__") == k) / N()).alias(k) for k in kinds])


def fill_scorecard(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(N().alias("n"), *[F.avg(S.nonblank(F.col(c)).cast("int")).alias(c) for c in columns])


def amount_stats(df: DataFrame, by: str, value: str = "amount_midpoint") -> DataFrame:
    c = F.col(value)
    whole = lambda x: F.floor(x).cast("long")
    return df.groupBy(by).agg(
        N().alias("n"), whole(F.median(c)).alias("median"), whole(F.mean(c)).alias("mean"), *[whole(F.percentile(c, F.lit(p / 100))).alias(f"p{p}") for p in (25, 75, 95)],
        F.sum(c).alias("volume"),
    )


def top_k_per_group(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The k most frequent values per group, numbered; ties go to the smaller value."""
    counted = df.where(S.nonblank(F.col(value))).groupBy(by, value).agg(N().alias("count"))
    w = Window.partitionBy(by).orderBy(F.desc("count"), value)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_text(df: DataFrame, by: str, value: str, k: int = 3) -> DataFrame:
    """Per group one text, "X 20%, Y 14%", of its k most frequent values."""
    n = df.where(S.nonblank(F.col(value))).groupBy(by).agg(N().alias("total"))
    top = top_k_per_group(df, by, value, k).join(n, by)
    part = F.concat(F.col(value), F.lit(" "), F.bround(100 * F.col("count") / F.col("total"), 0).cast("int").cast("string"), F.lit("%"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"])  # k parts at most
    return top.groupBy(by).agg(F.array_join(listed, ", ").alias("top"))


def concentration(df: DataFrame, by: str, holder: str, value: str) -> DataFrame:
    """Per group over the holders' positive sums: how many, Herfindahl index, Gini coefficient and the ten largest's share."""
    v = df.where(F.col(holder).isNotNull()).groupBy(by, holder).agg(F.sum(value).alias("v")).where("v > 0")
    w = Window.partitionBy(by)
    v = v.withColumns({"total": F.sum("v").over(w), "i": F.row_number().over(w.orderBy("v", holder)), "down": F.row_number().over(w.orderBy(F.desc("v"), holder))})
    n = N()
    return v.groupBy(by).agg(
        n.alias("holders"), (F.sum((F.col("v") / F.col("total")) ** 2) * 10000).alias("hhi"),
        (2 * F.sum(F.col("i") * F.col("v")) / (n * F.sum("v")) - (n + 1) / n).alias("gini"), (F.sum(F.when(F.col("down") <= 10, F.col("v"))) / F.sum("v")).alias("top10_share"),
    )


def lorenz(df: DataFrame, holder: str, value: str) -> DataFrame:
    """The Lorenz curve of the holders' positive sums: share of holders and share of volume."""
    v = df.where(F.col(holder).isNotNull()).groupBy(holder).agg(F.sum(value).alias("v")).where("v > 0")
    total = v.agg(F.sum("v").alias("total"), N().alias("n"))
    v = ranked(v, [F.col("v"), F.col(holder)], "i", {"below": "v"}).crossJoin(F.broadcast(total))  # one row
    return v.select(holder, (F.col("i") / F.col("n")).alias("holders_share"), (F.col("below") / F.col("total")).alias("volume_share"))


TRANCHES = ((15000, "<=15k"), (50000, "15k-50k"), (250000, "50k-250k"), (1000000, "250k-1M"))


def tranche(c: Column) -> Column:
    """The tranche of an amount, closed on the right."""
    out = F.when(c.isNull() | (c < 0), F.lit(None))
    for bound, name in TRANCHES:
        out = out.when(c <= bound, name)
    return out.otherwise(">1M")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts of the bins of equal width from low to high; values outside are left out, high belongs to the last bin."""
    b = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(value.between(low, high)).groupBy(b.alias("bin")).agg(N().alias("n"))


def counted_in(df: DataFrame, by: str, domain: Sequence[str]) -> DataFrame:
    """(place, by, n, share) for each class of a fixed domain in its order, also those without rows; rows of no class of the domain count to the whole only."""
    known = df.sparkSession.createDataFrame(list(enumerate(domain)), f"place int, {by} string")
    n = df.groupBy(F.col(by).alias("k__")).agg(N().alias("n"))
    all_ = df.agg(N().alias("all__"))
    x = known.join(n, F.col(by) == F.col("k__"), "left").crossJoin(F.broadcast(all_))  # one row
    return x.select("place", by, F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("all__")).alias("share"))


def cluster_profile(df: DataFrame, cluster: Column, name: str, document: str, date_ok: Column, ticker: Column) -> DataFrame:
    """Per cluster of scans: rows, documents, and the share of rows with plausible dates and with a symbol."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.groupBy(cluster.alias(name)).agg(N().alias("n"), F.countDistinct(document).alias("documents"), share(date_ok).alias("plausible"), share(S.nonblank(ticker)).alias("with_ticker"))


def yields(df: DataFrame, by: str, column: str, kinds: Sequence[str]) -> DataFrame:
    """Shares of the kinds of a column per value of by; filled tells a column that is wholly blank, whose shares are null."""
    c = F.lower(F.trim(F.col(column)))
    any_ = F.max(S.nonblank(F.col(column)))
    return df.groupBy(by).agg(N().alias("n"), any_.alias("filled"), *[F.when(any_, F.count_if(c == k) / N()).alias(k) for k in kinds])


def covered_share(df: DataFrame, by: str, value: str, covered: Column) -> DataFrame:
    """(by, volume, covered): the sum of a value and the share of it in rows that are covered; null where the sum is none."""
    v = F.col(value)
    x = df.groupBy(by).agg(F.sum(v).alias("volume"), F.coalesce(F.sum(F.when(covered, v)), F.lit(0)).alias("c__"))
    return x.select(by, "volume", F.try_divide("c__", "volume").alias("covered"))


FUNNEL = ("a_dates", "b_sense", "c_asset", "d_size", "e_member")


def funnel_stage(df: DataFrame) -> DataFrame:
    """Adds stage: the first of the five checks that a row fails, null where it passes all."""
    x = with_lag(df)
    ok_dates = (F.col("lag_days") >= 0) & F.col("txn_year").between(S.FIRST_YEAR, F.col("file_year"))
    symbol = S.match_ticker(F.col("ticker"))
    ok_asset = (symbol != "") & ~S.untradeable(F.col("ticker")) & ~S.asset_bucket(F.col("asset_type")).isin("bond", "muni", "gov", "option", "other")
    checks = (ok_dates, S.op_class(F.col("operation_type")).isin("buy", "sell"), ok_asset, F.col("amount_midpoint") > 0, F.col("bioguide_id").isNotNull())
    stage = None
    for name, ok in zip(FUNNEL, checks):
        bad = ~F.coalesce(ok, F.lit(False))
        stage = F.when(bad, name) if stage is None else stage.when(bad, name)
    return x.withColumn("stage", stage)


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """Rows removed and left at each of the five stages, in one aggregation."""
    n = funnel_stage(df).agg(N().alias("all"), *[F.count_if(F.col("stage") == s).alias(s) for s in FUNNEL])
    left, rows = F.col("all"), []
    for i, s in enumerate(FUNNEL):
        left = left - F.col(s)
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("removed"), left.alias("remaining")))
    return n.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
