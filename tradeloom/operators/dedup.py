"""Keys and deduplication: natural keys, lots of one filing, and which of several copies is kept.

Every choice follows a total order, so results don't depend on how rows are laid out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATURAL_KEY = ("chamber", "declarant_name", "transaction_date", "asset_description", "operation_type", "amount_range", "owner")
#: How a missing field of the key is written; the others read as an empty text.
NULL_TOKENS = {"transaction_date": "nan"}


def natural_key(fields: Sequence[str] = NATURAL_KEY, null_tokens: Mapping[str, str] = NULL_TOKENS) -> Column:
    """SHA-256 of the fields joined by |; symbol and filing date are no part of it, so neither enrichment nor filing again changes it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit(null_tokens.get(f, ""))) for f in fields]), 256)


def with_occurrence(df: DataFrame, document: str, key: str, order: Sequence[str], name: str = "occurrence") -> DataFrame:
    """Numbers equal lots of one document from 0 in the given total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(document, key).orderBy(*order)) - 1)


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order; null keys are keys like others."""
    ranked = df.withColumn("rank__", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("rank__ = 1").drop("rank__")


def keep_latest(df: DataFrame, key: Sequence[str], date: str, ties: Sequence[str]) -> DataFrame:
    return keep_one(df, key, [F.col(date).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])


def keep_earliest(df: DataFrame, key: Sequence[str], date: str, ties: Sequence[str]) -> DataFrame:
    return keep_one(df, key, [F.col(date).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])


def dedup_summary(df: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """Rows, copies and unique keys by a dimension and in all (TOTAL); two partial aggregations, no distinct over the whole table."""
    per_key = df.groupBy(by, *key).agg(F.count(F.lit(1)).alias("n"))
    rolled = per_key.rollup(by).agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("unique_keys"), F.grouping(by).alias("all_"))
    return rolled.select(F.when(F.col("all_") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "raw", (F.col("raw") - F.col("unique_keys")).alias("copies"), "unique_keys")


def mode_smallest(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key, the smallest of several; nulls don't count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return keep_one(counted, [key], [F.col("n").desc(), F.col(value).asc()]).select(key, F.col(value).alias(f"{value}_mode"), "n")


def mode_first_seen(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The most frequent value per key, the one seen first of several."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("at"))
    return keep_one(counted, [key], [F.col("n").desc(), F.col("at").asc()]).select(key, F.col(value).alias(f"{value}_mode"), "n")


def first_wins(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The value of the first row of each key that has one."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, ordinal).alias(value))


def short_id(fields: Sequence[str], length: int = 24) -> Column:
    """A short hash over fields, nulls as empty texts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256), 1, length)


def replace_slices(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the slices that new recomputes, and new; columns are matched by name."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def conform(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly the given columns and types: others are dropped, missing ones null, values that don't fit null."""
    have = set(df.columns)
    return df.select(*[(F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])
