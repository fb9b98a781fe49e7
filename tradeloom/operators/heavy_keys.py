"""Per-key results when a handful of keys hold most records.

A sketch (one JVM aggregate over the key column) finds the keys above a share of all rows; there can be fewer than
1 / share of them, so their list is small whatever the input. Rows of those keys take the heavy way: they meet the
attributes by a broadcast join and are aggregated under a salt first. All other rows take the ordinary shuffle. The two
are disjoint and together whole, so the union needs no further merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """One aggregate that can be formed in two steps. kind: count (rows; source may be None), sum, min or max."""

    name: str
    kind: str
    source: str | None = None

    def first(self) -> Column:
        if self.kind == "count":
            return (F.count(F.lit(1)) if self.source is None else F.count(F.col(self.source))).alias(self.name)
        return getattr(F, self.kind)(F.col(self.source)).alias(self.name)

    def merge(self) -> Column:
        return (F.sum(self.name) if self.kind == "count" else getattr(F, self.kind)(self.name)).alias(self.name)


#: Rows that a task in Python should hold; buckets and salts are as many as that takes.
ROWS_PER_BUCKET = 500_000


def heavy_keys_and_rows(df: DataFrame, key: str, share: float = 0.01, tracked: int = 4096) -> tuple[list, int]:
    """Values of key (None for null) that hold more than about share of the rows, at most 1 / share + 1 of them, and the number of rows.

    The sketch is approximate; it only decides which way rows take, never what comes out.
    """
    k = min(tracked, max(2, int(1 / share)))
    top, n, nulls = (
        df.select(F.col(key).alias("k"))
        .agg(F.expr(f"approx_top_k(k, {k}, {tracked})"), F.count(F.lit(1)), F.count_if(F.col("k").isNull()))
        .first()
    )
    found = [r["item"] for r in top or [] if r["item"] is not None and r["count"] > share * n]
    return found + [None] * (nulls > share * n and nulls > 0), n


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, tracked: int = 4096) -> list:
    return heavy_keys_and_rows(df, key, share, tracked)[0]


def key_frame(df: DataFrame, key: str, values: list, name: str = "heavy_key") -> DataFrame:
    """The found keys as a one-column table, of the key's type."""
    return df.sparkSession.createDataFrame([(v,) for v in values], schema=f"{name} {df.schema[key].dataType.simpleString()}")


def aggregate_by_key(
    facts: DataFrame,
    key: str,
    measures: Sequence[Measure],
    attributes: DataFrame | None = None,
    attributes_key: str | None = None,
    keep: Sequence[str] = (),
    share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """One row per value of key with the measures and, where attributes is given, its columns named in keep.

    attributes must hold at most one row per key (a repeated key would repeat the group); keys that it lacks get nulls.
    Nulls in key form one group of their own. Extra columns of either table, also ones of the same name, are dropped at
    the start. Empty facts give an empty result. Sums ignore nulls and are null where all values are null.
    """
    inputs = sorted({m.source for m in measures if m.source} - {key})
    facts = facts.select(F.col(key).alias("k__"), *inputs)
    measures = [Measure(m.name, m.kind, "k__" if m.source == key else m.source) for m in measures]
    side = None
    if attributes is not None:
        side = attributes.select(F.col(attributes_key or key).alias("a__"), *[F.col(c).alias(f"a__{c}") for c in keep])

    hot = heavy_keys(facts, "k__", share)
    firsts, merges = [m.first() for m in measures], [m.merge() for m in measures]
    out = [F.col("k__").alias(key), *[m.name for m in measures], *([F.col(f"a__{c}").alias(c) for c in keep] if side is not None else [])]

    def joined(grouped: DataFrame, other: DataFrame | None) -> DataFrame:
        return grouped if other is None else grouped.join(other, F.col("k__") == F.col("a__"), "left")

    if not hot:
        return joined(facts.groupBy("k__").agg(*firsts), side).select(*out)
    listed = F.broadcast(key_frame(facts, "k__", hot))  # fewer than 1 / share + 2 rows
    same = F.col("k__").eqNullSafe(F.col("heavy_key"))
    light = joined(facts.join(listed, same, "left_anti").groupBy("k__").agg(*firsts), side)
    # The heavy keys' attributes are as few as the keys, given one row per key; they travel with the list.
    few = listed if side is None else F.broadcast(listed.join(side, F.col("heavy_key") == F.col("a__"), "left"))
    carried = [] if side is None else [f"a__{c}" for c in keep]
    heavy = (
        facts.join(few, same, "inner")
        .withColumn("salt__", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        .groupBy("k__", "salt__", *carried)
        .agg(*firsts)
        .groupBy("k__", *carried)
        .agg(*merges)
    )
    return light.select(*out).unionByName(heavy.select(*out))
