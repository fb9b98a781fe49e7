"""Best representative of each duplicate group, field by field.

Records that copy each other imperfectly carry a group key; one aggregation over the records then takes, for each attribute, the
maximum of a composite struct (is there a value, trust of the source, time, record): the record that supplies the value and
the value itself come out together, with partial aggregation before the shuffle, so a group of any size is one small row per
task. Groups whose key was cut short merge with those of the whole key by the same maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.session import checkpointed

#: Words that say nothing, as letters and digits in lower case. Signs without a letter or digit count as well.
FILLERS = ("na", "nan", "none", "null", "nil", "unknown", "unk", "notavailable", "notapplicable", "missing", "tbd", "tba", "undefined", "blank", "empty")


def says_something(c: Column) -> Column:
    """Whether a text holds a value: not null, not blank, no filler word and no mere sign. Never null."""
    s = F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", "")
    return F.coalesce((s != "") & ~s.isin(*FILLERS), F.lit(False))


def filing_key(filing_id: Column, doc_url: Column) -> Column:
    """The document that a filing record is about, whatever way its id is spelt.

    Ids lose the name of the chamber, case, braces, blanks and separators; numbers lose leading zeros. A whole id counts first, then
    the document named by the url, then what is left of a shortened id ("s:" and its start). Null where neither says anything.
    """
    raw = F.when(says_something(filing_id), F.lower(filing_id))
    core = F.regexp_replace(F.regexp_replace(raw, r"^[^a-z0-9]*(house|senate)", ""), r"[^a-z0-9]+", "")
    senate = raw.contains("senate")
    number = lambda c: F.concat(F.lit("h:"), F.regexp_replace(c, r"^0+(?=\d)", ""))
    url = F.regexp_replace(F.regexp_extract(F.lower(doc_url), r"ptr/([0-9a-f-]+)", 1), "-", "")
    return F.coalesce(
        F.when(core.rlike(r"^[0-9a-f]{32}$"), F.concat(F.lit("u:"), core)),
        F.when(core.rlike(r"^\d+$") & ~senate, number(core)),
        F.when(url.rlike(r"^[0-9a-f]{32}$"), F.concat(F.lit("u:"), url)),
        F.when(url.rlike(r"^\d+$"), number(url)),
        F.when(core != "", F.concat(F.lit("s:"), core)),
    )


def whole_keys(keys: DataFrame, key: str) -> DataFrame | None:
    """(s__, w__): for each shortened key ("s:") the one whole key ("u:") that starts alike, or None if no key is shortened.

    A key may be cut anywhere. Where several whole keys start alike, the short one is left out: it can't be told whose it is. Whole keys give a
    prefix for each length that occurs among short ones (fewer than 32) and meet by equality; a prefix of many keys is one row after
    partial aggregation.
    """
    short = keys.where(F.col(key).startswith("s:") & (F.length(key) < 34)).select(F.col(key).alias("s__")).distinct()
    lengths = sorted(r[0] for r in short.select(F.length("s__") - 2).distinct().collect())  # 31 at most
    if not lengths:
        return None
    whole = keys.where(F.col(key).startswith("u:")).select(F.col(key).alias("w__"))
    starts = whole.select("w__", F.explode(F.array(*[F.concat(F.lit("s:"), F.substring("w__", 3, n)) for n in lengths])).alias("p__"))
    alone = starts.groupBy("p__").agg(F.min("w__").alias("w__"), F.max("w__").alias("x__")).where("w__ = x__")
    return short.join(alone, F.col("s__") == F.col("p__")).select("s__", "w__")


def survivors(
    records: DataFrame,
    key: Column,
    record_id: str,
    fields: Sequence[str],
    source: str,
    ingested_at: str,
    trust: DataFrame,
    trust_source: str = "source_id",
    trust_rank: str = "trust_rank",
    least: int = 2,
) -> DataFrame:
    """One row per group of at least `least` records: first_record, n_records and, per field, a struct (record, value).

    Of the group's records whose value says something, the smallest trust rank wins, then the latest ingested_at, then the smallest
    record id; both parts of the struct are null where no record has a value. Sources that trust lacks, and null sources, rank behind all
    others; a null ingested_at counts as the earliest. Records with a null key belong to no group and are left out. Repeated rows are
    records like any other. trust must hold one row per source; it is small and fixed, so Spark broadcasts it by its size.
    """
    ranks = trust.select(F.col(trust_source).alias("source__"), F.col(trust_rank).cast("int").alias("rank__"))
    chosen = records.select(
        key.alias("key__"), F.col(record_id).cast("long").alias("record__"), F.col(source).alias("of__"), F.col(ingested_at).alias("at__"),
        *[F.when(says_something(F.col(f)), F.col(f).cast("string")).alias(f"f__{i}") for i, f in enumerate(fields)],
    ).where("key__ IS NOT NULL")
    chosen = chosen.join(ranks, F.col("of__") == F.col("source__"), "left")
    rank = -F.coalesce("rank__", F.lit(2**31 - 1))

    def best(i: int) -> Column:
        c = F.col(f"f__{i}")
        return F.max(F.when(c.isNotNull(), F.struct(rank.alias("trust"), F.col("at__").alias("at"), (-F.col("record__")).alias("back"), c.alias("value"))))

    # keys are formed once, over the records; what shortened keys need is done on a row per key
    grouped = checkpointed(
        chosen.groupBy("key__").agg(F.min("record__").alias("first_record"), F.count(F.lit(1)).alias("n_records"), *[best(i).alias(f"b__{i}") for i in range(len(fields))])
    )
    whole = whole_keys(grouped, "key__")
    if whole is not None:
        grouped = grouped.join(whole, F.col("key__") == F.col("s__"), "left").withColumn("key__", F.coalesce("w__", "key__"))
        grouped = grouped.groupBy("key__").agg(F.min("first_record").alias("first_record"), F.sum("n_records").alias("n_records"), *[F.max(f"b__{i}").alias(f"b__{i}") for i in range(len(fields))])
    shown = [F.struct((-F.col(f"b__{i}.back")).alias("record"), F.col(f"b__{i}.value").alias("value")).alias(f) for i, f in enumerate(fields)]
    return grouped.where(F.col("n_records") >= least).select("first_record", "n_records", *shown)


def sources_of_fields(survivor: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(first_record, field_name, record, value) for each field of each group that has a value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.record").alias("record"), F.col(f"{f}.value").alias("value")) for f in fields]))
    return survivor.select("first_record", each.alias("x")).select("first_record", "x.*").where("record IS NOT NULL")
