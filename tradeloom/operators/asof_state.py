"""Attributes as known at event time.

Versions of an entity's attributes have a period of validity and a time at which they were recorded. A version can serve an
event only where it is valid on the event's day and was recorded by 00:00 of that day. The operator turns the versions of each
entity, ties resolved beforehand, into current-state versions ordered by availability: a step function saying from which
day on which version is the best eligible one (or none). An embedded DuckDB then answers all events of a bucket with one
ASOF LEFT JOIN against it.

Events and versions are hash-partitioned by (entity, span of days, salt): a hot entity is split by its spans, and further by
salts where a span alone is heavy. Versions are copied to each span that they touch and to each salt of a heavy entity. Buckets and
salts grow with the rows, so that a bucket stays small enough for one task's memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.heavy_keys import ROWS_PER_BUCKET, heavy_keys_and_rows, key_frame
from tradeloom.session import partitions

SPAN_DAYS = 1461
#: Spans beyond these days (1980 and 2060) fall together, so that far-off dates make no further copies.
FIRST_DAY, LAST_DAY = 3652, 32872
FOREVER = 2**31 - 1


def current_states(rows: Sequence[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int | None]]:
    """(day, version) for each day from which another version, or None, is the one in force.

    rows: (first day, end day, order of valid_from, order of recorded_at, version) of one entity. A sweep over the days with a
    heap of the open versions, in O(n log n).
    """
    opening = sorted(rows)
    days = sorted({d for r in rows for d in r[:2] if d < FOREVER})
    open_: list[tuple[int, int, int, int]] = []
    i, last = 0, None
    for day in days:
        while i < len(opening) and opening[i][0] <= day:
            _, end, a, b, version = opening[i]
            heapq.heappush(open_, (-a, -b, -version, end))
            i += 1
        while open_ and open_[0][3] <= day:
            heapq.heappop(open_)
        now = -open_[0][2] if open_ else None
        if now != last:
            yield day, now
            last = now


def _bucket(events: pa.Table, versions: pa.Table) -> pa.Table:
    import duckdb

    by_entity: dict[tuple, list] = {}
    for e, s, first, end, a, b, v in zip(*(versions[c].to_pylist() for c in ("entity", "span", "first", "until", "by_from", "by_recorded", "version"))):
        by_entity.setdefault((e, s), []).append((first, end, a, b, v))
    found = [(e, s, day, v) for (e, s), rows in by_entity.items() for day, v in current_states(rows)]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
    states = pa.table({n: pa.array([r[i] for r in found], type=t) for i, (n, t) in enumerate(zip(("entity", "span", "day", "version"), kinds))})
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})  # a bucket is small; nothing is spilled to the machine's disk
    try:
        con.register("events_in", events.select(["event", "entity", "span", "day"]))
        con.register("states_in", states)
        found = con.sql("SELECT e.event, s.version FROM events_in e ASOF LEFT JOIN states_in s ON e.entity = s.entity AND e.span = s.span AND e.day >= s.day")
        return found.to_arrow_table().cast(pa.schema([("event", pa.int64()), ("version", pa.int64())]))
    finally:
        con.close()


def versions_in_force(
    events: DataFrame,
    versions: DataFrame,
    event_id: str,
    event_entity: str,
    event_date: str,
    version_id: str,
    version_entity: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    recorded_at: str = "recorded_at",
    entity_key=None,
    share: float = 0.02,
    salts: int = 8,
) -> DataFrame:
    """(event_id, version_id) for every event with an entity and a date; version_id is null where no version was in force.

    Of the eligible versions the latest valid_from wins, then the latest recorded_at, then the largest version_id. entity_key:
    a function of a column that gives spellings of one entity the same value. Events with a null entity or date are left out;
    versions with a null entity, valid_from or recorded_at are never eligible; an end that is not after the start makes an
    empty period. Repeated events give a row each. Other columns of both tables play no part, whatever their names.
    """
    key = entity_key or (lambda c: c)
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    span = lambda c: F.floor(F.least(F.greatest(c, F.lit(FIRST_DAY)), F.lit(LAST_DAY)) / SPAN_DAYS).cast("int")
    e = events.select(F.col(event_id).cast("long").alias("event"), key(F.col(event_entity)).alias("entity"), day(event_date).alias("day"))
    e = e.where(F.col("entity").isNotNull() & F.col("day").isNotNull()).withColumn("span", span(F.col("day")))
    recorded = F.col(recorded_at).cast("timestamp_ntz")
    known = day(recorded_at) + (recorded > F.date_trunc("day", recorded)).cast("int")
    v = versions.select(
        F.col(version_id).cast("long").alias("version"), key(F.col(version_entity)).alias("entity"), F.greatest(day(valid_from), known).alias("first"),
        F.coalesce(day(valid_to), F.lit(FOREVER)).alias("until"), day(valid_from).alias("by_from"),
        F.unix_micros(recorded.cast("timestamp")).alias("by_recorded"), known.alias("known"),
    )
    v = v.where(F.col("entity").isNotNull() & F.col("by_from").isNotNull() & F.col("known").isNotNull() & (F.col("first") < F.col("until"))).drop("known")
    v = v.withColumn("span", F.explode(F.sequence(span(F.col("first")), span(F.col("until") - 1))))

    hot, n = heavy_keys_and_rows(e, "entity", share)
    buckets = max(4 * partitions(events.sparkSession), -(-(n + versions.count()) // ROWS_PER_BUCKET))
    salts = max(salts, -(-n // ROWS_PER_BUCKET))
    if hot:
        listed = F.broadcast(key_frame(e, "entity", hot))  # fewer than 1 / share rows
        e = e.join(listed, F.col("entity") == F.col("heavy_key"), "left")
        e = e.withColumn("salt", F.when(F.col("heavy_key").isNotNull(), F.pmod(F.xxhash64("event"), F.lit(salts))).otherwise(F.lit(0))).drop("heavy_key")
        v = v.join(listed, F.col("entity") == F.col("heavy_key"), "left")
        every = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda x: x.cast("long"))
        v = v.withColumn("salt", F.explode(F.when(F.col("heavy_key").isNotNull(), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("heavy_key")
    else:
        e, v = e.withColumn("salt", F.lit(0)), v.withColumn("salt", F.lit(0))
    place = F.pmod(F.xxhash64("entity", "span", "salt"), F.lit(buckets)).cast("int")
    e = e.select("event", "entity", "span", "day", place.alias("bucket"))
    v = v.select("version", "entity", "span", "first", "until", "by_from", "by_recorded", place.alias("bucket"))
    found = e.groupBy("bucket").cogroup(v.groupBy("bucket")).applyInArrow(_bucket, "event long, version long")
    return found.select(F.col("event").alias(event_id), F.col("version").alias(version_id))


def with_attributes(events: DataFrame, versions: DataFrame, event_id: str, version_id: str, attributes: Sequence[str], prefix: str = "asof_", **columns) -> DataFrame:
    """events, every row kept, with the attributes of the version in force under prefixed names (null where there is none).

    event_id must be unique. Arguments in columns go to versions_in_force.
    """
    found = versions_in_force(events, versions, event_id, version_id=version_id, **columns)
    found = found.select(F.col(event_id).alias("e__"), F.col(version_id).alias("v__"))
    side = versions.select(F.col(version_id).alias("w__"), *[F.col(c).alias(prefix + c) for c in attributes])
    found = found.join(side, F.col("v__") == F.col("w__"), "left").drop("w__")
    return events.join(found, F.col(event_id) == F.col("e__"), "left").drop("e__").withColumnRenamed("v__", prefix + version_id)
