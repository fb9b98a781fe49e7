"""Operators along time: the next sale after a purchase, terms in force, committees by congress, and activity in a span of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def first_later(df: DataFrame, keys: list[str], date: str, is_event: Column, name: str) -> DataFrame:
    """Adds to every row the first date strictly after its own on which an event of the same keys falls.

    One window in order of the date, no self-join; rows with a null date or key get null.
    """
    w = Window.partitionBy(*keys).orderBy("day__").rangeBetween(1, Window.unboundedFollowing)
    known = F.col(date).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    later = F.min(F.when(is_event, F.col(date))).over(w)
    return df.withColumn("day__", _day(F.col(date))).withColumn(name, F.when(known, later)).drop("day__")


def purchases_with_exit(df: DataFrame) -> DataFrame:
    """Our purchases with sold: the first sale of the same member and ticker after them."""
    x = df.where("ticker IS NOT NULL AND bioguide_id IS NOT NULL AND transaction_date IS NOT NULL").withColumn("op", S.op_class(F.col("operation_type")))
    x = first_later(x.where("op IN ('buy', 'sell')"), ["bioguide_id", "ticker"], "transaction_date", F.col("op") == "sell", "sold")
    return x.where("op = 'buy'")


def purchase_outcome(df: DataFrame, by: str, days: int = 365) -> DataFrame:
    """What became of purchases: sold within the horizon, held to its end, or too recent to tell; rates over those that can be told."""
    buys = purchases_with_exit(df)
    end = df.agg(F.max("transaction_date").alias("window_end"))
    buys = buys.crossJoin(F.broadcast(end))  # one row
    due = F.date_add("transaction_date", days)
    state = F.when(F.col("sold") <= due, "sold").when(due > F.col("window_end"), "recent").otherwise("held")
    out = buys.withColumn("state", state).groupBy(by).agg(F.count(F.lit(1)).alias("buys"), *[F.count_if(F.col("state") == s).alias(s) for s in ("sold", "held", "recent")])
    return out.withColumn("sold_rate", F.try_divide(F.col("sold").cast("double"), F.col("sold") + F.col("held")))


def term_at(events: DataFrame, terms: DataFrame, event_id: str, entity: str, date: str, term_id: str, start: str, end: str) -> DataFrame:
    """(event_id, term_id): the first term that holds on the date, else the last that began before it, else the first of all.

    Both tables carry the entity under the same name. Ties go to the smaller term_id.
    """
    e = events.select(event_id, F.col(entity).alias("e__"), F.col(date).alias("at__")).where("e__ IS NOT NULL AND at__ IS NOT NULL")
    t = terms.select(F.col(entity).alias("e__"), F.col(term_id).alias("t__"), F.col(start).alias("s__"), F.col(end).alias("x__")).where("s__ IS NOT NULL")
    # an entity's days meet its terms, not its events: a hot entity has no more of them than the calendar
    j = e.select("e__", "at__").distinct().join(t, "e__")
    holds = (F.col("s__") <= F.col("at__")) & (F.col("x__").isNull() | (F.col("at__") < F.col("x__")))
    rank = F.when(holds, 0).when(F.col("s__") <= F.col("at__"), 1).otherwise(2)
    near = F.when(rank == 1, -_day(F.col("s__"))).otherwise(_day(F.col("s__")))
    best = j.groupBy("e__", "at__").agg(F.min(F.struct(rank.alias("r"), near.alias("n"), F.col("t__").alias("t"))).alias("b"))
    return e.join(best, ["e__", "at__"]).select(event_id, F.col("b.t").alias(term_id), F.col("b.r").alias("how"))


def active_at(events: DataFrame, periods: DataFrame, entity: str, date: str, start: str, end: str) -> DataFrame:
    """Events of entities with some period that holds on the date; open ends hold for ever."""
    p = periods.select(F.col(entity).alias("e__"), F.col(start).alias("s__"), F.col(end).alias("x__"))
    on = (F.col(entity) == F.col("e__")) & (F.col("s__").isNull() | (F.col(date) >= F.col("s__"))) & (F.col("x__").isNull() | (F.col(date) <= F.col("x__")))
    return events.join(p, on, "left_semi")


def key_flag_by_congress(df: DataFrame) -> DataFrame:
    """Per member and congress whether half or more of the rows with a flag are on a key committee."""
    x = df.where("bioguide_id IS NOT NULL AND transaction_date IS NOT NULL AND committees_key_flag IS NOT NULL")
    return x.groupBy("bioguide_id", S.congress_of(F.year("transaction_date")).alias("congress")).agg((F.avg(F.col("committees_key_flag").cast("int")) >= 0.5).alias("key_member"))


def committees_by_congress(df: DataFrame) -> DataFrame:
    """Per member and congress the committees stated on its last trade."""
    x = df.where("bioguide_id IS NOT NULL AND transaction_date IS NOT NULL AND committee_membership IS NOT NULL")
    last = F.max_by("committee_membership", F.struct("transaction_date", "txn_id"))
    return x.groupBy("bioguide_id", S.congress_of(F.year("transaction_date")).alias("congress")).agg(last.alias("committees"))


def distinct_in_span(df: DataFrame, group: str, date: str, counted: str, before: int, after: int, name: str) -> DataFrame:
    """Adds the number of distinct values of counted among the rows of the same group from `before` days before to `after` days after.

    A value is seen from `after` days before to `before` days after each of its days. These spans, merged where they touch, open and close on days; the
    running sum of openings less closings over a group's days is the number seen. No row carries a list, and what is ordered per group is at
    most its days.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(date).isNotNull()).select(F.col(group).alias("g__"), F.col(counted).alias("v__"), _day(F.col(date)).alias("n__"))
    each = Window.partitionBy("g__", "v__").orderBy("n__")
    seen = rows.where("v__ IS NOT NULL").distinct()
    opens = F.coalesce(F.col("n__") - after > F.lag("n__").over(each) + before + 1, F.lit(True)).cast("int")
    seen = seen.withColumn("opens", opens).withColumn("run", F.sum("opens").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    runs = seen.groupBy("g__", "v__", "run").agg((F.min("n__") - after).alias("a"), (F.max("n__") + before + 1).alias("z"))
    steps = runs.select("g__", F.explode(F.array(F.struct(F.col("a").alias("n__"), F.lit(1).alias("step")), F.struct(F.col("z").alias("n__"), F.lit(-1).alias("step")))).alias("s")).select("g__", "s.*")
    steps = steps.withColumn("asked", F.lit(0)).unionByName(rows.select("g__", "n__").distinct().select("g__", "n__", F.lit(0).alias("step"), F.lit(1).alias("asked")))
    days = steps.groupBy("g__", "n__").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    total = F.sum("step").over(Window.partitionBy("g__").orderBy("n__").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn(name, total.cast("int")).where("asked = 1").select("g__", F.date_add(F.lit("1970-01-01").cast("date"), F.col("n__")).alias("d__"), name)
    return df.join(days, (F.col(group) == F.col("g__")) & (F.col(date) == F.col("d__")), "left").drop("g__", "d__")


def with_trading_day(df: DataFrame, date: str, calendar: DataFrame, day: str = "date", name: str = "trading_day") -> DataFrame:
    """Adds the first day of the calendar on or after the date, however far; null after the last. The calendar's days are copied back over the gaps between them."""
    c = calendar.select(F.col(day).alias("c__")).where("c__ IS NOT NULL").distinct()
    dense = c.withColumn("prior__", F.lag("c__").over(Window.orderBy("c__"))).select(F.explode(F.sequence(F.coalesce(F.date_add("prior__", 1), F.col("c__")), F.col("c__"))).alias("d__"), F.col("c__").alias(name))
    x = df.crossJoin(F.broadcast(c.agg(F.min("c__").alias("first__")))).withColumn("at__", F.when(F.col(date).isNotNull(), F.greatest(date, "first__")))  # one row
    return x.join(dense, F.col("at__") == F.col("d__"), "left").drop("d__", "at__", "first__")
