"""Incremental processing: windows over an event stream, copies within a bounded lateness, and reading only what a cache lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark on its time, which must be an instant for that; a table as it is."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per window and type; works on a stream, where rows later than `late` are left out, and on a table alike."""
    x = _timed(events, "ts", late)
    x = x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a pause of more than `gap`."""
    x = _timed(events, "ts", late)
    x = x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), "n")


def without_copies(stream: DataFrame, key: list[str], time: str, late: str = "75 days") -> DataFrame:
    """Rows whose key was not seen within the lateness; a table keeps one row of each key."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(key) if stream.isStreaming else stream.dropDuplicates(key)


def not_cached(backlog: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Documents that the cache doesn't hold, finished, under this version of prompt and model."""
    done = cache.where((F.col("version") == version) & (F.col("status") == "ok")).select("doc_id")
    return backlog.join(done, "doc_id", "left_anti")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; run again, it takes up only what is new."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_batches(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], slices: int = 64) -> None:
    """Keeps in path the first row of each key in the given order over all batches so far.

    The table lies in slices by a hash of the key. A batch is merged with the slices that its keys touch and only these are written anew, under the
    batch's number; the list of which number holds each slice is one small file per batch, written last, so a batch that fails or runs again leaves
    what was there. What no list names any more is removed. read_merged reads the table.
    """
    from tradeloom.operators.dedup import keep_one

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = _slices(spark, path, before=number)
        place = F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int")
        rows = batch.withColumn("slice__", place).persist()
        try:
            touched = sorted(r[0] for r in rows.select("slice__").distinct().collect())  # no more than slices
            old = [f"{path}/b{now[s]}/slice__={s}" for s in touched if s in now]
            both = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("slice__", place)) if old else rows
            kept = keep_one(both, [*key, "slice__"], [F.col(c).asc_nulls_last() for c in order])
            kept.repartition("slice__").write.mode("overwrite").partitionBy("slice__").parquet(f"{path}/b{number}")
        finally:
            rows.unpersist()
        listed = {**now, **{s: number for s in touched}}
        spark.createDataFrame(sorted(listed.items()), "slice int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list/{number}")
        for s in touched:  # the slice as it was two lists ago may still be read; older ones go
            if s in now and now[s] < number - 1:
                _remove(spark, f"{path}/b{now[s]}/slice__={s}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def _slices(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which batch's folder holds each slice, by the last finished list (before a batch number); empty if there is none."""
    fs, where = _files(spark, f"{path}/list")
    if not fs.exists(where):
        return {}
    done = [int(x.getPath().getName()) for x in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return {r["slice"]: r["batch"] for r in spark.read.parquet(f"{path}/list/{max(done)}").collect()} if done else {}


def read_merged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that merge_batches keeps in path."""
    now = _slices(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/b{b}/slice__={s}" for s, b in sorted(now.items())]) if now else spark.createDataFrame([], schema)


def run_totals(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there of an aggregated stream and gives the totals, of which each batch writes the whole to path."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    last: list[int] = []
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
