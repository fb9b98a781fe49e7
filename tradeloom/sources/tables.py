"""Reading and writing of the tables of the pipeline: text CSV, indexes in XML, caches in JSON, references in YAML, partitioned Parquet."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S

CACHE = (
    "doc_id string, member string, model string, prompt_sha string, created_utc string, status string, batches array<struct<batch:int, pages:int, status:string, "
    "transactions:array<struct<asset_description:string, transaction_type:string, owner:string, transaction_date:string, notification_date:string, ticker:string, amount_code:string>>>>"
)
INDEX = "Last string, First string, FilingType string, StateDst string, Year string, FilingDate string, DocID string"


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Text columns only, no inference, with the file each row came from; several files are one table."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(paths, header=True, multiLine=True, escape='"').withColumn("file", F.input_file_name())


def read_index(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The filings of type P of an index in XML that were filed between two days, with their day."""
    raw = spark.read.format("xml").option("rowTag", "Member").schema(INDEX).load(path)
    day = F.try_to_date(F.col("FilingDate"), "M/d/yyyy")
    return raw.where(F.col("FilingType") == "P").withColumn("filed", day).where(F.col("filed").between(start, end))


def index_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Member").schema(INDEX).load(path).groupBy("FilingType").count()


def read_cache(spark: SparkSession, path: str, model: str | None = None, prompt_sha: str | None = None, lines: bool = True) -> DataFrame:
    """The transactions of a folder of cached answers, one to a line, or one to a file with lines=False."""
    return cache_transactions(spark.read.schema(CACHE).json(path, multiLine=not lines), model, prompt_sha)


def read_prices(spark: SparkSession, path: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """(ticker, date, close) of a folder per ticker (ticker=X) of CSV; a ticker without a folder has no rows, folders not asked for are not read."""
    x = spark.read.schema("date date, close double, ticker string").csv(path, header=True)
    x = x if tickers is None else x.where(F.col("ticker").isin(*tickers))
    return x.where("date IS NOT NULL AND close IS NOT NULL").select("ticker", "date", "close")


def read_factors(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """(date, factors) of a CSV of daily factors in per cent, as fractions; names: column of the file to name of the factor, in any order."""
    raw = spark.read.csv(path, header=True)
    day = F.coalesce(F.try_to_date(F.trim("date"), "yyyy-MM-dd"), F.try_to_date(F.trim("date"), "yyyyMMdd"))
    return raw.select(day.alias("date"), *[(F.trim(F.col(f"`{c}`")).try_cast("double") / 100).alias(n) for c, n in names.items()]).where("date IS NOT NULL")


def read_counts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, n): rows per plain name in JSON of another vendor's trades; rows without a name don't count."""
    x = spark.read.schema(f"{name} string").json(path).where(F.col(name).isNotNull())
    return x.groupBy(S.plain_name(F.col(name)).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def cache_transactions(cache: DataFrame, model: str | None = None, prompt_sha: str | None = None) -> DataFrame:
    """A row for each transaction of the finished batches, of one version of model and prompt where given."""
    x = cache if model is None else cache.where(F.col("model") == model)
    x = x if prompt_sha is None else x.where(F.col("prompt_sha") == prompt_sha)
    x = x.select("doc_id", "member", F.explode("batches").alias("b")).where("b.status = 'ok'")
    return x.select("doc_id", "member", "b.batch", F.posexplode("b.transactions").alias("pos", "t")).select("doc_id", "member", "batch", "pos", "t.*")


def envelope_rows(payload: Column, row: str) -> Column:
    """The rows of a vendor's answer, whether a bare list or under results, data or items; row is the schema of one."""
    under = F.from_json(payload, f"results array<{row}>, data array<{row}>, items array<{row}>")
    bare = F.from_json(payload, f"array<{row}>")
    return F.coalesce(F.when(F.trim(payload).startswith("["), bare), under["results"], under["data"], under["items"])


def first_column(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that the table has, null if none; not a value-wise choice."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(None).cast("string")


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(bioguide_id, first_name, last_name, chamber, party, state, district, start, end) of every term in a YAML of legislators, a small file or a folder of such.

    Without a YAML library only files that are JSON, or JSON after each dash, can be read.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # people are few
    try:
        import yaml

        people = yaml.safe_load(text) or []
    except ImportError:
        people = [json.loads(x[2:]) for x in text.splitlines() if x.startswith("- ")] if text.lstrip().startswith("-") else json.loads(text or "[]")
    rows = []
    for p in people:
        for t in p.get("terms", []):
            rows.append((p["id"]["bioguide"], p["name"].get("first"), p["name"].get("last"), t.get("type"), t.get("party"), t.get("state"), str(t.get("district") or ""), *[None if t.get(x) is None else str(t[x]) for x in ("start", "end")]))
    return spark.createDataFrame(rows, "bioguide_id string, first_name string, last_name string, chamber string, party string, state string, district string, start string, end string")


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet under one folder per value of by; overwriting replaces only the slices that df has."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def add_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column at the end, unchanged if it is there already."""
    return df if name in df.columns else df.withColumn(name, value)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown text; limit bounds what is brought to the driver, and a last line says so where there is more."""
    rows = df.limit(limit + 1).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    more = [f"(the first {limit} rows)"] if len(rows) > limit else []
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows[:limit]], *more])
