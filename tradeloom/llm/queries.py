"""Queries of this subpackage and the SQL that gives the same rows, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.ids import member_id
from tradeloom.llm import canonical, entities, mixture, nearest_time, subjects, survivorship, tokens
from tradeloom.session import table

FIELDS = ("filing_date", "filing_type", "full_name", "state", "n_trades")
TEN_DAYS = 864_000


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.match_trades(*(table(spark, sf_dir, t) for t in ("quiver_missing_trades", "disclosures", "members", "asset_reference")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("vendor_no", "txn_id")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_values(table(spark, sf_dir, "ocr_lines_2022"), "line_no", "asset_description", table(spark, sf_dir, "asset_reference"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("line_no", "asset_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "ocr_lines_2022").select("line_no", "asset_description")
    return _mapped(spark, sf_dir).where("asset_id = 0").join(lines, "line_no").select("line_no", "asset_description", "score")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = survivorship.filing_key(F.col("filing_id"), F.col("doc_url"))
    return survivorship.survivors(table(spark, sf_dir, "filing_records"), key, "record_no", FIELDS, "source_id", "ingested_at", table(spark, sf_dir, "source_trust"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivorship.sources_of_fields(_survivors(spark, sf_dir), FIELDS)
    return found.select(F.col("first_record").alias("first_record_no"), "field_name", F.col("record").alias("record_no"))


def p4_surviving_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select(F.col("first_record").alias("first_record_no"), "n_records", *[F.col(f"{f}.value").alias(f) for f in FIELDS])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_time.nearest_in_time(
        table(spark, sf_dir, "quiver_missing_trades"), table(spark, sf_dir, "ptr_index"), "vendor_no", "ptr_no", member_id(F.col("bioguideid")), member_id(F.col("bioguide_id")),
        F.col("traded"), F.col("received_at"), TEN_DAYS,
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, sf_dir, "documents")))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(mixture.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.emit_copies(p8_mixture(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_report(mixture.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subject_areas")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    by = _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))
    return by.crossJoin(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share_of_documents"), "words")  # n: one row


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_matches, p3_found, p3_unmatched, p4_found, p4_surviving_records, p5_found, p7_ids, p7_decoded, p8_mixture, p8_copies, p8_report, p9_found, p9_composition)}


_SAYS = "coalesce(regexp_replace(lower(CAST({0} AS VARCHAR)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') NOT IN ('', " + ", ".join(f"'{w}'" for w in survivorship.FILLERS) + "), false)"
_KEYED = f"""
WITH a AS (SELECT *, CASE WHEN {_SAYS.format("filing_id")} THEN lower(filing_id) END AS raw,
    replace(regexp_extract(lower(doc_url), 'ptr/([0-9a-f-]+)', 1), '-', '') AS url FROM filing_records),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '^[^a-z0-9]*(house|senate)', ''), '[^a-z0-9]+', '', 'g') AS core FROM a),
k AS (SELECT *, coalesce(
    CASE WHEN regexp_matches(core, '^[0-9a-f]{{32}}$') THEN 'u:' || core END,
    CASE WHEN regexp_matches(core, '^[0-9]+$') AND NOT contains(raw, 'senate') THEN 'h:' || ltrim(core, '0') END,
    CASE WHEN regexp_matches(url, '^[0-9a-f]{{32}}$') THEN 'u:' || url END,
    CASE WHEN regexp_matches(url, '^[0-9]+$') THEN 'h:' || ltrim(url, '0') END,
    CASE WHEN core <> '' THEN 's:' || core END) AS k0 FROM b),
h AS (SELECT s.k0 AS s, min(w.k0) AS w FROM (SELECT DISTINCT k0 FROM k WHERE k0 LIKE 's:%') s JOIN (SELECT DISTINCT k0 FROM k WHERE k0 LIKE 'u:%') w ON starts_with(w.k0, 'u:' || substr(s.k0, 3)) AND length(s.k0) < 34 GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT k.*, coalesce(h.w, k.k0) AS gk FROM k LEFT JOIN h ON h.s = k.k0),
g AS (SELECT * FROM (SELECT m.*, coalesce(t.trust_rank, 2147483647) AS rnk, min(record_no) OVER (PARTITION BY gk) AS first_record_no, count(*) OVER (PARTITION BY gk) AS n_records
    FROM m LEFT JOIN source_trust t USING (source_id) WHERE gk IS NOT NULL) WHERE n_records > 1)"""


def _best(field: str) -> str:
    return f"""SELECT first_record_no, '{field}' AS field_name, record_no, CAST({field} AS VARCHAR) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY gk ORDER BY rnk, ingested_at DESC NULLS LAST, record_no) AS rn FROM g WHERE {_SAYS.format(field)}) WHERE rn = 1"""


_ID = "regexp_replace(upper({0}), '[^A-Z0-9]+', '', 'g')"
_MEMBER = "CASE WHEN regexp_matches({0}, '^[A-Z][0-9O]{{1,6}}$') THEN left({0}, 1) || lpad(replace(substr({0}, 2), 'O', '0'), 6, '0') ELSE nullif({0}, '') END"


def oracle_sql() -> dict[str, str]:
    every = " UNION ALL ".join(_best(f) for f in FIELDS)
    return {
        "p4_found": f"{_KEYED} SELECT first_record_no, field_name, record_no FROM ({every})",
        "p4_surviving_records": f"""{_KEYED}, w AS ({every})
SELECT f.first_record_no, f.n_records, {", ".join(f"max(w.value) FILTER (w.field_name = '{x}') AS {x}" for x in FIELDS)}
FROM (SELECT DISTINCT first_record_no, n_records FROM g) f LEFT JOIN w USING (first_record_no) GROUP BY 1, 2""",
        "p7_decoded": "SELECT doc_id, text FROM documents",
        "p5_found": f"""
WITH v AS (SELECT vendor_no, {_MEMBER.format(_ID.format("bioguideid"))} AS m, CAST(traded AS TIMESTAMP) AS at FROM quiver_missing_trades),
r AS (SELECT ptr_no, {_MEMBER.format(_ID.format("bioguide_id"))} AS m, received_at FROM ptr_index)
SELECT vendor_no, ptr_no FROM (
  SELECT v.vendor_no, r.ptr_no, row_number() OVER (PARTITION BY v.vendor_no ORDER BY abs(epoch_us(r.received_at) - epoch_us(v.at)), r.received_at, r.ptr_no) AS rn
  FROM v JOIN r ON v.m = r.m AND abs(epoch_us(r.received_at) - epoch_us(v.at)) <= 864000000000) WHERE rn = 1""",
    }
