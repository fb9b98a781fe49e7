"""Queries on keys, copies and data quality, each with SQL that states the same rule independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.operators import dedup as D
from tradeloom.operators import quality as A
from tradeloom.operators.ranks import quantiles
from tradeloom.plans.registry import Registry
from tradeloom.session import table

query = Registry()


def _ours(spark, d):
    return table(spark, d, "disclosures")


_KEY = "sha256(concat_ws('|', coalesce(chamber, ''), coalesce(declarant_name, ''), coalesce(CAST(transaction_date AS VARCHAR), 'nan'), coalesce(asset_description, ''), coalesce(operation_type, ''), coalesce(amount_range, ''), coalesce(owner, '')))"
_LAG = "(SELECT *, date_diff('day', transaction_date, disclosure_date) AS lag_days, year(transaction_date) AS txn_year, year(disclosure_date) AS file_year FROM disclosures)"
_BUCKET = "CASE WHEN asset_type IS NULL OR trim(asset_type) = '' THEN 'missing' WHEN asset_type ILIKE '%option%' THEN 'option' WHEN asset_type ILIKE '%muni%' THEN 'muni' WHEN asset_type ILIKE '%gov%' OR asset_type ILIKE '%treasur%' THEN 'gov' WHEN asset_type ILIKE '%bond%' THEN 'bond' WHEN asset_type ILIKE '%fund%' OR asset_type ILIKE '%etf%' THEN 'fund' WHEN asset_type ILIKE '%stock%' THEN 'stock' ELSE 'other' END"


@query("natural_key", f"SELECT txn_id, {_KEY} AS key FROM disclosures")
def natural_key(spark, d):
    return _ours(spark, d).select("txn_id", D.natural_key().alias("key"))


@query("occurrence_index", f"SELECT txn_id, CAST(row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY txn_id) - 1 AS INTEGER) AS occurrence FROM disclosures")
def occurrence_index(spark, d):
    return D.with_occurrence(_ours(spark, d).withColumn("key", D.natural_key()), "doc_id", "key", ["txn_id"]).select("txn_id", "occurrence")


@query("dedup_latest", "SELECT txn_id FROM disclosures QUALIFY row_number() OVER (PARTITION BY natural_key_hash, occurrence_index ORDER BY disclosure_date DESC NULLS LAST, doc_id NULLS LAST, txn_id) = 1")
def dedup_latest(spark, d):
    return D.keep_latest(_ours(spark, d).select("txn_id", "natural_key_hash", "occurrence_index", "disclosure_date", "doc_id"), ["natural_key_hash", "occurrence_index"], "disclosure_date", ["doc_id", "txn_id"]).select("txn_id")


@query("dedup_earliest_year", "SELECT txn_id FROM disclosures QUALIFY row_number() OVER (PARTITION BY natural_key_hash, occurrence_index ORDER BY year(disclosure_date) ASC NULLS LAST, txn_id) = 1")
def dedup_earliest_year(spark, d):
    x = _ours(spark, d).select("txn_id", "natural_key_hash", "occurrence_index", F.year("disclosure_date").alias("y"))
    return D.keep_earliest(x, ["natural_key_hash", "occurrence_index"], "y", ["txn_id"]).select("txn_id")


@query("dedup_digital_first", "SELECT txn_id, provenance FROM disclosures QUALIFY row_number() OVER (PARTITION BY natural_key_hash, occurrence_index ORDER BY CASE WHEN provenance LIKE '%ocr%' THEN 1 ELSE 0 END, txn_id) = 1")
def dedup_digital_first(spark, d):
    x = _ours(spark, d).select("txn_id", "natural_key_hash", "occurrence_index", "provenance")
    return D.keep_one(x, ["natural_key_hash", "occurrence_index"], [F.coalesce(F.col("provenance").contains("ocr"), F.lit(False)).cast("int"), F.col("txn_id")]).select("txn_id", "provenance")


@query("scans_not_in_digital", "SELECT txn_id FROM disclosures s WHERE provenance LIKE '%ocr%' AND NOT EXISTS (SELECT 1 FROM disclosures e WHERE e.natural_key_hash = s.natural_key_hash AND e.provenance NOT LIKE '%ocr%')")
def scans_not_in_digital(spark, d):
    x = _ours(spark, d).select("txn_id", "natural_key_hash", "provenance")
    scans, rest = x.where(F.col("provenance").contains("ocr")), x.where(~F.col("provenance").contains("ocr"))
    return scans.join(rest, "natural_key_hash", "left_anti").select("txn_id")


@query("vendor_amendments", "SELECT vendor_no FROM quiver_missing_trades QUALIFY row_number() OVER (PARTITION BY bioguideid, ticker, traded, transaction ORDER BY filed DESC NULLS LAST, vendor_no) = 1")
def vendor_amendments(spark, d):
    return D.keep_latest(table(spark, d, "quiver_missing_trades"), ["bioguideid", "ticker", "traded", "transaction"], "filed", ["vendor_no"]).select("vendor_no")


@query("dedup_summary", """
SELECT coalesce(chamber, 'TOTAL') AS chamber, CAST(sum(n) AS BIGINT) AS raw, CAST(sum(n) - count(*) AS BIGINT) AS copies, count(*) AS unique_keys
FROM (SELECT chamber, natural_key_hash, occurrence_index, count(*) AS n FROM disclosures GROUP BY ALL) GROUP BY ROLLUP (chamber)""")
def dedup_summary(spark, d):
    return D.dedup_summary(_ours(spark, d), ["natural_key_hash", "occurrence_index"], "chamber")


@query("short_ids", "SELECT vendor_no, substr(sha256(concat_ws('|', coalesce(bioguideid, ''), coalesce(ticker, ''), coalesce(CAST(traded AS VARCHAR), ''), coalesce(transaction, ''), coalesce(CAST(filed AS VARCHAR), ''))), 1, 24) AS id FROM quiver_missing_trades")
def short_ids(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", D.short_id(["bioguideid", "ticker", "traded", "transaction", "filed"]).alias("id"))


@query("mode_smallest", "SELECT ticker, sector_gics AS sector_gics_mode, n FROM (SELECT ticker, sector_gics, count(*) AS n FROM disclosures WHERE sector_gics IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, sector_gics) = 1")
def mode_smallest(spark, d):
    return D.mode_smallest(_ours(spark, d), "ticker", "sector_gics")


@query("mode_first_seen", "SELECT bioguide_id, ticker AS ticker_mode, n FROM (SELECT bioguide_id, ticker, count(*) AS n, min(txn_id) AS seen FROM disclosures WHERE ticker IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY bioguide_id ORDER BY n DESC, seen) = 1")
def mode_first_seen(spark, d):
    return D.mode_first_seen(_ours(spark, d), "bioguide_id", "ticker", "txn_id")


@query("first_wins", "SELECT asset_description, arg_min(ticker, txn_id) AS ticker FROM disclosures WHERE ticker IS NOT NULL GROUP BY 1")
def first_wins(spark, d):
    return D.first_wins(_ours(spark, d), "asset_description", "ticker", "txn_id")


@query("replace_years", "SELECT txn_id, 'kept' AS state FROM disclosures WHERE year(disclosure_date) IS DISTINCT FROM 2022 UNION ALL SELECT txn_id, 'new' FROM disclosures WHERE year(disclosure_date) = 2022 AND provenance NOT LIKE '%ocr%'")
def replace_years(spark, d):
    x = _ours(spark, d).select("txn_id", "provenance", F.year("disclosure_date").alias("y"))
    new = x.where("y = 2022").where(~F.col("provenance").contains("ocr")).withColumn("state", F.lit("new"))
    return D.replace_slices(x.withColumn("state", F.lit("kept")), new, "y").select("txn_id", "state")


@query("conformed_union", """
SELECT txn_id AS row_no, 'ours' AS origin, bioguide_id, ticker, transaction_date AS traded, amount_midpoint AS size FROM disclosures
UNION ALL SELECT vendor_no, 'vendor', bioguideid, ticker, traded, trade_size_usd FROM quiver_missing_trades""")
def conformed_union(spark, d):
    shape = {"row_no": "long", "origin": "string", "bioguide_id": "string", "ticker": "string", "traded": "date", "size": "double"}
    ours = _ours(spark, d).withColumnsRenamed({"txn_id": "row_no", "transaction_date": "traded", "amount_midpoint": "size"}).withColumn("origin", F.lit("ours"))
    vendor = table(spark, d, "quiver_missing_trades").withColumnsRenamed({"vendor_no": "row_no", "bioguideid": "bioguide_id", "trade_size_usd": "size"}).withColumn("origin", F.lit("vendor"))
    return D.conform(ours, shape).unionByName(D.conform(vendor, shape))


@query("date_coherence", f"""
SELECT chamber, count(*) AS n, count(lag_days) AS dated, count_if(lag_days >= 0) AS coherent, count_if(lag_days < 0) AS incoherent, count_if(txn_year > file_year OR txn_year < 2012) AS implausible_year,
  count_if(lag_days IS NULL) AS undated FROM {_LAG} GROUP BY chamber""")
def date_coherence(spark, d):
    return A.date_coherence(_ours(spark, d), "chamber")


@query("delay_buckets", f"""
SELECT provenance, count(*) AS n, count_if(lag_days BETWEEN 0 AND 45) AS legal, count_if(lag_days > 45 AND lag_days <= 75) AS late, count_if(lag_days > 75) AS very_late, count_if(lag_days < 0) AS negative,
  CAST(floor(median(lag_days) FILTER (lag_days >= 0)) AS BIGINT) AS median_days FROM {_LAG} WHERE lag_days IS NOT NULL GROUP BY provenance""")
def delay_buckets(spark, d):
    return A.delay_buckets(_ours(spark, d), "provenance")


@query("delay_outliers", f"SELECT txn_id, declarant_name, lag_days, ticker, operation_type FROM {_LAG} WHERE lag_days > 365 ORDER BY lag_days DESC, txn_id LIMIT 15")
def delay_outliers(spark, d):
    return A.delay_outliers(_ours(spark, d))


@query("amount_distribution", """
SELECT chamber, count(amount_midpoint) AS n, avg(amount_midpoint) AS mean, stddev_samp(amount_midpoint) AS std, min(amount_midpoint) AS min, quantile_cont(amount_midpoint, 0.25) AS p25,
  quantile_cont(amount_midpoint, 0.5) AS p50, quantile_cont(amount_midpoint, 0.75) AS p75, quantile_cont(amount_midpoint, 0.9) AS p90, max(amount_midpoint) AS max FROM disclosures GROUP BY chamber""", "mean std p25 p50 p75 p90")
def amount_distribution(spark, d):
    return A.describe(_ours(spark, d), "amount_midpoint", ["chamber"])


@query("top_filers", "SELECT bioguide_id, chamber, sum(amount_midpoint) AS volume, count(amount_midpoint) AS n_trades FROM disclosures GROUP BY ALL ORDER BY volume DESC NULLS LAST, bioguide_id NULLS FIRST, chamber LIMIT 15")
def top_filers(spark, d):
    return A.top_by_volume(_ours(spark, d), ["bioguide_id", "chamber"], "amount_midpoint", 15)


@query("top_tickers", "SELECT ticker, sum(amount_midpoint) AS volume, count(amount_midpoint) AS n_trades FROM disclosures WHERE ticker IS NOT NULL GROUP BY ALL ORDER BY volume DESC NULLS LAST, ticker LIMIT 15")
def top_tickers(spark, d):
    return A.top_by_volume(_ours(spark, d).where(S.nonblank(F.col("ticker"))), ["ticker"], "amount_midpoint", 15)


@query("top_sectors", "SELECT sector_gics, sum(amount_midpoint) AS volume, count(amount_midpoint) AS n_trades FROM disclosures WHERE sector_gics IS NOT NULL GROUP BY ALL ORDER BY volume DESC NULLS LAST, sector_gics LIMIT 11")
def top_sectors(spark, d):
    return A.top_by_volume(_ours(spark, d).where(S.nonblank(F.col("sector_gics"))), ["sector_gics"], "amount_midpoint", 11)


_COVERAGE = f"""SELECT bioguide_id, chamber, count(*) AS total, count_if(provenance LIKE '%ocr%') AS scanned, count(DISTINCT doc_id) AS documents, count(DISTINCT txn_year) AS years, min(txn_year) AS first_year,
  max(txn_year) AS last_year, count_if(provenance LIKE '%ocr%') / count(*) AS scanned_share, CASE count_if(provenance LIKE '%ocr%') WHEN 0 THEN 'electronic' WHEN count(*) THEN 'scanned_only' ELSE 'mixed' END AS status
FROM {_LAG} WHERE bioguide_id IS NOT NULL GROUP BY bioguide_id, chamber"""


@query("coverage_per_member", _COVERAGE)
def coverage_per_member(spark, d):
    return A.coverage_per_member(_ours(spark, d))


@query("filer_status", f"SELECT status, count(*) AS filers, CAST(sum(total) AS BIGINT) AS total FROM ({_COVERAGE}) GROUP BY status")
def filer_status(spark, d):
    return A.coverage_per_member(_ours(spark, d)).groupBy("status").agg(A.N().alias("filers"), F.sum("total").alias("total"))


@query("eligible_members", f"SELECT count(*) AS members, count_if(total >= 10) AS eligible, count_if(total >= 10 AND years >= 3) AS eligible_in_years FROM ({_COVERAGE})")
def eligible_members(spark, d):
    return A.eligible_members(A.coverage_per_member(_ours(spark, d)))


@query("corpus_overview", "SELECT provenance, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM disclosures GROUP BY provenance")
def corpus_overview(spark, d):
    n = _ours(spark, d).groupBy("provenance").agg(A.N().alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("provenance", "n", (F.col("n") / F.col("all")).alias("share"))


@query("operation_mix", "SELECT provenance, count(*) AS n, count_if(operation_type ILIKE '%purchase%') / count(*) AS buy, count_if(operation_type ILIKE '%sale%') / count(*) AS sell, count_if(operation_type ILIKE '%exchange%') / count(*) AS exchange FROM disclosures GROUP BY provenance")
def operation_mix(spark, d):
    return A.mix(_ours(spark, d), "provenance", S.op_class(F.col("operation_type")), ["buy", "sell", "exchange"])


@query("owner_mix", """
SELECT provenance, count(*) AS n, count_if(o = 'self') / count(*) AS self, count_if(o = 'spouse') / count(*) AS spouse, count_if(o = 'joint') / count(*) AS joint, count_if(o = 'dependent') / count(*) AS dependent, count_if(o = 'other') / count(*) AS other
FROM (SELECT provenance, CASE WHEN s LIKE '%joint%' OR s = 'jt' THEN 'joint' WHEN s LIKE '%self%' THEN 'self' WHEN s LIKE '%spouse%' OR s = 'sp' THEN 'spouse' WHEN s LIKE '%dependent%' OR s LIKE '%child%' OR s = 'dc' THEN 'dependent' ELSE 'other' END AS o
  FROM (SELECT provenance, lower(trim(coalesce(owner, ''))) AS s FROM disclosures)) GROUP BY provenance""")
def owner_mix(spark, d):
    return A.mix(_ours(spark, d), "provenance", S.owner_class(F.col("owner")), ["self", "spouse", "joint", "dependent", "other"])


_KINDS = ["stock", "option", "gov", "muni", "bond", "fund", "other", "missing"]


@query("asset_mix", "SELECT provenance, count(*) AS n, " + ", ".join(f"count_if(b = '{k}') / count(*) AS {k}" for k in _KINDS) + f" FROM (SELECT provenance, {_BUCKET} AS b FROM disclosures) GROUP BY provenance")
def asset_mix(spark, d):
    return A.mix(_ours(spark, d), "provenance", S.asset_bucket(F.col("asset_type")), _KINDS)


@query("source_yield", "SELECT provenance, count(*) AS n, " + ", ".join(f"count_if(lower(trim(ticker_source)) = '{k}') / count(*) AS {k}" for k in ("explicit", "dictionary", "none")) + " FROM disclosures GROUP BY provenance")
def source_yield(spark, d):
    return A.mix(_ours(spark, d), "provenance", F.lower(F.trim("ticker_source")), ["explicit", "dictionary", "none"])


@query("fill_scorecard", "SELECT provenance, count(*) AS n, " + ", ".join(f"avg(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) NOT IN ('', 'nan') THEN 1 ELSE 0 END) AS {c}" for c in ("ticker", "sector_gics", "etf_proxy", "committee_membership", "bioguide_id", "years_in_office")) + " FROM disclosures GROUP BY provenance")
def fill_scorecard(spark, d):
    return A.fill_scorecard(_ours(spark, d), "provenance", ["ticker", "sector_gics", "etf_proxy", "committee_membership", "bioguide_id", "years_in_office"])


@query("amount_stats", """
SELECT provenance, count(*) AS n, CAST(floor(median(amount_midpoint)) AS BIGINT) AS median, CAST(floor(avg(amount_midpoint)) AS BIGINT) AS mean, CAST(floor(quantile_cont(amount_midpoint, 0.25)) AS BIGINT) AS p25,
  CAST(floor(quantile_cont(amount_midpoint, 0.75)) AS BIGINT) AS p75, CAST(floor(quantile_cont(amount_midpoint, 0.95)) AS BIGINT) AS p95, sum(amount_midpoint) AS volume FROM disclosures GROUP BY provenance""")
def amount_stats(spark, d):
    return A.amount_stats(_ours(spark, d), "provenance")


@query("sector_top3", """
WITH g AS (SELECT provenance, sector_gics, count(*) AS n FROM disclosures WHERE sector_gics IS NOT NULL GROUP BY provenance, sector_gics),
r AS (SELECT *, sum(n) OVER (PARTITION BY provenance) AS total, row_number() OVER (PARTITION BY provenance ORDER BY n DESC, sector_gics) AS rank FROM g)
SELECT provenance, string_agg(sector_gics || ' ' || CAST(round_even(100 * n / total, 0) AS INTEGER) || '%', ', ' ORDER BY rank) AS top FROM r WHERE rank <= 3 GROUP BY provenance""")
def sector_top3(spark, d):
    return A.top_k_text(_ours(spark, d), "provenance", "sector_gics")


@query("tickers_per_sector", "SELECT * FROM (SELECT sector_gics, ticker, n AS count, CAST(row_number() OVER (PARTITION BY sector_gics ORDER BY n DESC, ticker) AS INTEGER) AS rank FROM (SELECT sector_gics, ticker, count(*) AS n FROM disclosures WHERE ticker IS NOT NULL GROUP BY ALL)) WHERE rank <= 5")
def tickers_per_sector(spark, d):
    return A.top_k_per_group(_ours(spark, d), "sector_gics", "ticker", 5)


@query("concentration", """
WITH v AS (SELECT chamber, bioguide_id, sum(amount_midpoint) AS v FROM disclosures WHERE bioguide_id IS NOT NULL GROUP BY ALL HAVING sum(amount_midpoint) > 0),
r AS (SELECT *, sum(v) OVER (PARTITION BY chamber) AS t, row_number() OVER (PARTITION BY chamber ORDER BY v, bioguide_id) AS i, row_number() OVER (PARTITION BY chamber ORDER BY v DESC, bioguide_id) AS k FROM v)
SELECT chamber, count(*) AS holders, sum((v / t) ** 2) * 10000 AS hhi, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) AS gini, sum(v) FILTER (k <= 10) / sum(v) AS top10_share FROM r GROUP BY chamber""", "hhi gini top10_share")
def concentration(spark, d):
    return A.concentration(_ours(spark, d), "chamber", "bioguide_id", "amount_midpoint")


@query("lorenz", """
WITH v AS (SELECT bioguide_id, sum(amount_midpoint) AS v FROM disclosures WHERE bioguide_id IS NOT NULL GROUP BY ALL HAVING sum(amount_midpoint) > 0)
SELECT bioguide_id, row_number() OVER (ORDER BY v, bioguide_id) / count(*) OVER () AS holders_share, sum(v) OVER (ORDER BY v, bioguide_id ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS volume_share FROM v""", "volume_share")
def lorenz(spark, d):
    return A.lorenz(_ours(spark, d), "bioguide_id", "amount_midpoint")


@query("amount_tranches", """
SELECT chamber, CASE WHEN amount_midpoint IS NULL OR amount_midpoint < 0 THEN NULL WHEN amount_midpoint <= 15000 THEN '<=15k' WHEN amount_midpoint <= 50000 THEN '15k-50k' WHEN amount_midpoint <= 250000 THEN '50k-250k'
  WHEN amount_midpoint <= 1000000 THEN '250k-1M' ELSE '>1M' END AS tranche, count(*) AS n FROM disclosures GROUP BY ALL""")
def amount_tranches(spark, d):
    return _ours(spark, d).groupBy("chamber", A.tranche(F.col("amount_midpoint")).alias("tranche")).agg(A.N().alias("n"))


@query("lag_histogram", f"SELECT CAST(least(floor(lag_days / (200 / 60.0::DOUBLE)), 59) AS INTEGER) AS bin, count(*) AS n FROM {_LAG} WHERE lag_days BETWEEN 0 AND 200 GROUP BY bin")
def lag_histogram(spark, d):
    return A.histogram(A.with_lag(_ours(spark, d)), F.col("lag_days"), 0, 200, 60)


@query("amount_histogram", "SELECT CAST(least(floor((log10(amount_midpoint) - 3) / (5 / 40.0::DOUBLE)), 39) AS INTEGER) AS bin, count(*) AS n FROM disclosures WHERE amount_midpoint > 0 AND log10(amount_midpoint) BETWEEN 3 AND 8 GROUP BY bin")
def amount_histogram(spark, d):
    return A.histogram(_ours(spark, d).where("amount_midpoint > 0"), F.log10("amount_midpoint"), 3, 8, 40)


@query("year_by_chamber", "SELECT year(disclosure_date) AS year, count_if(chamber = 'House') AS house, count_if(chamber = 'Senate') AS senate FROM disclosures GROUP BY ALL")
def year_by_chamber(spark, d):
    return _ours(spark, d).groupBy(F.year("disclosure_date").alias("year")).agg(F.count_if(F.col("chamber") == "House").alias("house"), F.count_if(F.col("chamber") == "Senate").alias("senate"))


_FUNNEL = f"""SELECT txn_id, CASE WHEN NOT coalesce(lag_days >= 0 AND txn_year BETWEEN 2012 AND file_year, false) THEN 'a_dates' WHEN NOT (operation_type ILIKE '%purchase%' OR operation_type ILIKE '%sale%') THEN 'b_sense'
  WHEN ticker IS NULL OR upper(trim(ticker)) IN ('', 'NAN', 'NONE', '--') OR regexp_matches(upper(trim(ticker)), '[ :/$]|MATUR|WEEK|MONTH') OR length(replace(upper(trim(ticker)), '_', '')) > 5 OR {_BUCKET} IN ('bond', 'muni', 'gov', 'option', 'other') THEN 'c_asset'
  WHEN NOT coalesce(amount_midpoint > 0, false) THEN 'd_size' WHEN bioguide_id IS NULL THEN 'e_member' END AS stage FROM {_LAG}"""


@query("funnel_stages", _FUNNEL)
def funnel_stages(spark, d):
    return A.funnel_stage(_ours(spark, d)).select("txn_id", "stage")


@query("cleaning_funnel", f"""
WITH f AS ({_FUNNEL}), s AS (SELECT * FROM (VALUES (1, 'a_dates'), (2, 'b_sense'), (3, 'c_asset'), (4, 'd_size'), (5, 'e_member')) t(step, stage))
SELECT s.step, s.stage, (SELECT count(*) FROM f WHERE f.stage = s.stage) AS removed, (SELECT count(*) FROM f) - (SELECT count(*) FROM f JOIN s z USING (stage) WHERE z.step <= s.step) AS remaining FROM s""")
def cleaning_funnel(spark, d):
    return A.cleaning_funnel(_ours(spark, d))


@query("latency", f"SELECT median(lag_days) AS median, quantile_cont(lag_days, 0.9) AS p90, avg(CASE WHEN lag_days <= 45 THEN 1.0 ELSE 0 END) AS within_45 FROM {_LAG} WHERE lag_days >= 0 AND lag_days < 400", "median p90 within_45")
def latency(spark, d):
    lag = F.col("lag_days")
    x = A.with_lag(_ours(spark, d)).where((lag >= 0) & (lag < 400))
    return x.agg(F.median(lag).alias("median"), F.percentile(lag, F.lit(0.9)).alias("p90"), F.avg((lag <= 45).cast("int")).alias("within_45"))


@query("filing_census", "SELECT year(disclosure_date) AS year, filing_type, count(*) AS n, string_agg(DISTINCT last_name, '; ' ORDER BY last_name) AS filers FROM ptr_index GROUP BY ALL")
def filing_census(spark, d):
    by = table(spark, d, "ptr_index").groupBy(F.year("disclosure_date").alias("year"), "filing_type")
    return by.agg(A.N().alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("last_name")), "; "), F.lit("")).alias("filers"))  # one entry per member


@query("committee_join", "SELECT bioguide_id, array_to_string(list_sort(list_distinct(string_split(committee_membership, '; '))), '; ') AS committees FROM members")
def committee_join(spark, d):
    return table(spark, d, "members").select("bioguide_id", F.array_join(F.array_sort(F.array_distinct(F.split("committee_membership", "; "))), "; ").alias("committees"))


@query("approximate_counts", "SELECT chamber, count(DISTINCT ticker) AS tickers, quantile_disc(amount_midpoint, 0.5) AS median, 1 AS close FROM disclosures GROUP BY chamber")
def approximate_counts(spark, d):
    """Exact values, and whether the sketches come within their bounds of them."""
    exact, fast, c = F.countDistinct("ticker"), F.approx_count_distinct("ticker", 0.02), F.col("amount_midpoint")
    x = _ours(spark, d).groupBy("chamber").agg(exact.alias("tickers"), fast.alias("fast"), F.percentile_approx(c, 0.5, 10_000_000).alias("median"), F.approx_percentile(c, [0.45, 0.55], 1000).alias("rough"))
    near = (F.abs(F.col("tickers") - F.col("fast")) <= 0.1 * F.col("tickers")) & (F.col("rough")[0] <= F.col("median")) & (F.col("median") <= F.col("rough")[1])
    return x.select("chamber", "tickers", "median", near.cast("int").alias("close"))


@query("counted_in", "WITH k AS (SELECT * FROM (VALUES (0, 'self'), (1, 'joint'), (2, 'spouse'), (3, 'dependent'), (4, 'trust')) t(place, class)), o AS (SELECT CASE WHEN s LIKE '%joint%' OR s = 'jt' THEN 'joint' WHEN s LIKE '%self%' THEN 'self' WHEN s LIKE '%spouse%' OR s = 'sp' THEN 'spouse' WHEN s LIKE '%dependent%' OR s LIKE '%child%' OR s = 'dc' THEN 'dependent' ELSE 'other' END AS class FROM (SELECT lower(trim(coalesce(owner, ''))) AS s FROM disclosures)) SELECT place, k.class, count(o.class) AS n, 100.0::DOUBLE * count(o.class) / (SELECT count(*) FROM o) AS share FROM k LEFT JOIN o ON o.class = k.class GROUP BY ALL", "share")
def counted_in(spark, d):
    return A.counted_in(_ours(spark, d).select(S.owner_class(F.col("owner")).alias("class")), "class", ["self", "joint", "spouse", "dependent", "trust"])


@query("source_yields", "SELECT chamber, count(*) AS n, max(trim(coalesce(x, '')) NOT IN ('', 'nan')) AS filled, " + ", ".join(f"CASE WHEN max(trim(coalesce(x, '')) NOT IN ('', 'nan')) THEN count_if(lower(trim(x)) = '{k}') / count(*) END AS {k}" for k in ("explicit", "dictionary", "none")) + " FROM (SELECT chamber, CASE WHEN chamber = 'House' THEN ticker_source END AS x FROM disclosures) GROUP BY chamber")
def source_yields(spark, d):
    """The Senate's column is wholly blank here, which is told apart from shares of nothing."""
    x = _ours(spark, d).select("chamber", F.when(F.col("chamber") == "House", F.col("ticker_source")).alias("x"))
    return A.yields(x, "chamber", "x", ["explicit", "dictionary", "none"])


_CENSUS = "(SELECT doc_id, CASE CAST(min(ptr_no) AS BIGINT) % 3 WHEN 0 THEN 'typed' WHEN 1 THEN 'turned' ELSE 'handwritten' END AS cluster FROM ptr_index WHERE doc_id IS NOT NULL GROUP BY doc_id)"


def _census(spark, d):
    kind = F.when(F.min("ptr_no") % 3 == 0, "typed").when(F.min("ptr_no") % 3 == 1, "turned").otherwise("handwritten")
    return table(spark, d, "ptr_index").where("doc_id IS NOT NULL").groupBy("doc_id").agg(kind.alias("cluster"))


@query("scan_clusters", f"SELECT txn_id, cluster FROM (SELECT txn_id, doc_id FROM disclosures WHERE provenance LIKE '%ocr%') LEFT JOIN {_CENSUS} USING (doc_id)")
def scan_clusters(spark, d):
    return _ours(spark, d).where(F.col("provenance").contains("ocr")).select("txn_id", "doc_id").join(_census(spark, d), "doc_id", "left").select("txn_id", "cluster")


@query("cluster_profile", f"SELECT cluster, count(*) AS n, count(DISTINCT doc_id) AS documents, avg((lower(trim(coalesce(date_confidence, ''))) = 'plausible')::INT) AS plausible, avg((trim(coalesce(ticker, '')) NOT IN ('', 'nan'))::INT) AS with_ticker FROM disclosures JOIN {_CENSUS} USING (doc_id) WHERE provenance LIKE '%ocr%' GROUP BY cluster")
def cluster_profile(spark, d):
    x = _ours(spark, d).where(F.col("provenance").contains("ocr")).join(_census(spark, d), "doc_id")
    return A.cluster_profile(x, F.col("cluster"), "cluster", "doc_id", F.lower(F.trim("date_confidence")) == "plausible", F.col("ticker"))


@query("prompt_filings", "SELECT txn_id, disclosure_date AS signal_date FROM disclosures WHERE date_diff('day', transaction_date, disclosure_date) BETWEEN 0 AND 10")
def prompt_filings(spark, d):
    """The day on which a trade became known, for those filed within ten days."""
    return A.with_lag(_ours(spark, d)).where("lag_days BETWEEN 0 AND 10").select("txn_id", F.col("disclosure_date").alias("signal_date"))


@query("filed_in_year", "SELECT txn_id FROM disclosures WHERE year(disclosure_date) = 2021")
def filed_in_year(spark, d):
    """The year as a range of days, which reaches the scan."""
    return _ours(spark, d).where("disclosure_date >= DATE '2021-01-01' AND disclosure_date < DATE '2022-01-01'").select("txn_id")


@query("size_cuts", "SELECT txn_id, amount_midpoint >= 250000 AS ge250k, amount_midpoint > (SELECT quantile_cont(amount_midpoint, 0.9) FROM disclosures) AS above_q90 FROM disclosures WHERE amount_midpoint IS NOT NULL")
def size_cuts(spark, d):
    x = _ours(spark, d).where("amount_midpoint IS NOT NULL")
    x = x.select("txn_id", "amount_midpoint").crossJoin(F.broadcast(quantiles(x, "amount_midpoint", {"q": 0.9})))  # one row
    return x.select("txn_id", (F.col("amount_midpoint") >= 250000).alias("ge250k"), (F.col("amount_midpoint") > F.col("q")).alias("above_q90"))


@query("year_dashboard", "SELECT year(disclosure_date) AS year, chamber, count(*) AS rows, count(DISTINCT doc_id) AS documents, count(DISTINCT bioguide_id) AS members, count_if(provenance LIKE '%ocr%') AS scanned, count(ticker) AS with_ticker, sum(amount_midpoint) AS volume FROM disclosures GROUP BY ALL")
def year_dashboard(spark, d):
    by = _ours(spark, d).groupBy(F.year("disclosure_date").alias("year"), "chamber")
    return by.agg(A.N().alias("rows"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("bioguide_id").alias("members"), F.count_if(F.col("provenance").contains("ocr")).alias("scanned"), F.count("ticker").alias("with_ticker"), F.sum("amount_midpoint").alias("volume"))


@query("census_of_kinds", "SELECT year(disclosure_date) AS year, count_if(filing_type = 'P') AS reports, count_if(filing_type <> 'P') AS others, count_if(filing_type IS NULL) AS unstated, coalesce(string_agg(DISTINCT last_name, '; ' ORDER BY last_name) FILTER (filing_type = 'P'), '') AS filers FROM ptr_index GROUP BY 1")
def census_of_kinds(spark, d):
    by, p = table(spark, d, "ptr_index").groupBy(F.year("disclosure_date").alias("year")), F.col("filing_type") == "P"
    return by.agg(F.count_if(p).alias("reports"), F.count_if(~p).alias("others"), F.count_if(F.col("filing_type").isNull()).alias("unstated"), F.array_join(F.array_sort(F.collect_set(F.when(p, F.col("last_name")))), "; ").alias("filers"))  # one entry per member


@query("full_short_ids", "SELECT trade_no, substr(sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("filing_id", "filer_id", "transaction_date", "notification_date", "owner", "ticker", "asset_name", "transaction_type", "amount_range_label", "comment")) + ")), 1, 24) AS id FROM open_trades")
def full_short_ids(spark, d):
    return table(spark, d, "open_trades").select("trade_no", D.short_id(["filing_id", "filer_id", "transaction_date", "notification_date", "owner", "ticker", "asset_name", "transaction_type", "amount_range_label", "comment"]).alias("id"))


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
