"""Queries that reconcile our transactions with the vendor's, each with SQL that states the same rule independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import reconcile as R
from tradeloom.operators.quality import counted_in
from tradeloom.plans.registry import Registry
from tradeloom.session import table

_TK = "CASE WHEN upper(trim(coalesce(ticker, ''))) IN ('', 'NAN', 'NONE', '--') THEN '' ELSE replace(replace(regexp_replace(upper(trim(ticker)), '\\s+(PUT|CALL)$', ''), '.', '_'), '-', '_') END"
_S = "CASE left(lower(trim(coalesce({0}, 'none'))), 1) WHEN 'p' THEN 'Purchase' WHEN 's' THEN 'Sale' WHEN 'e' THEN 'Exchange' WHEN '' THEN '?' ELSE lower(trim(coalesce({0}, 'none'))) END"
_WITH = f"""
WITH o AS (SELECT *, bioguide_id AS member, {_TK} AS tk, transaction_date AS d, {_S.format("operation_type")} AS s, CAST(nullif(replace(regexp_extract(amount_range, '\\$([\\d,]+)', 1), ',', ''), '') AS DOUBLE) AS low,
  coalesce(provenance LIKE '%ocr%', false) AS ocr FROM disclosures),
v AS (SELECT *, bioguideid AS member, {_TK} AS tk, traded AS d, {_S.format("transaction")} AS s, trade_size_usd AS low FROM quiver_missing_trades),
c AS (SELECT DISTINCT member FROM o WHERE member IN (SELECT member FROM v WHERE member IS NOT NULL)),
ok AS (SELECT DISTINCT member, tk, d, s FROM o WHERE tk <> '' AND member IN (FROM c)), vk AS (SELECT DISTINCT member, tk, d, s FROM v WHERE tk <> '' AND member IN (FROM c)),
mk AS (FROM ok INTERSECT FROM vk) """
_UNTRADEABLE = "(tk = '' OR regexp_matches(tk, '[ :/$]|MATUR|WEEK|MONTH') OR length(replace(tk, '_', '')) > 5)"
_EXACT, _UNDATED, _UNTICKERED = (f"EXISTS (SELECT 1 FROM {{0}} y WHERE y.member = x.member AND {c})" for c in ("y.tk = x.tk AND y.d IS NOT DISTINCT FROM x.d AND y.s = x.s", "y.tk = x.tk AND y.s = x.s", "y.d IS NOT DISTINCT FROM x.d AND y.s = x.s"))


query = Registry(_WITH)


def _sides(spark, d):
    return R.our_keys(table(spark, d, "disclosures")), R.vendor_keys(table(spark, d, "quiver_missing_trades"))


_CLASS = f"SELECT x.*, CASE WHEN tk = '' THEN 'non_equity' WHEN {_EXACT.format('v')} THEN 'exact_match' WHEN {_UNDATED.format('v')} THEN 'date_mismatch' ELSE 'no_match' END AS class FROM o x"


@query("match_breakdown_asset", f"""
SELECT coalesce(asset_type, '(unknown)') AS asset_type, count_if(class = 'exact_match') AS exact_match, count_if(class = 'date_mismatch') AS date_mismatch, count_if(class = 'no_match') AS no_match,
  count_if(class = 'non_equity') AS non_equity, count(*) AS total, CASE WHEN count_if(class <> 'non_equity') > 0 THEN count_if(class IN ('exact_match', 'date_mismatch')) / count_if(class <> 'non_equity') END AS vendor_has
FROM ({_CLASS}) GROUP BY 1""")
def match_breakdown_asset(spark, d):
    return R.match_breakdown(*_sides(spark, d), F.coalesce("asset_type", F.lit("(unknown)")), "asset_type")


_OURS = f"""SELECT x.txn_id, x.chamber, CASE WHEN tk = '' THEN CASE WHEN lower(trim(coalesce(asset_type, ''))) = 'stock' AND {_UNTICKERED.format('v')} THEN 'ticker_gap' ELSE 'structural' END WHEN {_EXACT.format('v')} THEN 'agreed'
  WHEN {_UNDATED.format('v')} THEN 'date_gap' WHEN {_UNTICKERED.format('v')} THEN 'ticker_gap' ELSE 'ours_only' END AS verdict FROM o x"""


@query("verdict_ours", f"SELECT txn_id, verdict FROM ({_OURS})")
def verdict_ours(spark, d):
    return R.our_verdicts(*_sides(spark, d)).select("txn_id", "verdict")


@query("verdict_ours_tally", f"SELECT chamber, verdict, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY chamber) AS share FROM ({_OURS}) GROUP BY chamber, verdict")
def verdict_ours_tally(spark, d):
    n = R.our_verdicts(*_sides(spark, d)).groupBy("chamber", "verdict").agg(R.N().alias("n"))
    return n.join(n.groupBy("chamber").agg(F.sum("n").alias("all")), "chamber").select("chamber", "verdict", "n", (F.col("n") / F.col("all")).alias("share"))


_VENDOR = f"""SELECT member, tk, d, s, CASE WHEN {_UNDATED.format('o')} THEN 'date_gap' WHEN {_UNTICKERED.format('o')} THEN 'ticker_gap' WHEN {_UNTRADEABLE} THEN 'unlisted'
  WHEN EXISTS (SELECT 1 FROM o y WHERE y.member = x.member AND y.ocr) THEN 'on_paper' ELSE 'missing' END AS verdict FROM (FROM vk EXCEPT FROM ok) x"""


@query("verdict_vendor", _VENDOR)
def verdict_vendor(spark, d):
    return R.vendor_verdicts(*_sides(spark, d))


@query("net_completeness", f"SELECT (SELECT count(*) FROM ({_OURS}) WHERE verdict = 'ours_only') AS more, (SELECT count(*) FROM ({_VENDOR}) WHERE verdict = 'missing') AS fewer")
def net_completeness(spark, d):
    o, v = _sides(spark, d)
    more = R.our_verdicts(o, v).agg(F.count_if(F.col("verdict") == "ours_only").alias("more"))
    return more.crossJoin(F.broadcast(R.vendor_verdicts(o, v).agg(F.count_if(F.col("verdict") == "missing").alias("fewer"))))  # one row each


@query("top_missing_filers", f"SELECT member, count(*) AS n FROM ({_VENDOR}) WHERE verdict IN ('missing', 'on_paper') GROUP BY member ORDER BY n DESC, member LIMIT 8")
def top_missing_filers(spark, d):
    x = R.vendor_verdicts(*_sides(spark, d)).where(F.col("verdict").isin("missing", "on_paper"))
    return x.groupBy("member").agg(R.N().alias("n")).orderBy(F.desc("n"), "member").limit(8)


@query("reconcile_metrics", """
, n AS (SELECT (SELECT count(*) FROM c)::DOUBLE AS common_members, (SELECT count(*) FROM ok)::DOUBLE AS ours, (SELECT count(*) FROM vk)::DOUBLE AS vendor, (SELECT count(*) FROM mk)::DOUBLE AS matched)
SELECT unnest(['common_members', 'ours', 'vendor', 'matched', 'only_vendor', 'only_ours', 'coverage']) AS metric, unnest([common_members, ours, vendor, matched, vendor - matched, ours - matched, matched / vendor]) AS value FROM n""")
def reconcile_metrics(spark, d):
    return R.reconcile_metrics(*_sides(spark, d))


@query("only_vendor_keys", "SELECT * FROM (FROM vk EXCEPT FROM ok)")
def only_vendor_keys(spark, d):
    o, v = _sides(spark, d)
    both, key = R.common_members(o, v), ["member", "tk", "d", "s"]
    pick = lambda x: x.where("tk <> ''").join(both, "member", "left_semi").select(*key)
    return pick(v).distinct().exceptAll(pick(o).distinct().intersect(pick(v)))


@query("scope_stack", """
, z AS (SELECT DISTINCT member, tk, d, s, unnest(CASE WHEN ocr THEN ['ocr', 'both'] ELSE ['digital', 'both'] END) AS scope FROM o WHERE tk <> '' AND member IS NOT NULL),
w AS (SELECT DISTINCT member, tk, d, s, 1 AS hit FROM v WHERE tk <> '' AND member IS NOT NULL)
SELECT scope, count(*) AS ours, count(hit) AS matched, (SELECT count(*) FROM w) AS vendor, count(hit) / (SELECT count(*) FROM w) AS coverage FROM z LEFT JOIN w ON z.member = w.member AND z.tk = w.tk AND z.s = w.s AND z.d IS NOT DISTINCT FROM w.d GROUP BY scope""")
def scope_stack(spark, d):
    return R.scoped_metrics(*_sides(spark, d))


@query("field_agreement", "SELECT count(*) AS pairs, avg((o.s = v.s)::INT) AS sense, avg(coalesce(o.low = v.low, false)::INT) AS amount FROM o JOIN v ON o.member = v.member AND o.tk = v.tk AND o.d = v.d WHERE o.tk <> ''")
def field_agreement(spark, d):
    return R.field_agreement(*_sides(spark, d))


@query("cell_agreement", """
, a AS (SELECT member, tk, d, list_sort(list(DISTINCT s)) AS ss FROM o WHERE tk <> '' GROUP BY ALL), b AS (SELECT member, tk, d, list_sort(list(DISTINCT s)) AS ss FROM v WHERE tk <> '' GROUP BY ALL)
SELECT a.member, a.tk, a.d, array_to_string(a.ss, ',') AS ours, array_to_string(b.ss, ',') AS vendor, list_has_any(a.ss, b.ss) AS agree FROM a JOIN b ON a.member = b.member AND a.tk = b.tk AND a.d IS NOT DISTINCT FROM b.d""")
def cell_agreement(spark, d):
    return R.cell_agreement(*_sides(spark, d))


@query("weighted_agreement", """
SELECT sum(p * n) / sum(n) AS sense, CAST(sum(n) AS BIGINT) AS pairs FROM (SELECT o.chamber, count(*) AS n, avg((o.s = v.s)::INT) AS p FROM o JOIN v ON o.member = v.member AND o.tk = v.tk AND o.d = v.d WHERE o.tk <> '' GROUP BY 1)""", "sense")
def weighted_agreement(spark, d):
    o, v = _sides(spark, d)
    j = o.where("tk <> ''").join(v.select("member", "tk", "d", F.col("s").alias("vs")), ["member", "tk", "d"])
    by = j.groupBy("chamber").agg(R.N().alias("n"), F.avg((F.col("s") == F.col("vs")).cast("int")).alias("p"))
    return by.agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("sense"), F.sum("n").alias("pairs"))


@query("ticker_sets", """
, a AS (SELECT DISTINCT member, tk FROM ok), b AS (SELECT DISTINCT member, tk FROM vk), f AS (SELECT coalesce(a.member, b.member) AS member, a.tk AS ot, b.tk AS vt FROM a FULL JOIN b ON a.member = b.member AND a.tk = b.tk)
SELECT member, count(ot) AS ours, count(vt) AS vendor, count(*) FILTER (ot IS NOT NULL AND vt IS NOT NULL) AS shared, count(*) FILTER (vt IS NULL) AS ours_only, count(*) FILTER (ot IS NULL) AS vendor_only,
  coalesce(string_agg(vt, ',' ORDER BY vt) FILTER (ot IS NULL), '') AS vendor_only_list FROM f GROUP BY member""")
def ticker_sets(spark, d):
    return R.ticker_sets(*_sides(spark, d))


@query("member_deltas", """
, a AS (SELECT member, count(*) AS n, count_if(tk = '') AS t, count_if(ocr) AS c FROM o WHERE member IS NOT NULL GROUP BY 1), b AS (SELECT member, count(*) AS n FROM v WHERE member IS NOT NULL GROUP BY 1),
z AS (SELECT coalesce(a.member, b.member) AS member, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS vendor, coalesce(t, 0) AS no_ticker, coalesce(c, 0) AS ocr FROM a FULL JOIN b ON a.member = b.member)
SELECT *, ours - vendor AS delta, CASE WHEN vendor = 0 THEN 'not_at_vendor' WHEN ours = 0 THEN 'absent' WHEN ours = vendor THEN 'equal' WHEN ours > vendor THEN 'more' ELSE 'fewer' END AS verdict FROM z""")
def member_deltas(spark, d):
    return R.member_deltas(*_sides(spark, d))


@query("inclusion", f"""
, q AS (SELECT DISTINCT CASE WHEN chamber LIKE 'S%' THEN 'Senate' ELSE 'House' END AS chamber, member, tk, s FROM v WHERE tk <> '' AND member IN (FROM c)),
w AS (SELECT chamber, CASE WHEN EXISTS (SELECT 1 FROM o y WHERE y.chamber = x.chamber AND y.member = x.member AND y.tk = x.tk AND y.s = x.s) THEN 'included' WHEN EXISTS (SELECT 1 FROM o y WHERE y.chamber = x.chamber AND y.member = x.member AND y.ocr) THEN 'on_paper'
  WHEN {_UNTRADEABLE} THEN 'unlisted' WHEN EXISTS (SELECT 1 FROM o y WHERE y.chamber = x.chamber AND y.member = x.member AND contains(y.tk, ' ') AND list_contains(string_split_regex(y.tk, '\\s+'), x.tk)) THEN 'two_legs'
  WHEN EXISTS (SELECT 1 FROM o y WHERE y.chamber <> x.chamber AND y.member = x.member) THEN 'other_chamber' ELSE 'missing' END AS why FROM q x)
SELECT chamber, count(*) AS vendor, {", ".join(f"count_if(why = '{k}') AS {k}" for k in ("included", "on_paper", "unlisted", "two_legs", "other_chamber", "missing"))} FROM w GROUP BY chamber""")
def inclusion(spark, d):
    return R.inclusion(*_sides(spark, d))


@query("nearest_signed", """
SELECT txn_id, CAST(delta AS INTEGER) AS delta, CASE WHEN delta = 0 THEN 'same_day' WHEN delta < 0 THEN 'vendor_earlier' ELSE 'vendor_later' END AS status FROM (SELECT o.txn_id, date_diff('day', o.d, v.d) AS delta, row_number() OVER (PARTITION BY o.txn_id ORDER BY abs(date_diff('day', o.d, v.d)), v.d) AS rn
FROM o JOIN v ON o.member = v.member AND o.tk = v.tk AND o.s = v.s AND abs(date_diff('day', o.d, v.d)) <= 3 WHERE o.tk <> '') WHERE rn = 1""")
def nearest_signed(spark, d):
    return R.nearest_signed(*_sides(spark, d))


@query("one_to_one_exact", """
, a AS (SELECT member, tk, s, d, count(*) AS n FROM o WHERE tk <> '' AND d IS NOT NULL GROUP BY ALL), b AS (SELECT member, tk, s, d, count(*) AS n FROM v WHERE tk <> '' AND d IS NOT NULL GROUP BY ALL)
SELECT a.member, CAST(sum(least(a.n, b.n)) AS BIGINT) AS pairs FROM a JOIN b ON a.member = b.member AND a.tk = b.tk AND a.s = b.s AND a.d = b.d GROUP BY a.member""")
def one_to_one_exact(spark, d):
    o, v = _sides(spark, d)
    return R.one_to_one_exact(o, v)[0].join(o.select("txn_id", "member"), "txn_id").groupBy("member").agg(R.N().alias("pairs"))


@query("one_to_one")
def one_to_one(spark, d):
    return R.one_to_one(*_sides(spark, d))


@query("index_join", "SELECT d.txn_id, p.listings, p.first_received FROM disclosures d LEFT JOIN (SELECT doc_id, count(*) AS listings, min(received_at) AS first_received FROM ptr_index GROUP BY doc_id) p USING (doc_id)".replace("SELECT d.", " SELECT d."))
def index_join(spark, d):
    p = table(spark, d, "ptr_index").groupBy("doc_id").agg(R.N().alias("listings"), F.min("received_at").alias("first_received"))
    return table(spark, d, "disclosures").select("txn_id", "doc_id").join(p, "doc_id", "left").drop("doc_id")


@query("document_crosscheck", """
, a AS (SELECT doc_id, count(*) AS n FROM disclosures WHERE doc_id IS NOT NULL GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM ptr_index WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (a.n IS NULL) AS without_rows, count(*) FILTER (b.n IS NULL) AS not_indexed, count(*) FILTER (b.n > 1) AS listed_twice FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def document_crosscheck(spark, d):
    a = table(spark, d, "disclosures").where("doc_id IS NOT NULL").groupBy("doc_id").agg(R.N().alias("a"))
    b = table(spark, d, "ptr_index").where("doc_id IS NOT NULL").groupBy("doc_id").agg(R.N().alias("b"))
    return a.join(b, "doc_id", "full_outer").agg(R.N().alias("documents"), F.count_if(F.col("a").isNull()).alias("without_rows"), F.count_if(F.col("b").isNull()).alias("not_indexed"), F.count_if(F.col("b") > 1).alias("listed_twice"))


@query("scans_with_exception", " SELECT line_no FROM ocr_lines_2022 l WHERE amount_code IS DISTINCT FROM 'A' OR member IN (SELECT member FROM ocr_lines_2022 WHERE amount_code = 'K')")
def scans_with_exception(spark, d):
    x = table(spark, d, "ocr_lines_2022")
    kept = x.where(~F.col("amount_code").eqNullSafe("A"))
    excepted = x.where(F.col("amount_code").eqNullSafe("A")).join(x.where("amount_code = 'K'").select("member").distinct(), "member", "left_semi")
    return kept.select("line_no").unionByName(excepted.select("line_no"))


@query("vendor_chamber_filter", " SELECT vendor_no FROM quiver_missing_trades WHERE chamber LIKE '%Rep%'")
def vendor_chamber_filter(spark, d):
    return table(spark, d, "quiver_missing_trades").where(F.col("chamber").contains("Rep")).select("vendor_no")


@query("date_agreement", """
, a AS (SELECT member, tk, s, list(DISTINCT d) FILTER (d IS NOT NULL) AS ds, list(DISTINCT disclosure_date) FILTER (disclosure_date IS NOT NULL) AS fs FROM o WHERE tk <> '' AND member IS NOT NULL GROUP BY ALL),
b AS (SELECT member, tk, s, list(DISTINCT d) FILTER (d IS NOT NULL) AS ds, list(DISTINCT filed) FILTER (filed IS NOT NULL) AS fs FROM v WHERE tk <> '' AND member IS NOT NULL GROUP BY ALL)
SELECT count(*) AS keys, avg(coalesce(list_has_any(a.ds, b.ds), false)::INT) AS date_traded, avg(coalesce(list_has_any(a.fs, b.fs), false)::INT) AS date_filed FROM a JOIN b ON a.member = b.member AND a.tk = b.tk AND a.s = b.s""")
def date_agreement(spark, d):
    return R.date_agreement(*_sides(spark, d))


@query("disagreements", """
SELECT x.txn_id, CASE WHEN EXISTS (SELECT 1 FROM v y WHERE y.member = x.member AND y.tk = x.tk AND y.d = x.d AND y.s = x.s AND y.low = x.low) THEN 'agreed' WHEN list_contains(c.ss, x.s) THEN 'amount' ELSE 'sense' END AS kind, array_to_string(c.ss, ',') AS vendor_senses
FROM o x JOIN (SELECT member, tk, d, list_sort(list(DISTINCT s)) AS ss FROM v WHERE tk <> '' AND d IS NOT NULL GROUP BY ALL) c ON c.member = x.member AND c.tk = x.tk AND c.d = x.d WHERE x.tk <> ''""")
def disagreements(spark, d):
    return R.disagreements(*_sides(spark, d))


@query("document_drift", """
, a AS (SELECT doc_id, count(*) AS n FROM disclosures WHERE doc_id IS NOT NULL GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM disclosures WHERE doc_id IS NOT NULL AND occurrence_index = 0 AND provenance NOT LIKE '%ocr%' GROUP BY 1)
SELECT doc_id, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS baseline, CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'equal' WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'missing' WHEN a.n > b.n THEN 'superset' ELSE 'drift' END AS state FROM a FULL JOIN b USING (doc_id)""")
def document_drift(spark, d):
    x = table(spark, d, "disclosures")
    return R.document_drift(x, x.where("occurrence_index = 0 AND provenance NOT LIKE '%ocr%'"), "doc_id")


_VERDICTS = (("agreed", False), ("date_gap", True), ("ticker_gap", True), ("structural", False), ("ours_only", False))


@query("verdict_table", f""", k AS (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest(['agreed', 'date_gap', 'ticker_gap', 'structural', 'ours_only']) AS verdict, unnest([false, true, true, false, false]) AS to_fix), t AS ({_OURS})
SELECT place, k.verdict, to_fix, count(t.verdict) AS n, 100.0::DOUBLE * count(t.verdict) / (SELECT count(*) FROM t) AS share FROM k LEFT JOIN t ON t.verdict = k.verdict GROUP BY ALL""")
def verdict_table(spark, d):
    """Every verdict in a fixed order, those that a correction could mend marked, also those without rows."""
    fix = spark.createDataFrame([(v, f) for v, f in _VERDICTS], "verdict string, to_fix boolean")
    return counted_in(R.our_verdicts(*_sides(spark, d)), "verdict", [v for v, _ in _VERDICTS]).join(F.broadcast(fix), "verdict")  # five rows


@query("senate_vendor_rows", " SELECT vendor_no FROM quiver_missing_trades WHERE lower(chamber) = 'senate'")
def senate_vendor_rows(spark, d):
    return table(spark, d, "quiver_missing_trades").where(F.lower("chamber") == "senate").select("vendor_no")


@query("year_verdicts", """
, a AS (SELECT year(d) AS year, count(*) AS n, count_if(ocr) AS c FROM o WHERE d IS NOT NULL GROUP BY 1), b AS (SELECT year(d) AS year, count(*) AS n FROM v WHERE d IS NOT NULL GROUP BY 1)
SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS vendor, coalesce(a.c, 0) AS ocr, CASE WHEN b.n IS NULL THEN 'not_at_vendor' WHEN a.n IS NULL THEN 'absent' WHEN a.c = a.n THEN 'scanned_only' WHEN abs(a.n - b.n) <= 0.05 * b.n THEN 'close' WHEN a.n > b.n THEN 'more' ELSE 'fewer' END AS verdict FROM a FULL JOIN b ON a.year = b.year""")
def year_verdicts(spark, d):
    """Rows per year of trade on either side, a difference of up to a twentieth counted as close, years that we know from scans only told apart."""
    o, v = _sides(spark, d)
    a = o.where("d IS NOT NULL").groupBy(F.year("d").alias("year")).agg(R.N().alias("a"), F.count_if("ocr").alias("c"))
    j = a.join(v.where("d IS NOT NULL").groupBy(F.year("d").alias("year")).agg(R.N().alias("b")), "year", "full_outer")
    n, m = F.col("a"), F.col("b")
    verdict = F.when(m.isNull(), "not_at_vendor").when(n.isNull(), "absent").when(F.col("c") == n, "scanned_only").when(F.abs(n - m) <= 0.05 * m, "close").when(n > m, "more").otherwise("fewer")
    return j.select("year", F.coalesce("a", F.lit(0)).alias("ours"), F.coalesce("b", F.lit(0)).alias("vendor"), F.coalesce("c", F.lit(0)).alias("ocr"), verdict.alias("verdict"))


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
