"""Queries over the scalar functions, each with SQL that states the same rule independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.plans.registry import Registry
from tradeloom.session import table

query = Registry()


def _case(column: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{value}'" for cond, value in pairs) + f" ELSE {default} END AS {column}"


@query("match_ticker", """
SELECT vendor_no, CASE WHEN upper(trim(coalesce(ticker, ''))) IN ('', 'NAN', 'NONE', '--') THEN ''
  ELSE replace(replace(regexp_replace(upper(trim(ticker)), '\\s+(PUT|CALL)$', ''), '.', '_'), '-', '_') END AS tk FROM quiver_missing_trades""")
def match_ticker(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.match_ticker(F.col("ticker")).alias("tk"))


@query("market_ticker", """
SELECT vendor_no, CASE WHEN regexp_full_match(upper(trim(ticker)), '[A-Z]{1,5}') THEN upper(trim(ticker))
  WHEN regexp_full_match(upper(trim(ticker)), '[A-Z]{1,4}\\.[A-Z]') THEN replace(upper(trim(ticker)), '.', '-') END AS strict,
 CASE WHEN regexp_full_match(upper(trim(ticker)), '[A-Z]{1,5}') THEN upper(trim(ticker))
  WHEN regexp_full_match(upper(trim(ticker)), '[A-Z]{1,4}[.-][A-Z]') THEN replace(upper(trim(ticker)), '.', '-') END AS panel
FROM quiver_missing_trades""")
def market_ticker(spark, d):
    t = F.col("ticker")
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.market_ticker(t).alias("strict"), S.market_ticker(t, hyphen=True).alias("panel"))


@query("vendor_ticker", """
WITH t AS (SELECT vendor_no, trim(regexp_replace(ticker, '\\s+', ' ', 'g')) AS s FROM quiver_missing_trades),
u AS (SELECT vendor_no, CASE WHEN s NOT IN ('', 'nan', 'None', 'NaT') THEN replace(replace(upper(s), ' ', ''), '/', '.') END AS s FROM t)
SELECT vendor_no, CASE WHEN s NOT IN ('-', '—', 'N/A', 'NA', 'NONE') THEN s END AS tk FROM u""")
def vendor_ticker(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.vendor_ticker(F.col("ticker")).alias("tk"))


@query("untradeable", """
SELECT vendor_no, length(s) = 0 OR contains(s, ' ') OR contains(s, ':') OR contains(s, '/') OR contains(s, '$') OR contains(s, 'MATUR') OR contains(s, 'WEEK')
  OR contains(s, 'MONTH') OR length(replace(s, '_', '')) > 5 AS untradeable
FROM (SELECT vendor_no, upper(trim(coalesce(ticker, ''))) AS s FROM quiver_missing_trades)""")
def untradeable(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.untradeable(F.col("ticker")).alias("untradeable"))


@query("ticker_legs", """
SELECT vendor_no, leg FROM (SELECT vendor_no, unnest(string_split_regex(trim(ticker), '\\s+')) AS leg FROM quiver_missing_trades) WHERE leg <> ''""")
def ticker_legs(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", F.explode(S.legs(F.col("ticker"))).alias("leg"))


@query("match_sense", """
SELECT vendor_no, CASE left(s, 1) WHEN 'p' THEN 'Purchase' WHEN 's' THEN 'Sale' WHEN 'e' THEN 'Exchange' ELSE coalesce(nullif(s, ''), '?') END AS sense
FROM (SELECT vendor_no, lower(trim(coalesce(transaction, 'none'))) AS s FROM quiver_missing_trades)""")
def match_sense(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.match_sense(F.col("transaction")).alias("sense"))


@query("op_class", """
SELECT txn_id, CASE WHEN operation_type ILIKE '%purchase%' THEN 'buy' WHEN operation_type ILIKE '%sale%' THEN 'sell' WHEN operation_type ILIKE '%exchange%' THEN 'exchange'
  ELSE 'other' END AS op FROM disclosures""")
def op_class(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.op_class(F.col("operation_type")).alias("op"))


@query("op_from_code", """
SELECT txn_id, CASE WHEN operation_type = 'Purchase' THEN 'Purchase' WHEN operation_type = 'Exchange' THEN 'Exchange' WHEN operation_type ILIKE '%partial%' THEN 'Sale (Partial)'
  WHEN operation_type ILIKE '%full%' THEN 'Sale (Full)' ELSE 'Sale' END AS operation FROM disclosures""")
def op_from_code(spark, d):
    op = F.lower(F.col("operation_type"))
    part = F.regexp_extract(op, "(partial|full)", 1)
    return table(spark, d, "disclosures").select("txn_id", S.op_from_code(F.when(op == "partial sale", "S").otherwise(F.upper(F.substring(op, 1, 1))), part).alias("operation"))


@query("vendor_op", """
SELECT vendor_no, CASE WHEN s IN ('p', 'buy', 'bought') OR contains(s, 'purchase') THEN 'Purchase' WHEN s = 's' OR contains(s, 'sale') OR contains(s, 'sold') OR contains(s, 'sell') THEN 'Sale'
  WHEN contains(s, 'exchange') THEN 'Exchange' ELSE 'Other' END AS op FROM (SELECT vendor_no, lower(trim(coalesce(transaction, ''))) AS s FROM quiver_missing_trades)""")
def vendor_op(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.vendor_op(F.col("transaction")).alias("op"))


@query("owner_class", """
SELECT txn_id, CASE WHEN contains(s, 'joint') OR s = 'jt' THEN 'joint' WHEN contains(s, 'self') THEN 'self' WHEN contains(s, 'spouse') OR s = 'sp' THEN 'spouse'
  WHEN contains(s, 'dependent') OR contains(s, 'child') OR s = 'dc' THEN 'dependent' ELSE 'other' END AS owner_class FROM (SELECT txn_id, lower(trim(coalesce(owner, ''))) AS s FROM disclosures)""")
def owner_class(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.owner_class(F.col("owner")).alias("owner_class"))


_BUCKET = """CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nan', '(unknown)') THEN 'missing' WHEN {0} ILIKE '%option%' THEN 'option' WHEN {0} ILIKE '%muni%' THEN 'muni'
  WHEN {0} ILIKE '%gov%' OR {0} ILIKE '%treasur%' THEN 'gov' WHEN {0} ILIKE '%bond%' THEN 'bond' WHEN {0} ILIKE '%fund%' OR {0} ILIKE '%etf%' THEN 'fund' WHEN {0} ILIKE '%stock%' THEN 'stock' ELSE 'other' END"""


@query("asset_bucket", f"SELECT txn_id, {_BUCKET.format('asset_type')} AS bucket FROM disclosures")
def asset_bucket(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.asset_bucket(F.col("asset_type")).alias("bucket"))


@query("vendor_asset", """
SELECT vendor_no, CASE WHEN tickertype IS NULL THEN 'Unknown' WHEN s IN ('st', 'cs', 'stock') OR contains(s, 'common stock') THEN 'Stock' WHEN contains(s, 'option') THEN 'Option'
  WHEN contains(s, 'etf') OR contains(s, 'fund') OR s = 'ot' THEN 'Fund/ETF' WHEN contains(s, 'bond') OR contains(s, 'note') THEN 'Bond' ELSE 'Other' END AS kind
FROM (SELECT vendor_no, tickertype, lower(trim(tickertype)) AS s FROM quiver_missing_trades)""")
def vendor_asset(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.vendor_asset(F.col("tickertype")).alias("kind"))


_RULES = (("Bond", r"\bNOTES?\b|\bBONDS?\b|\bDUE\b"), ("Fund", r"\bFUND\b|\bETF\b|\bINDEX\b"), ("Stock", r"\bINC\b|\bCORP|\bPLC\b|\bCOMPANY\b|COMMON"))


@query("inferred_kind", """
SELECT line_no, CASE WHEN regexp_matches(s, '\\bNOTES?\\b|\\bBONDS?\\b|\\bDUE\\b') THEN 'Bond' WHEN regexp_matches(s, '\\bFUND\\b|\\bETF\\b|\\bINDEX\\b') THEN 'Fund' WHEN regexp_matches(s, '\\bINC\\b|\\bCORP|\\bPLC\\b|\\bCOMPANY\\b|COMMON') THEN 'Stock' END AS kind
FROM (SELECT line_no, regexp_replace(replace(upper(coalesce(asset_description, '')), chr(160), ' '), '[^\\x00-\\x7F]', '_', 'g') AS s FROM ocr_lines_2022)""")
def inferred_kind(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.inferred_kind(F.col("asset_description"), _RULES).alias("kind"))


@query("explicit_ticker", """
SELECT txn_id, CASE WHEN length(s) BETWEEN 1 AND 5 THEN s END AS symbol
FROM (SELECT txn_id, trim(regexp_extract(coalesce(asset_description, ''), '(?:-|\\()\\s*([A-Z](?:[A-Z0-9]|[.]){0,5})[)]?\\s*$', 1), '.') AS s FROM disclosures)""")
def explicit_ticker(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.explicit_ticker(F.col("asset_description")).alias("symbol"))


@query("name_is_ticker", """
SELECT line_no, nullif(regexp_extract(trim(coalesce(asset_description, '')), '^([A-Z]{1,5})([.][A-Z])?(\\s+(PUT|CALL))?$', 1), '') AS symbol FROM ocr_lines_2022""")
def name_is_ticker(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.name_is_ticker(F.col("asset_description")).alias("symbol"))


@query("inline_ticker", """
SELECT line_no, upper(list_filter(regexp_extract_all(coalesce(asset_description, ''), '\\((?:[A-Za-z]+\\s*:\\s*)?([A-Za-z][A-Za-z0-9.\\-]{0,6})\\)', 1), lambda x: lower(x) NOT IN ('partial', 'full'))[1]) AS symbol FROM ocr_lines_2022""")
def inline_ticker(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.inline_ticker(F.col("asset_description")).alias("symbol"))


@query("asset_name", f"""
SELECT txn_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(asset_description, '')), '(?:-|\\()\\s*([A-Z](?:[A-Z0-9]|[.]){{0,5}})[)]?\\s*$', ''), '[^A-Z0-9 &]', ' ', 'g'),
  '{S.CORPORATE}', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM disclosures""")
def asset_name(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.asset_name(F.col("asset_description")).alias("name"))


@query("without_owner", "SELECT line_no, trim(regexp_replace(regexp_replace(asset_description, '^\\(\\s*(S|SP|DC|J|JT)\\s*\\)\\s*', '', 'i'), '^(SP|DC|JT)\\s+', ''), ' ') AS description FROM ocr_lines_2022")
def without_owner(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.without_owner(F.col("asset_description")).alias("description"))


@query("clean_text", """
SELECT doc_id, CASE WHEN s NOT IN ('', 'nan', 'None', 'NaT') THEN s END AS source FROM (SELECT doc_id, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS s FROM documents)""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.clean_text(F.col("source")).alias("source"))


@query("nonblank", """
SELECT line_no, trim(coalesce(asset_description, '')) <> '' AND lower(trim(coalesce(asset_description, ''))) <> 'nan' AS described, trim(coalesce(owner, '')) NOT IN ('', 'nan') AS owned FROM ocr_lines_2022""")
def nonblank(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.nonblank(F.col("asset_description")).alias("described"), S.nonblank(F.col("owner")).alias("owned"))


@query("plain_name", "SELECT ptr_no, trim(regexp_replace(lower(strip_accents(declarant_name)), '[^a-z]+', ' ', 'g')) AS name FROM ptr_index")
def plain_name(spark, d):
    return table(spark, d, "ptr_index").select("ptr_no", S.plain_name(F.col("declarant_name")).alias("name"))


@query("split_name", """
WITH a AS (SELECT bioguide_id, first_name || coalesce(' ' || middle_name, '') || ' ' || last_name AS n FROM members),
b AS (SELECT bioguide_id, list_filter(string_split(trim(regexp_replace(lower(strip_accents(n)), '[^a-z]+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'hon', 'jr', 'sr', 'ii', 'iii', 'iv', 'mr', 'mrs', 'ms', 'dr')) AS t FROM a)
SELECT bioguide_id, t[-1] AS last, CASE WHEN len(t) > 1 THEN t[1] END AS first, CASE WHEN len(t) > 2 THEN array_to_string(t[2:-2], ' ') END AS middles FROM b""")
def split_name(spark, d):
    whole = F.concat_ws(" ", F.concat(F.col("last_name"), F.lit(",")), "first_name", "middle_name")
    return table(spark, d, "members").select("bioguide_id", S.split_name(whole).alias("n")).select("bioguide_id", "n.last", "n.first", "n.middles")


@query("amount_midpoint", """
SELECT txn_id, CASE WHEN len(n) >= 2 THEN (n[1] + n[2]) / 2 WHEN len(n) = 1 THEN n[1] END AS midpoint
FROM (SELECT txn_id, list_transform(regexp_extract_all(coalesce(amount_range, ''), '\\$([\\d,]+)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM disclosures)""")
def amount_midpoint(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.amount_midpoint(F.col("amount_range")).alias("midpoint"))


@query("amount_low", "SELECT txn_id, CAST(nullif(replace(regexp_extract(amount_range, '\\$([\\d,]+)', 1), ',', '') , '') AS DOUBLE) AS low FROM disclosures")
def amount_low(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.amount_low(F.col("amount_range")).alias("low"))


@query("amount_range", """
WITH a AS (SELECT txn_id, amount_range AS r, list_transform(regexp_extract_all(coalesce(amount_range, ''), '[\\d,]*\\d(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n,
  regexp_matches(lower(trim(amount_range)), '>|over|more than|\\+$') AS o FROM disclosures)
SELECT txn_id, CASE WHEN len(n) >= 2 THEN least(n[1], n[2]) WHEN len(n) = 1 THEN n[1] END AS lower, CASE WHEN len(n) >= 2 THEN greatest(n[1], n[2]) END AS upper,
  CASE WHEN len(n) >= 2 THEN (n[1] + n[2]) / 2 WHEN len(n) = 1 AND o THEN 75000000.0 WHEN len(n) = 1 THEN n[1] END AS midpoint,
  CASE WHEN r IS NULL THEN 'missing' WHEN len(n) >= 2 THEN 'range' WHEN len(n) = 1 AND o THEN 'open' WHEN len(n) = 1 THEN 'lower_only' ELSE 'unparsed' END AS method FROM a""")
def amount_range(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.amount_range(F.col("amount_range")).alias("x")).select("txn_id", "x.*")


@query("bracket_codes", "SELECT line_no, CASE upper(amount_code) " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in S.BRACKETS.items()) + " END AS bracket, CAST(CASE upper(amount_code) "
       + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in S.BRACKETS.items()) + " END AS DOUBLE) AS house, CAST(CASE upper(amount_code) "
       + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in S.BRACKETS.items() if v[2]) + " END AS DOUBLE) AS senate FROM ocr_lines_2022")
def bracket_codes(spark, d):
    codes = spark.createDataFrame([(k, *v) for k, v in S.BRACKETS.items()], "code string, bracket string, house double, senate double")
    lines = table(spark, d, "ocr_lines_2022").withColumn("code", F.upper("amount_code"))
    return lines.join(F.broadcast(codes), "code", "left").select("line_no", "bracket", "house", "senate")  # eleven rows


@query("size_floor", "SELECT vendor_no, greatest(coalesce(trade_size_usd, 1001.0), 1001.0) AS size FROM quiver_missing_trades")
def size_floor(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.size_floor(F.col("trade_size_usd")).alias("size"))


@query("date_confidence", """
SELECT txn_id, date_diff('day', transaction_date, disclosure_date) AS lag, CASE WHEN transaction_date IS NULL OR disclosure_date IS NULL THEN 'unknown'
  WHEN date_diff('day', transaction_date, disclosure_date) BETWEEN 0 AND 75 THEN 'plausible' ELSE 'implausible' END AS confidence FROM disclosures""")
def date_confidence(spark, d):
    t, f = F.col("transaction_date"), F.col("disclosure_date")
    return table(spark, d, "disclosures").select("txn_id", S.lag_days(t, f).alias("lag"), S.date_confidence(t, f).alias("confidence"))


@query("repaired_year", """
WITH a AS (SELECT line_no, transaction_date AS r, notification_date AS f,
  try_cast(year(notification_date) || strftime(transaction_date, '-%m-%d') AS DATE) AS s, try_cast((year(notification_date) - 1) || strftime(transaction_date, '-%m-%d') AS DATE) AS p FROM ocr_lines_2022)
SELECT line_no, CASE WHEN r BETWEEN f - INTERVAL 90 DAY AND f + INTERVAL 10 DAY THEN r WHEN s BETWEEN f - INTERVAL 90 DAY AND f + INTERVAL 10 DAY THEN s
  WHEN p BETWEEN f - INTERVAL 90 DAY AND f + INTERVAL 10 DAY THEN p ELSE r END AS date FROM a""")
def repaired_year(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.repaired_year(F.col("transaction_date"), F.col("notification_date")).alias("date"))


@query("any_date", """
SELECT ptr_no, CASE WHEN year(x) BETWEEN 1678 AND 2261 THEN x END AS date FROM (SELECT ptr_no, CAST(coalesce(try_strptime(trim(filing_date_raw), '%Y-%m-%d'), try_strptime(trim(filing_date_raw), '%m/%d/%Y'),
  try_strptime(trim(filing_date_raw), '%Y%m%d'), try_strptime(trim(filing_date_raw), '%b %d, %Y'), try_strptime(trim(filing_date_raw), '%d %b %Y'), try_strptime(trim(filing_date_raw), '%Y/%m/%d'), try_strptime(trim(filing_date_raw), '%d-%b-%Y')) AS DATE) AS x FROM ptr_index)""")
def any_date(spark, d):
    return table(spark, d, "ptr_index").select("ptr_no", S.any_date(F.col("filing_date_raw")).alias("date"))


@query("congress", "SELECT txn_id, CAST(113 + floor((year(transaction_date) - 2013) / 2.0) AS INTEGER) AS congress FROM disclosures")
def congress(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.congress_of(F.year("transaction_date")).alias("congress"))


@query("tenure", """
SELECT t.txn_id, CASE WHEN y >= 0 THEN y END AS years, CASE WHEN y < 0 THEN 0 ELSE y END AS clipped FROM (SELECT txn_id, year(transaction_date) - year(term_start) AS y FROM disclosures d LEFT JOIN members m USING (bioguide_id)) t""")
def tenure(spark, d):
    m = table(spark, d, "members").select("bioguide_id", "term_start")
    t = table(spark, d, "disclosures").select("txn_id", "bioguide_id", "transaction_date").join(m, "bioguide_id", "left")
    a, b = F.col("term_start"), F.col("transaction_date")
    return t.select("txn_id", S.tenure(a, b).alias("years"), S.tenure(a, b, clip=True).alias("clipped"))


@query("sector_funds", "SELECT txn_id, CASE sector_gics " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SECTOR_FUNDS.items()) + " END AS fund FROM disclosures")
def sector_funds(spark, d):
    funds = F.create_map(*[F.lit(x) for kv in S.SECTOR_FUNDS.items() for x in kv])
    return table(spark, d, "disclosures").select("txn_id", F.try_element_at(funds, F.coalesce("sector_gics", F.lit(""))).alias("fund"))


@query("asset_codes", "SELECT vendor_no, CASE upper(trim(tickertype)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ASSET_CODES.items()) + " ELSE tickertype END AS kind FROM quiver_missing_trades")
def asset_codes(spark, d):
    names = F.create_map(*[F.lit(x) for kv in S.ASSET_CODES.items() for x in kv])
    return table(spark, d, "quiver_missing_trades").select("vendor_no", F.coalesce(F.try_element_at(names, F.coalesce(F.upper(F.trim("tickertype")), F.lit(""))), "tickertype").alias("kind"))


@query("without_tags", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def without_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", S.without_tags(F.col("text")).alias("text"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("version_hash", "SELECT line_no, substr(sha256(concat_ws(chr(10), coalesce(asset_description, ''), 'm1')), 1, 16) AS version FROM ocr_lines_2022")
def version_hash(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.versioned(F.coalesce("asset_description", F.lit("")), F.lit("m1")).alias("version"))


@query("example_row", "SELECT line_no, contains(s, 'seeattached') OR contains(s, 'illegible') AS example FROM (SELECT line_no, regexp_replace(lower(coalesce(asset_description, '')), '\\s+', '', 'g') AS s FROM ocr_lines_2022)")
def example_row(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.example_row(F.col("asset_description"), ("See attached", "illegible")).alias("example"))


@query("trimmed_description", "SELECT doc_id, trim(regexp_replace(text, '\\s{2,}(?:company:|description:|rate/coupon|matures:|comment).*$', '', 'is'), ' ') AS text FROM (SELECT doc_id, replace(text, '. ', '  Comment ') AS text FROM documents)")
def trimmed_description(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("  Comment ")).alias("text"))
    return x.select("doc_id", S.trimmed_description(F.col("text")).alias("text"))


@query("with_option", "SELECT line_no, CASE WHEN regexp_matches(asset_description, '\\b(call|put)\\b', 'i') THEN 'Option' ELSE 'Stock' END AS kind FROM ocr_lines_2022")
def with_option(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.with_option(F.lit("Stock"), F.col("asset_description")).alias("kind"))


@query("corpus_label", "SELECT txn_id, CASE chamber || ' ' || CASE WHEN provenance LIKE '%ocr%' THEN 'scan' ELSE 'form' END WHEN 'House form' THEN 'House electronic' WHEN 'House scan' THEN 'House scanned' WHEN 'Senate form' THEN 'Senate electronic' ELSE '(other)' END AS corpus FROM disclosures")
def corpus_label(spark, d):
    names = {"House form": "House electronic", "House scan": "House scanned", "Senate form": "Senate electronic"}
    kind = F.concat("chamber", F.lit(" "), F.when(F.col("provenance").contains("ocr"), "scan").otherwise("form"))
    return table(spark, d, "disclosures").select("txn_id", S.label_of(kind, names).alias("corpus"))


@query("unaccented_key", "SELECT ptr_no, trim(regexp_replace(lower(declarant_name), '[^a-z]+', ' ', 'g')) AS name FROM ptr_index")
def unaccented_key(spark, d):
    return table(spark, d, "ptr_index").select("ptr_no", S.unaccented_key(F.col("declarant_name")).alias("name"))


@query("senate_op", """
SELECT vendor_no, CASE WHEN s LIKE 'p%' THEN 'Purchase' WHEN s LIKE '%exchange%' THEN 'Exchange' WHEN s LIKE '%partial%' THEN 'Sale (Partial)' WHEN s LIKE '%full%' THEN 'Sale (Full)' WHEN s LIKE 's%' THEN 'Sale' ELSE trim(transaction) END AS operation
FROM (SELECT vendor_no, transaction, lower(trim(transaction)) AS s FROM quiver_missing_trades)""")
def senate_op(spark, d):
    return table(spark, d, "quiver_missing_trades").select("vendor_no", S.senate_op(F.col("transaction")).alias("operation"))


@query("last_term_key", "SELECT version_no, coalesce(-year(valid_to), -9999) AS key FROM filer_history")
def last_term_key(spark, d):
    return table(spark, d, "filer_history").select("version_no", S.last_term_key(F.col("valid_to")).cast("long").alias("key"))


@query("utc_day", "SELECT ptr_no, CAST(received_at AS DATE) AS day, CAST(received_at - INTERVAL 5 HOUR AS DATE) AS shifted FROM ptr_index")
def utc_day(spark, d):
    at = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "ptr_index").select("ptr_no", S.utc_day(at).alias("day"), S.utc_day(F.concat(at, F.lit("+05:00"))).alias("shifted"))


@query("bound_without_sign", "SELECT txn_id, greatest(coalesce(CAST(nullif(replace(regexp_extract(replace(amount_range, '$', ''), '(\\d[\\d,]*)', 1), ',', ''), '') AS DOUBLE), 1001.0), 1001.0) AS low FROM disclosures")
def bound_without_sign(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.bound_without_sign(F.replace("amount_range", F.lit("$"), F.lit(""))).alias("low"))


@query("percent", "SELECT chamber, round_even(100.0::DOUBLE * count(ticker) / nullif(count(*), 0), 1) AS with_ticker, CAST(NULL AS DOUBLE) AS of_none FROM disclosures GROUP BY chamber")
def percent(spark, d):
    x = table(spark, d, "disclosures").groupBy("chamber").agg(F.count("ticker").alias("t"), F.count(F.lit(1)).alias("n"))
    return x.select("chamber", S.percent(F.col("t"), F.col("n")).alias("with_ticker"), S.percent(F.col("t"), F.lit(0)).alias("of_none"))


@query("misread_names", "SELECT line_no, regexp_replace(regexp_replace(n, '\\bDEVLCES\\b', 'DEVICES', 'g'), '\\bH0LDINGS\\b', 'HOLDINGS', 'g') AS name FROM (SELECT line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(asset_description, '')), '(?:-|\\()\\s*([A-Z](?:[A-Z0-9]|[.]){0,5})[)]?\\s*$', ''), '[^A-Z0-9 &]', ' ', 'g'), '\\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LLC|LP|NV|SA|HOLDINGS|GROUP|CLASS [A-C]|COMMON STOCK|COMMON|STOCK)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM ocr_lines_2022)")
def misread_names(spark, d):
    return table(spark, d, "ocr_lines_2022").select("line_no", S.asset_name(F.col("asset_description"), {"DEVLCES": "DEVICES", "H0LDINGS": "HOLDINGS"}).alias("name"))


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
