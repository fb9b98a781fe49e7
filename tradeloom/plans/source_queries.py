"""Queries on sources, parsers, enrichment and windows of events, each with SQL that states the same rule independently."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.operators import enrich as E
from tradeloom.plans.registry import Registry
from tradeloom.sources import parsers as P
from tradeloom.sources import tables as T
from tradeloom.session import shared_folder, table
from tradeloom.streaming import disclosures as W

query = Registry()

_OP = "CASE WHEN lower(operation_type) LIKE 'p%' THEN 'Purchase' WHEN operation_type ILIKE '%exchange%' THEN 'Exchange' WHEN operation_type ILIKE '%partial%' THEN 'Sale (Partial)' WHEN operation_type ILIKE '%full%' THEN 'Sale (Full)' WHEN lower(operation_type) LIKE 's%' THEN 'Sale' ELSE operation_type END"
_SQUEEZED = "nullif(nullif(nullif(trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), ''), '--'), 'None')"


@query("parsed_reports", f"""
SELECT txn_id AS doc_id, 0 AS pos, CASE operation_type WHEN 'Purchase' THEN 'Purchase' WHEN 'Exchange' THEN 'Exchange' WHEN 'Sale (Partial)' THEN 'Sale (Partial)' WHEN 'Sale (Full)' THEN 'Sale (Full)' ELSE 'Sale' END AS operation,
  strftime(transaction_date, '%m/%d/%Y') AS transaction_date, strftime(disclosure_date, '%m/%d/%Y') AS notification_date, amount_range AS amount,
  upper(coalesce(list_filter(regexp_extract_all(regexp_replace(coalesce(asset_description, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '\\(([A-Za-z][A-Za-z0-9.\\-]{{0,6}})\\)', 1), lambda x: lower(x) NOT IN ('partial', 'full'))[1], ticker)) AS ticker
FROM disclosures WHERE transaction_date IS NOT NULL AND disclosure_date IS NOT NULL AND amount_range IS NOT NULL""")
def parsed_reports(spark, d):
    """Reports of all rows, with the upper bound of the amount and the kind on a later line; those without a date or an amount hold no transaction."""
    x = table(spark, d, "disclosures")
    day = lambda c: F.coalesce(F.date_format(c, "MM/dd/yyyy"), F.lit("--"))
    op = F.when(F.col("operation_type") == "Purchase", "P").when(F.col("operation_type") == "Exchange", "E").when(F.col("operation_type") == "Sale (Partial)", "S (partial)").when(F.col("operation_type") == "Sale (Full)", "S (full)").otherwise("S")
    owner = F.when(F.lower("owner") == "spouse", "SP ").otherwise("")
    bounds = F.split(F.coalesce("amount_range", F.lit("--")), " - ")
    symbol = F.coalesce(F.concat(F.lit(" ("), F.col("ticker"), F.lit(")")), F.lit(""))
    text = F.concat(
        F.lit("ID OWNER ASSET TRANSACTION\n\n"), owner, F.coalesce(F.regexp_replace("asset_description", r"\s+", " "), F.lit("")), symbol, F.lit("\n"), op, F.lit(" "), day("transaction_date"), F.lit(" "),
        day("disclosure_date"), F.lit(" "), bounds[0], F.when(F.size(bounds) > 1, F.concat(F.lit(" -\n[ST] "), F.get(bounds, F.lit(1)))).otherwise("\n[ST]"), F.lit("\n\nFiling Status: New\n"),
    )
    return P.parsed(x.select("txn_id", text.alias("text")), "txn_id", "text", P.parse_report).select("doc_id", "pos", "operation", "transaction_date", "notification_date", "amount", "ticker")


@query("parsed_tables", f"""
SELECT txn_id AS doc_id, 0 AS pos, {_SQUEEZED.format("owner")} AS owner, {_SQUEEZED.format("asset_description")} AS asset, {_SQUEEZED.format("ticker")} AS ticker, {_SQUEEZED.format("asset_type")} AS kind, {_OP} AS operation,
  strftime(transaction_date, '%m/%d/%Y') AS transaction_date, NULL::VARCHAR AS notification_date, {_SQUEEZED.format("amount_range")} AS amount FROM disclosures""")
def parsed_tables(spark, d):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td> "), F.coalesce(esc(c), F.lit("--")), F.lit("</td>"))
    other = F.lit("<table><tr><th>Filed</th></tr><tr><td>x</td></tr></table>")
    head = F.lit("<table><thead><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th></tr></thead><tr>")
    names = ("owner", "ticker", "asset_description", "asset_type", "operation_type", "amount_range")
    html = F.concat(other, head, cell(F.lit("1")), cell(F.date_format("transaction_date", "MM/dd/yyyy")), *[cell(F.col(c)) for c in names], F.lit("</tr></table>"), other)
    return P.parsed(table(spark, d, "disclosures").select("txn_id", html.alias("html")), "txn_id", "html", P.parse_tables)


@query("cached_lines", "SELECT coalesce(doc_id, '') AS doc_id, coalesce(batch, 0) AS batch, count(*) AS lines, count(asset_description) AS described FROM ocr_lines_2022 GROUP BY ALL")
def cached_lines(spark, d):
    """Every line, written as answers of the cache: finished batches, and beside each a failed one of the same lines, which gives no rows."""
    t = F.struct("asset_description", "transaction_type", "owner", F.col("transaction_date").cast("string").alias("transaction_date"), F.col("notification_date").cast("string").alias("notification_date"), F.lit(None).cast("string").alias("ticker"), "amount_code")
    x = table(spark, d, "ocr_lines_2022").withColumns({"doc_id": F.coalesce("doc_id", F.lit("")), "batch": F.coalesce("batch", F.lit(0))})
    b = x.groupBy("doc_id", "batch").agg(F.collect_list(t).alias("transactions"))  # the lines of one batch of pages
    b = b.withColumn("status", F.explode(F.array(F.lit("ok"), F.lit("failed"))))
    b = b.groupBy("doc_id").agg(F.collect_list(F.struct("batch", F.lit(1).alias("pages"), "status", "transactions")).alias("batches"))
    text = F.to_json(F.struct("doc_id", F.lit("m").alias("model"), F.lit("p").alias("prompt_sha"), F.lit("ok").alias("status"), "batches"))
    folder = _folder_for(spark, "cache")
    b.select(text.alias("value")).write.text(folder)
    return T.read_cache(spark, folder, "m", "p").groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("lines"), F.count("asset_description").alias("described"))


@query("envelopes", "SELECT vendor_no, ticker, trade_size_usd AS size FROM quiver_missing_trades")
def envelopes(spark, d):
    v = table(spark, d, "quiver_missing_trades")
    one = F.to_json(F.struct("vendor_no", "ticker", F.col("trade_size_usd").alias("size")))
    k = F.col("vendor_no") % 4
    text = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"results":['), one, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"data":['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"items":['), one, F.lit("]}")))
    return v.select(F.explode(T.envelope_rows(text, "struct<vendor_no:bigint,ticker:string,size:double>")).alias("r")).select("r.*")


@query("index_entries", "SELECT doc_id, last_name, disclosure_date AS filed FROM ptr_index WHERE filing_type = 'P' AND disclosure_date BETWEEN DATE '2016-01-01' AND DATE '2021-12-31'")
def index_entries(spark, d):
    """The index written as XML files and read again: filings of type P within a window of days."""
    x = table(spark, d, "ptr_index")
    x = x.select(F.col("last_name").alias("Last"), F.col("first_name").alias("First"), F.col("filing_type").alias("FilingType"), F.col("state_district").alias("StateDst"), F.year("disclosure_date").cast("string").alias("Year"), F.date_format("disclosure_date", "M/d/yyyy").alias("FilingDate"), F.col("doc_id").alias("DocID"))
    folder = _folder_for(spark, "index")
    x.write.format("xml").option("rowTag", "Member").option("rootTag", "Members").save(folder)
    return T.read_index(spark, folder, "2016-01-01", "2021-12-31").select(F.col("DocID").alias("doc_id"), F.col("Last").alias("last_name"), "filed")


@query("csv_years", "SELECT txn_id::VARCHAR AS txn_id, nullif(asset_description, '') AS asset_description, nullif(amount_range, '') AS amount_range FROM disclosures")
def csv_years(spark, d):
    """Written as one folder of CSV per chamber, read as one table of texts."""
    x = table(spark, d, "disclosures").select(F.col("txn_id").cast("string").alias("txn_id"), "asset_description", "amount_range", "chamber")
    folder = _folder_for(spark, "csv")
    for c in ("House", "Senate"):
        T.write_csv(x.where(F.col("chamber").eqNullSafe(c)).drop("chamber"), f"{folder}/{c}")
    T.write_csv(x.where(~F.coalesce(F.col("chamber").isin("House", "Senate"), F.lit(False))).drop("chamber"), f"{folder}/none")
    return T.read_csv(spark, [f"{folder}/{c}" for c in ("House", "Senate", "none")], ["txn_id", "asset_description", "amount_range"]).drop("file")


@query("partitioned_table", "SELECT chamber, coalesce(year(disclosure_date), 0) AS file_year, count(*) AS n, count(asset_description) AS described FROM disclosures GROUP BY ALL")
def partitioned_table(spark, d):
    x = table(spark, d, "disclosures").withColumn("file_year", F.coalesce(F.year("disclosure_date"), F.lit(0)))
    folder = _folder_for(spark, "table")
    T.write_table(x, folder, ["chamber", "file_year"])
    T.write_table(x.where("file_year = 2021"), folder, ["chamber", "file_year"])  # the same slices once more
    return spark.read.parquet(folder).groupBy("chamber", "file_year").agg(F.count(F.lit(1)).alias("n"), F.count("asset_description").alias("described"))


_PRICES = "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity) + 1e-7, 4) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


@query("price_files", _PRICES, "close")
def price_files(spark, d):
    """Prices written as a folder of CSV per ticker and read as one long table."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
    folder = _folder_for(spark, "prices")
    x.agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-7, 4).alias("close")).repartition("ticker").write.partitionBy("ticker").csv(folder, header=True)
    return T.read_prices(spark, folder)


@query("factor_file", "SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) AS mkt, avg(l_tax) AS smb, 0.0001 AS rf FROM lineitem GROUP BY 1", "mkt smb rf")
def factor_file(spark, d):
    """Daily factors in per cent, written as CSV and read as fractions."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((100 * F.avg("l_discount")).alias("Mkt-RF"), (100 * F.avg("l_tax")).alias("SMB"), F.lit(0.01).alias("RF"))
    folder = _folder_for(spark, "factors")
    x.write.csv(folder, header=True)
    return T.read_factors(spark, folder, {"Mkt-RF": "mkt", "SMB": "smb", "RF": "rf"})


@query("pending_documents", "SELECT DISTINCT doc_id FROM ptr_index WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM disclosures WHERE doc_id IS NOT NULL AND provenance NOT LIKE '%ocr%')")
def pending_documents(spark, d):
    """The backlog less what the cache holds finished under this version; scans count as failed here."""
    cache = table(spark, d, "disclosures").select("doc_id", F.lit("v1").alias("version"), F.when(F.col("provenance").contains("ocr"), "failed").otherwise("ok").alias("status"))
    return W.not_cached(table(spark, d, "ptr_index").select("doc_id").where("doc_id IS NOT NULL").distinct(), cache, "v1")


@query("merged_disclosures", "SELECT natural_key_hash, min(txn_id) AS txn_id FROM disclosures WHERE natural_key_hash IS NOT NULL GROUP BY 1")
def merged_disclosures(spark, d):
    """Trades delivered or filed again in later batches of a stream: one row per key, the first by number, over all batches."""
    path = f"{d}/disclosures.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(path if _folder(path) else f"{path}*")
    stream = stream.where("natural_key_hash IS NOT NULL").select("natural_key_hash", "txn_id")
    folder = _folder_for(spark, "merged")
    W.merge_batches(stream, f"{folder}/table", f"{folder}/state", ["natural_key_hash"], ["txn_id"])
    return W.read_merged(spark, f"{folder}/table", stream.schema)


@query("vendor_count_files", f"""
WITH v AS (SELECT trim(regexp_replace(lower(strip_accents(name)), '[^a-z]+', ' ', 'g')) AS n, count(*) AS vendor FROM quiver_missing_trades WHERE name IS NOT NULL GROUP BY 1) SELECT n AS name, vendor FROM v""")
def vendor_count_files(spark, d):
    """Another vendor's trades as JSON, a line each, counted by plain name."""
    folder = _folder_for(spark, "counts")
    table(spark, d, "quiver_missing_trades").select("name", "ticker").write.json(folder)
    return T.read_counts(spark, folder, "name").withColumnRenamed("n", "vendor")


@query("people", "SELECT bioguide_id, first_name, last_name, chamber, state, CAST(term_start AS VARCHAR) AS start FROM members WHERE bioguide_id IS NOT NULL")
def people(spark, d):
    """The members as a file of YAML (JSON is YAML), read back term by term."""
    x = table(spark, d, "members").where("bioguide_id IS NOT NULL")
    term = F.struct(F.col("chamber").alias("type"), "party", "state", "district", F.col("term_start").cast("string").alias("start"), F.lit("2030-01-03").alias("end"))
    one = F.struct(F.struct(F.col("bioguide_id").alias("bioguide")).alias("id"), F.struct(F.col("first_name").alias("first"), F.col("last_name").alias("last")).alias("name"), F.array(term).alias("terms"))
    folder = _folder_for(spark, "people")
    lines = x.select(F.concat(F.lit("- "), F.to_json(one)).alias("value"))
    lines.coalesce(1).write.text(folder)  # a small fixed table
    return T.read_people(spark, folder).select("bioguide_id", "first_name", "last_name", "chamber", "state", "start")


@query("first_column", "SELECT vendor_no, ticker AS symbol, NULL::VARCHAR AS none FROM quiver_missing_trades")
def first_column(spark, d):
    x = table(spark, d, "quiver_missing_trades")
    return x.select("vendor_no", T.first_column(x, ["symbol", "ticker", "tickertype"]).alias("symbol"), T.first_column(x, ["nope"]).alias("none"))


@query("with_tenure", "SELECT txn_id, CASE WHEN year(transaction_date) >= year(term_start) THEN year(transaction_date) - year(term_start) END AS tenure FROM disclosures LEFT JOIN members USING (bioguide_id)")
def with_tenure(spark, d):
    """One more column, added once however often it is asked for."""
    m = table(spark, d, "members").select("bioguide_id", "term_start")
    x = table(spark, d, "disclosures").select("txn_id", "bioguide_id", "transaction_date").join(m, "bioguide_id", "left")
    for _ in range(2):
        x = T.add_once(x, "tenure", S.tenure(F.col("term_start"), F.col("transaction_date")))
    return x.select("txn_id", "tenure")


@query("years_asked", "SELECT txn_id FROM disclosures WHERE year(disclosure_date) IN (2018, 2019, 2020, 2022)")
def years_asked(spark, d):
    return table(spark, d, "disclosures").where(F.year("disclosure_date").isin(*S.year_range("2018-2020, 2022"))).select("txn_id")


_PLAIN = "trim(regexp_replace(lower(strip_accents({})), '[^a-z]+', ' ', 'g'))"
_MEMBERS = f"m AS (SELECT *, {_PLAIN.format('last_name')} AS l, {_PLAIN.format('first_name')} AS f, {_PLAIN.format('nickname')} AS k, {_PLAIN.format('middle_name')} AS mi FROM members)"


@query("matched_filers", f"""
WITH {_MEMBERS}, p AS (SELECT ptr_no, {_PLAIN.format('last_name')} AS l, {_PLAIN.format('first_name')} AS f FROM ptr_index),
w AS (SELECT ptr_no, bioguide_id, 1 AS pr FROM p JOIN m USING (l, f) WHERE f <> '' UNION ALL SELECT ptr_no, bioguide_id, 2 FROM p JOIN m ON p.l = m.l AND p.f = m.k WHERE k <> '' UNION ALL SELECT ptr_no, bioguide_id, 3 FROM p JOIN m ON p.l = m.l AND p.f = m.mi WHERE mi <> ''
  UNION ALL SELECT ptr_no, bioguide_id, 4 FROM p JOIN m ON p.l = m.l AND p.f = trim(m.f || ' ' || coalesce(m.mi, '')) UNION ALL SELECT ptr_no, bioguide_id, 5 FROM p JOIN (SELECT l, min(bioguide_id) AS bioguide_id FROM m GROUP BY l HAVING count(*) = 1) u ON u.l = p.l),
t AS (SELECT ptr_no, pr, min(bioguide_id) AS b FROM w GROUP BY ALL HAVING count(DISTINCT bioguide_id) = 1)
SELECT p.ptr_no, b AS bioguide_id, ['first', 'nickname', 'middle', 'both', 'last'][pr] AS how FROM p LEFT JOIN (FROM t QUALIFY row_number() OVER (PARTITION BY ptr_no ORDER BY pr) = 1) USING (ptr_no)""")
def matched_filers(spark, d):
    return E.match_filers(table(spark, d, "ptr_index"), table(spark, d, "members"), "ptr_no", "last_name", "first_name")


@query("matched_in_chamber", f"""
WITH {_MEMBERS}, p AS (SELECT ptr_no, {_PLAIN.format('last_name')} AS l, {_PLAIN.format('first_name')} AS f, CASE WHEN length(state_district) = 2 THEN 'Senate' WHEN length(state_district) > 2 THEN 'House' END AS c FROM ptr_index),
x AS (SELECT p.ptr_no, m.bioguide_id, (p.c = m.chamber)::INT AS home, left(p.f, 3) = left(m.f, 3) AS alike FROM p JOIN m ON p.l = m.l),
y AS (SELECT * FROM x QUALIFY home = max(home) OVER (PARTITION BY ptr_no) OR home IS NULL), z AS (SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY ptr_no) = 1 OR alike)
SELECT p.ptr_no, q.bioguide_id FROM p LEFT JOIN (SELECT ptr_no, min(bioguide_id) AS bioguide_id FROM z GROUP BY 1 HAVING count(DISTINCT bioguide_id) = 1) q USING (ptr_no)""")
def matched_in_chamber(spark, d):
    n = F.length("state_district")
    p = table(spark, d, "ptr_index").withColumn("in", F.when(n == 2, "Senate").when(n > 2, "House"))
    return E.match_in_chamber(p, table(spark, d, "members"), "ptr_no", "last_name", "first_name", "in")


@query("vendor_counts_by_name", f"""
WITH o AS (SELECT {_PLAIN.format('declarant_name')} AS n, count(*) AS ours FROM disclosures GROUP BY 1), v AS (SELECT {_PLAIN.format('name')} AS n, count(*) AS vendor FROM quiver_missing_trades WHERE name IS NOT NULL GROUP BY 1)
SELECT n AS name, ours, coalesce(vendor, 0) AS vendor FROM o LEFT JOIN v USING (n)""")
def vendor_counts_by_name(spark, d):
    o = table(spark, d, "disclosures").groupBy(S.plain_name(F.col("declarant_name")).alias("name")).agg(F.count(F.lit(1)).alias("ours"))
    v = table(spark, d, "quiver_missing_trades").where("name IS NOT NULL").groupBy(S.plain_name(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("vendor"))
    return o.join(v, "name", "left").select("name", "ours", F.coalesce("vendor", F.lit(0)).alias("vendor"))


_NAME = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(asset_description, '')), '(?:-|\\()\\s*([A-Z](?:[A-Z0-9]|[.]){{0,5}})[)]?\\s*$', ''), '[^A-Z0-9 &]', ' ', 'g'), '{S.CORPORATE}', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("ticker_cascade", f"""
WITH d AS (SELECT name, ticker FROM (SELECT {_NAME} AS name, ticker, count(*) AS n FROM disclosures WHERE trim(coalesce(ticker, '')) NOT IN ('', 'nan') GROUP BY ALL) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, ticker) = 1),
l AS (SELECT line_no, nullif({_NAME}, '') AS name, trim(regexp_extract(coalesce(asset_description, ''), '(?:-|\\()\\s*([A-Z](?:[A-Z0-9]|[.]){{0,5}})[)]?\\s*$', 1), '.') AS e0, nullif(regexp_extract(trim(coalesce(asset_description, '')), '^([A-Z]{{1,5}})(?:[.][A-Z])?(?:\\s+(?:PUT|CALL))?$', 1), '') AS w FROM ocr_lines_2022),
x AS (SELECT *, CASE WHEN length(e0) BETWEEN 1 AND 5 THEN e0 END AS e FROM l)
SELECT line_no, coalesce(e, w, d.ticker) AS ticker, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN w IS NOT NULL THEN 'asset_name' WHEN d.ticker IS NOT NULL THEN 'dictionary' ELSE 'none' END AS source FROM x LEFT JOIN d USING (name)""")
def ticker_cascade(spark, d):
    return E.resolve_tickers(table(spark, d, "ocr_lines_2022"), E.ticker_dictionary(table(spark, d, "disclosures")), "line_no", "asset_description")


@query("recovered_tickers", f"""
WITH d AS (SELECT name, ticker FROM (SELECT {_NAME} AS name, ticker, count(*) AS n FROM disclosures WHERE trim(coalesce(ticker, '')) NOT IN ('', 'nan') GROUP BY ALL) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, ticker) = 1)
SELECT txn_id, coalesce(x.ticker, d.ticker) AS ticker, CASE WHEN x.ticker IS NULL AND d.ticker IS NOT NULL THEN 'recovered' WHEN trim(coalesce(ticker_source, '')) NOT IN ('', 'nan') THEN ticker_source WHEN x.ticker IS NOT NULL THEN 'explicit' ELSE 'none' END AS source
FROM (SELECT *, nullif({_NAME}, '') AS name FROM disclosures) x LEFT JOIN d USING (name)""")
def recovered_tickers(spark, d):
    x = table(spark, d, "disclosures")
    known = E.ticker_dictionary(x).select(F.col("name").alias("n__"), F.col("ticker").alias("r__"))
    x = x.select("txn_id", "ticker", "ticker_source", F.nullif(S.asset_name(F.col("asset_description")), F.lit("")).alias("n")).join(known, F.col("n") == F.col("n__"), "left")
    source = F.when(F.col("ticker").isNull() & F.col("r__").isNotNull(), "recovered").otherwise(E.implied_source(F.col("ticker"), F.col("ticker_source")))
    return x.select("txn_id", F.coalesce("ticker", "r__").alias("ticker"), source.alias("source"))


@query("sector_cascade", """
WITH s AS (SELECT ticker, min(sector_gics) AS sector FROM asset_reference WHERE ticker IS NOT NULL AND sector_gics IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT ticker, CASE WHEN ticker LIKE 'A%' THEN NULL ELSE 'Energy' END AS sector FROM asset_reference WHERE ticker LIKE 'A%A' OR ticker LIKE 'B%B')
SELECT d.txn_id, CASE WHEN o.ticker IS NOT NULL THEN o.sector ELSE s.sector END AS sector, CASE WHEN o.ticker IS NOT NULL THEN 'manual' WHEN s.sector IS NOT NULL THEN 'table' ELSE 'none' END AS sector_from FROM disclosures d LEFT JOIN s USING (ticker) LEFT JOIN o USING (ticker)""")
def sector_cascade(spark, d):
    r = table(spark, d, "asset_reference").where("ticker IS NOT NULL")
    sectors = r.where("sector_gics IS NOT NULL").groupBy("ticker").agg(F.min("sector_gics").alias("sector"))
    overrides = r.where("ticker LIKE 'A%A' OR ticker LIKE 'B%B'").select("ticker", F.when(~F.col("ticker").startswith("A"), F.lit("Energy")).alias("sector")).distinct()
    return E.resolve_sectors(table(spark, d, "disclosures").select("txn_id", "ticker"), sectors, overrides).select("txn_id", "sector", "sector_from")


@query("fixed_dates", """
SELECT txn_id, CASE WHEN regexp_replace(doc_id, '\\.0$', '') = (SELECT min(doc_id) FROM disclosures) AND ticker = 'AADA' AND transaction_date = DATE '2020-01-02' THEN DATE '2020-01-03' WHEN transaction_date = DATE '2021-03-04' THEN DATE '2021-04-03' ELSE transaction_date END AS date FROM disclosures""")
def fixed_dates(spark, d):
    x = table(spark, d, "disclosures")
    day = lambda s: F.lit(s).cast("date")
    everywhere = spark.range(1).select(day("2021-03-04").alias("wrong"), day("2021-04-03").alias("right"))
    scoped = x.agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit("AADA").alias("ticker"), day("2020-01-02").alias("wrong"), day("2020-01-03").alias("right"))
    return E.fixed_dates(x.select("txn_id", "doc_id", "ticker", "transaction_date"), everywhere, scoped, "transaction_date", "doc_id", "ticker").select("txn_id", F.col("transaction_date").alias("date"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL", "value")
def event_windows(spark, d):
    return W.windowed_activity(table(spark, d, "events"))


@query("event_sessions", """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events), b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def event_sessions(spark, d):
    return W.sessions(table(spark, d, "events"))


@query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL", "value")
def stream_windows(spark, d):
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _folder(path) else f"{d}/events.parquet*")
    folder = _folder_for(spark, "stream_windows")
    return W.run_totals(W.windowed_activity(stream, "1 day", "40 days"), f"{folder}/out", f"{folder}/state")


def _folder_for(spark, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(path: str) -> bool:
    import os

    return os.path.isdir(path)


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
