"""Queries along time, each with SQL that states the same rule independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.functions.ids import slug
from tradeloom.operators import temporal as T
from tradeloom.plans.registry import Registry
from tradeloom.session import table

query = Registry()


_BUYS = """
WITH b AS (SELECT *, (SELECT min(s.transaction_date) FROM disclosures s WHERE s.bioguide_id = x.bioguide_id AND s.ticker = x.ticker AND s.operation_type ILIKE '%sale%' AND s.transaction_date > x.transaction_date) AS sold
  FROM disclosures x WHERE operation_type ILIKE '%purchase%' AND ticker IS NOT NULL AND bioguide_id IS NOT NULL AND transaction_date IS NOT NULL) """


@query("first_sale_after", _BUYS + "SELECT txn_id, sold FROM b")
def first_sale_after(spark, d):
    return T.purchases_with_exit(table(spark, d, "disclosures")).select("txn_id", "sold")


def _outcome(by: str) -> str:
    return _BUYS + f""", w AS (SELECT max(transaction_date) AS e FROM disclosures), z AS (SELECT {by}, CASE WHEN sold <= transaction_date + INTERVAL 365 DAY THEN 'sold' WHEN transaction_date + INTERVAL 365 DAY > (SELECT e FROM w) THEN 'recent' ELSE 'held' END AS st FROM b)
SELECT {by}, count(*) AS buys, count_if(st = 'sold') AS sold, count_if(st = 'held') AS held, count_if(st = 'recent') AS recent, CASE WHEN count_if(st <> 'recent') > 0 THEN count_if(st = 'sold') / count_if(st <> 'recent') END AS sold_rate FROM z GROUP BY {by}"""


@query("purchase_outcome_by_chamber", _outcome("chamber"))
def purchase_outcome_by_chamber(spark, d):
    return T.purchase_outcome(table(spark, d, "disclosures"), "chamber")


@query("purchase_outcome_by_corpus", _outcome("provenance"))
def purchase_outcome_by_corpus(spark, d):
    return T.purchase_outcome(table(spark, d, "disclosures"), "provenance")


_SLUG = "nullif(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


@query("term_at_date", f"""
WITH j AS (SELECT t.trade_no, h.version_no, h.valid_from, CASE WHEN h.valid_from <= t.transaction_date AND (h.valid_to IS NULL OR t.transaction_date < h.valid_to) THEN 0 WHEN h.valid_from <= t.transaction_date THEN 1 ELSE 2 END AS how
  FROM open_trades t JOIN filer_history h ON {_SLUG.format("t.filer_id")} = {_SLUG.format("h.filer_id")} WHERE t.transaction_date IS NOT NULL AND h.valid_from IS NOT NULL)
SELECT trade_no, version_no, how FROM j QUALIFY row_number() OVER (PARTITION BY trade_no ORDER BY how, CASE WHEN how = 1 THEN -epoch(valid_from) ELSE epoch(valid_from) END, version_no) = 1""")
def term_at_date(spark, d):
    t, h = table(spark, d, "open_trades").withColumn("who", slug(F.col("filer_id"))), table(spark, d, "filer_history").withColumn("who", slug(F.col("filer_id")))
    return T.term_at(t, h, "trade_no", "who", "transaction_date", "version_no", "valid_from", "valid_to")


@query("leaders_at_date", f"""
SELECT trade_no FROM open_trades t WHERE EXISTS (SELECT 1 FROM filer_history h WHERE {_SLUG.format("t.filer_id")} = {_SLUG.format("h.filer_id")} AND h.committee_membership LIKE '%Ways and Means%'
  AND (h.valid_from IS NULL OR t.transaction_date >= h.valid_from) AND (h.valid_to IS NULL OR t.transaction_date <= h.valid_to))""")
def leaders_at_date(spark, d):
    t, h = table(spark, d, "open_trades").withColumn("who", slug(F.col("filer_id"))), table(spark, d, "filer_history").withColumn("who", slug(F.col("filer_id")))
    return T.active_at(t, h.where(F.col("committee_membership").contains("Ways and Means")), "who", "transaction_date", "valid_from", "valid_to").select("trade_no")


_CONGRESS = "CAST(113 + floor((year(transaction_date) - 2013) / 2.0) AS INTEGER)"


@query("key_flag_by_congress", f"SELECT bioguide_id, {_CONGRESS} AS congress, avg(committees_key_flag::INT) >= 0.5 AS key_member FROM disclosures WHERE bioguide_id IS NOT NULL AND transaction_date IS NOT NULL AND committees_key_flag IS NOT NULL GROUP BY ALL")
def key_flag_by_congress(spark, d):
    return T.key_flag_by_congress(table(spark, d, "disclosures"))


@query("committees_at_trade", f"""
WITH s AS (SELECT bioguide_id, {_CONGRESS} AS congress, committee_membership AS committees FROM disclosures WHERE bioguide_id IS NOT NULL AND transaction_date IS NOT NULL AND committee_membership IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY bioguide_id, congress ORDER BY transaction_date DESC, txn_id DESC) = 1)
SELECT x.txn_id, s.committees FROM (SELECT txn_id, bioguide_id, {_CONGRESS} AS congress FROM disclosures) x LEFT JOIN s ON s.bioguide_id = x.bioguide_id AND s.congress = x.congress""")
def committees_at_trade(spark, d):
    x = table(spark, d, "disclosures")
    s = T.committees_by_congress(x)
    return x.select("txn_id", "bioguide_id", S.congress_of(F.year("transaction_date")).alias("congress")).join(s, ["bioguide_id", "congress"], "left").select("txn_id", "committees")


@query("conviction", """
SELECT txn_id, CAST((SELECT count(DISTINCT y.bioguide_id) FROM disclosures y WHERE y.ticker = x.ticker AND y.operation_type = 'Purchase' AND y.transaction_date BETWEEN x.transaction_date - INTERVAL 30 DAY AND x.transaction_date + INTERVAL 30 DAY) AS INTEGER) AS members
FROM disclosures x WHERE operation_type = 'Purchase' AND ticker IS NOT NULL AND transaction_date IS NOT NULL""")
def conviction(spark, d):
    buys = table(spark, d, "disclosures").where("operation_type = 'Purchase' AND ticker IS NOT NULL AND transaction_date IS NOT NULL")
    return T.distinct_in_span(buys, "ticker", "transaction_date", "bioguide_id", 30, 30, "members").select("txn_id", "members")


@query("sector_breadth", """
WITH d AS (SELECT DISTINCT sector_gics, transaction_date FROM disclosures WHERE operation_type = 'Purchase' AND sector_gics IS NOT NULL AND transaction_date IS NOT NULL)
SELECT d.sector_gics, d.transaction_date, CAST((SELECT count(DISTINCT y.bioguide_id) FROM disclosures y WHERE y.sector_gics = d.sector_gics AND y.operation_type = 'Purchase' AND y.transaction_date BETWEEN d.transaction_date - INTERVAL 90 DAY AND d.transaction_date) AS INTEGER) AS members FROM d""")
def sector_breadth(spark, d):
    buys = table(spark, d, "disclosures").where("operation_type = 'Purchase' AND sector_gics IS NOT NULL AND transaction_date IS NOT NULL")
    return T.distinct_in_span(buys, "sector_gics", "transaction_date", "bioguide_id", 90, 0, "members").select("sector_gics", "transaction_date", "members").distinct()


@query("hybrid_history", """
SELECT 'vendor' AS origin, vendor_no AS row_no, traded AS day FROM quiver_missing_trades WHERE traded < DATE '2020-01-01' UNION ALL SELECT 'ours', txn_id, transaction_date FROM disclosures WHERE transaction_date >= DATE '2020-01-01'""")
def hybrid_history(spark, d):
    v = table(spark, d, "quiver_missing_trades").where("traded < DATE '2020-01-01'").select(F.lit("vendor").alias("origin"), F.col("vendor_no").alias("row_no"), F.col("traded").alias("day"))
    return v.unionByName(table(spark, d, "disclosures").where("transaction_date >= DATE '2020-01-01'").select(F.lit("ours").alias("origin"), F.col("txn_id").alias("row_no"), F.col("transaction_date").alias("day")))


@query("next_trading_day", """
WITH c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity > 49 AND CAST(l_shipdate AS DATE) >= DATE '1995-06-17') SELECT o_orderkey, day AS trading_day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) ASOF LEFT JOIN c ON c.day >= d""")
def next_trading_day(spark, d):
    """The calendar starts years after the first orders, all of which get its first day, and ends before the last ones."""
    days = table(spark, d, "lineitem").where("l_quantity > 49 AND CAST(l_shipdate AS DATE) >= DATE '1995-06-17'").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return T.with_trading_day(o, "d", days).select("o_orderkey", "trading_day")


@query("jurisdiction", "SELECT txn_id, coalesce(" + " OR ".join(f"(committee_membership LIKE '%{w}%' AND sector_gics IN ({', '.join(repr(x) for x in xs)}))" for w, xs in S.JURISDICTION) + ", false) AS aligned FROM disclosures")
def jurisdiction(spark, d):
    return table(spark, d, "disclosures").select("txn_id", S.within_jurisdiction(F.col("committee_membership"), F.col("sector_gics")).alias("aligned"))


@query("member_lookup", "SELECT v.vendor_no, m.party, m.committee_membership, coalesce(m.committee_membership LIKE '%Ways and Means%' OR m.committee_membership LIKE '%Financial Services%', false) AS key_member FROM quiver_missing_trades v LEFT JOIN members m ON m.bioguide_id = v.bioguideid")
def member_lookup(spark, d):
    m = table(spark, d, "members").select("bioguide_id", "party", "committee_membership")
    v = table(spark, d, "quiver_missing_trades").select("vendor_no", F.col("bioguideid").alias("bioguide_id")).join(m, "bioguide_id", "left")
    key = F.coalesce(F.col("committee_membership").rlike("Ways and Means|Financial Services"), F.lit(False))
    return v.select("vendor_no", "party", "committee_membership", key.alias("key_member"))


@query("vendor_sectors", "SELECT asset_id, CASE sector_gics " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**{v: v for v in S.VENDOR_SECTORS.values()}, **S.VENDOR_SECTORS}.items()) + " END AS sector FROM asset_reference")
def vendor_sectors(spark, d):
    return table(spark, d, "asset_reference").select("asset_id", S.gics_sector(F.col("sector_gics")).alias("sector"))


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
