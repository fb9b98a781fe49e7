"""Queries over the core operators for problems 2 and 6, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.ids import slug
from tradeloom.operators.asof_state import versions_in_force, with_attributes
from tradeloom.operators.heavy_keys import Measure, aggregate_by_key
from tradeloom.session import table

TOTALS = (Measure("trades", "count"), Measure("total_trade_size_usd", "sum", "trade_size_usd"), Measure("first_traded", "min", "traded"), Measure("last_traded", "max", "traded"))
AS_OF = {"event_entity": "filer_id", "event_date": "transaction_date", "version_entity": "filer_id", "entity_key": slug}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions_in_force(table(spark, sf_dir, "open_trades"), table(spark, sf_dir, "filer_history"), "trade_no", version_id="version_no", **AS_OF)
    return found.where(F.col("version_no").isNotNull())


def p2_trades_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_attributes(
        table(spark, sf_dir, "open_trades"), table(spark, sf_dir, "filer_history"), "trade_no", "version_no", ("party", "state", "district", "committee_membership"), **AS_OF
    )
    return out.select("trade_no", "filer_id", "transaction_date", "asof_version_no", "asof_party", "asof_state", "asof_district", "asof_committee_membership")


def p6_member_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_by_key(table(spark, sf_dir, "quiver_missing_trades"), "bioguideid", TOTALS)


def p6_member_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_by_key(
        table(spark, sf_dir, "quiver_missing_trades"), "bioguideid", TOTALS, table(spark, sf_dir, "members"), "bioguide_id", ("last_name", "state", "term_start")
    )


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_trades_with_attributes, p6_member_totals, p6_member_profiles)}


_SLUG = "nullif(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_IN_FORCE = f"""
SELECT trade_no, version_no FROM (
  SELECT t.trade_no, v.version_no, row_number() OVER (PARTITION BY t.trade_no ORDER BY v.valid_from DESC, v.recorded_at DESC, v.version_no DESC) AS rn
  FROM open_trades t JOIN filer_history v ON {_SLUG.format("t.filer_id")} = {_SLUG.format("v.filer_id")}
   AND v.valid_from <= t.transaction_date AND (v.valid_to IS NULL OR t.transaction_date < v.valid_to)
   AND v.recorded_at <= CAST(t.transaction_date AS TIMESTAMP)) WHERE rn = 1"""
_TOTALS = "count(*) AS trades, sum(trade_size_usd) AS total_trade_size_usd, min(traded) AS first_traded, max(traded) AS last_traded"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _IN_FORCE,
        "p2_trades_with_attributes": f"""
WITH f AS ({_IN_FORCE})
SELECT t.trade_no, t.filer_id, t.transaction_date, f.version_no AS asof_version_no, v.party AS asof_party, v.state AS asof_state,
  v.district AS asof_district, v.committee_membership AS asof_committee_membership
FROM open_trades t LEFT JOIN f USING (trade_no) LEFT JOIN filer_history v ON v.version_no = f.version_no""",
        "p6_member_totals": f"SELECT bioguideid, {_TOTALS} FROM quiver_missing_trades GROUP BY bioguideid",
        "p6_member_profiles": f"""
SELECT g.*, m.last_name, m.state, m.term_start
FROM (SELECT bioguideid, {_TOTALS} FROM quiver_missing_trades GROUP BY bioguideid) g LEFT JOIN members m ON m.bioguide_id = g.bioguideid""",
    }
