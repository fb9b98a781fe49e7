"""Queries on the choice of members and what comes of it: walk-forward portfolios, full tables of event studies, styles and the measures around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import scalars as S
from tradeloom.operators import inference as I
from tradeloom.operators import market as M
from tradeloom.operators.quality import covered_share
from tradeloom.operators.ranks import quantiles
from tradeloom.plans import market_queries as Q
from tradeloom.plans.registry import Registry
from tradeloom.session import checkpointed, table

_HELD = Q._BASE[Q._BASE.index("held AS (") : Q._BASE.index("ev AS (")]
query = Registry(Q._BASE)
_STATS = """SELECT portfolio, count(*) AS days, sum(ln(1 + net)) * 252 / count(*) AS log_growth, stddev_samp(net) * sqrt(252) AS vol, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe,
  avg(net) / (stddev_samp(net) FILTER (net < -1e-12)) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM (SELECT *, e / max(e) OVER (PARTITION BY portfolio ORDER BY idx) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY portfolio ORDER BY idx)) AS e FROM pf)) GROUP BY portfolio"""


def _keys(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("key"))


def _ranked(spark, d) -> DataFrame:
    s = Q._composite(spark, d).withColumn("composite", F.round("composite", 9))
    return s.join(_keys(spark, d), "member").select("decision_year", "member", "key", "composite")


# the rule of the quota by hand for each k: candidates met before, of either kind
_CANDIDATES = f"""(SELECT *, row_number() OVER y AS rn, coalesce(sum(key::INT) OVER b, 0) AS kb, coalesce(sum((NOT key)::INT) OVER b, 0) AS ub FROM (SELECT decision_year, member, round(composite, 9) AS composite, c_mktsegment IN ('BUILDING', 'MACHINERY') AS key
  FROM ({Q._COMPOSITE}) JOIN customer ON c_custkey = member) WINDOW y AS (PARTITION BY decision_year ORDER BY composite DESC, member), b AS (PARTITION BY decision_year ORDER BY composite DESC, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _chosen(k: int) -> str:
    beyond = k - -(-k // 2)
    return f"SELECT decision_year, member, CAST(row_number() OVER (PARTITION BY decision_year ORDER BY composite DESC, member) AS INTEGER) AS place FROM {_CANDIDATES} WHERE key OR kb < {beyond} OR ub < {beyond} QUALIFY place <= {k}"


@query("selected_members", _chosen(7))
def selected_members(spark, d):
    return I.select_members(_ranked(spark, d), "composite", 7)


_GRID, _WEIGHTS = (4, 5, 8, 10), ("equal", "size")
grid = Registry(Q._BASE.replace(_HELD, "held AS (SELECT portfolio, ticker, entry, exit, raw FROM (SELECT unnest(['top' || n || ' equal', 'top' || n || ' size']) AS portfolio, ticker, entry, exit, unnest([1.0::DOUBLE, size_usd]) AS raw FROM pos JOIN (" + " UNION ALL ".join(f"SELECT {k} AS n, decision_year, member FROM ({_chosen(k)})" for k in _GRID) + ") s ON s.member = pos.member AND s.decision_year = year(entry) - 1)),\n"))


@grid("walk_forward_grid", _STATS, "log_growth vol sharpe sortino max_drawdown")
def walk_forward_grid(spark, d):
    """For 4, 5, 8 and 10 members a year under their quota, and two weightings: the purchases of those chosen on the year before, simulated, all in one job."""
    scores = checkpointed(_ranked(spark, d))
    chosen = None
    for k in _GRID:
        s = I.select_members(scores, "composite", k).select("decision_year", F.col("member").alias("m__"), F.lit(k).alias("k"))
        chosen = s if chosen is None else chosen.unionByName(s)
    held = M.positions(Q.trades(spark, d)).join(chosen, (F.col("member") == F.col("m__")) & (F.year("entry") - 1 == F.col("decision_year")))
    ways = F.array(*[F.struct(F.concat(F.lit("top"), F.col("k"), F.lit(f" {w}")).alias("portfolio"), M.raw_weight(w).alias("raw")) for w in _WEIGHTS])
    held = held.select("ticker", "entry", "exit", F.explode(ways).alias("w")).select("w.*", "ticker", "entry", "exit")
    return M.annual_stats(M.portfolio_days(held, checkpointed(Q.prices(spark, d)))).withColumn("cagr", F.log1p("cagr")).withColumnRenamed("cagr", "log_growth")


sides = Registry(Q._BASE.replace(_HELD, "held AS (SELECT CASE op WHEN 'buy' THEN 'long' ELSE 'short' END AS portfolio, t.ticker, t.filed AS entry, x.date AS exit, size_usd AS raw FROM t ASOF LEFT JOIN cal e ON e.date >= t.filed + INTERVAL 1 DAY LEFT JOIN cal x ON x.idx = e.idx + 21 WHERE op IN ('buy', 'sell')),\n"))


@sides("long_short_fixed", "SELECT date, coalesce(sum(gross) FILTER (portfolio = 'long'), 0) - coalesce(sum(gross) FILTER (portfolio = 'short'), 0) AS gross, sum(cost) AS cost FROM pf GROUP BY date", "gross cost")
def long_short_fixed(spark, d):
    """What members bought against what they sold, each held for 21 trading days."""
    p = checkpointed(Q.prices(spark, d))
    cal = M.market_calendar(p)
    t = Q.trades(spark, d).where("op IN ('buy', 'sell')").withColumn("in__", F.date_add("filed", 1))
    t = M.with_next(t, "in__", cal, [], "idx", "i").join(cal.select((F.col("idx") - 21).alias("i"), F.col("date").alias("exit")), "i", "left")
    held = t.select(F.when(F.col("op") == "buy", "long").otherwise("short").alias("portfolio"), "ticker", F.col("filed").alias("entry"), "exit", F.col("size_usd").alias("raw"))
    x = M.portfolio_days(held, p).groupBy("date")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("portfolio") == s, F.col("gross"))), F.lit(0.0))
    return x.agg((side("long") - side("short")).alias("gross"), F.sum("cost").alias("cost"))


@query("portfolio_activity", "SELECT portfolio, min(date) AS active_from, avg(turnover) AS turnover, avg(holdings) AS avg_holdings, count(*) AS active_days FROM (SELECT portfolio, date, sum(abs(w - wp)) AS turnover, count_if(w > 0) AS holdings, min(min(CASE WHEN w > 0 THEN date END)) OVER (PARTITION BY portfolio) AS since FROM wp GROUP BY portfolio, date) WHERE date >= since GROUP BY portfolio", "turnover avg_holdings")
def portfolio_activity(spark, d):
    return M.activity(Q._portfolio(spark, d))


_BENCHES = "(SELECT 'all' AS benchmark, date, close FROM b UNION ALL SELECT 'typical', date, median(close) FROM p GROUP BY date UNION ALL SELECT 'large', CAST(l_shipdate AS DATE), round(avg(l_extendedprice / l_quantity) + 1e-7, 4) FROM lineitem WHERE l_quantity >= 40 GROUP BY 2)"


def _benches(spark, d) -> DataFrame:
    large = table(spark, d, "lineitem").where("l_quantity >= 40").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-7, 4).alias("close"))
    named = lambda x, n: x.select(F.lit(n).alias("benchmark"), "date", "close")
    typical = Q.prices(spark, d).groupBy("date").agg(F.median("close").alias("close"))
    return named(Q.bench(spark, d), "all").unionByName(named(typical, "typical")).unionByName(named(large, "large"))


@query("ar_by_benchmark", f"""SELECT horizon, benchmark, count(*) AS n, avg(ar) AS mean, median(ar) AS median, avg((ar > 0)::INT) AS positive, skewness(ar) AS skew FROM (
  SELECT x.trade_id, x.horizon, n.benchmark, CASE WHEN x.p0 > 0 THEN x.p1 / x.p0 - b1.close / b0.close END AS ar FROM (SELECT q.trade_id, h.horizon, a.date AS d0, a.close AS p0, c.date AS d1, c.close AS p1 FROM pos q ASOF JOIN own a ON a.ticker = q.ticker AND a.date >= q.entry
    CROSS JOIN (SELECT unnest([21, 63, 126, 252]) AS horizon) h JOIN own c ON c.ticker = q.ticker AND c.i = a.i + h.horizon) x CROSS JOIN (SELECT unnest(['all', 'typical', 'large']) AS benchmark) n
  ASOF JOIN {_BENCHES} b0 ON b0.benchmark = n.benchmark AND b0.date >= x.d0 ASOF JOIN {_BENCHES} b1 ON b1.benchmark = n.benchmark AND b1.date >= x.d1) WHERE ar IS NOT NULL GROUP BY ALL""", "mean median positive skew")
def ar_by_benchmark(spark, d):
    """Four horizons against three benchmarks in one pass."""
    x = M.abnormal_returns_against(Q.trades(spark, d).where("op = 'buy'"), checkpointed(Q.prices(spark, d)), checkpointed(_benches(spark, d)), [21, 63, 126, 252])
    a = F.col("ar")
    x = x.where("ar IS NOT NULL").groupBy("horizon", "benchmark")
    return x.agg(F.count(a).alias("n"), F.avg(a).alias("mean"), F.median(a).alias("median"), F.avg((a > 0).cast("int")).alias("positive"), M.skew(a).alias("skew"))


_IC = Q.query.sql["rank_correlation"]
_IC = _IC[len(Q._BASE) :]


@query("ic_summary", f"""SELECT months, mean, mean / (sd / sqrt(months)) AS t, mean / sqrt(s / months) AS nw_t FROM (SELECT count(*) AS months, avg(ic) AS mean, stddev_samp(ic) AS sd, (sum(c * c) + 2 * (2 / 3.0 * coalesce(sum(c * l1), 0) + 1 / 3.0 * coalesce(sum(c * l2), 0))) / count(*) AS s
  FROM (SELECT ic, c, lag(c, 1) OVER (ORDER BY m) AS l1, lag(c, 2) OVER (ORDER BY m) AS l2 FROM (SELECT m, ic, ic - avg(ic) OVER () AS c FROM ({_IC}) WHERE ic IS NOT NULL)))""", "mean t nw_t")
def ic_summary(spark, d):
    """Mean of the monthly rank correlations, its plain t and its t under autocorrelation."""
    x = checkpointed(Q.query.found["rank_correlation"](spark, d).where("ic IS NOT NULL").withColumn("all", F.lit(1)))
    nw = I.newey_west(x, ["all"], ["m"], "ic", 2).select("all", F.col("t").alias("nw_t"))
    s = x.groupBy("all").agg(F.count("ic").alias("months"), F.avg("ic").alias("mean"), (F.avg("ic") / (F.stddev("ic") / F.sqrt(F.count("ic")))).alias("t"))
    return s.join(nw, "all").select("months", "mean", "t", "nw_t")


@query("fundamental_law", f"SELECT avg(ic) AS ic, avg(n) * 12 AS breadth, avg(ic) * sqrt(avg(n) * 12) AS ir FROM ({_IC}) WHERE ic IS NOT NULL", "ic breadth ir")
def fundamental_law(spark, d):
    x = Q.query.found["rank_correlation"](spark, d).where("ic IS NOT NULL").agg(F.avg("ic").alias("ic"), (F.avg("n") * 12).alias("breadth"))
    return x.select("ic", "breadth", I.expected_ratio(F.col("ic"), F.col("breadth")).alias("ir"))


@query("monthly_excess", "SELECT portfolio, date_trunc('month', date)::DATE AS m, exp(sum(ln(1 + net))) - exp(sum(ln(1 + 0.00005::DOUBLE))) AS excess FROM pf GROUP BY ALL", "excess")
def monthly_excess(spark, d):
    """Monthly returns less the riskless rate compounded over the same days."""
    x = Q._portfolio(spark, d).withColumn("rf", F.lit(0.00005)).groupBy("portfolio", F.trunc("date", "month").alias("m"))
    return x.agg((F.exp(F.sum(F.log1p("net"))) - F.exp(F.sum(F.log1p("rf")))).alias("excess"))


_RECORD = "SELECT member, count(*) AS n, avg(abn) AS mean, avg(abn) / (stddev_samp(abn) + 1e-9) AS sharpe, avg((abn > 0)::INT) AS hit FROM tr WHERE abn IS NOT NULL GROUP BY member HAVING count(*) >= 5"


@query("records_at_the_ends", f"SELECT * EXCLUDE (up, down), CASE WHEN up <= 5 THEN 'top' ELSE 'bottom' END AS side FROM (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, member) AS up, row_number() OVER (ORDER BY round(mean, 9), member) AS down FROM ({_RECORD})) WHERE up <= 5 OR down <= 5", "mean sharpe hit")
def records_at_the_ends(spark, d):
    """The five members of the best and the five of the worst realised records."""
    a = F.col("abn")
    g = Q._returns(spark, d).where("abn IS NOT NULL").groupBy("member").agg(M.N().alias("n"), F.avg(a).alias("mean"), (F.avg(a) / (F.stddev(a) + 1e-9)).alias("sharpe"), F.avg((a > 0).cast("int")).alias("hit")).where("n >= 5")
    g = checkpointed(g)
    top = g.orderBy(F.round("mean", 9).desc(), "member").limit(5).withColumn("side", F.lit("top"))
    low = g.join(top.select("member"), "member", "left_anti").orderBy(F.round("mean", 9).asc(), "member").limit(5).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


@query("alpha_criteria", """SELECT decision_year, member, count(*) AS n, regr_intercept(ret, ret - abn) AS c10_alpha, regr_intercept(ret, ret - abn) / (sqrt(var_samp(ret) * (1 - regr_r2(ret, ret - abn))) + 1e-9) AS c11_ratio
  FROM tr JOIN (SELECT unnest([1996, 1997, 1998]) AS decision_year) y ON year(exit) <= decision_year WHERE abn IS NOT NULL GROUP BY ALL HAVING count(*) >= 10 AND var_samp(ret - abn) > 1e-12""", "c10_alpha c11_ratio")
def alpha_criteria(spark, d):
    """Two more criteria per decision year: alpha of a member's trades on the benchmark's returns over the same days, and alpha over what the benchmark leaves."""
    years = spark.createDataFrame([(y,) for y in (1996, 1997, 1998)], "decision_year int")
    return I.alpha_criteria(Q._returns(spark, d), years)


@query("style_by_year", """SELECT idx, date, sum(coalesce(u.share, 0) * r.r) + any_value(CASE WHEN y.total IS NULL THEN bm.b ELSE 0 END) AS style FROM r JOIN bm USING (idx, date)
  LEFT JOIN (SELECT year(filed) + 1 AS year, sum(size_usd) AS total FROM t WHERE op = 'buy' GROUP BY 1) y ON y.year = year(date)
  LEFT JOIN (SELECT year(filed) + 1 AS year, ticker, sum(size_usd) / sum(sum(size_usd)) OVER (PARTITION BY year(filed)) AS share FROM t WHERE op = 'buy' GROUP BY year(filed), ticker) u ON u.year = year(date) AND u.ticker = r.ticker GROUP BY ALL""", "style")
def style_by_year(spark, d):
    """The style's daily return with weights frozen anew each year on the purchases filed in the year before, so that it never looks ahead; a year without such weights has the benchmark's."""
    p = checkpointed(Q.prices(spark, d))
    cal = M.market_calendar(p)
    buys = Q.trades(spark, d).where("op = 'buy'").groupBy((F.year("filed") + 1).alias("year"), "ticker").agg(F.sum("size_usd").alias("s"))
    return M.style_returns(buys, M.dense_returns(p, cal), M.benchmark_days(Q.bench(spark, d), cal))


@query("benchmark_performance", "SELECT portfolio, count(*) AS days, avg((net > b)::INT) AS beaten, avg(net - b) * 252 AS alpha FROM (SELECT *, min(CASE WHEN invested > 0 THEN idx END) OVER (PARTITION BY portfolio) AS since FROM pf JOIN bm USING (idx)) WHERE idx >= since GROUP BY portfolio", "beaten alpha")
def benchmark_performance(spark, d):
    """From the first active day on: days on which the benchmark was beaten, and what was earned beyond it a year."""
    x = Q._active(spark, d)
    x = x.withColumn("since", F.min(F.when(F.col("invested") > 0, F.col("idx"))).over(Window.partitionBy("portfolio"))).where("idx >= since")
    a = F.col("net") - F.col("b")
    return x.groupBy("portfolio").agg(M.N().alias("days"), F.avg((a > 0).cast("int")).alias("beaten"), (F.avg(a) * 252).alias("alpha"))


@query("jackpot_holders", "SELECT dim, key, count(*) AS n, sum(abn) AS gain FROM (SELECT abn, unnest(['ticker', 'member', 'maker']) AS dim, unnest([ticker, member::VARCHAR, left(ticker, 7)]) AS key FROM tr WHERE abn >= (SELECT quantile_cont(abn, 0.9) FROM tr)) GROUP BY ALL", "gain")
def jackpot_holders(spark, d):
    """Where the highest tenth of the returns falls: by ticker, member and maker."""
    x = checkpointed(Q._returns(spark, d).where("abn IS NOT NULL").select("ticker", "member", "abn"))
    x = x.crossJoin(F.broadcast(quantiles(x, "abn", {"q": 0.9}))).where("abn >= q")  # one row
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), c.alias("key")) for n, c in (("ticker", F.col("ticker")), ("member", F.col("member").cast("string")), ("maker", F.substring("ticker", 1, 7)))])
    return x.select("abn", F.explode(dims).alias("k")).groupBy("k.dim", "k.key").agg(M.N().alias("n"), F.sum("abn").alias("gain"))


_CUTS = (
    ("all", "true"), ("ge50k", "size_usd >= 50000"), ("lt50k", "size_usd < 50000"), ("ge250k", "size_usd >= 250000"), ("above_median", "size_usd > med"), ("above_q90", "size_usd > q90"), ("short", "hold_days <= 90"), ("long", "hold_days > 90"),
    ("first_half", "month(entry) <= 6"), ("second_half", "month(entry) > 6"), ("early", "year(entry) <= 1994"), ("late", "year(entry) > 1994"), ("big_and_short", "size_usd > q90 AND hold_days <= 90"),
)


@query("cut_table", "SELECT cut, count(*) AS n, count(DISTINCT member) AS members, avg(abn) AS mean, avg((abn > 0)::INT) AS hit, CASE WHEN count(*) > 1 THEN avg(abn) / (stddev_samp(abn) / sqrt(count(*))) END AS t FROM (SELECT *, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CUTS) + "], lambda x: x IS NOT NULL)) AS cut FROM (SELECT *, median(size_usd) OVER () AS med, quantile_cont(size_usd, 0.9) OVER () AS q90 FROM tr WHERE abn IS NOT NULL)) GROUP BY cut", "mean hit t")
def cut_table(spark, d):
    """All thirteen cuts of the trades in one aggregation."""
    x = checkpointed(Q._returns(spark, d).where("abn IS NOT NULL"))
    x = x.crossJoin(F.broadcast(quantiles(x, "size_usd", {"med": 0.5, "q90": 0.9})))  # one row
    cuts = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in _CUTS]))
    n = M.N()
    return x.select("member", "abn", F.explode(cuts).alias("cut")).groupBy("cut").agg(
        n.alias("n"), F.countDistinct("member").alias("members"), F.avg("abn").alias("mean"), F.avg((F.col("abn") > 0).cast("int")).alias("hit"), F.when(n > 1, F.avg("abn") / (F.stddev("abn") / F.sqrt(n))).alias("t")
    )


@query("fund_coverage", ", f AS (SELECT chamber, amount_midpoint AS v, sector_gics IN ('Communication Services', 'Consumer Discretionary', 'Consumer Staples', 'Energy', 'Financials', 'Health Care', 'Industrials', 'Information Technology', 'Materials', 'Real Estate', 'Utilities') AS has FROM disclosures) SELECT chamber, sum(v) AS volume, coalesce(sum(v) FILTER (has), 0) / sum(v) AS covered FROM f GROUP BY chamber")
def fund_coverage(spark, d):
    """The share of the amounts whose sector has a fund."""
    funds = F.create_map(*[F.lit(x) for kv in S.SECTOR_FUNDS.items() for x in kv])
    x = table(spark, d, "disclosures").withColumn("fund", F.try_element_at(funds, F.coalesce("sector_gics", F.lit(""))))
    return covered_share(x, "chamber", "amount_midpoint", F.col("fund").isNotNull())


@query("outcome_model")
def outcome_model(spark, d):
    """A boosted model of whether a trade beats the benchmark, on seven things known at entry; fitted on the earlier trades, judged on the later ones."""
    x = Q._returns(spark, d).where("abn IS NOT NULL")
    before = lambda *k: F.count(F.lit(1)).over(Window.partitionBy(*k).orderBy("entry", "trade_id").rowsBetween(Window.unboundedPreceding, -1)).cast("double")
    x = x.select(
        "trade_id", "entry", "abn", (F.col("abn") > 0).cast("double").alias("label"), F.log("size_usd").alias("size"), F.month("entry").cast("double").alias("month"), F.dayofweek("entry").cast("double").alias("weekday"),
        F.dayofmonth("entry").cast("double").alias("monthday"), before("member").alias("member_trades"), before("ticker").alias("ticker_trades"), before("member", "ticker").alias("both_trades"),
    )
    return I.outcome_model(x, ["size", "month", "weekday", "monthday", "member_trades", "ticker_trades", "both_trades"])


def queries() -> dict:
    return {**query.found, **grid.found, **sides.found}


def oracle_sql() -> dict[str, str]:
    return {**query.sql, **grid.sql, **sides.sql}
