"""Queries over prices, portfolios, event studies and the choice of members, on trades and prices made from the star-schema tables.

A customer stands for a member, a brand for a ticker, a ship date for the day of filing, and the mean price of a brand on a day for its close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators import inference as I
from tradeloom.operators import market as M
from tradeloom.operators.ranks import quantiles, ranked
from tradeloom.plans.registry import Registry
from tradeloom.session import checkpointed, table

_BASE = """
WITH t AS (SELECT o_custkey AS member, p_brand AS ticker, CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'exch' END AS op, CAST(l_shipdate AS DATE) AS filed, CAST(round(sum(l_extendedprice)) AS DOUBLE) AS size_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
p AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity) + 1e-7, 4) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity) + 1e-7, 4) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM p)),
pos AS (SELECT concat_ws('|', member, ticker, filed) AS trade_id, member, ticker, filed AS entry, least(coalesce(sold, CAST(filed + INTERVAL 12 MONTH AS DATE)), CAST(filed + INTERVAL 12 MONTH AS DATE)) AS exit, size_usd
  FROM (SELECT x.*, (SELECT min(s.filed) FROM t s WHERE s.member = x.member AND s.ticker = x.ticker AND s.op = 'sell' AND s.filed > x.filed) AS sold FROM t x WHERE op = 'buy')),
own AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM p),
tr AS (SELECT q.trade_id, q.member, q.ticker, q.exit, q.entry, q.size_usd, CASE WHEN z.date > a.date AND a.close > 0 THEN z.close / a.close - 1 END AS ret, CASE WHEN z.date > a.date AND a.close > 0 THEN z.close / a.close - bz.close / ba.close END AS abn,
    CASE WHEN z.date > a.date THEN date_diff('day', a.date, z.date) END AS hold_days
  FROM pos q ASOF LEFT JOIN p a ON a.ticker = q.ticker AND a.date >= q.entry + INTERVAL 1 DAY ASOF LEFT JOIN p z0 ON z0.ticker = q.ticker AND z0.date >= q.exit
  LEFT JOIN (SELECT ticker, max(date) AS date FROM p GROUP BY 1) l ON l.ticker = q.ticker LEFT JOIN p z ON z.ticker = q.ticker AND z.date = coalesce(z0.date, l.date) LEFT JOIN b ba ON ba.date = a.date LEFT JOIN b bz ON bz.date = z.date),
r AS (SELECT ticker, idx, date, CASE WHEN x IS NULL THEN 0 WHEN x > 0.5 THEN 0.5 WHEN x < -0.5 THEN -0.5 ELSE x END AS r FROM (SELECT ticker, idx, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 AS x FROM (SELECT DISTINCT ticker FROM p) CROSS JOIN cal LEFT JOIN p USING (ticker, date))),
held AS (SELECT unnest(['equal', 'size', 'sqrt_size']) AS portfolio, ticker, entry, exit, unnest([1.0::DOUBLE, size_usd, sqrt(size_usd)]) AS raw FROM pos),
ev AS (SELECT portfolio, ticker, e.idx AS ei, x.idx AS xi, raw FROM held h ASOF JOIN cal e ON e.date >= h.entry + INTERVAL 1 DAY ASOF LEFT JOIN cal x ON x.date >= h.exit),
fl AS (SELECT portfolio, ticker, idx, sum(v) AS v FROM (SELECT portfolio, ticker, ei AS idx, raw AS v FROM ev UNION ALL SELECT portfolio, ticker, xi, -raw FROM ev WHERE xi IS NOT NULL) GROUP BY ALL),
hd AS (SELECT u.portfolio, u.ticker, r.idx, r.date, r.r, greatest(sum(coalesce(fl.v, 0)) OVER (PARTITION BY u.portfolio, u.ticker ORDER BY r.idx), 0) AS h FROM (SELECT DISTINCT portfolio, ticker FROM fl) u JOIN r USING (ticker) LEFT JOIN fl ON fl.portfolio = u.portfolio AND fl.ticker = u.ticker AND fl.idx = r.idx),
wt AS (SELECT *, CASE WHEN sum(h0) OVER (PARTITION BY portfolio, idx) > 0 THEN h0 / sum(h0) OVER (PARTITION BY portfolio, idx) ELSE 0 END AS w FROM (SELECT *, CASE WHEN h < 1e-6 THEN 0 ELSE h END AS h0 FROM hd)),
wp AS (SELECT *, lag(w, 1, 0) OVER (PARTITION BY portfolio, ticker ORDER BY idx) AS wp FROM wt),
pf AS (SELECT portfolio, idx, date, sum(wp * r) AS gross, 0.002 * sum(abs(w - wp)) AS cost, sum(wp * r) - 0.002 * sum(abs(w - wp)) AS net, sum(w) AS invested FROM wp GROUP BY ALL),
bm AS (SELECT idx, date, coalesce(q / lag(q) OVER (ORDER BY idx) - 1, 0) AS b FROM (SELECT idx, cal.date, last_value(close IGNORE NULLS) OVER (ORDER BY idx) AS q FROM cal LEFT JOIN b USING (date))) """


query = Registry(_BASE)


def trades(spark, d) -> DataFrame:
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    op = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("exch")
    x = x.groupBy(F.col("o_custkey").alias("member"), F.col("p_brand").alias("ticker"), op.alias("op"), F.col("l_shipdate").cast("date").alias("filed"))
    x = x.agg(F.round(F.sum("l_extendedprice")).alias("size_usd"))
    return x.withColumn("trade_id", F.concat_ws("|", "member", "ticker", F.col("filed").cast("string")))


def prices(spark, d) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
    return x.agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-7, 4).alias("close"))


def bench(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    return x.agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-7, 4).alias("close"))


def _portfolio(spark, d) -> DataFrame:
    held = M.positions(trades(spark, d))
    kinds = F.array(*[F.struct(F.lit(k).alias("portfolio"), M.raw_weight(k).alias("raw")) for k in ("equal", "size", "sqrt_size")])
    held = held.select("ticker", "entry", "exit", F.explode(kinds).alias("k")).select("k.*", "ticker", "entry", "exit")
    return M.portfolio_days(held, checkpointed(prices(spark, d)))  # days x tickers, used several times: built once


def _returns(spark, d) -> DataFrame:
    held = checkpointed(M.positions(trades(spark, d)))
    return held.join(M.trade_returns(held, checkpointed(prices(spark, d)), checkpointed(bench(spark, d))), "trade_id")


@query("daily_returns", "SELECT ticker, date, r FROM r", "r")
def daily_returns(spark, d):
    p = prices(spark, d)
    return M.dense_returns(p, M.market_calendar(p)).select("ticker", "date", "r")


@query("positions", "SELECT trade_id, entry, exit FROM pos")
def positions(spark, d):
    return M.positions(trades(spark, d)).select("trade_id", "entry", "exit")


_AR = """SELECT trade_id, unnest([21, 63]) AS horizon, unnest([a21, a63]) AS ar FROM (SELECT q.trade_id, CASE WHEN a.close > 0 THEN c.close / a.close - bc.close / ba.close END AS a21, CASE WHEN a.close > 0 THEN e.close / a.close - be.close / ba.close END AS a63
  FROM pos q ASOF LEFT JOIN own a ON a.ticker = q.ticker AND a.date >= q.entry LEFT JOIN own c ON c.ticker = q.ticker AND c.i = a.i + 21 LEFT JOIN own e ON e.ticker = q.ticker AND e.i = a.i + 63
  LEFT JOIN b ba ON ba.date = a.date LEFT JOIN b bc ON bc.date = c.date LEFT JOIN b be ON be.date = e.date)"""


def _abnormal(spark, d):
    return M.abnormal_returns(trades(spark, d).where("op = 'buy'"), prices(spark, d), bench(spark, d), [21, 63])


@query("abnormal_returns", _AR, "ar")
def abnormal_returns(spark, d):
    return _abnormal(spark, d)


@query("ar_table", f"SELECT horizon, count(ar) AS n, avg(ar) AS mean, median(ar) AS median, avg((ar > 0)::INT) AS positive, skewness(ar) AS skew FROM ({_AR}) WHERE ar IS NOT NULL GROUP BY horizon", "mean median positive skew")
def ar_table(spark, d):
    a = F.col("ar")
    x = _abnormal(spark, d).where("ar IS NOT NULL").groupBy("horizon")
    return x.agg(F.count(a).alias("n"), F.avg(a).alias("mean"), F.median(a).alias("median"), F.avg((a > 0).cast("int")).alias("positive"), M.skew(a).alias("skew"))


@query("trade_returns", "SELECT trade_id, ret, abn, coalesce(abn > 0, false) AS win, CAST(hold_days AS INTEGER) AS hold_days FROM tr", "ret abn")
def trade_returns(spark, d):
    return _returns(spark, d).select("trade_id", "ret", "abn", "win", "hold_days")


@query("trade_stats", """SELECT ticker, count(*) AS n, avg((abn > 0)::INT) AS hit_rate, coalesce(avg(abn) FILTER (abn > 0), 0) AS avg_win, coalesce(avg(abn) FILTER (abn <= 0), 0) AS avg_loss, avg(abn) AS mean_abn, median(abn) AS median_abn,
  CASE WHEN coalesce(sum(abn) FILTER (abn <= 0), 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(abn) FILTER (abn > 0), 0) / abs(sum(abn) FILTER (abn <= 0)) END AS profit_factor FROM tr WHERE abn IS NOT NULL GROUP BY ticker""", "hit_rate avg_win avg_loss mean_abn median_abn profit_factor")
def trade_stats(spark, d):
    return M.trade_stats(_returns(spark, d), ["ticker"])


@query("portfolio_daily", "SELECT portfolio, date, gross, cost, net, invested FROM pf", "gross cost net invested")
def portfolio_daily(spark, d):
    return _portfolio(spark, d).select("portfolio", "date", "gross", "cost", "net", "invested")


@query("portfolio_stats", """SELECT portfolio, count(*) AS days, sum(ln(1 + net)) * 252 / count(*) AS log_growth, stddev_samp(net) * sqrt(252) AS vol, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe,
  avg(net) / (stddev_samp(net) FILTER (net < -1e-12)) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM (SELECT *, e / max(e) OVER (PARTITION BY portfolio ORDER BY idx) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY portfolio ORDER BY idx)) AS e FROM pf)) GROUP BY portfolio""", "log_growth vol sharpe sortino max_drawdown")
def portfolio_stats(spark, d):
    return M.annual_stats(_portfolio(spark, d)).withColumn("cagr", F.log1p("cagr")).withColumnRenamed("cagr", "log_growth")


@query("benchmark_aligned", "SELECT date, b FROM bm", "b")
def benchmark_aligned(spark, d):
    return M.benchmark_days(bench(spark, d), M.market_calendar(prices(spark, d))).select("date", "b")


def _active(spark, d):
    return _portfolio(spark, d).join(M.benchmark_days(bench(spark, d), M.market_calendar(prices(spark, d))).select("idx", "b"), "idx")


@query("information_ratio", "SELECT portfolio, avg(net - b) / stddev_samp(net - b) * sqrt(252) AS ir, avg((net > b)::INT) AS beaten FROM pf JOIN bm USING (idx) GROUP BY portfolio", "ir beaten")
def information_ratio(spark, d):
    a = F.col("net") - F.col("b")
    return _active(spark, d).groupBy("portfolio").agg((F.avg(a) / F.stddev(a) * F.sqrt(F.lit(252.0))).alias("ir"), F.avg((a > 0).cast("int")).alias("beaten"))


@query("blend_grid", "SELECT portfolio, alpha, avg(alpha * net + (1 - alpha) * b) / stddev_samp(alpha * net + (1 - alpha) * b) * sqrt(252) AS sharpe FROM pf JOIN bm USING (idx) CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS alpha) GROUP BY ALL", "sharpe")
def blend_grid(spark, d):
    x = _active(spark, d).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (0.2, 0.4, 0.6, 0.8)])))
    m = F.col("alpha") * F.col("net") + (1 - F.col("alpha")) * F.col("b")
    return x.groupBy("portfolio", "alpha").agg((F.avg(m) / F.stddev(m) * F.sqrt(F.lit(252.0))).alias("sharpe"))


@query("period_sharpe", "SELECT portfolio, CASE WHEN year(date) % 2 = 0 THEN 'even' ELSE 'odd' END AS period, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe FROM pf GROUP BY ALL", "sharpe")
def period_sharpe(spark, d):
    period = F.when(F.year("date") % 2 == 0, "even").otherwise("odd")
    return _portfolio(spark, d).groupBy("portfolio", period.alias("period")).agg((F.avg("net") / F.stddev("net") * F.sqrt(F.lit(252.0))).alias("sharpe"))


@query("leverage_to_benchmark", "SELECT portfolio, stddev_samp(b) / stddev_samp(net) AS leverage, avg(net) * stddev_samp(b) / stddev_samp(net) * 252 AS levered FROM pf JOIN bm USING (idx) GROUP BY portfolio", "leverage levered")
def leverage_to_benchmark(spark, d):
    k = F.stddev("b") / F.stddev("net")
    return _active(spark, d).groupBy("portfolio").agg(k.alias("leverage"), (F.avg("net") * k * 252).alias("levered"))


@query("beta_to_benchmark", "SELECT ticker, corr(r.r, bm.b) AS corr, regr_slope(r.r, bm.b) AS beta, 1 - regr_r2(r.r, bm.b) AS idiosyncratic FROM r JOIN bm USING (idx) GROUP BY ticker", "corr beta idiosyncratic")
def beta_to_benchmark(spark, d):
    p = prices(spark, d)
    c = M.market_calendar(p)
    x = M.dense_returns(p, c).join(M.benchmark_days(bench(spark, d), c).select("idx", "b"), "idx")
    return x.groupBy("ticker").agg(F.corr("r", "b").alias("corr"), F.regr_slope("r", "b").alias("beta"), (1 - F.regr_r2("r", "b")).alias("idiosyncratic"))


@query("newey_west_t", """SELECT portfolio, n, mean, mean / sqrt(s / n) AS t FROM (SELECT portfolio, count(*) AS n, max(m) AS mean, (sum(c * c) + 2 * (5 / 6.0 * sum(c * l1) + 4 / 6.0 * sum(c * l2) + 3 / 6.0 * sum(c * l3) + 2 / 6.0 * sum(c * l4) + 1 / 6.0 * sum(c * l5))) / count(*) AS s
  FROM (SELECT *, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3, lag(c, 4) OVER w AS l4, lag(c, 5) OVER w AS l5 FROM (SELECT portfolio, idx, avg(net) OVER (PARTITION BY portfolio) AS m, net - avg(net) OVER (PARTITION BY portfolio) AS c FROM pf) WINDOW w AS (PARTITION BY portfolio ORDER BY idx)) GROUP BY portfolio)""", "mean t")
def newey_west_t(spark, d):
    return I.newey_west(_portfolio(spark, d), ["portfolio"], ["idx"], "net", 5)


def _factors(spark, d):
    """Market, size, value and momentum from halves of the tickers by price level; a fixed rate."""
    p = prices(spark, d)
    c = M.market_calendar(p)
    r = M.dense_returns(p, c).withColumn("h", F.pmod(F.xxhash64("ticker"), F.lit(2))).withColumn("v", F.pmod(F.xxhash64("ticker", F.lit(1)), F.lit(2)))
    mom = F.avg("r").over(Window.partitionBy("ticker").orderBy("idx").rowsBetween(-20, -1))
    r = r.withColumn("m", F.coalesce(mom, F.lit(0.0)))
    diff = lambda c: F.coalesce(F.avg(F.when(c, F.col("r"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~c, F.col("r"))), F.lit(0.0))
    return r.groupBy("idx").agg(F.avg("r").alias("mkt"), diff(F.col("h") == 0).alias("smb"), diff(F.col("v") == 0).alias("hml"), diff(F.col("m") > 0).alias("mom"), F.lit(0.00005).alias("rf"))


@query("factor_alpha")
def factor_alpha(spark, d):
    return I.factor_alpha(_portfolio(spark, d).join(_factors(spark, d), "idx"), "ffc4")


@query("joint_alpha")
def joint_alpha(spark, d):
    return I.joint_test(_portfolio(spark, d).join(_factors(spark, d), "idx").withColumn("test", F.lit("all")))


@query("skill_probability")
def skill_probability(spark, d):
    return I.probability_of_skill(I.sharpe_moments(_portfolio(spark, d)), trials=44)


@query("welch_t", "SELECT (avg(abn) FILTER (size_usd >= 50000) - avg(abn) FILTER (size_usd < 50000)) / sqrt(var_samp(abn) FILTER (size_usd >= 50000) / count(abn) FILTER (size_usd >= 50000) + var_samp(abn) FILTER (size_usd < 50000) / count(abn) FILTER (size_usd < 50000)) AS t FROM tr", "t")
def welch_t(spark, d):
    big, small = (F.when(c, F.col("abn")) for c in (F.col("size_usd") >= 50000, F.col("size_usd") < 50000))
    return _returns(spark, d).agg(((F.avg(big) - F.avg(small)) / F.sqrt(F.variance(big) / F.count(big) + F.variance(small) / F.count(small))).alias("t"))


@query("clustered_t", "SELECT avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t, count(*) AS members FROM (SELECT member, avg(abn) AS m FROM tr WHERE abn IS NOT NULL GROUP BY 1)", "t")
def clustered_t(spark, d):
    m = _returns(spark, d).where("abn IS NOT NULL").groupBy("member").agg(F.avg("abn").alias("m"))
    return m.agg((F.avg("m") / (F.stddev("m") / F.sqrt(F.count("m")))).alias("t"), F.count("m").alias("members"))


@query("ticker_year_residual", "SELECT trade_id, abn - avg(abn) OVER (PARTITION BY ticker, year(entry)) AS residual FROM tr WHERE abn IS NOT NULL", "residual")
def ticker_year_residual(spark, d):
    return _returns(spark, d).where("abn IS NOT NULL").select("trade_id", (F.col("abn") - F.avg("abn").over(Window.partitionBy("ticker", F.year("entry")))).alias("residual"))


_MONTHS = """SELECT ticker, m, c, lead(c) OVER (PARTITION BY ticker ORDER BY m) / c - 1 AS fwd FROM (SELECT s.ticker, s.m, q.c FROM (SELECT * FROM (SELECT DISTINCT ticker FROM p) CROSS JOIN (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM p)) s
  LEFT JOIN (SELECT ticker, date_trunc('month', date)::DATE AS m, arg_max(close, date) AS c FROM p GROUP BY ALL) q ON q.ticker = s.ticker AND q.m = s.m)"""


def _months(spark, d):
    p = prices(spark, d).withColumn("m", F.trunc("date", "month"))
    ends = p.groupBy("ticker", "m").agg(F.max_by("close", "date").alias("c"))
    grid = p.select("ticker").distinct().crossJoin(p.select("m").distinct())  # tickers x months is the size of the result
    x = grid.join(ends, ["ticker", "m"], "left")
    return x.withColumn("fwd", F.try_divide(F.lead("c").over(Window.partitionBy("ticker").orderBy("m")), F.col("c")) - 1)


@query("forward_months", f"SELECT ticker, m, fwd FROM ({_MONTHS})", "fwd")
def forward_months(spark, d):
    return _months(spark, d).select("ticker", "m", "fwd")


_BUYERS = "SELECT ticker, date_trunc('month', filed)::DATE AS m, count(DISTINCT member) FILTER (op = 'buy') AS buyers, coalesce(sum(size_usd) FILTER (op = 'buy'), 0) - coalesce(sum(size_usd) FILTER (op = 'sell'), 0) AS net FROM t GROUP BY ALL"


def _buyers(spark, d):
    buy, sell = (F.when(F.col("op") == o, F.col("size_usd")) for o in ("buy", "sell"))
    x = trades(spark, d).groupBy("ticker", F.trunc("filed", "month").alias("m"))
    return x.agg(F.countDistinct(F.when(F.col("op") == "buy", F.col("member"))).alias("buyers"), (F.coalesce(F.sum(buy), F.lit(0.0)) - F.coalesce(F.sum(sell), F.lit(0.0))).alias("net"))


@query("monthly_buyers", _BUYERS)
def monthly_buyers(spark, d):
    return _buyers(spark, d)


@query("rank_correlation", f"""WITH j AS (SELECT m, buyers, fwd FROM ({_BUYERS}) JOIN ({_MONTHS}) USING (ticker, m) WHERE fwd IS NOT NULL),
k AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY buyers) + (count(*) OVER (PARTITION BY m, buyers) - 1) / 2.0 AS x, rank() OVER (PARTITION BY m ORDER BY fwd) + (count(*) OVER (PARTITION BY m, fwd) - 1) / 2.0 AS y FROM j)
SELECT m, count(*) AS n, CASE WHEN isnan(corr(x, y)) THEN NULL ELSE corr(x, y) END AS ic FROM k GROUP BY m HAVING count(*) >= 8 AND min(x) < max(x) AND min(y) < max(y)""", "ic")
def rank_correlation(spark, d):
    j = _buyers(spark, d).join(_months(spark, d), ["ticker", "m"]).where("fwd IS NOT NULL")
    k = M.average_rank(M.average_rank(j, ["m"], "buyers", "x"), ["m"], "fwd", "y")
    k = k.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("ic"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("e"))
    return k.where("n >= 8 AND a < b AND c < e").select("m", "n", "ic")


@query("breadth_spread", f"SELECT m, avg(fwd) FILTER (buyers >= 2) - avg(fwd) FILTER (buyers = 1) AS spread FROM ({_BUYERS}) JOIN ({_MONTHS}) USING (ticker, m) WHERE fwd IS NOT NULL GROUP BY m HAVING count(*) >= 10 AND count(*) FILTER (buyers >= 2) >= 3 AND count(*) FILTER (buyers = 1) >= 3", "spread")
def breadth_spread(spark, d):
    many, one = F.col("buyers") >= 2, F.col("buyers") == 1
    j = _buyers(spark, d).join(_months(spark, d), ["ticker", "m"]).where("fwd IS NOT NULL").groupBy("m")
    j = j.agg((F.avg(F.when(many, F.col("fwd"))) - F.avg(F.when(one, F.col("fwd")))).alias("spread"), F.count(F.lit(1)).alias("n"), F.count_if(many).alias("a"), F.count_if(one).alias("b"))
    return j.where("n >= 10 AND a >= 3 AND b >= 3").select("m", "spread")


@query("monthly_compounded", "SELECT portfolio, date_trunc('month', date)::DATE AS m, exp(sum(ln(1 + net))) - 1 AS ret FROM pf GROUP BY ALL", "ret")
def monthly_compounded(spark, d):
    return _portfolio(spark, d).groupBy("portfolio", F.trunc("date", "month").alias("m")).agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("ret"))


@query("long_short", """SELECT date, sum(CASE WHEN rank <= 5 THEN r ELSE 0 END) / 5 - sum(CASE WHEN rank > 20 THEN r ELSE 0 END) / 5 AS ret FROM (SELECT r.date, r.r, row_number() OVER (PARTITION BY r.idx ORDER BY n.net DESC, r.ticker) AS rank
  FROM r JOIN (SELECT ticker, (m + INTERVAL 1 MONTH)::DATE AS m, net FROM (""" + _BUYERS + """)) n ON n.ticker = r.ticker AND n.m = date_trunc('month', r.date)::DATE) GROUP BY date""", "ret")
def long_short(spark, d):
    p = prices(spark, d)
    n = _buyers(spark, d).select("ticker", F.add_months("m", 1).alias("m"), "net")
    x = M.dense_returns(p, M.market_calendar(p)).withColumn("m", F.trunc("date", "month")).join(n, ["ticker", "m"])
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("net"), "ticker")))
    side = lambda c: F.sum(F.when(c, F.col("r")).otherwise(0.0)) / 5
    return x.groupBy("date").agg((side(F.col("rank") <= 5) - side(F.col("rank") > 20)).alias("ret"))


@query("gain_concentration", "SELECT sum(abn) FILTER (abn > 0 AND k <= n // 10) / sum(abn) FILTER (abn > 0) AS top_share, avg(abn) FILTER (k > n // 10) AS mean_without FROM (SELECT abn, row_number() OVER (ORDER BY abn DESC, trade_id) AS k, count(*) OVER () AS n FROM tr WHERE abn IS NOT NULL)", "top_share mean_without")
def gain_concentration(spark, d):
    x = ranked(_returns(spark, d).where("abn IS NOT NULL").select("abn", "trade_id"), [F.desc("abn"), F.col("trade_id")], "k")
    x = x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n")))).withColumn("top", F.col("k") <= F.floor(F.col("n") / 10))  # one row
    gain = F.when(F.col("abn") > 0, F.col("abn"))
    return x.agg((F.sum(F.when(F.col("top"), gain)) / F.sum(gain)).alias("top_share"), F.avg(F.when(~F.col("top"), F.col("abn"))).alias("mean_without"))


@query("cut_profile", """SELECT cut, count(*) AS n, count(DISTINCT member) AS members, avg(abn) AS mean, avg((abn > 0)::INT) AS hit, avg(abn) / (stddev_samp(abn) / sqrt(count(*))) AS t FROM (SELECT *, unnest(list_filter([CASE WHEN size_usd >= 50000 THEN 'ge50k' END, CASE WHEN size_usd < 50000 THEN 'lt50k' END,
  CASE WHEN size_usd > med THEN 'above_median' END, CASE WHEN hold_days <= 90 THEN 'short' END, 'all'], lambda x: x IS NOT NULL)) AS cut FROM (SELECT *, median(size_usd) OVER () AS med FROM tr WHERE abn IS NOT NULL)) GROUP BY cut""", "mean hit t")
def cut_profile(spark, d):
    x = _returns(spark, d).where("abn IS NOT NULL")
    x = x.crossJoin(F.broadcast(x.agg(F.median("size_usd").alias("med"))))  # one row
    cuts = F.array(F.when(F.col("size_usd") >= 50000, "ge50k"), F.when(F.col("size_usd") < 50000, "lt50k"), F.when(F.col("size_usd") > F.col("med"), "above_median"), F.when(F.col("hold_days") <= 90, "short"), F.lit("all"))
    x = x.select("member", "abn", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("cut")).groupBy("cut")
    n = F.count(F.lit(1))
    return x.agg(n.alias("n"), F.countDistinct("member").alias("members"), F.avg("abn").alias("mean"), F.avg((F.col("abn") > 0).cast("int")).alias("hit"), (F.avg("abn") / (F.stddev("abn") / F.sqrt(n))).alias("t"))


@query("jackpots", "SELECT ticker, count(*) AS n, avg(abn) AS mean FROM tr WHERE abn >= (SELECT quantile_cont(abn, 0.9) FROM tr) GROUP BY ticker", "mean")
def jackpots(spark, d):
    x = checkpointed(_returns(spark, d).where("abn IS NOT NULL"))
    return x.crossJoin(F.broadcast(quantiles(x, "abn", {"q": 0.9}))).where("abn >= q").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("abn").alias("mean"))  # one row


@query("damped_weights", "SELECT trade_id, 1 / sqrt(count(*) OVER (PARTITION BY member)) AS w FROM pos", "w")
def damped_weights(spark, d):
    return M.positions(trades(spark, d)).select("trade_id", (1 / F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("member")))).alias("w"))


_SCORES = """SELECT g.*, n / (n + 10) * c6_sharpe + (1 - n / (n + 10)) * avg(c6_sharpe) OVER (PARTITION BY decision_year) AS c7_shrunk,
  n / (n + 10) * c6_sharpe + (1 - n / (n + 10)) * avg(c6_sharpe) OVER (PARTITION BY decision_year) + 0.5 * sqrt(ln(sum(n) OVER (PARTITION BY decision_year)) / n) AS c8_ucb FROM (
  SELECT decision_year, member, count(*) AS n, avg((abn > 0)::INT) AS c1_hit, avg(ret) AS c2_raw, avg(abn) AS c3_abn, median(abn) AS c4_med, CASE WHEN coalesce(sum(abn) FILTER (abn <= 0), 0) = 0 THEN 10 ELSE least(coalesce(sum(abn) FILTER (abn > 0), 0) / abs(sum(abn) FILTER (abn <= 0)), 10) END AS c5_pf,
    avg(abn) / (stddev_samp(abn) + 1e-9) AS c6_sharpe, avg(abn) / (stddev_samp(abn) / sqrt(count(*)) + 1e-9) AS c9_t FROM tr JOIN (SELECT unnest([1996, 1997, 1998, 2023, 2024, 2025]) AS decision_year) y ON year(exit) <= decision_year WHERE abn IS NOT NULL GROUP BY decision_year, member HAVING count(*) >= 10) g"""


def _scores(spark, d):
    years = spark.createDataFrame([(y,) for y in (1996, 1997, 1998, 2023, 2024, 2025)], "decision_year int")
    return I.scoreboard(_returns(spark, d), years)


@query("member_scoreboard", _SCORES, "c1_hit c2_raw c3_abn c4_med c5_pf c6_sharpe c7_shrunk c8_ucb c9_t")
def member_scoreboard(spark, d):
    return _scores(spark, d)


_COMPOSITE = "SELECT decision_year, member, (" + " + ".join(f"rank() OVER (PARTITION BY decision_year ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY decision_year, round({c}, 9)) - 1) / 2.0" for c in I.CRITERIA) + f") / 5 / count(*) OVER (PARTITION BY decision_year) AS composite FROM ({_SCORES})"


def _composite(spark, d):
    s = _scores(spark, d)
    return I.composite(s.withColumns({c: F.round(F.col(c), 9) for c in I.CRITERIA}))


@query("composite_rank", _COMPOSITE, "composite")
def composite_rank(spark, d):
    return _composite(spark, d).select("decision_year", "member", "composite")


@query("walk_forward_gate", f"SELECT trade_id FROM pos q JOIN (SELECT decision_year, member FROM ({_COMPOSITE}) QUALIFY row_number() OVER (PARTITION BY decision_year ORDER BY round(composite, 9) DESC, member) <= 6) s ON s.member = q.member AND s.decision_year = year(q.entry) - 1")
def walk_forward_gate(spark, d):
    w = Window.partitionBy("decision_year").orderBy(F.desc("c"), "member")
    s = _composite(spark, d).withColumn("c", F.round("composite", 9)).withColumn("k", F.row_number().over(w)).where("k <= 6").select("decision_year", F.col("member").alias("m__"))
    q = M.positions(trades(spark, d))
    return q.join(s, (F.col("member") == F.col("m__")) & (F.year("entry") - 1 == F.col("decision_year")), "left_semi").select("trade_id")


@query("style_attribution", """SELECT portfolio, avg(net) * 252 AS total, avg(b) * 252 AS market, avg(net - st) * 252 AS selection, avg(st - b) * 252 AS allocation, avg(net - st + st - b - (net - b)) AS residual FROM (SELECT pf.portfolio, pf.idx, any_value(pf.net) AS net, any_value(bm.b) AS b, sum(u.share * r.r) AS st
  FROM pf JOIN bm USING (idx) JOIN (SELECT ticker, sum(size_usd) / sum(sum(size_usd)) OVER () AS share FROM t WHERE op = 'buy' GROUP BY ticker) u ON true JOIN r ON r.ticker = u.ticker AND r.idx = pf.idx GROUP BY pf.portfolio, pf.idx) GROUP BY portfolio""", "total market selection allocation residual")
def style_attribution(spark, d):
    buys = trades(spark, d).where("op = 'buy'").groupBy("ticker").agg(F.sum("size_usd").alias("s"))
    share = buys.crossJoin(F.broadcast(buys.agg(F.sum("s").alias("all")))).select("ticker", (F.col("s") / F.col("all")).alias("share"))  # one row
    p = prices(spark, d)
    style = M.dense_returns(p, M.market_calendar(p)).join(share, "ticker").groupBy("idx").agg(F.sum(F.col("share") * F.col("r")).alias("st"))
    x = _active(spark, d).join(style, "idx")
    a = lambda c: F.avg(c) * 252
    net, b, st = F.col("net"), F.col("b"), F.col("st")
    return x.groupBy("portfolio").agg(a(net).alias("total"), a(b).alias("market"), a(net - st).alias("selection"), a(st - b).alias("allocation"), F.avg((net - st) + (st - b) - (net - b)).alias("residual"))


@query("rank_persistence", f"""WITH s AS (SELECT decision_year, member, rank() OVER (PARTITION BY decision_year ORDER BY round(c3_abn, 9)) AS k FROM ({_SCORES}))
SELECT a.decision_year, count(*) AS n, avg(b.k) AS mean_next, CASE WHEN isfinite(corr(a.k, b.k)) THEN corr(a.k, b.k) END AS corr FROM s a JOIN s b ON a.member = b.member AND b.decision_year = a.decision_year + 1 GROUP BY a.decision_year HAVING count(*) > 2""", "mean_next corr")
def rank_persistence(spark, d):
    s = _scores(spark, d).select("decision_year", "member", F.rank().over(Window.partitionBy("decision_year").orderBy(F.round("c3_abn", 9))).alias("k"))
    nxt = s.select((F.col("decision_year") - 1).alias("decision_year"), "member", F.col("k").alias("next"))
    x = s.join(nxt, ["decision_year", "member"]).groupBy("decision_year").agg(F.count(F.lit(1)).alias("n"), F.avg("next").alias("mean_next"), F.corr("k", "next").alias("corr"))
    return x.where("n > 2")


@query("fund_substitution", "SELECT t.member, p_type AS fund, t.filed, t.op FROM t JOIN (SELECT p_brand, min(p_type) AS p_type FROM part WHERE p_size > 2 GROUP BY 1) f ON f.p_brand = t.ticker")
def fund_substitution(spark, d):
    f = table(spark, d, "part").where("p_size > 2").groupBy("p_brand").agg(F.min("p_type").alias("fund"))
    return trades(spark, d).join(f, F.col("ticker") == F.col("p_brand")).select("member", "fund", "filed", "op")


@query("placebo_sales", "SELECT op, count(*) AS n, median(size_usd) AS median FROM t WHERE op IN ('buy', 'sell') AND size_usd >= 50000 GROUP BY op")
def placebo_sales(spark, d):
    return trades(spark, d).where("op IN ('buy', 'sell') AND size_usd >= 50000").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.median("size_usd").alias("median"))


def queries() -> dict:
    return dict(query.found)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
