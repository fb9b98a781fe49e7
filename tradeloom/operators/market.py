"""Prices, positions, the daily portfolio and event studies, in long form: one row per ticker and day, never a dense matrix on the driver.

Two kinds of calendar are kept apart: the market's (all days on which any price exists; the portfolio runs on it) and each ticker's own days (event
studies and trade returns run on them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.temporal import first_later

N = lambda: F.count(F.lit(1))
CLIP = 0.5


def market_calendar(prices: DataFrame) -> DataFrame:
    """(date, idx) of all days with a price, from 0. One row per trading day, so the unpartitioned window is over thousands of rows."""
    return prices.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def dense_returns(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, idx, date, r): daily returns on the market's calendar, clipped; 0 where today's or yesterday's price is missing."""
    grid = prices.select("ticker").distinct().crossJoin(calendar)  # tickers x days is the size of the result
    x = grid.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left")
    prior = F.lag("close").over(Window.partitionBy("ticker").orderBy("idx"))
    raw = F.try_divide(F.col("close"), prior) - 1
    r = F.when(raw.isNull(), 0.0).otherwise(F.greatest(F.least(raw, F.lit(CLIP)), F.lit(-CLIP)))  # least and greatest pass over nulls
    return x.select("ticker", "idx", "date", r.alias("r"))


def with_next(df: DataFrame, day: str, calendar: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with name: value of the calendar's first day on or after a day, however far that is; null after the last one.

    calendar: (keys, date, value). Its days are copied back over the gaps between them, and every day before the first counts as the first.
    """
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")  # one row per trading day
    days = F.sequence(F.coalesce(F.date_add(F.lag("date").over(w), 1), F.col("date")), F.col("date"))
    dense = calendar.select(*keys, days.alias("ds"), F.col(value).alias(name)).select(*keys, F.explode("ds").alias("d__"), name)
    first = calendar.groupBy(*keys).agg(F.min("date").alias("first__"))
    df = df.join(first, keys, "left") if keys else df.crossJoin(F.broadcast(first))  # one row
    df = df.withColumn("d__", F.when(F.col(day).isNotNull(), F.greatest(day, "first__")))
    return df.join(dense, [*keys, "d__"], "left").drop("d__", "first__")


def positions(trades: DataFrame, months: int = 12) -> DataFrame:
    """(trade_id, member, ticker, entry, exit, size_usd) of purchases: out at the member's first later sale of the ticker, or after `months`.

    trades: (trade_id, member, ticker, op, filed, size_usd).
    """
    x = first_later(trades.where("ticker IS NOT NULL AND filed IS NOT NULL"), ["member", "ticker"], "filed", F.col("op") == "sell", "sold")
    out = F.least(F.coalesce("sold", F.add_months("filed", months)), F.add_months("filed", months))
    return x.where("op = 'buy'").select("trade_id", "member", "ticker", F.col("filed").alias("entry"), out.alias("exit"), "size_usd")


def raw_weight(weighting: str) -> Column:
    return {"equal": F.lit(1.0), "size": F.col("size_usd").cast("double"), "sqrt_size": F.sqrt("size_usd")}[weighting]


def portfolio_days(held: DataFrame, prices: DataFrame, cost_bps: float = 20.0, lag_days: int = 1) -> DataFrame:
    """(portfolio, idx, date, gross, cost, net) for every day of the market's calendar.

    held: (portfolio, ticker, entry, exit, raw). A position enters on the first trading day from entry + lag_days on and leaves on the first from exit on;
    entries past the end are dropped. A ticker's holding is the running sum of what entered and left, never below 0; weights are shares of all
    holdings; today's return is yesterday's weights times today's returns, and a change of weights costs cost_bps.
    """
    cal = market_calendar(prices)
    tickers = prices.select("ticker").distinct()
    h = held.join(tickers, "ticker", "left_semi").withColumn("in__", F.date_add("entry", lag_days))
    h = with_next(with_next(h, "in__", cal, [], "idx", "ei").where("ei IS NOT NULL"), "exit", cal, [], "idx", "xi")
    flow = h.select("portfolio", "ticker", F.explode(F.array(F.struct(F.col("ei").alias("idx"), F.col("raw").alias("v")), F.struct(F.col("xi").alias("idx"), (-F.col("raw")).alias("v")))).alias("f"))
    flow = flow.select("portfolio", "ticker", "f.*").where("idx IS NOT NULL").groupBy("portfolio", "ticker", "idx").agg(F.sum("v").alias("v"))
    r = dense_returns(prices, cal)
    used = flow.groupBy("portfolio", "ticker").agg(F.min("idx").alias("since"))
    days = used.join(r, "ticker").where("idx >= since").join(flow, ["portfolio", "ticker", "idx"], "left")
    by_ticker = Window.partitionBy("portfolio", "ticker").orderBy("idx")
    days = days.withColumn("h", F.greatest(F.sum(F.coalesce("v", F.lit(0.0))).over(by_ticker.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    # what is left of a sum of floats that cancels is no holding
    days = days.withColumn("h", F.when(F.col("h") < 1e-6, 0.0).otherwise(F.col("h")))
    days = days.withColumn("w", F.coalesce(F.try_divide("h", F.sum("h").over(Window.partitionBy("portfolio", "idx"))), F.lit(0.0)))
    days = days.withColumn("wp", F.lag("w", 1, 0.0).over(by_ticker))
    out = days.groupBy("portfolio", "idx").agg(
        F.sum(F.col("wp") * F.col("r")).alias("gross"), (cost_bps / 1e4 * F.sum(F.abs(F.col("w") - F.col("wp")))).alias("cost"), F.sum("w").alias("invested"),
        F.sum(F.abs(F.col("w") - F.col("wp"))).alias("turnover"), F.count_if(F.col("w") > 0).alias("holdings"),
    )
    # days before a portfolio's first entry are days of the result as well
    every = cal.join(used.select("portfolio").distinct(), F.lit(True))  # portfolios x days is the size of the result
    out = every.join(out, ["portfolio", "idx"], "left").fillna(0.0, ["gross", "cost", "invested", "turnover"]).fillna(0, ["holdings"])
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def activity(daily: DataFrame) -> DataFrame:
    """Per portfolio: mean turnover a day, mean number of holdings and the first day that any is held, over days from then on."""
    w = Window.partitionBy("portfolio")
    x = daily.withColumn("since", F.min(F.when(F.col("holdings") > 0, F.col("date"))).over(w)).where(F.col("date") >= F.col("since"))
    return x.groupBy("portfolio").agg(F.min("since").alias("active_from"), F.avg("turnover").alias("turnover"), F.avg("holdings").alias("avg_holdings"), N().alias("active_days"))


def curve(daily: DataFrame, r: str = "net") -> DataFrame:
    """daily with equity (compounded) and drawdown per portfolio."""
    w = Window.partitionBy("portfolio").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = daily.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w)))
    return x.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def annual_stats(daily: DataFrame, r: str = "net") -> DataFrame:
    """Per portfolio: growth a year, volatility, Sharpe, Sortino and the deepest fall, over 252 days a year."""
    c = F.col(r)
    x = curve(daily, r).groupBy("portfolio").agg(
        N().alias("days"), (F.exp(F.sum(F.log1p(c)) * 252 / N()) - 1).alias("cagr"), (F.stddev(c) * F.sqrt(F.lit(252.0))).alias("vol"),
        (F.try_divide(F.mean(c), F.stddev(c)) * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.try_divide(F.mean(c), F.stddev(F.when(c < -1e-12, c))) * F.sqrt(F.lit(252.0))).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )
    return x


def benchmark_days(bench: DataFrame, calendar: DataFrame) -> DataFrame:
    """(idx, date, b): the benchmark's returns on the market's calendar, its last price carried forward; 0 at the start."""
    w = Window.orderBy("idx")  # one row per trading day
    x = calendar.join(bench.select("date", "close"), "date", "left").withColumn("p", F.last_value("close", ignoreNulls=True).over(w))
    return x.select("idx", "date", F.coalesce(F.try_divide("p", F.lag("p").over(w)) - 1, F.lit(0.0)).alias("b"))


def own_calendar(prices: DataFrame) -> DataFrame:
    return prices.where("close IS NOT NULL").select("ticker", "date", "close", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("idx"))


def abnormal_returns(buys: DataFrame, prices: DataFrame, bench: DataFrame, horizons: list[int]) -> DataFrame:
    """(trade_id, horizon, ar): return of the ticker over `horizon` of its own days from the first on or after filed, less the benchmark's over the same days.

    Null where the ticker has no such days or no positive price, or the benchmark no day on or after one of the two.
    """
    own = own_calendar(prices)
    x = with_next(buys.select("trade_id", "ticker", "filed"), "filed", own, ["ticker"], "idx", "i").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    px = own.select("ticker", F.col("idx").alias("i"), F.col("date").alias("d0"), F.col("close").alias("p0"))
    py = own.select("ticker", F.col("idx").alias("j"), F.col("date").alias("d1"), F.col("close").alias("p1"))
    x = x.withColumn("j", F.col("i") + F.col("horizon")).join(px, ["ticker", "i"], "left").join(py, ["ticker", "j"], "left")
    days = bench.select("date", "close").where("close IS NOT NULL")
    x = with_next(with_next(x, "d0", days, [], "close", "b0"), "d1", days, [], "close", "b1")
    ar = F.when(F.col("p0") > 0, F.col("p1") / F.col("p0") - F.try_divide("b1", "b0"))
    return x.select("trade_id", "horizon", ar.alias("ar"))


def abnormal_returns_against(buys: DataFrame, prices: DataFrame, benches: DataFrame, horizons: list[int]) -> DataFrame:
    """(trade_id, horizon, benchmark, ar): as abnormal_returns, against each benchmark of benches (benchmark, date, close), few by nature."""
    own = own_calendar(prices)
    x = with_next(buys.select("trade_id", "ticker", "filed"), "filed", own, ["ticker"], "idx", "i").where("i IS NOT NULL").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    px = own.select("ticker", F.col("idx").alias("i"), F.col("date").alias("d0"), F.col("close").alias("p0"))
    py = own.select("ticker", F.col("idx").alias("j"), F.col("date").alias("d1"), F.col("close").alias("p1"))
    x = x.withColumn("j", F.col("i") + F.col("horizon")).join(px, ["ticker", "i"]).join(py, ["ticker", "j"])
    days = benches.where("close IS NOT NULL")
    # the benchmarks' returns are formed per pair of days, which are far fewer than trades
    spans = x.select("d0", "d1").distinct().join(days.select("benchmark").distinct(), F.lit(True))
    spans = with_next(with_next(spans, "d0", days, ["benchmark"], "close", "b0"), "d1", days, ["benchmark"], "close", "b1")
    ar = F.when(F.col("p0") > 0, F.col("p1") / F.col("p0") - F.try_divide("b1", "b0"))
    return x.join(spans, ["d0", "d1"]).select("trade_id", "horizon", "benchmark", ar.alias("ar"))


def style_returns(bought: DataFrame, returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(idx, date, style): daily returns of a style whose weights, the shares of s per ticker in bought (year, ticker, s), hold for the days of their year.

    returns: (ticker, idx, date, r), benchmark: (idx, date, b), which stands in for years without weights.
    """
    total = bought.groupBy("year").agg(F.sum("s").alias("all__"))
    share = bought.join(total, "year").select("year", "ticker", (F.col("s") / F.col("all__")).alias("share"))
    x = returns.withColumn("year", F.year("date")).join(share, ["year", "ticker"]).groupBy("idx").agg(F.sum(F.col("share") * F.col("r")).alias("style"))
    days = benchmark.withColumn("year", F.year("date")).join(total, "year", "left").join(x, "idx", "left")
    return days.select("idx", "date", F.when(F.col("all__").isNull(), F.col("b")).otherwise(F.coalesce("style", F.lit(0.0))).alias("style"))


def trade_returns(held: DataFrame, prices: DataFrame, bench: DataFrame, lag_days: int = 1) -> DataFrame:
    """(trade_id, ret, abn, win, hold_days) from entry + lag_days to exit on the ticker's own days, the exit no later than its last.

    Null where the exit isn't after the entry. win is false where abn is null.
    """
    own = own_calendar(prices)
    last = own.groupBy("ticker").agg(F.max("idx").alias("last"))
    x = held.select("trade_id", "ticker", F.date_add("entry", lag_days).alias("in__"), F.col("exit").alias("out__"))
    x = with_next(with_next(x, "in__", own, ["ticker"], "idx", "i"), "out__", own, ["ticker"], "idx", "j").join(last, "ticker", "left")
    x = x.withColumn("j", F.coalesce("j", "last"))
    px = own.select("ticker", F.col("idx").alias("i"), F.col("date").alias("d0"), F.col("close").alias("p0"))
    py = own.select("ticker", F.col("idx").alias("j"), F.col("date").alias("d1"), F.col("close").alias("p1"))
    x = x.join(px, ["ticker", "i"], "left").join(py, ["ticker", "j"], "left")
    days = bench.select("date", "close").where("close IS NOT NULL")
    x = with_next(with_next(x, "d0", days, [], "close", "b0"), "d1", days, [], "close", "b1")
    ok = (F.col("j") > F.col("i")) & (F.col("p0") > 0)
    x = x.withColumn("ret", F.when(ok, F.col("p1") / F.col("p0") - 1)).withColumn("abn", F.col("ret") - (F.try_divide("b1", "b0") - 1))
    return x.select("trade_id", "ret", "abn", F.coalesce(F.col("abn") > 0, F.lit(False)).alias("win"), F.when(ok, F.datediff("d1", "d0")).alias("hold_days"))


def trade_stats(returns: DataFrame, by: list[str]) -> DataFrame:
    a = F.col("abn")
    win, loss = F.when(a > 0, a), F.when(a <= 0, a)
    x = returns.where("abn IS NOT NULL").groupBy(*by).agg(N().alias("n"), F.avg((a > 0).cast("int")).alias("hit_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
                                                         F.sum(win).alias("w"), F.sum(loss).alias("l"), F.avg(a).alias("mean_abn"), F.median(a).alias("median_abn"))
    return x.withColumn("profit_factor", F.when(F.coalesce("l", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.coalesce("w", F.lit(0.0)) / F.abs("l"))).drop("w", "l")


def skew(c: Column) -> Column:
    """Sample skewness with the correction for bias; null for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value within by, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (N().over(Window.partitionBy(*by, value)) - 1) / 2.0)
