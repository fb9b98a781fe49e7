"""The portfolio and its tests on a few days computed by hand."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tradeloom.operators import inference as I
from tradeloom.operators import market as M
from tradeloom.operators import ranks as R

D = [date(2024, 1, x) for x in (2, 3, 4, 5, 8, 9)]


def panel(spark):
    a = [(t, d, p) for t, ps in (("A", (10, 11, 12, 12, 6, 6)), ("B", (20, 20, None, 21, 21, 42))) for d, p in zip(D, ps) if p]
    return spark.createDataFrame([(t, d, float(p)) for t, d, p in a], "ticker string, date date, close double")


def test_returns_are_clipped_and_gaps_are_zero(spark):
    p = panel(spark)
    got = {(r["ticker"], r["date"].day): round(r["r"], 6) for r in M.dense_returns(p, M.market_calendar(p)).collect()}
    assert [got["A", d.day] for d in D] == [0, 0.1, round(1 / 11, 6), 0, -0.5, 0]
    assert [got["B", d.day] for d in D] == [0, 0, 0, 0, 0, 0.5]


def test_portfolio_by_hand(spark):
    held = spark.createDataFrame([("p", "A", D[0], D[4], 1.0), ("p", "B", D[1], date(2024, 3, 1), 3.0), ("p", "C", D[0], D[1], 9.0)], "portfolio string, ticker string, entry date, exit date, raw double")
    got = {r["date"].day: (round(r["gross"], 6), round(r["cost"], 6), round(r["invested"], 6)) for r in M.portfolio_days(held, panel(spark)).collect()}
    # A enters on the 3rd, B on the 4th; A leaves on the 8th
    assert got == {2: (0, 0, 0), 3: (0, 0.002, 1), 4: (round(1 / 11, 6), 0.003, 1), 5: (0, 0, 1), 8: (-0.125, 0.001, 1), 9: (0.5, 0, 1)}


def test_exit_before_the_lagged_entry_leaves_no_holding_below_zero(spark):
    held = spark.createDataFrame([("p", "A", D[2], D[2], 1.0)], "portfolio string, ticker string, entry date, exit date, raw double")
    assert all(0 <= r["invested"] <= 1 for r in M.portfolio_days(held, panel(spark)).collect())


def test_least_squares_and_tails():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    b, t, r2 = I.least_squares(1 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=500), x, 5)
    assert np.allclose(b, [1, 2, -1], atol=0.03) and (np.abs(t) > 50).all() and r2 > 0.99
    assert abs(I.f_tail(4.0, 1, 10) - 0.07338803) < 1e-7 and abs(I.f_tail(2.5, 3, 20) - 0.08876) < 2e-4
    assert abs(I.beta_cdf(0.5, 2, 3) - 0.6875) < 1e-12


def chosen(spark, keyed, k):
    rows = [(2020, i, bool(x), -float(i)) for i, x in enumerate(keyed)]
    df = spark.createDataFrame(rows, "decision_year int, member int, key boolean, score double")
    return [r["member"] for r in sorted(I.select_members(df, "score", k).collect(), key=lambda r: r["place"])]


def test_quota(spark):
    late = [i in (7, 8, 9) for i in range(10)]
    assert chosen(spark, late, 4) == [0, 1, 2, 3]  # an even number fills up before the quota binds
    assert chosen(spark, late, 12) == list(range(10))
    assert chosen(spark, [True, False, False, True], 3) == [0, 1, 3]  # the third place is for one with a key
    assert chosen(spark, [False, False, False, True], 3) == [0, 1, 2]  # one place is beyond the quota and no key has come yet
    assert chosen(spark, [True, True, True, False], 3) == [0, 1, 2] and chosen(spark, [], 3) == []


def test_joint_test_of_one_asset_is_the_square_of_its_t(spark):
    """Against ordinary least squares by hand: for a single asset F is t squared of alpha but for the degrees of freedom that F is scaled with."""
    rng = np.random.default_rng(3)
    f, n = rng.normal(0.01, 1, (120, 2)), 120
    y = 0.2 + f @ [0.5, -0.3] + rng.normal(size=n)
    x = np.column_stack([np.ones(n), f])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    m, s = f.mean(0), np.cov(f, rowvar=False)
    wanted = n * (n - 1 - 2) / (n - 2 - 1) * b[0] ** 2 / ((e @ e) / (n - 3)) / (1 + m @ np.linalg.inv(s) @ m)
    rows = [("t", "p", i, float(y[i]), 0.0, *map(float, f[i])) for i in range(n)] + [("t", "p", 999, None, 0.0, 1.0, 1.0)]
    (got,) = I.joint_test(spark.createDataFrame(rows, "test string, portfolio string, date int, net double, rf double, mkt double, smb double"), ("mkt", "smb")).collect()
    assert abs(got["stat"] - wanted) < 1e-8 and (got["n"], got["t"], got["k"]) == (1, 120, 2) and abs(got["p"] - I.f_tail(wanted, 1, 117)) < 1e-12


def test_factor_alpha_by_hand(spark):
    rng = np.random.default_rng(5)
    mkt = rng.normal(0, 0.01, 80)
    net = 0.001 + 1.2 * mkt + rng.normal(0, 0.002, 80)
    df = spark.createDataFrame([("p", float(a), 0.0001, float(m)) for a, m in zip(net, mkt)] + [("short", 0.1, 0.0, 0.1)], "portfolio string, net double, rf double, mkt double")
    got = {r["portfolio"]: r for r in I.factor_alpha(df, "capm", 5).collect()}
    slope = np.cov(net - 0.0001, mkt)[0, 1] / np.var(mkt, ddof=1)
    alpha = (net - 0.0001).mean() - slope * mkt.mean()
    assert abs(got["p"]["beta"] - slope) < 1e-9 and abs(got["p"]["alpha"] - alpha * 252) < 1e-9 and got["short"]["alpha"] is None


def test_probability_of_skill(spark):
    import math

    rows = [("a", 0.1, 100, 0.0, 3.0), ("b", 0.0, 100, 0.0, 3.0), ("c", -0.1, 100, 0.0, 3.0)]
    got = {r["portfolio"]: r for r in I.probability_of_skill(spark.createDataFrame(rows, "portfolio string, sr double, n long, skew double, kurt double"), trials=10).collect()}
    z = 0.1 * math.sqrt(99) / math.sqrt(1 + 0.5 * 0.01)
    assert abs(got["a"]["psr"] - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-9 and abs(got["b"]["psr"] - 0.5) < 1e-9
    assert got["a"]["dsr"] < got["a"]["psr"] and abs(got["a"]["chance"] - 0.1 * 1.57) < 0.01


def test_positions_long_before_the_first_price(spark):
    """A position opened years before the first price enters on the first day; a trade then filed is measured from it."""
    held = spark.createDataFrame([("p", "A", date(2015, 6, 1), D[4], 1.0)], "portfolio string, ticker string, entry date, exit date, raw double")
    got = {r["date"].day: r["invested"] for r in M.portfolio_days(held, panel(spark)).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 8: 0, 9: 0}
    buys = spark.createDataFrame([(1, "A", date(1999, 1, 1)), (2, "A", None), (3, "Z", D[0])], "trade_id int, ticker string, filed date")
    bench = panel(spark).where("ticker = 'A'").select("date", F.lit(1.0).alias("close"))
    ar = {r["trade_id"]: r["ar"] for r in M.abnormal_returns(buys, panel(spark), bench, [1]).collect()}
    assert abs(ar[1] - 0.1) < 1e-9 and ar[2] is None and ar[3] is None


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in rng.integers(0, 50, 700)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(1000, None)], "id int, v double")
    got = R.ranked(df.where("v IS NOT NULL"), [F.col("v"), F.col("id")], "k", {"total": "v"}).collect()
    wanted = sorted((x, i) for i, x in enumerate(v))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["k"])] == wanted and sorted(r["k"] for r in got) == list(range(1, 701))
    assert {r["k"]: r["total"] for r in got}[700] == sum(v)
    (q,) = R.quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()
    assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(v, [0, 0.37, 1]))
    assert R.quantiles(df.where("false"), "v", {"a": 0.5}).collect()[0]["a"] is None


def test_later_trades_do_not_change_a_years_scores(spark):
    rows = [(m, date(2020 + i % 4, 3, 1), 0.1 * (i % 5), 0.05 * (i % 7) - 0.1) for m in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "member int, exit date, ret double, abn double")
    years = spark.createDataFrame([(2021,)], "decision_year int")
    full, cut = I.scoreboard(df, years).collect(), I.scoreboard(df.where("year(exit) <= 2021"), years).collect()
    assert sorted(map(str, full)) == sorted(map(str, cut))
