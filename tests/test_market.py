"""Boundary rules of bars, labels and point-in-time joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.core import asof_join, interval_join, interval_rollup
from tidemark.functions.signals import sign_dz
from tidemark.operators import market as mk
from tidemark.operators import trades as tr

DAY = dt.date(2024, 1, 1)
BAR = "symbol string, d date, open double, high double, low double, close double"


def bars(spark, closes, symbol="A"):
    rows = [(symbol, DAY + dt.timedelta(days=i), c, c + 1.0, c - 1.0, c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def event(spark, *days, symbol="A", hour=0):
    rows = [(symbol, dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=d)) for d in days]
    return spark.createDataFrame(rows, "symbol string, t_event timestamp_ntz")


def test_baseline_clamps_at_the_first_bar_and_drops_short_tails(spark):
    closes = [100.0, 110.0, 99.0, 105.0, 120.0, 90.0, 100.0, 130.0, 140.0, 100.0, 101.0, 102.0, 150.0]
    rows = {
        r["t_event"].day - 1: r
        for r in mk.baseline_events(event(spark, 0, 1, 7, 8, 20), bars(spark, closes)).collect()
    }
    # Bar 8 has no fifth bar after it, bar 20 does not exist.
    assert sorted(rows) == [0, 1, 7]
    assert rows[0]["baseline_pre_7d_return_pct"] == 0.0
    assert rows[0]["actual_5d_return_pct"] == -10.0
    assert rows[1]["baseline_pre_7d_return_pct"] == 0.0
    # From bar 0 to bar 6.
    assert rows[7]["baseline_pre_7d_return_pct"] == 0.0
    assert rows[7]["actual_5d_return_pct"] == round((150 - 130) / 130 * 100, 4)


@pytest.mark.parametrize("value, want", [(0.1, 0), (-0.1, 0), (0.1001, 1), (-0.1001, -1), (None, None)])
def test_dead_zone_is_closed(spark, value, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(sign_dz(F.col("x"), 0.1)).first()[0] == want


def test_realised_volatility_needs_five_returns(spark):
    closes = [100.0, 101.0, 99.0, 102.0, 100.0, 103.0, 101.0, 104.0]
    out = {
        r["t_event"].day - 1: r["pre_30d_vol_pct"]
        for r in mk.symbol_features(event(spark, 5, 6, 7), bars(spark, closes)).collect()
    }
    assert out[5] == 0.0
    rets = [b / a - 1 for a, b in zip(closes, closes[1:])][:5]
    mean = sum(rets) / 5
    want = (sum((r - mean) ** 2 for r in rets) / 4) ** 0.5 * 100
    assert out[6] == pytest.approx(want, abs=1e-4)


def test_constant_prices_have_no_volatility(spark):
    out = mk.symbol_features(event(spark, 20), bars(spark, [50.0] * 30)).first()
    assert out["pre_30d_vol_pct"] == 0.0


def test_prior_drift_strict_leaves_out_overlap(spark):
    closes = [float(100 + i) for i in range(20)]
    events = event(spark, 5, 8, 14)
    loose = {r["t_event"].day - 1: r["prior_post_earnings_5d_return_pct"] for r in mk.symbol_features(events, bars(spark, closes)).collect()}
    tight = {r["t_event"].day - 1: r["prior_post_earnings_5d_return_pct"] for r in mk.symbol_features(events, bars(spark, closes), strict=True).collect()}
    assert loose[5] == tight[5] == 0.0
    assert loose[8] == round(5 / 105 * 100, 4) and tight[8] == 0.0
    assert loose[14] == tight[14] == round(5 / 108 * 100, 4)


def test_two_events_on_one_date_share_their_bar(spark):
    rows = [("A", dt.datetime(2024, 1, 6, h)) for h in (3, 9)]
    events = spark.createDataFrame(rows, "symbol string, t_event timestamp_ntz")
    out = mk.symbol_features(events, bars(spark, [float(100 + i) for i in range(20)]))
    got = {r["t_event"].hour: r["prior_post_earnings_5d_return_pct"] for r in out.collect()}
    assert got == {3: 0.0, 9: round(5 / 105 * 100, 4)}


def test_no_feature_changes_when_the_future_is_appended(spark):
    closes = [100.0 + (i * 7 % 11) for i in range(40)]
    events = event(spark, 10, 20)
    company = spark.createDataFrame([("A", "a", "x"), ("B", "b", "x")], "symbol string, name string, sector string")
    edges = spark.createDataFrame([("A", "B", 0.5)], "src string, dst string, weight double")

    def features(n):
        both = bars(spark, closes[:n]).union(bars(spark, [c + i % 3 for i, c in enumerate(closes[:n])], "B"))
        calendar = event(spark, 10, 20).union(event(spark, 12, n - 1, symbol="B"))
        return sorted(map(tuple, mk.market_features(events, both, calendar, company, edges).collect()))

    assert features(26) == features(40)


def test_asof_directions_and_strictness(spark):
    b = bars(spark, [1.0, 2.0, 3.0]).where("day(d) != 2").select("symbol", "d", "close")
    e = event(spark, 0, 1, 2, hour=5)

    def got(**kw):
        return [(r["t_event"].day, r["close"]) for r in asof_join(e, b, **kw).orderBy("t_event").collect()]

    assert got() == [(1, 1.0), (2, 3.0), (3, 3.0)]
    assert got(strict=True) == [(1, 3.0), (2, 3.0)]
    assert got(direction="backward") == [(1, 1.0), (2, 1.0), (3, 3.0)]


MICRO = dt.timedelta(microseconds=1)


@pytest.mark.parametrize("hour", [0, 13])
def test_interval_is_closed_to_the_microsecond(spark, hour):
    t = dt.datetime(2024, 1, 20, hour)
    times = [t, t + MICRO, t - dt.timedelta(days=7), t - dt.timedelta(days=7) - MICRO, t - dt.timedelta(days=3)]
    facts = spark.createDataFrame(
        [("A", x, 1, float(i)) for i, x in enumerate(times)],
        "symbol string, published_at timestamp_ntz, n int, v double",
    )
    e = spark.createDataFrame([("A", t)], "symbol string, t_event timestamp_ntz")
    pairs = interval_join(e, facts, by=["symbol"]).select("v").collect()
    assert sorted(r["v"] for r in pairs) == [0.0, 2.0, 4.0]
    out = interval_rollup(e, facts, ["symbol"], sums=["n"], maxima=["v"]).first()
    assert (out["n"], out["v"]) == (3, 4.0)


def outcome(spark, signal, ahead, entry=100.0, stop=95.0, target=110.0):
    row = spark.createDataFrame(
        [(signal, entry, stop, target, ahead)],
        "signal int, entry double, stop_price double, target_price double, "
        "ahead array<struct<high: double, low: double, close: double>>",
    )
    return tr.first_touch(row).first()


def test_first_touch(spark):
    both = outcome(spark, 1, [(120.0, 90.0, 100.0)])
    assert (both["path_exit_reason"], both["path_return_pct"], both["path_holding_days"]) == ("stop", -5.0, 1)
    late = outcome(spark, 1, [(101.0, 99.0, 100.0), (111.0, 99.0, 105.0)])
    assert (late["path_exit_reason"], late["path_return_pct"], late["path_holding_days"]) == ("target", 10.0, 2)
    short = outcome(spark, -1, [(104.0, 89.0, 95.0)], stop=105.0, target=90.0)
    assert (short["path_exit_reason"], short["path_return_pct"], short["path_won"]) == ("target", 10.0, True)
    timed = outcome(spark, -1, [(101.0, 99.0, 100.0), (102.0, 98.0, 101.0)], stop=105.0, target=90.0)
    assert (timed["path_exit_reason"], timed["path_return_pct"], timed["path_holding_days"]) == ("time", -1.0, 2)
    none = outcome(spark, 1, [])
    assert (none["path_exit_reason"], none["path_return_pct"], none["path_holding_days"]) == ("no_data", None, 0)


def test_average_true_range_needs_fifteen_bars(spark):
    out = mk.structure_features(bars(spark, [10.0] * 16)).orderBy("d").collect()
    assert out[13]["atr_pct"] is None and out[14]["atr_pct"] == pytest.approx(20.0)
    assert out[3]["swing_high"] is None and out[4]["swing_high"] == 11.0
