"""Metrics, selection, resampling and walk-forward fits against brute force."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.core import exact_median, ordinal, shuffles
from tidemark.core.ordering import growth_summary, running_growth
from tidemark.operators import folds as fd
from tidemark.operators import resample as rs
from tidemark.operators import sessions as ss
from tidemark.operators import trades as tr
from tidemark.plans import draws
from tidemark.plans import permutation as pm
from tidemark.plans import walkforward as wf

# Published sessions (date, direction, session return) and their metrics.
SESSIONS = [
    ("2023-11-07", -1, -0.8189),
    ("2024-05-02", 1, -0.7139),
    ("2024-05-10", 1, -1.1933),
    ("2025-05-01", 1, -0.8379),
    ("2025-07-31", 1, -2.0225),
    ("2025-08-06", 1, 0.7327),
    ("2025-10-16", -1, -1.0984),
    ("2025-10-29", -1, -0.2262),
    ("2026-02-05", 1, -0.6551),
    ("2026-02-26", -1, -1.1561),
    ("2026-04-17", -1, 0.505),
]
PUBLISHED = {
    "trades": 11,
    "hit_rate": 0.4545,
    "long_trades": 6,
    "short_trades": 5,
    "mean_session_return_long_pct": -0.7817,
    "mean_session_return_short_pct": -0.5589,
    "directional_return_pct_mean": -0.1723,
    "directional_return_pct_cum": -1.9328,
    "sharpe_annualized": -2.6217,
    "max_drawdown_pct": -4.6881,
    "round_trip_cost_pct": 0.02,
    "after_cost_hit_rate": 0.4545,
    "after_cost_mean_pct": -0.1923,
    "after_cost_cum_pct": -2.1487,
    "after_cost_sharpe": -2.926,
}


def sessions(spark):
    rows = [
        (dt.date.fromisoformat(d), s, r, s * r, s * r > 0, ">=0.80") for d, s, r in SESSIONS
    ]
    return spark.createDataFrame(
        rows,
        "session_date date, direction int, session_return_pct double, "
        "directional_return_pct double, hit boolean, confidence_bucket string",
    )


def test_published_overlay_metrics(spark):
    assert ss.overlay_metrics(sessions(spark)).first().asDict() == PUBLISHED


def test_empty_buckets_stay(spark):
    rows = ss.by_confidence_bucket(sessions(spark)).orderBy("ord").collect()
    assert [r["trades"] for r in rows] == [0, 0, 0, 0, 11]
    assert rows[4]["hit_rate"] == 0.4545 and rows[0]["hit_rate"] is None


def test_session_permutation_agrees_in_distribution(spark):
    out = rs.session_permutation(sessions(spark), 1000).first()
    assert out["observed_hit_rate"] == 0.4545
    assert out["p_value_hit_rate_greater"] == pytest.approx(0.8182, abs=0.05)
    assert out["p_value_cum_return_greater"] == pytest.approx(0.6474, abs=0.05)


def trades(spark, returns, weight=1.0):
    rows = [
        ("s", dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3), i, r, True, weight)
        for i, r in enumerate(returns)
    ]
    return spark.createDataFrame(
        rows,
        "strategy string, t_event timestamp_ntz, k int, net_return_pct double, taken boolean, "
        "position_weight double",
    )


def metrics(spark, returns):
    return tr.strategy_metrics(
        trades(spark, returns), ["strategy"], [F.col("t_event"), F.col("k")], [F.to_date("t_event")]
    ).first()


def test_strategy_metrics_against_a_loop(spark):
    rng = random.Random(1)
    returns = [round(rng.uniform(-6, 5), 4) for _ in range(50)]
    out = metrics(spark, returns)
    level, peak, worst = 1.0, 1.0, 0.0
    for r in returns:
        level *= 1 + r / 100
        peak = max(peak, level)
        worst = max(worst, (peak - level) / peak * 100)
    assert out["max_drawdown_pct"] == pytest.approx(worst, abs=1e-4)
    assert out["cumulative_return_pct"] == pytest.approx((level - 1) * 100, abs=1e-4)
    assert out["median_trade_return_pct"] == pytest.approx(float(np.median(returns)), abs=1e-4)
    sharpe = np.mean(returns) / np.std(returns, ddof=1) * math.sqrt(50)
    assert out["sharpe_ratio"] == pytest.approx(sharpe, abs=1e-4)


def test_one_trade_flat_trades_and_no_trades(spark):
    one = metrics(spark, [-2.0])
    assert (one["trades"], one["sharpe_ratio"], one["max_drawdown_pct"]) == (1, None, 2.0)
    flat = metrics(spark, [1.0, 1.0])
    assert (flat["sharpe_ratio"], flat["max_drawdown_pct"], flat["hit_rate"]) == (None, 0.0, 1.0)
    none = tr.strategy_metrics(
        trades(spark, [1.0]).withColumn("taken", F.lit(False)),
        ["strategy"],
        [F.col("t_event")],
        [F.to_date("t_event")],
    ).first()
    assert (none["trades"], none["skipped"], none["hit_rate"]) == (0, 1, None)


def test_growth_in_chunks_equals_growth_in_one(spark):
    rng = random.Random(2)
    rows = trades(spark, [rng.uniform(-9, 9) for _ in range(60)])
    order = [F.col("t_event"), F.col("k")]
    for seeded in (True, False):
        fine = growth_summary(rows, "net_return_pct", order, [F.to_date("t_event")], seeded=seeded).first()
        whole = growth_summary(rows, "net_return_pct", order, [F.lit(0)], seeded=seeded).first()
        assert fine["growth"] == pytest.approx(whole["growth"])
        assert fine["worst_drawdown_pct"] == pytest.approx(whole["worst_drawdown_pct"])
        curve = running_growth(rows, "net_return_pct", order, [F.to_date("t_event")], seeded=seeded)
        assert curve.agg(F.min("drawdown_pct")).first()[0] == pytest.approx(whole["worst_drawdown_pct"])


def test_position_over_two_chunk_levels(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(40), i) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, day int, k int").repartition(7)
    out = ordinal(df, [F.col("day"), F.col("k")], [F.col("day"), F.floor(F.col("k") / 10)], by=["g"])
    for g in ("a", "b"):
        want = sorted((d, k) for x, d, k in rows if x == g)
        got = [(r["day"], r["k"]) for r in out.where(F.col("g") == g).orderBy("ord").collect()]
        assert got == want
    assert sorted(r["ord"] for r in out.where("g = 'a'").collect()) == list(range(200))


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.1, 0.105, 2.0, -3.0, rng.uniform(-5, 5)]) for _ in range(n)]
    df = spark.createDataFrame([("g", x) for x in values], "g string, v double")
    assert exact_median(df, "v", ["g"]).first()["median"] == pytest.approx(float(np.median(values)))


def events(spark, n=60, symbols=3, hot=0):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        symbol = "HOT" if i < hot else f"S{i % symbols}"
        rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), rng.choice([-1, 1]), float(i), rng.random()))
    return spark.createDataFrame(
        rows,
        "symbol string, t_event timestamp_ntz, actual_sign int, actual_5d_return_pct double, x double",
    )


@pytest.mark.parametrize("method", rs.BLOCKS)
def test_permutation_keeps_outcomes_per_block(spark, method):
    df = events(spark, 60, hot=25)
    out = rs.permute_outcomes(df, 3, method, seed=7)
    block = {"symbol_block": F.col("symbol"), "month_block": F.date_format("t_event", "yyyy-MM"), "global": F.lit(1)}[method]

    def outcomes(frame, *by):
        rows = frame.withColumn("block", block.cast("string")).collect()
        found = {}
        for r in rows:
            found.setdefault((*[r[b] for b in by], r["block"]), []).append((r["actual_sign"], r["actual_5d_return_pct"]))
        return {k: sorted(v) for k, v in found.items()}

    base = outcomes(df)
    shuffled = outcomes(out, "perm_id")
    assert len(shuffled) == 3 * len(base)
    assert all(v == base[k[1:]] for k, v in shuffled.items())
    same = rs.permute_outcomes(df.repartition(5), 3, method, seed=7)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, out.select(*same.columns).collect()))


def _shuffled_by_hand(rows, n_perm, seed, block_of):
    """Rows (symbol, t_event, outcome): the copies that ``permute_outcomes`` must make."""
    out, blocks = [], {}
    for row in rows:
        if block_of(row) is not None:
            blocks.setdefault(block_of(row), []).append(row)
    for own in blocks.values():
        placed = sorted((r for r in own if r[1]), key=lambda r: (r[1], r[0] is not None, r[0]))
        placed = [None] * (len(own) - len(placed)) + placed  # a row without a time takes a place, the first
        for p in range(1, n_perm + 1):
            def key(r):
                text = "|".join(str(x) for x in (seed, p, r[0], r[1]) if x is not None)
                return hashlib.md5(text.encode()).hexdigest()
            out += [(p, a[0], a[1], b[2]) for a, b in zip(placed, sorted(own, key=key)) if a]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [3_000_000, 30, 0])
@pytest.mark.parametrize("method", rs.BLOCKS)
def test_copies_are_made_where_the_block_lies(spark, method, block_rows):
    rng = random.Random(3)
    rows = [
        (f"S{i % 7}" if i % 23 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i) if i % 29 else None, i)
        for i in range(150)
    ]
    rows += [("HOT", dt.datetime(2024, 1, 5, 0, 0, 1) + dt.timedelta(hours=i), 1000 + i) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, t_event timestamp_ntz, o int").repartition(3)
    out = rs.permute_outcomes(df, 20, method, 7, ["o"], block_rows)
    block_of = {
        "symbol_block": lambda r: r[0], "month_block": lambda r: r[1] and r[1].strftime("%Y-%m"), "global": lambda r: 1,
    }[method]
    got = sorted((tuple(r[c] for c in ("perm_id", "symbol", "t_event", "o")) for r in out.collect()), key=str)
    assert got == _shuffled_by_hand(rows, 20, 7, block_of)
    if block_rows > len(rows):  # nothing that was copied is sent on
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Exchange")


def test_equal_keys_are_told_apart_by_the_rest_of_the_hash(spark, monkeypatch):
    rows = [(f"S{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(40)]
    table = pa.table(
        {
            "symbol": [r[0] for r in rows], "t_event": [r[1] for r in rows], "o": [r[2] for r in rows],
            "__block": ["all"] * 40, "__group": [0] * 40, "__groups": [1] * 40,
            "__s": [f"|{r[0]}" for r in rows], "__t": [f"|{r[1]}" for r in rows],
        }
    )
    (unit,) = shuffles.read_units(table.to_batches(), 2, 42)
    want = [(p, s.tolist()) for p, s in unit.sources()]
    assert [(p, unit._sorted(p, np.zeros(40, np.uint64)).tolist()) for p in (1, 2)] == want


def test_a_block_of_one_stays(spark):
    df = events(spark, 5, symbols=5)
    out = rs.permute_outcomes(df, 2, "symbol_block")
    assert out.join(df, ["symbol", "t_event", "actual_sign", "actual_5d_return_pct"]).count() == 10


def test_top_k_with_ties_and_too_few(spark):
    rows = [
        (0, "A", 1, 1, 0.9), (0, "B", 1, 1, 0.9), (0, "C", 2, 1, 0.5), (0, "D", 1, -1, 0.2),
        (1, "E", 3, 1, 0.1),
    ]
    df = spark.createDataFrame(
        [(f, s, dt.datetime(2024, 1, d), x, c) for f, s, d, x, c in rows],
        "fold_id int, symbol string, t_event timestamp_ntz, signal int, confidence double",
    )
    got = fd.top_k_signals(df, ["fold_id"], 2, 3).collect()
    assert sorted(r["symbol"] for r in got) == ["A", "B", "D", "E"]
    assert [r["symbol"] for r in fd.top_k_signals(df, ["fold_id"], 1, 0).orderBy("fold_id").collect()] == ["A", "E"]


def _newton(x, y):
    """Class-balanced, L2-penalised logistic regression of one training set."""
    mean, std = x.mean(0), x.std(0)
    u = np.column_stack([np.ones(len(x)), (x - mean) / np.where(std < 1e-9, 1, std)])
    n, ones = len(y), y.sum()
    w = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones)))
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    theta = np.zeros(u.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-u @ theta))
        grad = u.T @ (w * (p - y)) + ridge @ theta
        theta -= np.linalg.solve((u * (w * p * (1 - p))[:, None]).T @ u + ridge, grad)
    return theta, mean, np.where(std < 1e-9, 1, std)


def frame(spark, n=80):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        a, b = rng.normal(), 5 * rng.normal()
        up = int(a + 0.3 * b / 5 + rng.normal() > 0)
        rows.append((f"S{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * i), up, a, b, a, [float(up)]))
    return spark.createDataFrame(
        rows,
        "symbol string, t_event timestamp_ntz, label int, a double, b double, "
        "baseline_pre_7d_return_pct double, labels array<double>",
    )


def test_walk_forward_fits_equal_one_fit_per_fold(spark):
    df = frame(spark)
    folded = fd.walk_forward_folds(df, 48, 12).cache()
    models = wf.fit_folds(folded, ["a", "b"])
    got = {
        (r["symbol"], r["t_event"]): r["proba"] for r in wf.score_folds(folded, models).collect()
    }
    rows = df.orderBy("t_event").collect()
    x = np.array([[r["a"], r["b"]] for r in rows])
    y = np.array([r["label"] for r in rows], float)
    want, cuts = {}, {}
    for fold, start in enumerate(range(48, 80, 12)):
        theta, mean, std = _newton(x[:start], y[:start])
        for i in range(start, min(start + 12, 80)):
            z = theta[0] + (x[i] - mean) / std @ theta[1:]
            want[rows[i]["symbol"], rows[i]["t_event"]] = 1 / (1 + math.exp(-z))
        p = 1 / (1 + np.exp(-(theta[0] + (x[:start] - mean) / std @ theta[1:])))
        days = (rows[start - 1]["t_event"] - rows[0]["t_event"]).days
        k = min(max(1, round(3.0 * max(1.0, days / 30.0))), start)
        cuts[fold] = np.sort(np.maximum(p, 1 - p))[::-1][k - 1]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    levels = {r["fold_id"]: r["threshold"] for r in wf.train_thresholds(folded, models).collect()}
    assert levels == {k: pytest.approx(v, abs=1e-6) for k, v in cuts.items()}


def test_chains_of_folds_fit_every_permutation_in_few_jobs(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, 240)
    draws = [[float(v) for v in rng.permutation(np.arange(240) % 3 == 0)] for _ in range(240)]
    labels = {r["t_event"]: [float(r["label"]), *d[:4]] for r, d in zip(df.collect(), draws)}
    # Under the last permutation, labels have one class in the first folds.
    late = sorted(labels)[100:]
    for t in labels:
        labels[t][4] = float(t in late)
    table = spark.createDataFrame(list(labels.items()), "t_event timestamp_ntz, labels array<double>")
    folded = fd.walk_forward_folds(df.drop("labels").join(table, "t_event"), 48, 12).cache()
    folded.count()

    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    before = jobs()
    models = wf.fit_folds(folded, ["a", "b"], n_perm=5, perms=2, chain=5, keep=0)
    assert jobs() - before < 40
    got = {(r["fold_id"], r["pb"]): r.asDict() for r in models.table.collect()}
    rows = df.orderBy("t_event").collect()
    x = np.array([[r["a"], r["b"]] for r in rows])
    scaled = (x - models.means) / models.stds
    assert len(got) == 16 * 3
    for fold, start in enumerate(range(48, 240, 12)):
        for perm in range(5):
            m = got[fold, perm // 2]
            theta = np.reshape(m["theta"], (-1, 3))[perm % 2]
            y = np.array([labels[r["t_event"]][perm] for r in rows[:start]])
            if y.min() == y.max():
                assert m["up"][perm % 2] == 0 and not theta.any()
                continue
            want, mean, std = _newton(x[:start], y)
            z = theta[0] + (scaled[:start] - m["mean"]) / m["std"] @ theta[1:]
            assert z == pytest.approx(want[0] + (x[:start] - mean) / std @ want[1:], abs=1e-4)


def test_scores_of_permutations_hold_outcomes_but_no_features(spark):
    sign = F.col("label") * 2 - 1
    df = frame(spark).drop("labels").withColumns(
        {"actual_sign": sign, "actual_5d_return_pct": sign * 1.5}
    )
    scored = pm.walk_forward_scores(df, ["a", "b"], 3, "global", 7)
    assert not {"a", "b", "baseline_pre_7d_return_pct"} & set(scored.columns)
    rows = scored.collect()
    assert sorted({r["perm_id"] for r in rows}) == [0, 1, 2, 3] and len(rows) == 4 * 32
    truth = {r["t_event"]: r["label"] for r in df.collect()}
    assert all(r["label"] == truth[r["t_event"]] for r in rows if r["perm_id"] == 0)
    metrics = pm.walk_forward_draws(scored, "lane", 0.0).collect()
    assert len(metrics) == 4 and all(r["trades"] == 32 for r in metrics)


def test_one_class_falls_back_to_momentum(spark):
    df = frame(spark, 60).withColumns({"label": F.lit(1), "labels": F.array(F.lit(1.0))})
    folded = fd.walk_forward_folds(df, 48, 12).cache()
    models = wf.fit_folds(folded, ["a"])
    rows = wf.score_folds(folded, models).collect()
    assert len(rows) == 12
    for r in rows:
        assert r["proba"] == pytest.approx(min(0.95, 0.5 + abs(r["a"]) / 24))
        assert r["signal"] == (1 if r["a"] > 0 else -1)


def test_planted_signal_and_saved_model(spark, tmp_path):
    from tidemark.operators import model as md

    df = frame(spark)
    model = md.fit_classifier(df, ["a", "b"], "logistic")
    md.save_model(model, str(tmp_path / "m"), spark)
    again = md.load_model(str(tmp_path / "m"), spark)
    first = [r["proba"] for r in md.predict(model, df).orderBy("t_event").collect()]
    second = [r["proba"] for r in md.predict(again, df).orderBy("t_event").collect()]
    assert first == second and all(0 <= p <= 1 for p in first)
    right = sum((p >= 0.5) == bool(r["label"]) for p, r in zip(first, df.orderBy("t_event").collect()))
    assert right / len(first) > 0.6
    with pytest.raises(ValueError):
        md.fit_classifier(df.where("label = 1"), ["a"], "logistic")


def _signalled(spark, n=180):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        symbol = "HOT" if i % 3 == 0 else f"S{i % 9}"
        # Losses of more than all, so that levels sink below zero; one event returns nothing known.
        ret = None if i == 50 else round(rng.gauss(0, 90), 4)
        at = dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=i // 6)
        rows.append((symbol, at, rng.choice([-1, 1]), ret, rng.random(), rng.choice([-1, 0, 1]), rng.choice([-1, 1])))
    return spark.createDataFrame(
        rows,
        "symbol string, t_event timestamp_ntz, actual_sign int, actual_5d_return_pct double, "
        "enhanced_confidence double, a int, b int",
    )


@pytest.mark.parametrize("method", rs.BLOCKS)
def test_packed_draws_are_the_metrics_of_all_copies(spark, method):
    df = _signalled(spark).dropDuplicates(["symbol", "t_event"]).cache()
    lanes = [("a", "one"), ("b", "two")]
    want = pm.heuristic_draws(df, lanes, 30, method, 5, 0.3, block_rows=0)
    got = pm.heuristic_draws(df, lanes, 30, method, 5, 0.3)

    def rows(frame):
        return {(r["strategy"], r["perm_id"]): r.asDict() for r in frame.select(*want.columns).collect()}

    want, got = rows(want), rows(got)
    assert len(want) == 2 * 31 and want.keys() == got.keys()
    for key, row in want.items():
        assert got[key] == {c: pytest.approx(x, rel=1e-9, abs=2e-4) if isinstance(x, float) else x for c, x in row.items()}
    assert any(r["max_drawdown_pct"] > 100 for r in want.values())


def test_draws_are_not_stored_event_by_event(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(draws, "cut_lineage", lambda df: (stored.append(df.count()), df)[1])
    df = _signalled(spark).dropDuplicates(["symbol", "t_event"]).coalesce(1).cache()
    out = pm.heuristic_draws(df, [("a", "one")], 200, "global", 5)
    assert out.count() == 201
    assert stored and max(stored) < 200 * df.count() / 4
