"""Thresholds of expanding prefixes, and sector returns from running totals, against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.core import prefixes
from tidemark.operators import folds as fd
from tidemark.operators import market as mk


def chunk_rows(spark, values, chunk, wanted):
    rows = [(i // chunk, v, wanted(i // chunk) if i % chunk == chunk - 1 else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "chunk long, value double, n int")


@pytest.mark.parametrize("fan,per_block,chunk", [(2, 1, 3), (3, 2, 1), (64, 4, 5)])
def test_every_prefix_has_its_nth_largest(spark, monkeypatch, fan, per_block, chunk):
    monkeypatch.setattr(prefixes, "FAN", fan)
    draw = random.Random(fan)
    values = [draw.choice([None, *[round(draw.random(), 1) for _ in range(5)]]) for _ in range(20 * chunk)]
    wanted = lambda c: min(1 + c * 2, (c + 1) * chunk)
    got = prefixes.prefix_thresholds(chunk_rows(spark, values, chunk, wanted), 20, 41, per_block)
    want = {}
    for c in range(20):
        held = sorted((v for v in values[: (c + 1) * chunk] if v is not None), reverse=True)
        want[c] = held[wanted(c) - 1] if wanted(c) <= len(held) else None
    assert {r.chunk: r.threshold for r in got.collect()} == want


def test_summaries_grow_with_the_rows(spark):
    """Ten times the rows and folds make ten times the summaries and carried lists, of one size."""
    sizes = {}
    for n in (400, 4000):
        values = [float((k * 7919) % n) for k in range(n)]
        rows = chunk_rows(spark, values, 4, lambda c: 3).withColumn("block", F.floor(F.col("chunk") / 10).cast("long"))
        top = prefixes._summaries(rows, 5)
        carried = prefixes._carried(top, n // 40, 5)
        sizes[n] = [x.agg(F.count(F.lit(1)), F.max(F.size("top"))).first()[:] for x in (top, carried)]
    for (few, a), (many, b) in zip(sizes[400], sizes[4000]):
        assert many == 10 * few and a == b == 5


def events_of(spark, n, seed=1):
    draw, at = random.Random(seed), dt.datetime(2020, 1, 1)
    rows = []
    for k in range(n):
        at += dt.timedelta(hours=draw.randrange(0, 60))
        rows.append((f"s{k % 7}", at, draw.choice([0.5, 0.6, 0.7, round(draw.random(), 3)])))
    return spark.createDataFrame(rows, "symbol string, t_event timestamp_ntz, confidence double")


@pytest.mark.parametrize("n", [0, 5, 13, 60, 301])
def test_fold_thresholds_equal_a_plain_version(spark, n):
    folded = fd.walk_forward_folds(events_of(spark, n), 12, 6)
    got = {r.fold_id: r.threshold for r in fd.confidence_thresholds(folded, 12, 6, 3.0, block_rows=20).collect()}
    rows = sorted(folded.collect(), key=lambda r: r.ord)
    want = {}
    for fold in sorted({r.fold_id for r in rows if r.fold_id is not None}):
        train = rows[: 12 + 6 * fold]
        days = (train[-1].t_event - train[0].t_event).total_seconds() // 86400
        k = min(max(1, round(3.0 * max(1.0, days / 30.0))), len(train))
        want[fold] = sorted((r.confidence for r in train), reverse=True)[k - 1]
    assert got == want


def bars_of(spark, symbols, days, seed=3):
    draw, start = random.Random(seed), dt.date(2021, 1, 1)
    rows = []
    for s in range(symbols):
        price = 50.0 + s
        for d in range(days):
            price = max(1.0, price * (1 + draw.uniform(-0.05, 0.05)))
            if draw.random() < 0.8:
                rows.append((f"s{s}", start + dt.timedelta(days=d), price, price, price, price))
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double")


def test_cohort_return_equals_a_plain_version(spark):
    """One sector holds half of all symbols; some symbols end early or have no bars."""
    bars = bars_of(spark, 12, 60).where("symbol <> 's3' OR d < '2021-01-20'")
    company = spark.createDataFrame(
        [(f"s{k}", "big" if k < 6 else f"c{k % 3}") for k in range(14)] + [("n1", None)], "symbol string, sector string"
    )
    draw = random.Random(8)
    events = spark.createDataFrame(
        [(f"s{draw.randrange(14)}", dt.datetime(2020, 12, 20) + dt.timedelta(hours=draw.randrange(2200))) for _ in range(80)]
        + [("n1", dt.datetime(2021, 1, 9)), ("unknown", dt.datetime(2021, 1, 9))],
        "symbol string, t_event timestamp_ntz",
    ).distinct()
    got = {(r.symbol, r.t_event): r.sector_cohort_5d_return_pct for r in mk.cohort_return(events, bars, company).collect()}
    features = {}
    for r in sorted(mk.bar_features(bars).collect(), key=lambda r: (r.symbol, r.d)):
        features.setdefault(r.symbol, []).append((r.d, r.last_5))
    sector = {r.symbol: r.sector for r in company.collect()}
    assert len(got) == events.count()
    for (symbol, at), value in got.items():
        peers = [s for s in sector if sector[s] is not None and sector.get(symbol) == sector[s] and s != symbol]
        found = []
        for s in peers:
            later = [v for d, v in features.get(s, []) if d >= at.date()]
            if later and later[0] is not None:
                found.append(later[0])
        want = round(float(np.mean(found)), 4) if found else 0.0
        assert math.isclose(value, want, abs_tol=1.01e-4)


def test_no_row_of_the_cohort_is_a_member_at_a_date(spark):
    """Steps are as many as bars (and an end per symbol), whatever the events."""
    bars = bars_of(spark, 5, 30)
    steps = mk.return_steps(mk.bar_features(bars).select("symbol", "d", "last_5"))
    assert steps.count() == bars.count() + 5
    total = steps.groupBy("symbol").agg(F.sum("change").alias("c"), F.sum("count").alias("n")).collect()
    assert all(r.c == 0 and r.n == 0 for r in total)


def test_drawdown_of_an_account_that_sinks_below_zero(spark):
    """Returns below -100 percent turn the level over; peak and drawdown follow it row by row."""
    from tidemark.core.ordering import growth_summary, running_growth

    draw = random.Random(2)
    for scale in (3, 180, 400):
        rows = [
            (g, k, dt.date(2020, 1, 1) + dt.timedelta(days=k // 3), draw.uniform(-scale, scale))
            for g in "ab"
            for k in range(40)
        ]
        df = spark.createDataFrame(rows, "g string, k int, d date, r double")
        end = {r.g: r for r in growth_summary(df, "r", [F.col("k")], [F.col("d")], ["g"]).collect()}
        each = {
            (r.g, r.k): r
            for r in running_growth(df, "r", [F.col("k")], [F.col("d")], ["g"]).collect()
        }
        for g in "ab":
            level, peak, worst = 1.0, 1.0, 0.0
            for _, k, _, r in (x for x in rows if x[0] == g):
                level *= 1 + r / 100
                peak = max(peak, level)
                worst = min(worst, (level - peak) / peak * 100)
                assert math.isclose(each[g, k].equity, level, rel_tol=1e-9)
                assert math.isclose(each[g, k].drawdown_pct, (level - peak) / peak * 100, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(end[g].growth, level, rel_tol=1e-9)
            assert math.isclose(end[g].worst_drawdown_pct, worst, rel_tol=1e-9, abs_tol=1e-9)


def test_quantiles_of_any_group_size(spark):
    from tidemark.core.ordering import exact_quantiles

    draw = random.Random(5)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 50 + [8.0], "wide": [draw.uniform(-1e6, 1e6) for _ in range(500)],
              "small": [draw.gauss(0, 1e-4) for _ in range(333)], "zeros": [0.0, -0.0, 0.0], None: [1.0, 5.0, 9.0]}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r.q for r in exact_quantiles(df.where("g IS NOT NULL"), "v", qs, ["g"], name="q").collect()}
    for g, values in groups.items():
        if g is not None:
            assert got[g] == pytest.approx([float(np.quantile(values, q)) for q in qs], rel=1e-12, abs=1e-18)
    assert "empty" not in got
    every = [v for values in groups.values() for v in values]
    assert exact_quantiles(df, "v", qs, name="q").first().q == pytest.approx([float(np.quantile(every, q)) for q in qs])


def test_summaries_of_groups_and_of_nothing(spark):
    from tidemark.operators.resample import distribution_summary

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in distribution_summary(df, "v", ["g"]).collect()}
    assert got == {"a": (2.0, 1.4142, 1.1, 2.0, 2.9), "b": (None,) * 5, None: (2.0, 0.0, 2.0, 2.0, 2.0)}


def test_stored_lexicon_scores_stand(spark):
    from tidemark.operators.news import document_facts

    docs = spark.createDataFrame(
        [("a", None, "gain", "gain", 1.0), ("b", None, "loss", "gain loss", 1.0), ("c", None, "", "", 1.0)],
        "doc_id string, doc_ts timestamp_ntz, title string, body string, relevance_score double",
    )
    stored = spark.createDataFrame([("a", -0.25), ("c", None), ("z", 1.0)], "doc_id string, score double")
    plain = {r.doc_id: r.lex for r in document_facts(docs, ["gain"], ["loss"]).collect()}
    got = {r.doc_id: r.lex for r in document_facts(docs, ["gain"], ["loss"], lexicon_scores=stored).collect()}
    assert plain["a"] == 1.0 and got == {**plain, "a": -0.25}
