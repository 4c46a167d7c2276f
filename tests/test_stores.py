"""Backfills in any order, account peaks, inputs left alone, and edges that only weigh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import journal as jn
from tidemark.operators import model as md
from tidemark.sources.calendar import default_edges
from tidemark.streaming import jobs


def daily(spark, first=0, days=40):
    start = dt.datetime(1996, 1, 1, 9)
    rows = [
        (str(k), f"u{k}", start + dt.timedelta(days=k), f"t{k}") for k in range(first, first + days)
    ]
    return spark.createDataFrame(rows, "doc_id string, url string, doc_ts timestamp_ntz, title string")


@pytest.mark.parametrize(
    "ranges",
    [
        [("1996-01-01", "1996-02-10"), ("1996-01-01", "1996-01-10")],
        [("1996-01-01", "1996-02-10"), ("1996-01-05", "1996-02-10")],
        [("1996-01-20", "1996-02-10"), ("1996-01-01", "1996-01-25"), ("1996-01-01", "1996-02-10")],
        [("1996-01-01", "1996-02-10")] * 2,
    ],
)
def test_backfill_leaves_one_row_per_url(spark, ranges):
    store = f"{jobs.work_dir(spark, 'backfill-test')}/documents"
    docs = daily(spark)
    # A copy of a URL on another day, in another slice.
    copies = docs.where("doc_id = '3'").withColumn("doc_ts", F.expr("doc_ts + INTERVAL 20 DAYS"))
    for start, end in ranges:
        jobs.backfill(docs.unionByName(copies), store, start, end, 14)
    rows = jobs.backfill_table(spark, store, docs.schema).read().collect()
    assert sorted(r.url for r in rows) == sorted(f"u{k}" for k in range(40))
    assert all((r.slice - dt.date(1970, 1, 1)).days % 14 == 0 for r in rows)


def test_account_state_with_a_known_peak(spark):
    presets = spark.createDataFrame(
        [("50K", 50000.0, 2000.0, 3000.0)], "preset string, start double, trail double, target double"
    )
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = [
        ("a", days[0], 49000.0, -1000.0, "50K", 49500.0),
        ("a", days[1], 47600.0, -1400.0, "50K", 49500.0),
        ("a", days[2], 50100.0, 2500.0, "50K", 50100.0),
        ("a", days[3], 50300.0, 200.0, "50K", None),
    ]
    schema = "account string, day date, balance double, todays_pnl double, preset string, peak double"
    got = jn.account_state(spark.createDataFrame(rows, schema), presets).orderBy("day").collect()
    assert [r.trailing_floor for r in got] == [47500.0, 47500.0, 50000.0, 50000.0]
    assert [r.is_locked_floor for r in got] == [False, False, True, True]
    assert [r.kill_switch_reason for r in got] == [None, "near", "near", None]
    without = jn.account_state(spark.createDataFrame(rows, schema).drop("peak"), presets)
    assert {r.trailing_floor for r in without.collect()} == {50000.0}


def test_predict_leaves_its_inputs_alone(spark):
    rows = [(f"s{k}", k % 2, 0.1 * k if k % 5 else None, "kept") for k in range(40)]
    df = spark.createDataFrame(rows, "symbol string, label int, x double, proba string")
    model = md.fit_classifier(df, ["x"], "logistic")
    out = md.predict(model, df)
    assert out.select("symbol", "label", "x").exceptAll(df.select("symbol", "label", "x")).count() == 0
    assert out.columns[:3] == ["symbol", "label", "x"] and dict(out.dtypes)["proba"] == "double"


def test_only_missing_classes_fall_back(spark):
    schema = "symbol string, label int, x double, baseline_pre_7d_return_pct double"
    one = spark.createDataFrame([("a", 1, 0.5, 6.0), ("b", 1, 0.1, -6.0)], schema)
    assert [r.signal for r in md.fit_predict(one, one, ["x"], "logistic").orderBy("symbol").collect()] == [1, -1]
    both = one.unionByName(spark.createDataFrame([("c", 0, 0.2, 1.0)], schema))
    with pytest.raises(Exception, match="missing"):
        md.fit_predict(both, both, ["missing"], "logistic").collect()


def test_built_in_graph_tells_peers_from_weights(spark):
    rows = {(r.src, r.dst): r for r in default_edges(spark).collect()}
    assert not rows["PLTR", "JPM"].is_peer and rows["PLTR", "JPM"].weight is not None
    assert all((r.place is not None) == r.is_peer for r in rows.values())
