"""Streams over several batches: copies, late rows, replays, restarts, growth, and broken runs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from catalog import q_streams
from tidemark.operators import documents as dc
from tidemark.streaming import jobs
from tidemark.streaming.files import Marks
from tidemark.streaming.keyed import KeyedStore
from tidemark.streaming.versions import VersionedTable

ARTICLES = (
    "doc_id string, url string, title string, body string, priority int, published_at string, "
    "fetched_at string"
)


def article(k, day="2001-01-01", title=None):
    return (f"d{k}", f"u{k}", title or f"gain {k}", "profit and loss", 1, day, day)


class Landing:
    """Articles that land file by file, and the ingest that takes them up."""

    def __init__(self, spark, **options):
        self.spark, self.base, self.options = spark, jobs.work_dir(spark, "stream-test"), options
        self.files = 0

    def land(self, rows, run=True):
        df = self.spark.createDataFrame(rows, ARTICLES).coalesce(1)
        df.write.mode("append").parquet(f"{self.base}/landed")
        if run:
            self.run()

    def run(self, checkpoint="checkpoint", scorer=None, one_file=False):
        reader = self.spark.readStream.schema(ARTICLES)
        if one_file:
            reader = reader.option("maxFilesPerTrigger", 1)
        jobs.ingest_stream(
            reader.parquet(f"{self.base}/landed"),
            lambda a: a,
            f"{self.base}/documents",
            f"{self.base}/scores",
            scorer or dc.lexicon_scorer(["gain"], ["loss"]),
            f"{self.base}/{checkpoint}",
            **self.options,
        ).awaitTermination()

    def urls(self):
        return sorted(r.url for r in jobs.stored(self.spark, f"{self.base}/documents").collect())

    def scored(self):
        return sorted(r.doc_id for r in jobs.stored(self.spark, f"{self.base}/scores").collect())


def test_copies_across_three_batches_late_rows_and_restart(spark):
    landing = Landing(spark)
    landing.land([article(k) for k in range(10)] + [article(3)])
    landing.land([article(k, "2001-06-01") for k in range(5, 15)])
    # A late article (half a year older than what has been seen) is stored; late copies are not.
    landing.land([article(k, "2000-06-01") for k in (0, 7, 14, 15)])
    want = [f"u{k}" for k in range(16)]
    assert landing.urls() == sorted(want)
    assert landing.scored() == sorted(f"d{k}" for k in range(16))
    landing.run()  # nothing has landed
    assert landing.urls() == sorted(want)
    # A new checkpoint takes everything up again, from batch 0 on, and adds nothing.
    landing.run("another", one_file=True)
    landing.land([article(16)], run=False)
    landing.run("another")
    assert landing.urls() == sorted([*want, "u16"]) and landing.scored() == sorted(
        f"d{k}" for k in range(17)
    )


def test_a_batch_that_broke_off_is_run_again(spark):
    landing = Landing(spark, bucket_rows=4, buckets=2)
    landing.land([article(k) for k in range(30)])

    def broken(docs):
        raise RuntimeError("lost")

    landing.land([article(k) for k in range(25, 60)], run=False)
    with pytest.raises(Exception, match="lost"):
        landing.run(scorer=broken)
    # The documents are stored, their scores are not; the buckets are overfull by then.
    landing.run()
    assert landing.urls() == sorted(f"u{k}" for k in range(60))
    assert landing.scored() == sorted(f"d{k}" for k in range(60))


def test_first_version_of_an_article_stays(spark):
    landing = Landing(spark)
    landing.land([article(1, title="first"), article(2)])
    landing.land([article(1, title="second"), article(3)])
    rows = {r.url: r.title for r in jobs.stored(spark, f"{landing.base}/documents").collect()}
    assert rows["u1"] == "first" and len(rows) == 3


def opened_bytes(store, batch):
    """Bytes of the files of earlier batches in the folders that were opened."""
    total = 0
    for path in set(store.opened):
        for folder, _, files in os.walk(path):
            if f"batch={batch}" not in folder and "batch=-1" not in folder:
                total += sum(os.path.getsize(f"{folder}/{f}") for f in files if f.endswith(".parquet"))
    return total


def keyed(spark, rows):
    return rows.select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.sha2(F.col("id").cast("string"), 256).alias("body"),
    )


def test_bytes_read_per_batch_stay_flat_while_the_store_grows(spark):
    store = KeyedStore.create(
        spark, jobs.work_dir(spark, "flat"), ["url"], "url string, body string", 4, 200
    )
    sizes = []
    for number, (first, last) in ((1, (0, 2_000)), (3, (2_000, 20_000))):
        rows = keyed(spark, spark.range(first, last))
        store.put(store.missing(rows, number - 1), number - 1, f"t{number - 1}")
        assert store.crowded()
        few = keyed(spark, spark.range(first + 50_000, first + 50_010))
        store.put(store.missing(few, number), number, f"t{number}")
        store.reorganise()
        # Three known keys and three new ones.
        asked = keyed(spark, spark.createDataFrame([(first,), (first + 7,), (last - 1,), (10**6,), (10**7,), (10**8,)], "id long"))
        fresh = store.missing(asked, number + 1)
        assert sorted(r.url for r in fresh.collect()) == ["u1000000", "u10000000", "u100000000"]
        sizes.append(opened_bytes(store, number + 1))
        assert len(store.opened) <= 9
    assert store.buckets >= 100 and store.read().count() == 20_020
    assert sizes[1] <= 1.5 * sizes[0]


def test_hashes_that_collide_decide_nothing(spark, monkeypatch):
    monkeypatch.setattr(KeyedStore, "_hash", lambda self: F.lit(1).cast("bigint"))
    store = KeyedStore.create(spark, jobs.work_dir(spark, "collide"), ["url"], "url string, body string")
    store.put(keyed(spark, spark.range(5)), 0, "a")
    fresh = store.missing(keyed(spark, spark.range(3, 9)), 1)
    assert sorted(r.url for r in fresh.collect()) == ["u5", "u6", "u7", "u8"]


def test_a_number_is_published_once(spark):
    marks = Marks(spark, f"{jobs.work_dir(spark, 'marks')}/versions")
    assert marks.latest() is None
    marks.publish(0, {"x": "é"})
    with pytest.raises(Exception, match="[Ee]xist"):
        marks.publish(0, {"x": "other"})
    assert marks.latest() == (0, {"x": "é"}) and marks.numbers() == [0]


# --- update logs


def ticks(rows):
    return [(s, dt.datetime(2020, 1, d, h), float(p)) for s, d, h, p in rows]


def land_ticks(spark, base, rows):
    df = spark.createDataFrame(ticks(rows), "symbol string, ts timestamp_ntz, price double")
    df.coalesce(1).write.mode("append").parquet(f"{base}/landed")


def run_bars(spark, base, **options):
    source = spark.readStream.schema("symbol string, ts timestamp_ntz, price double").parquet(f"{base}/landed")
    jobs.bars_stream(source, f"{base}/log", f"{base}/checkpoint", state_partitions=2, **options).awaitTermination()


def test_bars_over_three_batches_equal_one_batch(spark):
    base = jobs.work_dir(spark, "bars-test")
    batches = [
        [("a", 1, 9, 5), ("a", 1, 12, 7), ("b", 1, 9, 1)],
        [("a", 1, 15, 2), ("a", 2, 9, 9), ("a", 1, 8, 4)],  # late, but inside the watermark
        [("b", 2, 9, 3), ("a", 2, 10, 8), ("a", 2, 10, 8)],
    ]
    for rows in batches:
        land_ticks(spark, base, rows)
        run_bars(spark, base, most=1)
    got = jobs.current_bars(spark, f"{base}/log")
    whole = spark.createDataFrame(
        ticks([r for b in batches for r in b]), "symbol string, ts timestamp_ntz, price double"
    )
    want = jobs.bars_from_ticks(whole)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_mentions_over_three_batches_equal_one_batch(spark):
    base = jobs.work_dir(spark, "mentions-test")
    schema = "doc_id string, alias string, by_ticker int, doc_ts timestamp_ntz, lex double"
    rows = [
        (f"{k}", "abc"[k % 3], k % 2, dt.datetime(2020, 1, 1 + k // 4, k % 24), float(k % 5)) for k in range(48)
    ]
    for part in (rows[:16], rows[16:32], rows[32:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/named")
        named = spark.readStream.schema(schema).parquet(f"{base}/named")
        jobs.rolling_mentions_stream(named, f"{base}/log", f"{base}/checkpoint", 2, most=1).awaitTermination()
    got = jobs.current_mentions(spark, f"{base}/log")
    want = jobs.rolling_mentions(spark.createDataFrame(rows, schema)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reading_a_log_costs_the_same_after_fifty_batches_as_after_five(spark):
    log = jobs.update_log(spark, jobs.work_dir(spark, "log-test"), "k long, v long")
    write = jobs._changes(log, ["k"], 4, "here")
    files = {}
    for number in range(50):
        write(spark.range(20).select(F.col("id").alias("k"), F.lit(number).cast("long").alias("v")).coalesce(1), number)
        if number + 1 in (5, 50):
            files[number + 1] = (len(log.entries()), len(log.read().inputFiles()))
            assert len(log.versions.numbers()) <= 7
    assert {r.v for r in jobs.current(log, ["k"]).collect()} == {49}
    assert files[50] == files[5]
    write(spark.range(1).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v")), 49)  # again
    assert {r.v for r in jobs.current(log, ["k"]).collect()} == {49}


# --- versions


def folder_files(path):
    return {
        f"{folder}/{f}": os.path.getmtime(f"{folder}/{f}")
        for folder, _, files in os.walk(f"{path}/data")
        for f in files
        if f.endswith(".parquet")
    }


def days(spark, first, n):
    start = dt.datetime(1996, 1, 1, 9)
    rows = [(str(k), f"u{k}", start + dt.timedelta(days=k), f"t{k}") for k in range(first, first + n)]
    return spark.createDataFrame(rows, "doc_id string, url string, doc_ts timestamp_ntz, title string")


def test_a_broken_backfill_loses_nothing_and_leaves_files_alone(spark, monkeypatch):
    store = f"{jobs.work_dir(spark, 'broken')}/documents"
    docs = days(spark, 0, 60)
    jobs.backfill(docs, store, "1996-01-01", "1996-01-15")
    jobs.backfill(docs, store, "1996-01-10", "1996-02-01")
    before, files = jobs.backfill_table(spark, store, docs.schema).read().count(), folder_files(store)

    def lost(self, number, content):
        raise RuntimeError("lost before publishing")

    with monkeypatch.context() as broken:
        broken.setattr(Marks, "publish", lost)
        with pytest.raises(RuntimeError):
            jobs.backfill(docs, store, "1996-01-20", "1996-03-01")
        with pytest.raises(RuntimeError):
            jobs.merge_backfills(spark, store, docs.schema)
    table = jobs.backfill_table(spark, store, docs.schema)
    assert table.read().count() == before
    jobs.backfill(docs, store, "1996-01-20", "1996-03-01")
    assert table.read().select("url").distinct().count() == table.read().count() == 60
    after = folder_files(store)
    assert files.items() <= after.items()
    # Merging keeps all rows; files go when no kept version names them.
    jobs.merge_backfills(spark, store, docs.schema, keep=2)
    assert table.read().count() == 60 and files.items() <= folder_files(store).items()
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "vacuum", lambda self, keep: (_ for _ in ()).throw(RuntimeError("lost")))
        jobs.backfill(days(spark, 60, 10), store, "1996-01-01", "1997-01-01")
        with pytest.raises(RuntimeError):
            jobs.merge_backfills(spark, store, docs.schema)
    assert table.read().count() == 70
    table.vacuum(1)
    assert table.read().count() == 70 and len(table.versions.numbers()) == 1
    assert not files.keys() & folder_files(store).keys()


def test_a_table_in_one_file_and_in_many_is_the_same_stream(spark, tmp_path):
    rows = [(k, f"user {k}", float(k)) for k in range(40)]
    table = spark.createDataFrame(rows, "event_id long, name string, value double")
    table.repartition(4).write.parquet(f"{tmp_path}/many/events.parquet")
    table.coalesce(1).write.parquet(f"{tmp_path}/written")
    (only,) = (tmp_path / "written").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "events.parquet").write_bytes(only.read_bytes())
    (tmp_path / "one" / "other_events.parquet").write_bytes(b"not this one")
    for kind in ("one", "many"):
        got = []
        started = jobs._start(
            q_streams.stream(spark, f"{tmp_path}/{kind}", "events"),
            lambda batch, number: got.extend(tuple(r) for r in batch.collect()),
            f"{tmp_path}/checkpoint-{kind}",
        )
        started.awaitTermination()
        assert sorted(got) == rows
