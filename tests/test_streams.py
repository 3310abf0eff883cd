"""The source of changed paths, and counters folded from a stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import counters, listing


def put(path, text, ms):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, ns=(ms * 1_000_000, ms * 1_000_000))


def test_changes_of_listings():
    before, after = {"a": (1, 10), "b": (2, 10), "c": (3, 10)}, {"a": (1, 10), "b": (2, 11), "d": (4, 10)}
    assert listing.changes(before, after) == [("b", "modified", 2, 11), ("c", "deleted", None, None), ("d", "added", 4, 10)]
    assert listing.changes({}, {}) == [] == listing.changes(after, after)


def test_stream_of_changed_paths(spark, tmp_path):
    root, state, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    seen, fail = {}, []

    def batch(df, n):
        rows = sorted((r["path"].rpartition("/")[2], r["change"], r["size"]) for r in df.collect())
        if fail:
            fail.clear()
            raise RuntimeError("stopped in mid-batch")
        seen.setdefault(n, []).append(rows)

    def run():
        before = len(seen)
        q = listing.changed_files(spark, str(root), state).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(300):
                time.sleep(0.2)
                if q.exception() or len(seen) > before:
                    break
            if not q.exception():
                q.processAllAvailable()
            return q.exception()
        finally:
            q.stop()

    put(root / "a.txt", "a", 1000)
    put(root / "deep" / "b.txt", "bb", 1000)
    put(root / "_tmp" / "x.txt", "x", 1000)
    put(root / ".y.txt", "y", 1000)
    assert run() is None
    assert seen == {0: [[("a.txt", "added", 1), ("b.txt", "added", 2)]]}

    put(root / "a.txt", "aaa", 2000)
    put(root / "c.txt", "c", 2000)
    (root / "deep" / "b.txt").unlink()
    fail.append(True)
    assert run() is not None
    # The folder changes while the query is down: the batch that comes again is the one that was planned.
    (root / "c.txt").unlink()
    put(root / "d.txt", "dddd", 3000)
    assert run() is None
    assert seen[1] == [[("a.txt", "modified", 3), ("b.txt", "deleted", None), ("c.txt", "added", 1)]]
    if 2 not in seen:
        assert run() is None
    assert seen[2] == [[("c.txt", "deleted", None), ("d.txt", "added", 4)]]
    assert len(listing.Listings(state).numbers()) <= 2


def test_empty_and_missing_folders(tmp_path):
    assert listing.list_folder(str(tmp_path / "none")) == {}
    kept = listing.Listings(f"file:{tmp_path}/state")
    assert kept.numbers() == [] and kept.read(0) == {}
    kept.write(1, {"é": (1, 2)})
    kept.write(2, {})
    assert kept.read(1) == {"é": (1, 2)} and kept.read(2) == {}
    kept.forget(2)
    assert kept.numbers() == [2]


def test_counters_of_a_stream_equal_those_of_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    fed, out, checkpoint, lines = (str(tmp_path / x) for x in ("fed", "out", "checkpoint", "lines"))
    reporter = counters.JsonLines(lines)
    spark.streams.addListener(reporter)
    try:
        for part in range(3):
            events.where(F.col("event_id") % 3 == part).drop("event_id").coalesce(1).write.mode("append").parquet(fed)
            stream = spark.readStream.schema(events.drop("event_id").schema).parquet(fed)
            counters.start_counters(stream, out, checkpoint).awaitTermination()
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(reporter)
    got = {r["event_type"]: r for r in counters.latest_counters(spark, out).collect()}
    want = {r["event_type"]: r for r in counters.counters(events).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k]["events"], got[k]["large"], got[k]["k_total"]) == (w["events"], w["large"], w["k_total"])
        assert got[k]["total"] == pytest.approx(w["total"], abs=1e-3)
    reported = spark.read.json(lines).groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in reported}.get("cycle_start") == 3
    assert spark.read.json(lines).agg(F.sum("rows")).first()[0] == events.count()
