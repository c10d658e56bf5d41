"""The watch as a stream: what is told, restarts, crashes, and how edits fall into batches."""

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.tools import Engine
from loomgraph.sources.store import RepositoryStore
from loomgraph.streaming import edits

T0 = 1_700_000_000_000
SHAPE = "path string, content string, ms long"


def deliver(spark, folder, rows):
    """One file of edits (path, content, milliseconds)."""
    spark.createDataFrame([(p, c, T0 + ms) for p, c, ms in rows], SHAPE).select("path", "content", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, **options):
    return spark.readStream.schema("path string, content string, at timestamp").options(**options).parquet(folder)


def told(store):
    found = store.load("told", "u")
    return sorted((r["path"], r["change"]) for r in found.collect()) if found is not None else []


EDITS = [
    [("a.py", "1", 0), ("b.py", "1", 0), ("c.txt", "1", 0), ("node_modules/d.py", "1", 0)],
    [("a.py", "2", 1000), ("a.py", "3", 1300), ("b.py", "2", 1000), ("b.py", "1", 1400), ("e.py", "1", 1000)],
    [("e.py", None, 1200), ("a.py", None, 4000), (None, None, 5000)],
    [("a.py", "3", 9000), (None, None, 20_000)],
]
WANT = [("a.py", "added"), ("a.py", "added"), ("a.py", "modified"), ("a.py", "removed"), ("b.py", "added")]


@pytest.mark.parametrize("options", [{}, {"maxFilesPerTrigger": "1"}, {"maxFilesPerTrigger": "3"}])
def test_batches_dont_matter(spark, tmp_path, options):
    """A burst is one change, an edit taken back is none, nor is a file that came and went while its path wasn't quiet."""
    store = RepositoryStore(spark, str(tmp_path / "s"))
    for rows in EDITS:
        deliver(spark, str(tmp_path / "in"), rows)
    q = edits.follow(source(spark, str(tmp_path / "in"), **options), store, "u", str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    assert told(store) == WANT and {r["path"] for r in store.load("snapshots", "u").collect()} == {"a.py", "b.py"}
    assert {r["file_path"] for r in store.load("results", "u").collect()} == {"a.py", "b.py"}


def test_each_edit_is_told_once_over_restarts_and_a_crash(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "s"))
    folder, point = str(tmp_path / "in"), str(tmp_path / "c")
    for k, rows in enumerate(EDITS):
        deliver(spark, folder, rows)
        if k == 2:  # the version is published, then the batch fails: it comes again
            real = edits.apply_changes

            def broken(store, url):
                apply = real(store, url)

                def run(batch, number):
                    apply(batch, number)
                    raise RuntimeError("lost after commit")

                return run

            monkeypatch.setattr(edits, "apply_changes", broken)
            with pytest.raises(Exception, match="lost after commit"):
                e.watch("u", source(spark, folder), point, availableNow=True).awaitTermination()
            monkeypatch.setattr(edits, "apply_changes", real)
        e.watch("u", source(spark, folder), point, availableNow=True).awaitTermination()
    assert told(e.store) == WANT
    assert e.watching()["u"]["active"] is False and e.unwatch("u")["status"] == "ok" and e.unwatch("u")["status"] == "error"


def test_a_watch_goes_on_from_a_scan(spark, tmp_path):
    """Files as they were scanned aren't told."""
    e = Engine(spark, str(tmp_path / "s"))
    e.scan("u", spark.createDataFrame([("a.py", "def a():\n    b()\n"), ("b.py", "def b():\n    pass\n")], "path string, content string"))
    deliver(spark, str(tmp_path / "in"), [("a.py", "def a():\n    b()\n", 0), ("b.py", "def c():\n    pass\n", 0), ("b.py", None, 3000), (None, None, 9000)])
    e.watch("u", source(spark, str(tmp_path / "in")), str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert told(e.store) == [("b.py", "modified"), ("b.py", "removed")]
    assert [r["file_path"] for r in e.store.load("results", "u").collect()] == ["a.py"]


def test_a_live_watch_has_a_clock(spark, tmp_path):
    import time

    store, folder = RepositoryStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    now = int(time.time() * 1000)
    deliver(spark, folder, [("a.py", "1", now - T0)])
    q = edits.follow(edits.with_clock(source(spark, folder), spark), store, "u", str(tmp_path / "c"), late="0 seconds", processingTime="200 milliseconds")
    until = time.time() + 90
    while time.time() < until and not told(store):
        time.sleep(0.5)
    report = edits.progress(q)
    q.stop()
    assert told(store) == [("a.py", "added")] and report["active"] and report["rows"] >= 1 and report["failed"] is None
