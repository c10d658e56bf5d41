"""A watch as a stream: edits come in, settled changes come out, each once, across restarts.

State is kept of each path: the hash that was told last, and an edit that waits. An edit is told when its path has been quiet
for a while, by event time, so a burst of edits is one change and an edit that is taken back is none. What comes out
doesn't depend on how edits fall into batches. Rows without a path only move time on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..extract.router import parse_files
from ..functions.text import content_hash
from ..operators import incremental
from ..sources.repository import scan
from ..sources.store import RepositoryStore
from .watch import watched

QUIET_MS = 500
#: How late an edit may come, by event time.
LATE = "2 seconds"
#: Paths are kept together by so many hashes of them, however many paths there are.
BUCKETS = 2048
CHANGE = "path string, change string, sha256 string, content string, ms long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SettledEdits(StatefulProcessor):
    """Of the paths of one bucket: which edits stay for `quiet` milliseconds. A bucket's paths are read and written together,
    as each access of state is a message between Python and Spark."""

    def __init__(self, quiet: int = QUIET_MS):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "path array<string>, sha256 array<string>")
        self.waiting = handle.getValueState("waiting", "path array<string>, sha256 array<string>, content array<string>, ms array<long>")

    def _told(self) -> dict[str, str]:
        found = self.told.get()
        return dict(zip(*found, strict=True)) if found else {}

    def _waiting(self) -> dict[str, tuple]:
        found = self.waiting.get()
        return {path: x for path, *x in zip(*found, strict=True)} if found else {}

    def _keep(self, told: dict[str, str] | None, waiting: dict[str, tuple]) -> None:
        """told: None where nothing was told."""
        if told:
            self.told.update((list(told), list(told.values())))
        elif told is not None:
            self.told.clear()
        if waiting:
            self.waiting.update((list(waiting), *map(list, zip(*waiting.values(), strict=True))))
        else:
            self.waiting.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(dict(zip(initialState["paths"], initialState["hashes"], strict=True)), {})

    def _settle(self, path: str, edit: tuple, told: dict[str, str]) -> Iterator[Row]:
        """The edit that waited is told, if the path isn't as it was told last."""
        now, content, ms = edit
        was = told.get(path)
        if now == was:
            return
        if now is None:
            del told[path]
        else:
            told[path] = now
        yield Row(path=path, change="added" if was is None else "removed" if now is None else "modified", sha256=now, content=content, ms=ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, told, timers = self._waiting(), None, set()
        for r in sorted(rows, key=lambda r: (r["ms"], r["sha256"] or "")):  # of edits at one time the greatest hash counts
            path = r["path"]
            if path in waiting:
                ms = waiting[path][2]
                if r["ms"] < ms:  # came late: a newer edit is known
                    continue
                if r["ms"] >= ms + self.quiet:
                    told = self._told() if told is None else told
                    yield from self._settle(path, waiting[path], told)
            waiting[path] = (r["sha256"], r["content"], r["ms"])
            timers.add(r["ms"] + self.quiet)
        self._keep(told, waiting)
        for at in {ms + self.quiet for _, _, ms in waiting.values()} & timers:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What waits no longer than the timer; one whose edits were replaced by later ones finds none."""
        until, waiting = expiredTimerInfo.getExpiryTimeInMs() - self.quiet, self._waiting()
        due = [path for path, (_, _, ms) in waiting.items() if ms <= until]
        if due:
            told = self._told()
            for path in due:
                yield from self._settle(path, waiting.pop(path), told)
            self._keep(told, waiting)

    def close(self) -> None:
        pass


def settled_edits(edits: DataFrame, known: DataFrame | None = None, quiet_ms: int = QUIET_MS, late: str = LATE) -> DataFrame:
    """(path, change, sha256, content, ms): a stream of changes from one of edits (path, content (null: removed), at).

    known: (path, sha256) of a snapshot that the watch goes on from. Paths that aren't watched are left out; rows with a
    null path, and rows of unwatched paths, move time on; rows with a null time are left out. Edits later than `late` are dropped. An edit is told as soon as
    event time, less `late`, is quiet_ms past it. One shuffle by buckets of paths; state is kept in RocksDB, which spills.
    """
    spark = edits.sparkSession
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Each condition names the time, else it would be moved below the watermark, and rows without a path with it.
    never = F.col("at") < F.lit("0001-01-01").cast("timestamp")
    timed = edits.withWatermark("at", late).filter(F.col("at").isNotNull()).filter(never | (F.col("path").isNotNull() & watched(F.col("path"))))
    rows = timed.select("path", "content", F.when(F.col("content").isNotNull(), content_hash(F.col("content"))).alias("sha256"), F.unix_millis("at").alias("ms"), "at")
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    first = None
    if known is not None:
        held = known.groupBy(bucket).agg(F.collect_list(F.struct("path", "sha256")).alias("x"))
        first = held.select("bucket", F.col("x.path").alias("paths"), F.col("x.sha256").alias("hashes")).groupBy("bucket")
    return rows.select(bucket, "*").groupBy("bucket").transformWithState(statefulProcessor=SettledEdits(quiet_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime", initialState=first)


def apply_changes(store: RepositoryStore, url: str):
    """For foreachBatch: each batch of changes becomes one version of the repository's changes, results and snapshots.
    The version notes which batch of which stream it holds, so a batch that comes again after a crash isn't applied twice."""

    def apply(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        t = store.begin(url)
        # Written in any case: the state of a batch that comes again is made by running it.
        now = t.save("changes", batch.select("path", "change", "sha256", "content", F.lit(number).cast("long").alias("batch")))
        if now.isEmpty() or t.notes.get("stream") == stream and t.notes.get("batch", -1) >= number:
            return
        files, _ = scan(now.filter("change != 'removed'").select("path", "content"), None)
        fresh = parse_files(files)
        old, was = t.former("results"), t.former("snapshots")
        t.save("results", fresh if old is None else incremental.merge(old, fresh, now))
        kept = now.filter("change != 'removed'").select("path", "sha256")
        t.save("snapshots", kept if was is None else was.join(now.select("path"), "path", "left_anti").unionByName(kept))
        t.save("told", now.select("path", "change", "sha256", "batch"), append=True)
        t.notes |= {"stream": stream, "batch": number}
        t.commit()

    return apply


def follow(edits: DataFrame, store: RepositoryStore, url: str, checkpoint: str, quiet_ms: int = QUIET_MS, late: str = LATE, **trigger) -> StreamingQuery:
    """Starts a watch, or goes on with the one that has this checkpoint, wherever it was stopped or has failed. A new one
    goes on from the snapshot that the store has. trigger: of writeStream.trigger(); without it, as soon as it can."""
    known = store.load("snapshots", url)
    out = settled_edits(edits, known, quiet_ms, late).writeStream.foreachBatch(apply_changes(store, url)).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def with_clock(edits: DataFrame, spark: SparkSession) -> DataFrame:
    """edits and a row a second without a path, so that the last edit of a live watch is told, too."""
    tick = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return edits.unionByName(tick.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content"), F.col("timestamp").alias("at")))


def progress(query: StreamingQuery) -> dict:
    """Of a watch: whether it runs, its last batch, rows read, and paths that state is kept of, as Spark reports them."""
    last = query.lastProgress
    state = (last["stateOperators"] or [{}])[0] if last else {}
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": sum(p["numInputRows"] for p in query.recentProgress), "state_rows": state.get("numRowsTotal", 0), "failed": str(query.exception()) if query.exception() else None}
