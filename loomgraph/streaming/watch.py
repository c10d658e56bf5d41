"""Watching a folder.

A file stream reports new files only, neither edits nor removals. So a trigger starts a look at the folder as it is
now; its snapshot is compared with the last one, and what changed is merged into the tables. New files are seen too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.router import parse_files
from ..operators import incremental
from ..operators.modules import parts
from ..sources.repository import CONFIG_EXTENSIONS, EXCLUDED_DIRS, LANGUAGE_EXTENSIONS, extension, scan

SECONDS = 0.5


def watched(path: Column) -> Column:
    """Not below an excluded directory, and with a known suffix."""
    known = [*LANGUAGE_EXTENSIONS, *CONFIG_EXTENSIONS]
    return ~F.exists(parts(path), lambda p: p.isin(*EXCLUDED_DIRS)) & extension(path).isin(*known)


@dataclass
class Watch:
    """State of one watch: the tables as of the last look, and counters."""

    spark: SparkSession
    listing: Callable[[], DataFrame]
    save: Callable[[DataFrame, str], DataFrame]  # writes a table and reads it back, so lineage doesn't grow
    snapshot: DataFrame | None = None
    results: DataFrame | None = None
    events: list[dict] = field(default_factory=list)
    _query: object = None

    def look(self) -> dict:
        """One look: how many paths were added, modified, removed; tables follow."""
        files, _ = scan(self.listing().filter(watched(F.col("path"))), None)
        now = self.save(incremental.snapshot(files), "snapshot")
        if self.snapshot is None:
            changed = now.select("path", F.lit("added").alias("change"))
        else:
            changed = incremental.changes(self.snapshot, now)
        changed = self.save(changed, "changes")
        counts = {r["change"]: r["n"] for r in changed.groupBy("change").agg(F.count("*").alias("n")).collect()}  # three rows
        if counts:
            fresh = parse_files(files.join(changed.filter("change != 'removed'").select("path"), "path", "left_semi"))
            self.results = self.save(fresh if self.results is None else incremental.merge(self.results, fresh, changed), "results")
        self.snapshot = now
        event = {k: counts.get(k, 0) for k in ("added", "modified", "removed")}
        self.events.append(event)
        return event

    def start(self, seconds: float = SECONDS) -> None:
        """Look at every trigger, until stop()."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self._query = ticks.writeStream.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").foreachBatch(lambda _batch, _id: self.look() and None).start()

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def status(self) -> dict:
        progress = self._query.lastProgress if self._query is not None else None
        return {"active": bool(self._query is not None and self._query.isActive), "looks": len(self.events), "last": self.events[-1] if self.events else None, "last_batch": progress["batchId"] if progress else None}
