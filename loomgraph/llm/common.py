"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: What separates words in every contract: space, tab, newline, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"

REPO_ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that Python workers get at once: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 500


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere, and get rows in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, REPO_ROOT])


#: What the run that this thread is in has made; None outside of runs, whose tables stay until the cluster cleans them.
_RUN: ContextVar[Run | None] = ContextVar("loomgraph_run", default=None)


@dataclass
class Run:
    """Tables and broadcasts of one run. Runs don't know of each other's, so any number may go on side by side."""

    spark: SparkSession
    tables: list[str] = field(default_factory=list)
    shared: list[Broadcast] = field(default_factory=list)

    def discard(self) -> None:
        for path in self.tables:
            delete(self.spark, path)
        for value in self.shared:
            value.destroy()
        self.tables, self.shared = [], []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Run]:
    """A run: what materialize() writes and share() sends inside it, in this thread, goes at its end. Its result must be
    written by then, with written()."""
    own = Run(spark)
    before = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(before)
        own.discard()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read back, and its place: lineage is cut and the data survives the loss of
    any executor. Whoever writes it deletes it."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """written(), deleted at the end of the run that this thread is in, if any."""
    out, path = written(df, tag)
    if own := _RUN.get():
        own.tables.append(path)
    return out


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast, let go at the end of the run that this thread is in, if any."""
    out = spark.sparkContext.broadcast(value)
    if own := _RUN.get():
        own.shared.append(out)
    return out


def text_key(text: str = "text") -> Column:
    """With an id, tells rows apart whose ids repeat; rows alike in both give like results."""
    return F.xxhash64(F.col(text))


#: Bytes of input, as files hold them, for each part that is dealt out by a key.
PART_BYTES = 32 << 20


def input_parallelism(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions that df is dealt to: as many as the session's shuffles have, more where its input is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # tables of unknown size are told as huge
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // part_bytes), 1 << 18))


#: Input, as files hold it, that is dealt anew in any case: it may lie in one piece, and moving it costs next to nothing.
SMALL_BYTES = 48 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew only where it is small or its files come in far fewer splits than there is work for."""
    wanted = input_parallelism(df)
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    return df.repartition(wanted) if small or 4 * df.rdd.getNumPartitions() < wanted else df


def let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for value; value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_blocks(array: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for array's entries in blocks of about the root of their number: work on
    each block and then on all blocks costs little more than once over the array, however long it is."""
    cut = "transform(sequence(0, cast((size(a_) - 1) div w_ as int)), i_ -> slice(a_, i_ * w_ + 1, w_))"
    return let(array, "a_", let("greatest(64, cast(ceil(sqrt(size(a_))) as int))", "w_", let(f"if(size(a_) = 0, slice(array(a_), 1, 0), {cut})", name, body)))


def running_starts(lengths: str) -> str:
    """SQL for array<int>: the sum of all lengths (array<int>) before each."""
    before = "aggregate(slice(sums_, 1, k_), 0, (s_, y_) -> s_ + y_)"
    fold = f"aggregate(x_, struct({before} as at, cast(array() as array<int>) as all), (s_, y_) -> struct(s_.at + y_ as at, array_append(s_.all, s_.at) as all)).all"
    return in_blocks(lengths, "b_", let("transform(b_, x_ -> aggregate(x_, 0, (s_, y_) -> s_ + y_))", "sums_", f"flatten(transform(b_, (x_, k_) -> {fold}))"))


def substrings(text: str, spans: str) -> str:
    """SQL for array<string>: what spans (in order, of start and length, code points from 0) hold of text."""
    last = "x_[size(x_) - 1]"
    held = let(f"substring({text}, x_[0].start + 1, {last}.start + {last}.length - x_[0].start)", "g_", "transform(x_, y_ -> substring(g_, y_.start - x_[0].start + 1, y_.length))")
    return in_blocks(spans, "b_", f"flatten(transform(b_, x_ -> {held}))")


def tidy(run, tokenizes: bool = False):
    """run, a function on batches, which gives memory back to the system when its task ends: workers live on. What
    tokenizers have learnt in a worker stays between tasks that tokenize; any other task lets go of it."""

    def tidied(batches):
        if not tokenizes:
            from .tokens import let_go

            let_go()
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return tidied
