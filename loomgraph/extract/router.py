"""files (path, language, content) -> parse results, nested, by the best tier that a file allows."""

from __future__ import annotations

import signal
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt
from . import grammar, native, patterns

SCHEMA = (
    "file_path string, language string, line_count long, parse_method string, parse_confidence double, fallback_reason string, parse_errors array<string>,"
    " functions array<struct<name:string,params:array<string>,return_type:string,line_start:int,line_end:int,docstring:string,is_method:boolean,parent_class:string>>,"
    " classes array<struct<name:string,methods:array<string>,parent_class:string,line_start:int,line_end:int>>,"
    " imports array<struct<module:string,names:array<string>,is_relative:boolean,line:int>>,"
    " calls array<struct<caller_func:string,callee_name:string,line:int>>"
)
#: Fixed: languages that a grammar would serve; without one the reason is told.
GRAMMARS = ("python", "typescript", "javascript", "java", "go", "rust", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "zig", "scala", "dart", "objc", "haskell", "ocaml", "elixir", "erlang", "lua", "perl", "r", "julia", "bash", "clojure", "groovy", "nim", "v", "d")
#: Seconds that a file may take; after them it gets the lowest tier's empty result, and its task goes on.
SECONDS = 5.0
TIMED_OUT = ("basic", 0.3)


class TooLong(BaseException):
    """Not an Exception: the tiers' own handlers leave it alone."""


@contextmanager
def limited(seconds: float):
    """Raises TooLong inside after so many seconds; only in a process's main thread, where workers run tasks."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_):
        raise TooLong

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse(path: str, language: str, content: str | None, is_config: bool = False, line_count: int = 0, seconds: float = SECONDS) -> dict:
    """The facts of one file, by the best tier in the time it has."""
    try:
        with limited(seconds):
            return _parse(path, language, content, is_config, line_count)
    except TooLong:
        none: dict = {"functions": [], "classes": [], "imports": [], "calls": []}
        return {"file_path": path, "language": language, "line_count": line_count, "parse_method": TIMED_OUT[0], "parse_confidence": TIMED_OUT[1], "fallback_reason": "", "parse_errors": [f"Timeout after {seconds:g}s"], **none}


def _parse(path: str, language: str, content: str | None, is_config: bool, line_count: int) -> dict:
    none: dict = {"functions": [], "classes": [], "imports": [], "calls": []}
    out = {"file_path": path, "language": language, "line_count": line_count, "parse_method": "full", "parse_confidence": 1.0, "fallback_reason": "", "parse_errors": [], **none}
    if is_config:
        return out
    if content is None:
        return out | {"parse_method": patterns.FAILED, "parse_confidence": 0.0, "parse_errors": ["Read error: no content"]}
    lines = content.count("\n") + (content != "" and not content.endswith("\n"))
    if language == "python":
        try:
            return out | native.extract(content) | {"line_count": lines, "parse_method": native.METHOD, "parse_confidence": native.CONFIDENCE}
        except SyntaxError as e:
            out["fallback_reason"] = f"ast parse error: {e}"
        except (ValueError, RecursionError, MemoryError) as e:
            out["fallback_reason"] = f"native ast error: {e}"
    if language in GRAMMARS:
        parser = grammar.HEALTH.parser(language)
        if parser is None:
            out["fallback_reason"] = "tree-sitter unavailable"
        else:
            try:
                return out | grammar.extract(parser, content, language) | {"line_count": lines}
            except Exception as e:  # whatever a grammar raises, patterns still serve
                out["fallback_reason"] = f"tree-sitter parse error: {e}"
    try:
        facts, confidence = patterns.extract(content, language)
        return out | facts | {"line_count": lines, "parse_method": patterns.METHOD, "parse_confidence": confidence}
    except Exception as e:
        return out | {"parse_method": patterns.FAILED, "parse_confidence": 0.0, "parse_errors": [f"Regex fallback error: {e}"]}


def _parse_batches(batches):
    import pyarrow as pa

    text, number, flag, texts = pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string())
    place = [("line_start", number), ("line_end", number)]
    schema = pa.schema([
        ("file_path", text), ("language", text), ("line_count", pa.int64()), ("parse_method", text), ("parse_confidence", pa.float64()), ("fallback_reason", text), ("parse_errors", texts),
        ("functions", pa.list_(pa.struct([("name", text), ("params", texts), ("return_type", text), *place, ("docstring", text), ("is_method", flag), ("parent_class", text)]))),
        ("classes", pa.list_(pa.struct([("name", text), ("methods", texts), ("parent_class", text), *place]))),
        ("imports", pa.list_(pa.struct([("module", text), ("names", texts), ("is_relative", flag), ("line", number)]))),
        ("calls", pa.list_(pa.struct([("caller_func", text), ("callee_name", text), ("line", number)]))),
    ])
    for batch in batches:
        rows = [parse(*x) for x in zip(*(batch[c].to_pylist() for c in ("path", "language", "content", "is_config", "line_count")), strict=True)]
        for at in range(0, len(rows), 200):
            yield pa.RecordBatch.from_pylist(rows[at : at + 200], schema)


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, language, content, is_config, line_count. One row per file. Files are dealt by
    path first, as many small ones may lie in one piece."""
    rows = files.select("path", "language", "content", "is_config", F.col("line_count").cast("long").alias("line_count"))
    return dealt(rows, "path").mapInArrow(_parse_batches, SCHEMA)


def facts(results: DataFrame) -> dict[str, DataFrame]:
    """Flat fact tables (file, ord, ...) of parse results."""
    f = F.col("file_path").alias("file")

    def flat(column: str) -> DataFrame:
        return results.select(f, F.posexplode(column).alias("ord", "x")).select("file", "ord", "x.*")

    return {k: flat(k) for k in ("functions", "classes", "imports", "calls")}


def quality(results: DataFrame) -> DataFrame:
    """One row: files by method and the mean confidence of those that aren't configuration, two digits."""
    counts = [F.count_if(F.col("parse_method") == m).alias(m) for m in ("native", "full", "partial", "basic", "failed")]
    return results.agg(F.count("*").alias("files"), *counts, F.coalesce(F.bround(F.avg("parse_confidence"), 2), F.lit(0.0)).alias("avg_confidence"))


def warning(quality_row: dict) -> str:
    """What to tell where more than half of the files weren't parsed in full."""
    n, weak = quality_row["files"], quality_row["partial"] + quality_row["basic"]
    if not n or not weak:
        return ""
    text = f"{weak}/{n} 个文件使用降级解析"
    return f"⚠️ {text}" if weak / n > 0.5 else text
