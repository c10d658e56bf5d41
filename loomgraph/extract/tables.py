"""Extraction as a table function of SQL, with a caller's own extractors.

    register(spark, [Extractor("ini", read_ini, {"settings": "section string, key string, value string, line int"})])
    SELECT f.path, x.* FROM files f, LATERAL extract_facts(f.path, f.language, f.content, 'functions') x

What columns a call has depends on the kind of facts that it asks for, which Spark learns when it plans the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .router import SCHEMA, parse

#: Kinds that every language has.
KINDS = ("functions", "classes", "imports", "calls")


@dataclass(frozen=True)
class Extractor:
    """A caller's own: run(content, path) gives {kind: [facts]}, facts by name of column; what it leaves out is null. It may
    give KINDS and kinds of its own, whose columns are told by DDL. Where it raises, the file has no facts."""

    language: str
    run: Callable[[str, str], dict[str, list[dict]]]
    kinds: dict[str, str] = field(default_factory=dict)


def _columns(kind: str, own: dict[str, str]) -> StructType:
    if kind in own:
        return StructType.fromDDL(own[kind])
    held = StructType.fromDDL(SCHEMA)[kind].dataType
    assert isinstance(held, ArrayType)
    return StructType(held.elementType.fields)


def register(spark: SparkSession, extractors: Iterable[Extractor] = (), name: str = "extract_facts") -> None:
    """Makes name(path, language, content, kind) known to SQL. kind is a constant. Languages without an extractor among
    these are read as scans read them. A null content has no facts."""
    by_language = {x.language: x.run for x in extractors}
    own = {k: ddl for x in extractors for k, ddl in x.kinds.items()}
    shapes = {k: [f.name for f in _columns(k, own).fields] for k in (*KINDS, *own)}
    schemas = {k: _columns(k, own) for k in shapes}

    class Facts:
        @staticmethod
        def analyze(path: AnalyzeArgument, language: AnalyzeArgument, content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            if not kind.isConstantExpression or kind.value not in schemas:
                raise ValueError(f"kind is one of {', '.join(schemas)}, as a constant")
            return AnalyzeResult(schema=schemas[kind.value])

        def eval(self, path: str, language: str, content: str, kind: str):
            if content is None:
                return
            if language in by_language:
                try:
                    found = by_language[language](content, path)
                except Exception:
                    return
            else:
                found = parse(path or "", language or "", content)
            for row in found.get(kind, ()):
                yield tuple(row.get(c) for c in shapes[kind])

    spark.udtf.register(name, udtf(Facts))
