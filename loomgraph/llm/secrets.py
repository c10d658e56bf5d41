"""Secret scan with multipart credential linking.

Strong spans (assign, access, hex) are always reported. Weak candidates (an account name, a token without a keyword,
an endpoint) are reported only where a complementary part stands in reach in the same scope: identifiers and
secrets complete each other, and an endpoint completes, and is completed by, either. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, let, materialize, running_starts, text_key

#: Fixed patterns: (kind, role, pattern, group whose length counts, least length of it).
BASE = (
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32),
)
WEAK = (
    ("account", "identifier", r"""(?i)\b(?:client_?id|key_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 1, 3),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", "endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+""", 0, 8),
)
ORDER = {kind: i for i, (kind, *_) in enumerate(BASE + WEAK)}
#: Code points within which parts complete each other.
REACH = 200

_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _matches(text: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """array<struct<start,rank,end>>: leftmost matches without overlap whose group is long enough; code points.
    What split() leaves between matches and the matches' own lengths give the places."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whole, part = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {group})"
    pairs = f"arrays_zip(transform(split({text}, {p}, -1), g -> length(g)), transform({whole}, m -> length(m)), transform({part}, m -> length(m)))"
    place = f"transform(p_, (x, i) -> struct(at_[i] + x.`0` as start, {rank} as rank, at_[i] + x.`0` + x.`1` as end, x.`2` as n))"
    found = let(pairs, "p_", let(running_starts("transform(p_, x -> x.`0` + coalesce(x.`1`, 0))"), "at_", f"transform(filter({place}, x -> x.n >= {least}), x -> struct(x.start as start, x.rank as rank, x.end as end))"))
    return F.expr(f"if(rlike({text}, {p}), {found}, cast(array() as {_SPANS}))")


def scan_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and text key with base and weak (arrays of start, rank, end)."""
    df = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__t"), text_key(text).alias("text_key"))
    hints = {"endpoint": "instr(__t, '://') > 0", "account": "instr(__t, '=') > 0 or instr(__t, ':') > 0"}
    for kind, _, pattern, group, least in BASE:
        df = df.withColumn(kind, _matches("__t", pattern, group, least, ORDER[kind]))
    none = F.expr(f"cast(array() as {_SPANS})")
    for kind, _, pattern, group, least in (WEAK[0], WEAK[2]):
        df = df.withColumn(kind, F.when(F.expr(hints[kind]), _matches("__t", pattern, group, least, ORDER[kind])).otherwise(none))
    # A token without a keyword counts only beside an identifier or endpoint, so other texts aren't searched for one.
    kind, _, pattern, group, least = WEAK[1]
    partner = (F.size("access") > 0) | (F.size("account") > 0) | (F.size("endpoint") > 0)
    df = df.withColumn(kind, F.when(partner, _matches("__t", pattern, group, least, ORDER[kind])).otherwise(none))
    return df.select("doc_id", "text_key", F.size("assign").alias("n_assign"), F.size("access").alias("n_access"), F.size("hex").alias("n_hex"), F.sort_array(F.concat("assign", "access", "hex")).alias("base"), F.sort_array(F.concat("account", "opaque", "endpoint")).alias("weak"))


def link_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text_key, linked): weak spans that a complementary part completes.

    An interval join: the gap between the two spans is under `reach`. Both sides are dealt by document and by
    stretches of `reach` code points, so a task never holds a document's pairs together, and a left semi join
    emits each candidate once however many parts complete it. Spans over each other aren't complementary, and a
    weak span over a base one is no candidate.
    """
    roles = F.create_map(*[F.lit(x) for kind, role, *_ in BASE + WEAK for x in (ORDER[kind], role)])
    some = parts.filter(F.size("weak") > 0).dropDuplicates(["doc_id", "text_key"])  # rows alike in both have like spans
    weak = some.select("doc_id", "text_key", F.explode("weak").alias("w")).withColumn("w_role", roles[F.col("w.rank")])
    weak = weak.withColumn("cell", F.explode(F.expr(f"sequence(floor((w.start - {reach}) / {reach}), floor((w.end + {reach}) / {reach}))")))
    other = some.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("p")).withColumn("p_role", roles[F.col("p.rank")])
    other = other.withColumn("cell", F.explode(F.expr(f"sequence(floor(p.start / {reach}), floor(p.end / {reach}))")))
    base = some.select("doc_id", "text_key", F.explode("base").alias("b")).withColumn("cell", F.explode(F.expr(f"sequence(floor(b.start / {reach}), floor(b.end / {reach}))")))
    w, b, p = weak.alias("w_"), base.alias("b_"), other.alias("p_")
    own = F.col("w_.doc_id").eqNullSafe(F.col("b_.doc_id")) & (F.col("w_.text_key") == F.col("b_.text_key")) & (F.col("w_.cell") == F.col("b_.cell")) & (F.col("b.start") < F.col("w.end")) & (F.col("w.start") < F.col("b.end"))
    covered = w.join(b, own, "left_semi").select("doc_id", "text_key", "w").distinct().alias("c_")
    same = F.col("w_.doc_id").eqNullSafe(F.col("c_.doc_id")) & (F.col("w_.text_key") == F.col("c_.text_key")) & (F.col("w_.w") == F.col("c_.w"))
    w = w.join(covered, same, "left_anti").alias("w_")
    near = (F.col("p.start") - F.col("w.end") < reach) & (F.col("w.start") - F.col("p.end") < reach) & ((F.col("p.start") >= F.col("w.end")) | (F.col("p.end") <= F.col("w.start")))
    on = F.col("w_.doc_id").eqNullSafe(F.col("p_.doc_id")) & (F.col("w_.text_key") == F.col("p_.text_key")) & (F.col("w_.cell") == F.col("p_.cell")) & near & (F.col("w_role") != F.col("p_role"))
    return w.join(p, on, "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("w").alias("linked"))


def find_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of docs: doc_id, text_key (hash of its text), n_assign, n_access, n_hex (long), base and
    spans (arrays of start, rank, end; rank: the place of the kind in ORDER; code points, end exclusive).

    Null text counts as empty and has no spans. Null ids and repeated ids are allowed: an id and its text's hash
    tell rows apart. Of other columns nothing is read. An empty table gives no rows. The scan's spans, not the
    texts, are written to the shared folder, so texts are searched once and never shuffled.
    """
    parts = materialize(scan_parts(docs, text), "secret-parts")
    linked = link_weak(parts, reach).withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    both = parts.join(linked, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left").drop("__d", "__k")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "linked")))
    return both.select("doc_id", "text_key", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], "base", spans.alias("spans"))


def spans_text(column: str) -> Column:
    """kind:start:end, comma-joined, in order."""
    names = "array(" + ", ".join(f"'{k}'" for k in ORDER) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.rank], ':', x.start, ':', x.end)), ',')")


#: Up to so many documents with linked weak spans, these are sent to all executors: some 100 bytes each, so 10 MB.
BROADCAST_LINKED = 100_000


def _base_spans(text: str) -> Column:
    return F.sort_array(F.concat(*[_matches(text, pattern, group, least, ORDER[kind]) for kind, _, pattern, group, least in BASE]))


def _without(text: str, spans: str, mark: str) -> str:
    """SQL for text with mark in place of spans (sorted; those over each other are one), block by block: what a block's
    spans leave of the text between the ends of the block before and its own."""
    ends = let("transform(b_, x -> array_max(transform(x, y -> y.end)))", "most_", "transform(sequence(0, size(b_)), i -> coalesce(array_max(slice(most_, 1, i)), 0))")
    step = f"if(y.start - c_[i] >= s.at, struct(y.end - c_[i] as at, array_append(s.all, concat(substring(g_, s.at + 1, y.start - c_[i] - s.at), {mark})) as all), struct(greatest(s.at, y.end - c_[i]) as at, s.all as all))"
    fold = f"aggregate(x, struct(0 as at, cast(array() as array<string>) as all), (s, y) -> {step}, s -> s.all)"
    kept = f"flatten(transform(b_, (x, i) -> {let(f'substring({text}, c_[i] + 1, c_[i + 1] - c_[i])', 'g_', fold)}))"
    return in_blocks(spans, "b_", let(ends, "c_", f"concat(array_join({kept}, ''), substring({text}, c_[size(b_)] + 1))"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with each reported span of `text` replaced by `mark`; spans that overlap become one. Null text stays.

    Null and repeated ids are allowed, an empty table gives none; columns starting with two underscores are in use while
    it runs. Base spans are replaced where the row is. Only documents with linked weak spans are joined by id and text
    hash: they are counted first, and up to BROADCAST_LINKED they go to all executors, so no text is shuffled; beyond,
    both sides are dealt.
    """
    weak = materialize(scan_parts(docs, text).filter(F.size("weak") > 0), "secret-parts")
    linked = materialize(link_weak(weak, reach).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("linked").alias("__linked")), "secret-linked")
    side = F.broadcast(linked) if linked.count() <= BROADCAST_LINKED else linked
    df = docs.withColumn("__tk", text_key(text))
    df = df.join(side, df["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__tk") == F.col("__k")), "left")
    base = _base_spans(f"`{text}`")
    df = df.withColumn("__spans", F.when(F.col("__linked").isNull(), base).otherwise(F.sort_array(F.concat(base, F.col("__linked")))))
    quoted = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    new = F.expr(let("__spans", "z_", f"if(size(z_) > 0, {_without(f'`{text}`', 'z_', quoted)}, `{text}`)"))
    return df.withColumn(text, new).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
