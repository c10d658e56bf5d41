"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 code points says so, so passages that documents share are cut
alike. A chunk met before isn't encoded again. Chunks are cut anywhere, also inside words: at each join the last
and first spans of both sides are encoded anew, and the window grows until its outer ids agree with both chunks'.

Documents are dealt to parts by the least hash of their lines, so most copies and near copies meet; groups too large
for a task are dealt over several parts. Within a part a chunk is encoded once. Chunks of several parts, which a first
pass over hashes finds, are dealt by their hash, encoded once there, and their ids are sent to the parts that have them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_parallelism, materialize, tidy
from .jaccard import _candidate_filter, _filter_places
from .packing import vocabulary
from .tokens import SpanEncoder, batches, encoder

#: A cut every 1024 code points on average, at least 256 apart and at most 8192.
CUT_MASK, LEAST_CHUNK, MOST_CHUNK = 1023, 256, 8192
#: Code points of chunks whose ids a task remembers; beyond, it forgets all.
REMEMBERED = 12_000_000
#: UTF-8 bytes that documents of one group bring to one task.
GROUP_BYTES = 16 << 20
#: Parts for each partition, so that these come out even.
PARTS_EACH = 4
#: Up to so many groups over that are sent to all tasks: 12 bytes each.
HOT_GROUPS = 200_000


def chunk_ends(text: str) -> list[int]:
    """Where the chunks of a text end; the last is its length."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    factor, step = 0x9E3779B1, 1
    while step < 16:  # after the loop: h[i] = sum of text[i - j] * factor ** j for j under 16
        if len(h) > step:
            h[step:] += h[:-step] * np.uint32(factor)
        factor, step = factor * factor & 0xFFFFFFFF, step * 2
    h ^= h >> np.uint32(15)
    ends, last, n = [], 0, len(text)
    for at in (np.flatnonzero((h & CUT_MASK) == 0) + 1).tolist():
        while at - last > MOST_CHUNK:
            last += MOST_CHUNK
            ends.append(last)
        if at - last >= LEAST_CHUNK and n - at >= LEAST_CHUNK:
            ends.append(last := at)
    while n - last > MOST_CHUNK + LEAST_CHUNK:
        last += MOST_CHUNK
        ends.append(last)
    return [*ends, n]


def cut_text(text: str) -> list[str]:
    ends = chunk_ends(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_name(chunk: str) -> bytes:
    """128 bits that stand for a chunk."""
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class ChunkEncoder:
    """Encodes texts from chunks; `reused` and `encoded` count code points of chunks. given: what others have encoded,
    by name: (ids, where spans end)."""

    def __init__(self, spans: SpanEncoder):
        self.spans, self.chunks, self.held = spans, {}, 0
        self.given: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.joins: dict[tuple[str, str], tuple[int, int, np.ndarray]] = {}
        self.reused = self.encoded = self.widened = 0

    def _learn(self, fresh: list[str]) -> None:
        if self.given:
            known = {c: found for c in fresh if (found := self.given.get(chunk_name(c))) is not None}
            self.chunks |= known
            self.held += sum(map(len, known))
            fresh = [c for c in fresh if c not in known]
        for part in batches(fresh):
            ids, at, ends, span_at = self.spans.encode(part)
            for k, chunk in enumerate(part):
                own = ends[span_at[k] : span_at[k + 1]] - at[k]
                self.chunks[chunk] = (ids[at[k] : at[k + 1]].copy(), np.concatenate([[0], own]).astype(np.int32))
                self.held += len(chunk)
                self.encoded += len(chunk)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > REMEMBERED:
            self.chunks, self.joins, self.held = {}, {}, 0
        cut = [cut_text(t) for t in texts]
        fresh = {c: None for chunks in cut for c in chunks if c not in self.chunks}
        self.reused += sum(map(len, texts)) - sum(map(len, fresh))
        self._learn(list(fresh))
        self._repair(list({p: None for chunks in cut for p in zip(chunks, chunks[1:], strict=False) if p not in self.joins}))
        return [self._joined(chunks) for chunks in cut]

    def _joined(self, chunks: list[str]) -> np.ndarray:
        if len(chunks) == 1:
            return self.chunks[chunks[0]][0]
        parts, skip = [], 0
        for left, right in zip(chunks, chunks[1:], strict=False):
            drop_left, drop_right, middle = self.joins[left, right]
            ids = self.chunks[left][0]
            if len(ids) - drop_left < skip:  # two repairs meet inside one chunk: no id of it is left to trust
                return self.spans.encode(["".join(chunks)])[0]
            parts += [ids[skip : len(ids) - drop_left], middle]
            skip = drop_right
        return np.concatenate([*parts, self.chunks[chunks[-1]][0][skip:]])

    def _repair(self, pairs: list[tuple[str, str]], width: int = 2) -> None:
        """Sets joins: (ids to drop at left's end, ids to drop at right's begin, ids to put between)."""
        open_, windows = [], []
        for left, right in pairs:
            (a, a_ends), (b, b_ends) = self.chunks[left], self.chunks[right]
            if width < len(a_ends) - 1 and width < len(b_ends) - 1:
                open_.append((left, right))
                windows.append("".join(self.spans.spans(left)[-width:]) + "".join(self.spans.spans(right)[:width]))
            else:
                self.joins[left, right] = (len(a), len(b), self.spans.encode([left + right])[0])
        if not open_:
            return
        ids, at, _, _ = self.spans.encode(windows)
        again = []
        for k, (left, right) in enumerate(open_):
            (a, a_ends), (b, b_ends) = self.chunks[left], self.chunks[right]
            window = ids[at[k] : at[k + 1]]
            lo, hi = int(a_ends[-1 - width]), int(b_ends[width])
            first, last = a[lo : int(a_ends[-width])], b[int(b_ends[width - 1]) : hi]
            if len(window) >= len(first) + len(last) and (window[: len(first)] == first).all() and (window[len(window) - len(last) :] == last).all():
                self.joins[left, right] = (len(a) - lo, hi, window.copy())
            else:
                again.append((left, right))
        self.widened += len(again)
        if again:
            self._repair(again, 2 * width)


class Decoder:
    """ids -> text, as the vocabulary's own decoder does with special tokens kept."""

    def __init__(self, encoder_: SpanEncoder):
        from tokenizers.pre_tokenizers import ByteLevel

        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(visible)]
        table = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        assert set(table) == set(ByteLevel.alphabet())
        t = encoder_.tokenizer
        special = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
        self.bytes = []
        for i in range(t.get_vocab_size()):
            token = special.get(i) or t.id_to_token(i) or ""
            self.bytes.append(token.encode() if i in special else bytes(table[c] for c in token))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8, with replacement characters where the bytes are none."""
        out = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


def _encode_rows(path: str, keep_ids: bool):
    """Rows of parts, each part's given chunks (node) before its documents."""

    def run(batch_iterator):
        import pyarrow as pa

        spans = encoder(path, words=False)
        chunks, decoder, part_of = ChunkEncoder(spans), Decoder(spans), None

        def documents(rows):
            for part in batches(rows, lambda r: len(r[1]) + 1):
                found = chunks.encode([r[1] for r in part])
                raw = [ids.astype("<u4").tobytes() for ids in found]
                decoded = [decoder.decode(ids) for ids in found]
                cols = [pa.array([r[0] for r in part], pa.int64()), pa.array(list(map(len, found)), pa.int64())]
                if keep_ids:
                    cols += [pa.array(raw, pa.binary()), pa.array([d.decode() for d in decoded], pa.string())]
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                else:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batch_iterator:
            rows = []
            for part, node, ids, ends, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "node", "ids", "ends", "doc_id", "text")), strict=True):
                if part != part_of:
                    yield from documents(rows)
                    rows, part_of = [], part
                    chunks.given = {}
                if node is not None:
                    chunks.given[node] = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<i4")
                else:
                    rows.append((doc_id, text))
            yield from documents(rows)

    return run


def _names_met(batch_iterator):
    """(node, part) of chunks, each once in a task as far as it remembers."""
    import pyarrow as pa

    seen: set[tuple[bytes, int]] = set()
    for batch in batch_iterator:
        if len(seen) > 200_000:
            seen.clear()
        fresh = {(chunk_name(c), part) for part, text in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True) for c in cut_text(text)} - seen
        seen |= fresh
        nodes, parts = zip(*fresh, strict=True) if fresh else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(parts, pa.int32())], names=["node", "part"])


def _texts_of(bits):
    """(node, chunk) of chunks that the filter lets through, each once in a task as far as it remembers."""

    def run(batch_iterator):
        import pyarrow as pa

        known, seen = bits.value, set()
        for batch in batch_iterator:
            if len(seen) > 200_000:
                seen.clear()
            rows = []
            for text in batch["text"].to_pylist():
                for c in cut_text(text):
                    f = chunk_name(c)
                    if f not in seen and all(known[p >> 3] >> (p & 7) & 1 for p in _filter_places(f, len(known) * 8)):
                        seen.add(f)
                        rows.append((f, c))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.string())], names=["node", "chunk"])

    return run


def _encode_chunks(path: str):
    def run(batch_iterator):
        import pyarrow as pa

        spans = encoder(path, words=False)
        for batch in batch_iterator:
            for some in batches(zip(batch["node"].to_pylist(), batch["chunk"].to_pylist(), strict=True), lambda r: len(r[1]) + 1):
                chunks = ChunkEncoder(spans)
                chunks._learn([c for _, c in some])
                found = [chunks.chunks[c] for _, c in some]
                cols = [pa.array([f for f, _ in some], pa.binary()), pa.array([ids.astype("<u4").tobytes() for ids, _ in found], pa.binary()), pa.array([ends.astype("<i4").tobytes() for _, ends in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "ids", "ends"])

    return run


def place_by_content(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, text, part), null texts empty, placed so that documents with lines in common tend to meet.

    A group is the least hash of a document's lines. Groups over group_bytes are spread over as many parts as they
    have times group_bytes. They are written and counted first: up to HOT_GROUPS of them are sent to all tasks; of
    more, each row asks for its own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", t.alias("text"), F.array_min(F.transform(F.split(t, "\n"), lambda x: F.xxhash64(x))).alias("route"))
    hot = rows.groupBy("route").agg(F.sum(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") > group_bytes)
    hot = materialize(hot.select("route", F.ceil(F.col("bytes") / group_bytes).cast("int").alias("ways")), "bpe-hot")
    side = F.broadcast(hot) if hot.count() <= HOT_GROUPS else hot
    way = F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.col("ways")).cast("int"))
    return rows.join(side, "route", "left").select("doc_id", "text", F.pmod(F.xxhash64("route", way), F.lit(PARTS_EACH * input_parallelism(docs))).cast("int").alias("part"))


def _dealt(docs: DataFrame, path: str, text: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(part, node, ids, ends, doc_id, text): each part's chunks that other parts have, too, then its documents."""
    spark = docs.sparkSession
    placed = place_by_content(docs, text, group_bytes)
    met = placed.select("part", "text").mapInArrow(tidy(_names_met), "node binary, part int")
    shared = materialize(met.distinct().groupBy("node").agg(F.collect_list("part").alias("parts")).filter(F.size("parts") > 1), "bpe-shared")
    bits = spark.sparkContext.broadcast(_candidate_filter(shared))
    texts = placed.select("text").mapInArrow(tidy(_texts_of(bits)), "node binary, chunk string").join(shared.select("node"), "node", "left_semi")
    once = texts.groupBy("node").agg(F.first("chunk").alias("chunk"))
    known = materialize(once.mapInArrow(tidy(_encode_chunks(path), tokenizes=True), "node binary, ids binary, ends binary"), "bpe-chunks")
    bits.destroy()
    none = lambda kind: F.lit(None).cast(kind)
    given = known.join(shared, "node").select(F.explode("parts").alias("part"), "node", "ids", "ends", none("long").alias("doc_id"), none("string").alias("text"))
    own = placed.select("part", none("binary").alias("node"), none("binary").alias("ids"), none("binary").alias("ends"), "doc_id", "text")
    return given.unionByName(own).repartition(input_parallelism(docs), "part").sortWithinPartitions("part", F.col("node").isNull())


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (binary, 32-bit little-endian), decoded (string).

    ids are exactly the vocabulary's for the whole text, without special tokens added; their strings in a text are
    taken as the vocabulary takes them. Null and empty texts have no ids. Repeated rows give repeated rows, other
    columns aren't read, an empty table gives no rows. Texts are shuffled once. A task remembers REMEMBERED code points
    of chunks; should a part hold more, it forgets them and encodes anew what it meets again.
    """
    return _dealt(docs, tokenizer_path, text, group_bytes).mapInArrow(tidy(_encode_rows(tokenizer_path, True), tokenizes=True), "doc_id long, n_tokens long, ids binary, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents; the digests are taken where the ids are, so ids and texts needn't come back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = vocabulary("byte_bpe_50k.json")
    return _dealt(docs, path, "text").mapInArrow(tidy(_encode_rows(path, False), tokenizes=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
