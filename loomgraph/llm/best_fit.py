"""Best-fit packing after Martello and Toth's dominance reduction.

A set of pieces that fills a sequence dominates another with the same largest piece if its pieces can be exchanged for
the other's without needing more room anywhere else. Where such a set is proven for a piece, it is fixed for good: some
best packing has it. Fixing goes on, on what is left, until nothing more can be proven; what remains is packed by best
fit, largest pieces first.

Pieces differ by their number of tokens alone, so an instance is a count for each length, however many documents there
are, and a packing is a few patterns, each with how many sequences follow it. Only counts reach the driver. Pieces are
numbered among those of their length, and a piece's number says which sequence of which pattern it is in.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread, tidy
from .packing import vocabulary
from .tokens import batches, encoder, pieces

WINDOW, END_ID = 1024, 2
#: Spans of text that a worker remembers with their ids; only speed depends on it.
SPANS = 1_000_000
#: Up to so many rows of (task, length) are sent to all tasks; of more, pieces are joined with theirs.
BROADCAST_BASES = 1_000_000


def _smallest(counts: list[int], n: int) -> list[int]:
    """The n least sizes, by multiplicity."""
    out = []
    for size, c in enumerate(counts):
        out += [size] * min(c, n - len(out))
        if len(out) == n:
            break
    return out


def _largest_pair(counts: list[int], room: int) -> tuple[int, int]:
    """(larger, smaller) of the largest sum that room holds; of equal sums the one with the larger piece. There is one."""
    best, lo = (0, 0), 1
    for hi in range(min(room, len(counts) - 1), 0, -1):
        if not counts[hi] or 2 * hi < best[0] + best[1]:
            continue
        lo = min(room - hi, hi)
        while lo > 0 and not (counts[lo] - (lo == hi) > 0):
            lo -= 1
        if lo > 0 and hi + lo > sum(best):
            best = (hi, lo)
    return best


def dominating(counts: list[int], w: int, capacity: int) -> list[int] | None:
    """Pieces that, with one of size w (not in counts), are a set that dominates all others with it; None: not proven."""
    room = capacity - w
    least = _smallest(counts, 3)
    fits = sum(int(sum(least[: k + 1]) <= room) for k in range(len(least)))
    if not fits:
        return []
    partner = max(size for size in range(1, room + 1) if counts[size])
    if fits == 1 or partner == room:
        return [partner]
    if fits == 2:
        a, b = _largest_pair(counts, room)
        if partner >= a + b:
            return [partner]
        if a == partner:
            # Any other pair must be no larger, piece by piece: no two pieces larger than b fit together beside a's loss.
            above = [size for size in range(b + 1, len(counts)) for _ in range(min(2, counts[size] - (size == a)))][:2]
            if len(above) < 2 or sum(above) > room:
                return [a, b]
    return None


def reduce_instance(counts: list[int], capacity: int) -> tuple[Counter, list[int]]:
    """(sets of sizes, largest first, that are fixed and how often; counts left). counts: by size, from 0 on.

    Equal pieces are fixed together: what was proven for one stays proven while each size in the set and each of the
    three least sizes has pieces to spare, so steps depend on the number of sizes, not of pieces.
    """
    left, fixed = list(counts), Counter()
    found = True
    while found:
        found = False
        for w in range(capacity, 0, -1):
            while left[w]:
                left[w] -= 1
                others = dominating(left, w, capacity)
                left[w] += 1
                if others is None:
                    break
                group = tuple(sorted([w, *others], reverse=True))
                need = Counter(group)
                times = max(1, min((left[s] - 4) // n for s, n in need.items()))
                for s, n in need.items():
                    left[s] -= n * times
                fixed[group] += times
                found = True
    return fixed, left


def best_fit(counts: list[int], capacity: int) -> Counter:
    """Sets of sizes and how often: each piece, largest first, goes where it leaves least room."""
    opened: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by room left: sets and their number
    for w in range(capacity, 0, -1):
        n = counts[w]
        room = w
        while n:
            while room <= capacity and not opened[room]:
                room += 1
            if room > capacity:  # new sequences, filled with as many of this size as they hold
                each = capacity // w
                full, rest = divmod(n, each)
                if full:
                    opened[capacity - each * w][(w,) * each] += full
                if rest:
                    opened[capacity - rest * w][(w,) * rest] += 1
                break
            each = room // w  # as many go to one sequence as it holds, as they would one after the other
            for group in sorted(opened[room]):
                has = opened[room].pop(group)
                full = min(has, n // each)
                if full:
                    opened[room - each * w][group + (w,) * each] += full
                    has, n = has - full, n - full * each
                if has and n < each:
                    if n:
                        opened[room - n * w][group + (w,) * n] += 1
                    has, n = has - (n > 0), 0
                if has:
                    opened[room][group] = has
                if not n:
                    break
    out = Counter()
    for level in opened:
        out.update(level)
    return out


def plan(counts: list[int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((set of sizes, how many sequences) in order, how many of the sequences the reduction has fixed)."""
    fixed, left = reduce_instance(counts, capacity)
    rest = best_fit(left, capacity)
    return sorted(fixed.items(), reverse=True) + sorted(rest.items(), reverse=True), sum(fixed.values())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (size, first, each, sequence, offset) by size and first: pieces numbered from `first` on go to sequences from
    `sequence` on, `each` to one, from `offset` on."""
    rows, given, sequence = [], Counter(), 0
    for group, times in patterns:
        offset = 0
        for size, each in sorted(Counter(group).items(), reverse=True):
            rows.append((size, given[size], each, sequence, offset))
            given[size] += each * times
            offset += each * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECE = "doc_id long, piece int, start long, length long, ids binary, task int, nth long"


def _pieces(path: str, window: int):
    """Documents' pieces, each numbered among the task's pieces of its length."""

    def run(batch_iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        known, task, met = encoder(path, words=False, most=SPANS), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batch_iterator:
            rows = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
            for part in batches(rows, lambda r: len(r[1] or "") + 1):
                texts, owner = [], []
                for k, row in enumerate(part):
                    for x in pieces(row[1] or ""):
                        texts.append(x)
                        owner.append(k)
                ids, at, _, _ = known.encode(texts)
                lo = at[np.searchsorted(owner, np.arange(len(part) + 1))]
                ended = np.insert(ids, lo[1:], END_ID).astype("<u4", copy=False)
                lo = lo + np.arange(len(lo))
                out = []
                for k, (doc_id, _) in enumerate(part):
                    n = int(lo[k + 1] - lo[k])
                    first = n % window or window
                    edges = [0, *range(first, n + 1, window)]
                    for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                        out.append((doc_id, p, s, e - s, ended[lo[k] + s : lo[k] + e].tobytes(), task, int(met[e - s])))
                        met[e - s] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _placed(table: np.ndarray):
    def run(batch_iterator):
        import pyarrow as pa

        for b in batch_iterator:
            size, number = b["length"].to_numpy(), b["number"].to_numpy()
            at = np.empty(len(size), np.int64)
            for w in np.unique(size):
                lo, hi = np.searchsorted(table[:, 0], [w, w + 1])
                mine = size == w
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], number[mine], side="right") - 1
            _, first, each, sequence, offset = table[at].T
            q, r = np.divmod(number - first, each)
            cols = [b[x] for x in ("doc_id", "piece", "start", "length", "ids")] + [pa.array(sequence + q), pa.array(offset + r * size)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, piece (from 0), start, length, ids (binary, 32-bit little-endian), sequence_id, offset.

    A document's ids are those of its whole text, then END_ID; null and empty texts: END_ID alone. One longer than
    `window` is cut into pieces of `window`, of which the first may be shorter. Ids of documents may be null or repeat:
    each row is a document of its own. Of pieces of equal length any may come first. Very long texts are encoded in parts
    that the vocabulary never joins. Sequences' ids are gapless from 0. Other columns aren't read; an empty table gives no
    rows.

    Texts are read once. Pieces with their ids are written; counts by task and length, the length's own count at most as
    many rows as tasks times `window`, give each piece its number; nothing else is shuffled while those rows are few.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("doc_id", F.col(text).alias("text")))
    cut = materialize(rows.mapInArrow(tidy(_pieces(tokenizer_path, window), tokenizes=True), PIECE), "fit-pieces")
    by_task = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "fit-counts")
    counts = [0] * (window + 1)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `window` rows at most
        counts[r["length"]] = r["n"]
    table = slots(plan(counts, window)[0])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    side = F.broadcast(bases) if by_task.count() <= BROADCAST_BASES else bases
    numbered = cut.join(side, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("nth") + F.col("base")).alias("number"))
    return numbered.mapInArrow(tidy(_placed(table)), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_best_fit(docs, vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
