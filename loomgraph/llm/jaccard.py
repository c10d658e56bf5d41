"""N-gram Jaccard join, size-aware: small sets by fixed-size subsets, large ones by inverted lists.

Two sets link when 100 * |A and B| >= percent * |A or B|. Equal sets are one class from the start.

Light sets (up to a size chosen by cost): all their subsets of the sizes that a partner could share are enumerated.
Two sets with a common subset of the size that they need are linked: no further check.

Heavy sets: shingles are ordered by how common they are, and a set enters the inverted lists of the first few, as
many as a partner cannot miss all. Short lists emit their pairs. A pair first meets both sets' sketches: a row of
bits in which each shingle flips one, about as many bits as shingles. Bits that differ need a shingle each that only
one set has, so a pair that differs in more bits than linked sets may is no link, and no text moves for it. What is
left is checked with the texts, one pair for each set first, then the pairs that aren't connected by then.

Long lists never emit pairs: their runs, in order of size, are joined to groups, and a group's sets are held against
each other in blocks of bounded size: within each block first, then what isn't yet connected against all blocks of
its group. So components are exact, but links inside what is connected already needn't be looked for.

Orders need no exact counts, so counts may merge shingles and take in copies: results are the same for any order.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_parallelism, materialize, tidy
from .tokens import batches

WORDS, PERCENT = 4, 85
#: A list with more sets of one range of sizes than this is long.
SHORT_LIST = 32
#: Sets of one block of a group, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 23
#: Bits of a sketch at least; larger sets have the next power of two from their size on.
SKETCH_BITS = 512
#: Slots that tell how common shingles are, by their upper bits, each in 4 bits: so many for each part of the input, in these
#: bounds. Beyond some billions of shingles slots are shared by more and only save less.
SLOTS_EACH, SLOTS_LEAST, SLOTS_MOST = 1 << 22, 1 << 20, 1 << 27
#: The highest level: shingles met 2 ** 15 times or more.
TOP_LEVEL = 15
#: Bits of the filter that tells which sets are candidates: so many for each, in these bounds. False positives only
#: cost work.
FILTER_BITS_EACH, FILTER_BITS_LEAST, FILTER_BITS_MOST = 16, 1 << 20, 1 << 28
#: Fingerprints that a task remembers of sets it has sent; only the volume sent depends on it.
REMEMBERED = 100_000
#: Bytes of input for each part of shingles or entries, which a task holds as a whole.
PART_BYTES = 5 << 20
#: Light sets are no larger, whatever the costs.
LIGHT_MOST = 14

_ROOT = 0x9E3779B97F4A7C15 | 1
_M = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_GAPS = np.zeros(256, bool)
_GAPS[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        inverse = pow(_ROOT, -1, 1 << 64)
        out = []
        for root in (_ROOT, inverse):
            table = np.full(size, root, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers = (out[0], out[1])
    return _powers


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; all of its words as one where they are fewer."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gap = _GAPS[data]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    n = len(word)
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            rolled = _mix(rolled * _M[3] + word[k : k + n - words + 1] * _M[4])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = _mix(h * _M[2] + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    x = _mix(s * _M[3] + _M[4])
    return s.sum(dtype=np.uint64).tobytes() + (x.sum(dtype=np.uint64) ^ np.uint64(len(s))).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """Bits, each flipped by the shingles that fall to it. A sketch of half the bits is the exclusive or of both halves."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else SKETCH_BITS
    flips = np.bincount((_mix(s * _M[4]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little").tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def needed(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(batch_iterator):
    """Lists of (id, text) of bounded size; the ids may be anything."""
    for batch in batch_iterator:
        yield from batches(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True), lambda r: len(r[1] or "") + 1, 500_000)


def _classes(words: int):
    """Rows' ids with their sets' sizes, fingerprints and sketches (these once in a task as far as it remembers); with a
    column of texts' keys, these too."""

    def run(batch_iterator):
        import pyarrow as pa

        seen: set[bytes] = set()

        def fresh(f):
            if f in seen:
                return False
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.add(f)
            return True

        for batch in batch_iterator:
            keys = [batch["key"]] if "key" in batch.schema.names else []
            done = 0
            for part in _texts([batch]):
                sets = shingle_sets([t or "" for _, t in part], words)
                names = [fingerprint(s) if len(s) else None for s in sets]
                cols = [pa.array([d for d, _ in part], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary())]
                cols.append(pa.array([sketch(s) if f and fresh(f) else None for f, s in zip(names, sets, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols + [k.slice(done, len(part)) for k in keys], names=["doc_id", "n", "class", "sketch", "key"][: 4 + len(keys)])
                done += len(part)

    return run


def _new_sets(batch_iterator, words: int):
    """Sets and their fingerprints; each set once in a task as far as it remembers."""
    seen: set[bytes] = set()
    for part in _texts(batch_iterator):
        if len(seen) > REMEMBERED:
            seen.clear()
        for s, (_, text) in zip(shingle_sets([t or "" for _, t in part], words), part, strict=True):
            if len(s) and (f := fingerprint(s)) not in seen:
                seen.add(f)
                yield f, s, text


def _packed(values: np.ndarray, of: np.ndarray, parts: int):
    """(part, bytes of its values) of each part."""
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(parts + 1))
    values = values[order]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, values[edges[k] : edges[k + 1]].tobytes()


def _grouped(items, size, most: int):
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _rows(rows, names: list[str], types: list):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of 32-bit values."""
    return (values.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _deltas(values: np.ndarray) -> bytes:
    """Increasing 32-bit values as differences, lower halves first: the upper ones are mostly zero and compress."""
    d = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    return (d & np.uint32(0xFFFF)).astype("<u2").tobytes() + (d >> np.uint32(16)).astype("<u2").tobytes()


def _from_deltas(data: bytes) -> np.ndarray:
    half = np.frombuffer(data, "<u2")
    n = len(half) // 2
    return np.cumsum(half[:n].astype(np.uint32) | half[n:].astype(np.uint32) << np.uint32(16), dtype=np.uint32)


def _send_shingles(words: int, parts: int):
    """Shingles cut to 32 bits, those of a few thousand documents at a time, by part; often: with how often."""

    def run(batch_iterator):
        import pyarrow as pa

        for some in _grouped((s for _, s, _ in _new_sets(batch_iterator, words)), len, 1_000_000):
            values, counts = np.unique((np.concatenate(some) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            edges = np.searchsorted(_part_of(values, parts), np.arange(parts + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                v, c = values[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]]
                rows.append((k, _deltas(v[c == 1]), v[c > 1].tobytes() + c[c > 1].astype("<u4").tobytes()))
            yield _rows(rows, ["part", "once", "often"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def slot_count(parts: int) -> int:
    return min(SLOTS_MOST, max(SLOTS_LEAST, 1 << (SLOTS_EACH * parts - 1).bit_length()))


def _slots_of(values: np.ndarray, slots: int) -> np.ndarray:
    """Slots of 32-bit values, in the same order."""
    return values >> np.uint32(32 - slots.bit_length() + 1)


def _count_shingles(slots: int):
    """Rows (first slot, packed levels): how often the most common of each slot's shingles was met, as a power of two (0:
    none was met twice)."""

    def run(batch_iterator):
        import pyarrow as pa

        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batch_iterator:
            for k, a, b in zip(*(batch[c].to_pylist() for c in ("part", "once", "often")), strict=True):
                held.setdefault(k, []).append((a, b))
        for k in list(held):
            rows = held.pop(k)
            many = [np.frombuffer(b, np.uint32).reshape(2, -1) for _, b in rows]
            once = [_from_deltas(a) for a, _ in rows]
            values, at = np.unique(np.concatenate(once + [m[0] for m in many]), return_inverse=True)
            count = np.bincount(at, np.concatenate([np.ones(sum(map(len, once)))] + [m[1] for m in many]), len(values))
            slot, level = _slots_of(values[count >= 2], slots).astype(np.int64), np.minimum(np.log2(count[count >= 2]), TOP_LEVEL).astype(np.uint8)
            if not len(slot):
                continue
            first = int(slot[0]) & ~1
            levels = np.zeros((int(slot[-1]) - first) // 2 * 2 + 2, np.uint8)
            np.maximum.at(levels, slot - first, level)
            packed = levels[::2] | levels[1::2] << 4
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], names=["first", "levels"])

    return run


def corpus_shingles(docs: DataFrame, words: int, parts: int) -> np.ndarray:
    """How common shingles are, by slots of their upper bits, two slots in a byte."""
    slots = slot_count(parts)
    counted = materialize(docs.mapInArrow(tidy(_send_shingles(words, parts)), "part int, once binary, often binary").repartition(parts, "part").mapInArrow(tidy(_count_shingles(slots)), "first long, levels binary"), "join-common")
    out = np.zeros(slots // 2, np.uint8)
    for r in counted.toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
        here = out[r["first"] // 2 : r["first"] // 2 + len(part)]
        # neighbours may share a slot, of which each knows its own shingles
        here[:] = np.maximum(here & 15, part & 15) | np.maximum(here & 240, part & 240)
    return out


def levels_of(s: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    slot = _slots_of((s >> np.uint64(32)).astype(np.uint32), 2 * len(corpus))
    return corpus[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8) & 15


def _prefix(s: np.ndarray, corpus: np.ndarray, percent: int) -> np.ndarray:
    """The lists that a set (sorted) enters: its first shingles in order, the rarest ones, without those that no other has."""
    level = levels_of(s, corpus)
    first = np.argsort(level, kind="stable")[: prefix_size(len(s), percent)]
    return s[first[level[first] > 0]]


def subsets(s: np.ndarray, percent: int):
    """(size, hash) of all subsets of a light set of the sizes that a partner may share."""
    mixed = _mix(s * _M[2] + _M[0])
    for c in range(-(-percent * len(s) // 100), len(s) + 1):
        for left_out in combinations(range(len(s)), len(s) - c):
            keep = np.ones(len(s), bool)
            keep[list(left_out)] = False
            yield c, mixed[keep]


_ENTRY = np.dtype([("key", "<u8"), ("more", "<u8"), ("class", "S16"), ("n", "<i4"), ("c", "<i4")])


def _send_entries(words: int, parts: int, light: int, percent: int, corpus):
    """Entries of inverted lists (c 0, key: the shingle) and of subsets (c: their size, key and more: their hash)."""
    least_heavy = -(-percent * (light + 1) // 100)

    def entries(f, s):
        out = []
        if len(s) <= light:
            for c, x in subsets(s, percent):
                out.append((int(_mix(x).sum(dtype=np.uint64)), int(_mix(x + _M[1]).sum(dtype=np.uint64)), c))
        rows = np.zeros(len(out), _ENTRY)
        if out:
            rows["key"], rows["more"], rows["c"] = map(np.array, zip(*((np.uint64(a), np.uint64(b), c) for a, b, c in out), strict=True))
        if len(s) >= least_heavy:
            head = _prefix(s, corpus.value, percent)
            listed = np.zeros(len(head), _ENTRY)
            listed["key"] = head
            rows = np.concatenate([rows, listed])
        rows["class"], rows["n"] = f, len(s)
        return rows

    def run(batch_iterator):
        import pyarrow as pa

        for some in _grouped((entries(f, s) for f, s, _ in _new_sets(batch_iterator, words)), len, 100_000):
            rows = np.concatenate(some)
            yield _rows(list(_packed(rows, (rows["key"] >> np.uint64(20)) % np.uint64(parts), parts)), ["part", "entries"], [pa.int32(), pa.binary()])

    return run


SURE, PAIR, RUN = 0, 1, 2


def _list_edges(percent: int):
    """Edges (a, b, kind) between entries of a list: linked by a subset, a pair to be checked, or a set with the
    least one of its run in a long list."""

    def edges(rows: np.ndarray):
        rows = rows[np.lexsort((rows["class"], rows["n"], rows["c"], rows["more"], rows["key"]))]
        n = rows["n"].astype(np.int64)
        same = (rows["key"][1:] == rows["key"][:-1]) & (rows["more"][1:] == rows["more"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
        fresh = ~(same & (rows["class"][1:] == rows["class"][:-1]))  # a set's entry may come from several tasks
        keep = np.concatenate([[True], fresh]) if len(rows) else np.zeros(0, bool)
        rows, n = rows[keep], n[keep]
        same = (rows["key"][1:] == rows["key"][:-1]) & (rows["more"][1:] == rows["more"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
        # With the least set of a subset's bucket link all that are small enough; links of two others imply both of theirs.
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, int)
        at = np.flatnonzero((rows["c"] > 0) & (np.arange(len(rows)) != head) & (needed(n, n[head], percent) <= rows["c"]))
        yield rows["class"][at], rows["class"][head[at]], SURE
        # Runs of a list in which each size is in reach of the one before.
        near = same & (rows["c"][1:] == 0) & (100 * n[:-1] >= percent * n[1:])
        begin = np.flatnonzero(np.concatenate([[True], ~near])) if len(rows) else np.zeros(0, int)
        end = np.append(begin[1:], len(rows))
        long = end - begin > SHORT_LIST
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            yield np.full(b - a - 1, rows["class"][a]), rows["class"][a + 1 : b], RUN
        for step in range(1, int((end - begin)[~long].max(initial=1))):
            a = np.concatenate([np.arange(x, y - step) for x, y in zip(begin[~long].tolist(), end[~long].tolist(), strict=True) if y - x > step] or [np.zeros(0, int)])
            a = a[100 * n[a] >= percent * n[a + step]]
            yield rows["class"][a], rows["class"][a + step], PAIR

    def run(batch_iterator):
        import pyarrow as pa

        held: dict[int, list[bytes]] = {}
        for batch in batch_iterator:
            for k, x in zip(batch["part"].to_pylist(), batch["entries"].to_pylist(), strict=True):
                held.setdefault(k, []).append(x)
        for k in list(held):
            rows = np.frombuffer(b"".join(held.pop(k)), _ENTRY)
            # Of each kind by itself: a long list's edge stays beside a pair's other kind, as it alone puts both sets in
            # one group. As arrays, since pairs are many.
            met: dict[int, list[np.ndarray]] = {}
            for a, b, kind in edges(rows):
                pair = np.empty(len(a), [("p", "S16"), ("q", "S16")])
                pair["p"], pair["q"] = np.where(a < b, a, b), np.where(a < b, b, a)
                met.setdefault(kind, []).append(np.unique(pair.view("S32")))
                if sum(map(len, met[kind][1:])) > 500_000:
                    met[kind] = [np.unique(np.concatenate(met[kind]))]
            for kind in list(met):
                pairs = np.unique(np.concatenate(met.pop(kind)))
                for lo in range(0, len(pairs), 50_000):
                    raw = pairs[lo : lo + 50_000].tobytes()
                    yield _rows([(raw[x : x + 16], raw[x + 16 : x + 32], kind) for x in range(0, len(raw), 32)], ["a", "b", "kind"], [pa.binary(), pa.binary(), pa.int32()])

    return run


def _contract(batch_iterator):
    """Edges of a task, some at a time, as stars to the least node that they connect."""
    import pyarrow as pa

    pairs = ((p, q) for batch in batch_iterator for p, q in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True))
    for some in _grouped(pairs, lambda _: 1, 100_000):
        root: dict[bytes, bytes] = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for p, q in some:
            x, y = find(p), find(q)
            if x != y:
                root[max(x, y)] = min(x, y)
        stars = [(x, find(x)) for x in list(root)]
        yield _rows([(x, r) for x, r in stars if x != r], ["a", "b"], [pa.binary(), pa.binary()])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, comp): the least node that is reachable. Each task contracts its edges to stars; then large-star and
    small-star rounds of joins by group minimum, until all edges form stars. Each round is written to the shared
    folder. Every node has an edge."""
    now = materialize(edges.select("a", "b").filter("a != b").mapInArrow(tidy(_contract), "a binary, b binary"), tag)
    while True:
        # A star: no node is above one edge and below another, and each is below one.
        sides = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))).alias("x")).select("x.*")
        odd = sides.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low + high > 1")
        if not odd.limit(1).count():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of each node go to its least neighbour or itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours of each node, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a != b").distinct(), tag)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).distinct().unionByName(roots)


def _may_link(percent: int):
    """Pairs whose sketches differ in no more bits than linked sets' may: |A or B| - |A and B| at most."""

    def run(batch_iterator):
        import pyarrow as pa

        for batch in batch_iterator:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            most = n_a + n_b - 2 * needed(n_a, n_b, percent)
            raw = [batch[c].to_pylist() for c in ("s_a", "s_b")]
            sizes = np.array([list(map(len, x)) for x in raw]).reshape(2, -1)
            keep = np.zeros(len(most), bool)
            for wide, narrow in {tuple(x) for x in sizes.T.tolist()}:
                at = np.flatnonzero((sizes[0] == wide) & (sizes[1] == narrow))
                a, b = (np.frombuffer(b"".join(x[k] for k in at.tolist()), "<u8").reshape(len(at), -1) for x in raw)
                width = min(a.shape[1], b.shape[1])
                keep[at] = np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum(1) <= most[at]
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def possible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""
    for side in "ab":
        pairs = pairs.join(sketches.withColumnsRenamed({"class": side, "n": f"n_{side}", "sketch": f"s_{side}"}), side)
    return pairs.mapInArrow(tidy(_may_link(percent)), "a binary, b binary")


def _filter_places(f: bytes, bits: int) -> list[int]:
    a, b = int.from_bytes(f[:8], "little"), int.from_bytes(f[8:], "little")
    return [(a + k * (b | 1)) % bits for k in range(3)]


def _candidate_filter(nodes: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of bounded size; partial filters meet as (byte, bits) rows."""
    size = min(FILTER_BITS_MOST, max(FILTER_BITS_LEAST, 1 << (FILTER_BITS_EACH * nodes.count()).bit_length()))

    def run(batch_iterator):
        import pyarrow as pa

        for batch in batch_iterator:
            at = np.array([p for f in batch["node"].to_pylist() for p in _filter_places(f, size)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(np.left_shift(1, at & 7).astype(np.int32))], names=["byte", "bits"])

    rows = nodes.select("node").mapInArrow(run, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    out[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _send_texts(words: int, bits):
    def run(batch_iterator):
        import pyarrow as pa

        known = bits.value
        some = ((f, t) for f, _, t in _new_sets(batch_iterator, words) if all(known[p >> 3] >> (p & 7) & 1 for p in _filter_places(f, len(known) * 8)))
        for rows in _grouped(some, lambda r: len(r[1]), 1_000_000):
            yield _rows(rows, ["node", "text"], [pa.binary(), pa.string()])

    return run


def linked_matrix(sets: list[np.ndarray], rows: int, percent: int) -> np.ndarray:
    """linked[i, j]: do the first `rows` sets link with each. Overlaps come from products of 0-1 matrices over the
    shingles that two sets have at least, a bounded number of columns at a time."""
    size = np.array(list(map(len, sets)), np.int32)
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    column = np.cumsum(count > 1) - 1
    use = count[at] > 1
    column, owner = column[at[use]], owner[use]
    width = int((count > 1).sum())
    overlap = np.zeros((rows, len(sets)), np.float32)
    step = max(256, (1 << 22) // len(sets))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        overlap += m[:rows] @ m.T
    # whole numbers under 2 ** 24, so single precision is exact; times 100 in double
    return overlap.astype(np.float64) * (100 + percent) >= percent * (size[:rows, None] + size[None, :]).astype(np.float64)


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that `linked` does, one fewer than each component's members."""
    rows, n = linked.shape
    root = np.arange(n)
    out = []
    for i in range(rows):
        near = np.flatnonzero(linked[i])
        parts, first = np.unique(root[near], return_index=True)
        new = parts != root[i]
        if new.any():
            out += [(i, j) for j in near[first[new]].tolist()]
            root[np.isin(root, parts[new])] = root[i]
    return out


def _check_blocks(words: int, percent: int):
    """Rows sorted by group and block: node, text, role (0: to be held against all, 1: against role 0 only)."""

    def links(rows):
        known = {}
        for node, text, role in rows:
            if role == 0 or node not in known:
                known[node] = (text, role)
        nodes = list(known)
        left, right = [x for x in nodes if known[x][1] == 0], [x for x in nodes if known[x][1] == 1]
        sets = {x: s for part in batches(nodes, lambda x: len(known[x][0]) + 1, 500_000) for x, s in zip(part, shingle_sets([known[y][0] for y in part], words), strict=True)}
        names = left + right
        if not left or len(names) < 2:
            return []
        return [(names[i], names[j]) for i, j in spanning_links(linked_matrix([sets[x] for x in names], len(left), percent))]

    def run(batch_iterator):
        import pyarrow as pa

        key, held, out = None, [], []
        for batch in batch_iterator:
            for g, b, node, text, role in zip(*(batch[c].to_pylist() for c in ("grp", "block", "node", "text", "role")), strict=True):
                if (g, b) != key:
                    out += links(held)
                    key, held = (g, b), []
                held.append((node, text, role))
            if len(out) > 10_000:
                yield _rows(out, ["a", "b"], [pa.binary(), pa.binary()])
                out = []
        out += links(held)
        if out:
            yield _rows(out, ["a", "b"], [pa.binary(), pa.binary()])

    return run


def light_size(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary with the least cost. A light set costs its subsets; a heavy one its list entries and, in the
    mean, one check of its shingles."""
    from math import comb

    def cost(x):
        light = sum(n * sum(comb(s, c) for c in range(-(-percent * s // 100), s + 1)) for s, n in sizes.items() if s <= x)
        return light + sum(n * (prefix_size(s, percent) + s) for s, n in sizes.items() if s >= percent * (x + 1) / 100)

    return min(range(LIGHT_MOST + 1), key=cost)


def jaccard_components(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long), component_id (least doc_id reachable by links, itself
    included).

    Null, empty and blank texts have no shingles and link with nothing: component_id is their own doc_id. Null ids:
    such rows count in links, and a component of null ids alone has none. Repeated ids are rows of their own. Other
    columns aren't read; an empty table gives no rows. Texts are read four times and only those of candidates are
    shuffled.
    """
    by_class = row_components(docs, text, words, percent)
    least = materialize(by_class.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "join-least")
    return by_class.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def row_components(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n, comp (a set that stands for all that are reachable by links; null without
    shingles); keyed: key, 128 bits of the text (null: null), which with the id tell rows apart, too."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col(text).alias("text"))
    parts = input_parallelism(docs, PART_BYTES)
    named, types = (docs.select("doc_id", F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("key")), ", key binary") if keyed else (rows, "")
    classes = materialize(named.mapInArrow(tidy(_classes(words)), "doc_id long, n long, class binary, sketch binary" + types), "join-classes")
    sketches = classes.filter("sketch is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = materialize(sketches, "join-sketches")
    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n").between(1, LIGHT_MOST * 2)).groupBy("n").count().collect()}
    light = light_size(sizes, percent)
    corpus = spark.sparkContext.broadcast(corpus_shingles(rows, words, parts))
    sent = rows.mapInArrow(tidy(_send_entries(words, parts, light, percent, corpus)), "part int, entries binary").repartition(parts, "part")
    edges = materialize(sent.mapInArrow(tidy(_list_edges(percent)), "a binary, b binary, kind int").groupBy("a", "b").agg(F.min("kind").alias("kind"), F.max("kind").alias("most")), "join-edges")
    corpus.destroy()
    sure = edges.filter(F.col("kind") == SURE).select("a", "b")

    # Groups of long lists, in blocks; pairs of short ones, unless one group holds both: its blocks cover them.
    group = components(edges.filter(F.col("most") == RUN), "join-groups")
    group = group.join(sketches.select(F.col("class").alias("node"), "n"), "node")
    counts = group.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    group = group.join(counts, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    group = materialize(group.select("node", F.col("comp").alias("grp"), "blocks", "block"), "join-groups")
    home = group.select("node", F.col("grp").alias("home"))
    pairs = edges.filter(F.col("kind") == PAIR).select("a", "b").join(home.withColumnsRenamed({"node": "a", "home": "h_a"}), "a", "left").join(home.withColumnsRenamed({"node": "b", "home": "h_b"}), "b", "left")
    pairs = pairs.filter("h_a is null or h_b is null or h_a != h_b").select("a", "b")
    pairs = materialize(possible_pairs(pairs, sketches, percent), "join-pairs")
    wanted = materialize(group.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "join-wanted")
    bits = spark.sparkContext.broadcast(_candidate_filter(wanted))
    texts = rows.mapInArrow(tidy(_send_texts(words, bits)), "node binary, text string").join(wanted, "node")
    texts = materialize(texts, "join-texts")
    bits.destroy()

    def checked(dealt: DataFrame, tag: str) -> DataFrame:
        sorted_ = dealt.select("grp", "block", "node", "text", "role").repartition(parts, "grp", "block").sortWithinPartitions("grp", "block")
        return materialize(sorted_.mapInArrow(tidy(_check_blocks(words, percent)), "a binary, b binary"), tag)

    def checked_pairs(some: DataFrame) -> DataFrame:
        # A pair's second set goes to its first one, which comes to each block of its partners.
        width = some.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        first = width.select(F.col("a").alias("node"), F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
        second = some.join(width, "a").select(F.col("b").alias("node"), F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"))
        return checked(texts.join(first.unionByName(second), "node"), "join-links")

    # Of each set one pair first: most others are connected by then.
    once = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = sure.unionByName(checked_pairs(once))
    grouped = texts.join(group, "node")
    found = found.unionByName(checked(grouped.withColumn("role", F.lit(0)), "join-links"))
    comp = components(found, "join-components")
    rest = pairs.join(once, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(comp.withColumnsRenamed({"node": side, "comp": f"c_{side}"}), side, "left")
    rest = materialize(rest.filter("c_a is null or c_b is null or c_a != c_b").select("a", "b"), "join-pairs")
    if rest.limit(1).count():
        more = checked_pairs(rest)
        if more.limit(1).count():
            comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "join-components")
    large = grouped.filter("blocks > 1").select("node", "text", "grp", "blocks", "block")
    if large.limit(1).count():
        more = _across_blocks(large, comp, checked)
        if more.limit(1).count():
            comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "join-components")
    by_class = classes.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    return materialize(by_class.select("doc_id", "n", "comp", *["key"] * keyed), "join-comp")


def _across_blocks(large: DataFrame, comp: DataFrame, checked) -> DataFrame:
    """Links between blocks of a group. Its largest connected part is left out on one side: two of its members
    needn't be compared. All others are held, in blocks, against all blocks of the group."""
    large = large.dropDuplicates(["node"])
    so_far = comp.withColumnRenamed("comp", "part")
    named = large.select("node", "grp", "blocks", "block").join(so_far, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = named.groupBy("grp", "part").agg(F.count("*").alias("n"))
    giant = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("giant"), F.sum("n").alias("all"), F.max("n").alias("most"))
    named = materialize(named.join(giant, "grp").filter("most < all"), "join-parts")
    rest = named.filter("part != giant")
    # Blocks of those to be held against all: as many as they fill.
    n_rest = rest.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ways"))
    rest = rest.join(n_rest, "grp").select("node", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ways")).cast("int").alias("way"), "blocks")
    asked = large.select("node", "text", "grp").join(rest, "node").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("node", "text", "grp", F.struct("way", "to").alias("block"), F.lit(0).alias("role"))
    held = large.join(n_rest, "grp").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    held = held.select("node", "text", "grp", F.struct("way", F.col("block").alias("to")).alias("block"), F.lit(1).alias("role"))
    both = asked.unionByName(held).withColumn("block", F.xxhash64("block.way", "block.to"))
    return checked(both, "join-links")


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
