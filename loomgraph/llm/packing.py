"""Order-preserving packing by dynamic programming.

Documents keep their order. Cuts are chosen at ends of documents or sentences so that padding plus penalties for
cutting documents is least; as padding is linear in the cut's place, the best window start for each end is the
least of a sliding window, kept in a monotone queue: constant work for each possible cut.

Documents are dealt in equal stretches of their order. A stretch is read as a stream: as soon as all choices that are
still open agree on what came before, that part is cut for good, so cuts are the best of the whole stretch though only
its open end is held.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_parallelism, tidy
from .tokens import batches, encoder, pieces

WINDOW = 4096
#: In padded ids: what a cut between sentences of a document costs, and one inside a sentence.
SENTENCE_CUT, FORCED_CUT = 24.0, 400.0
#: Ids after which a task looks for what it can cut for good. Results don't depend on it.
HELD_IDS = 1 << 20
#: Ids of pieces that go out at once.
BATCH_IDS = 1 << 18
END_ID = 2


def _best_before(ends: np.ndarray, penalties: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(places, with 0 first; of each the index of the place where its window begins)."""
    place, cost = [0, *map(int, ends)], [0.0] * (len(ends) + 1)
    before = [0] * len(place)
    queue = deque([(0.0, 0)])  # (cost + place, index): costs increase, so the head is best
    for j in range(1, len(place)):
        at = place[j]
        while at - place[queue[0][1]] > window:
            queue.popleft()
        key, i = queue[0]
        new = key + window + penalties[j - 1]  # cost[j] + at
        cost[j], before[j] = new - at, i
        while queue and queue[-1][0] >= new:
            queue.pop()
        queue.append((new, j))
    return place, before


def _path(place: list[int], before: list[int], j: int) -> list[int]:
    cuts = []
    while j:
        cuts.append(place[j])
        j = before[j]
    return cuts[::-1]


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places to cut, the last of ends among them. ends: increasing places where a cut is possible, each at most
    `window` after the one before (or 0); penalties: of each. Least sum of padding and penalties over all choices."""
    place, before = _best_before(ends, penalties, window)
    return _path(place, before, len(ends))


def settled_cuts(ends: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts that stay the best whatever follows: those before the last place that all places in reach of what
    follows come from."""
    place, before = _best_before(ends, penalties, window)
    open_ = {j for j in range(len(place) - 1, -1, -1) if place[j] >= place[-1] - window}
    while len(open_) > 1:
        j = max(open_)
        open_.remove(j)
        open_.add(before[j])
    return _path(place, before, open_.pop())


def _merged(*parts: np.ndarray) -> np.ndarray:
    """All values of sorted arrays, each once, in order."""
    every = np.sort(np.concatenate(parts), kind="stable")
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def possible_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """choose_cuts()'s arguments, of sorted places; stretches over a window without an end get cuts inside sentences."""
    places = _merged(doc_ends, sentence_ends)
    gaps = np.diff(places, prepend=0)
    extra = [np.arange(e - g + window, e, window) for e, g in zip(places[gaps > window], gaps[gaps > window], strict=True)]
    if extra:
        places = _merged(places, *extra)
    penalty = np.where(_among(places, doc_ends), 0.0, np.where(_among(places, sentence_ends), SENTENCE_CUT, FORCED_CUT))
    return places, penalty


def close_tail(last: int, end: int, window: int = WINDOW) -> list[int]:
    """Cuts of a block's last window (last, end]: where powers of two, which need no padding, cost less than padding."""
    size, out = end - last, []
    if SENTENCE_CUT * (size.bit_count() - 1) >= window - size:
        return [end]
    while size:
        power = 1 << (size.bit_length() - 1)
        last, size = last + power, size - power
        out.append(last)
    return out


def _encoded(batch_iterator, path: str):
    """(doc_id, ids with END_ID, where its sentences end) of rows in order."""
    known = encoder(path, words=True)
    for batch in batch_iterator:
        rows = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
        for part in batches(rows, lambda r: len(r[1] or "") + 1):
            texts, owner = [], []
            for k, row in enumerate(part):
                for piece in pieces(row[1] or ""):
                    texts.append(piece)
                    owner.append(k)
            ids, at, span_ends, _ = known.encode(texts)
            stops = span_ends[known.last_sentence_ends]
            lo = at[np.searchsorted(owner, np.arange(len(part) + 1))]
            cut = np.searchsorted(stops, lo, side="right").tolist()
            ended = np.insert(ids, lo[1:], END_ID).astype("<u4", copy=False)
            first = (lo + np.arange(len(lo))).tolist()
            for k, (row, at_k) in enumerate(zip(part, lo.tolist(), strict=False)):
                yield row[0], ended[first[k] : first[k + 1]], stops[cut[k] : cut[k + 1]] - at_k


class _Stream:
    """Documents that aren't cut yet, or in part; their ids stand one after the other."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.held: list[tuple] = []  # doc_id, ids left, sentence ends in them, ids before them
        self.n = 0

    def add(self, doc_id, ids: np.ndarray, stops: np.ndarray) -> None:
        self.held.append((doc_id, ids, stops, 0))
        self.n += len(ids)

    def cut(self, last: bool):
        """Pieces that are settled; last: all."""
        if not self.held:
            return
        sizes = np.array([len(x[1]) for x in self.held], np.int64)
        doc_ends = np.cumsum(sizes)
        begin = doc_ends - sizes
        stops = np.concatenate([x[2] + b for x, b in zip(self.held, begin, strict=True)])
        choices = possible_cuts(doc_ends, stops, self.window)
        if last:
            cuts = choose_cuts(*choices, self.window)
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + close_tail(before, int(doc_ends[-1]), self.window)
        else:
            cuts = settled_cuts(*choices, self.window)
        if not cuts:
            return
        end = cuts[-1]
        cuts = np.array(cuts, np.int64)
        edges = _merged(cuts, doc_ends[doc_ends < end])  # each piece ends at a cut or its document's end
        starts = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        offset = starts - np.concatenate([[0], cuts])[seq]
        for s, e, d, q, o in zip(starts.tolist(), edges.tolist(), doc.tolist(), seq.tolist(), offset.tolist(), strict=True):
            doc_id, ids, _, gone = self.held[d]
            b = int(begin[d])
            yield doc_id, gone + s - b, e - s, ids[s - b : e - b].tobytes(), gone + len(ids), self.sequence + q, o
        self.sequence += len(cuts)
        first = int(np.searchsorted(doc_ends, end, side="right"))
        left = self.held[first:]
        if left:
            doc_id, ids, stops, gone = left[0]
            used = end - int(begin[first])
            left[0] = (doc_id, ids[used:], stops[stops > used] - used, gone + used)
        self.held, self.n = left, int(doc_ends[-1]) - end


def _pack(path: str, window: int, held_ids: int):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batch_iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        stream, most = _Stream(window, TaskContext.get().partitionId() << 40), held_ids

        def sent(last):
            for rows in batches(stream.cut(last), lambda r: r[2], BATCH_IDS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for row in _encoded(batch_iterator, path):
            stream.add(*row)
            if stream.n >= most:
                yield from sent(False)
                most = max(held_ids, 2 * stream.n)  # where little could be settled, more has to come
        yield from sent(True)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", window: int = WINDOW, held_ids: int = HELD_IDS) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, 32-bit little-endian), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then END_ID; null text: END_ID alone. Documents are dealt in order of
    doc_id (null ids first, rows with the same id in the order of the input) in stretches of about equally many rows,
    one for each partition, so neither gaps in ids nor rows with the same id or without one make a stretch long; a
    task packs its stretch as a stream and holds what isn't settled yet, held_ids and one document or so.
    Sequences end on a power of two or are to be padded to `window`; a sequence's id is its stretch's number times
    2 ** 40 and its own. Other columns aren't read. An empty table gives no rows. Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"), F.monotonically_increasing_id().alias("nth"))
    dealt = rows.repartitionByRange(input_parallelism(docs), "doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    return dealt.select("doc_id", "text").mapInArrow(tidy(_pack(tokenizer_path, window, held_ids), tokenizes=True), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
