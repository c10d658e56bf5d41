"""Language ID by n-gram filters of language bitmasks.

A bit-sliced Bloom filter maps each character n-gram to a mask of all languages that use it: a slot holds a bit per
language, and the AND of an n-gram's slots is the answer for all languages at once. A text's language is the one
whose bit is set for the largest share of its n-grams, after the share that chance alone sets is taken off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, share, tidy
from .tokens import batches, pieces

#: Lengths of n-grams, in code points; a blank stands for what surrounds a word.
LENGTHS = (3, 4)
#: Slots of the filter and probes of each n-gram. The filter takes a byte a slot up to 8 languages, 8 bytes for each 64
#: beyond, whatever the corpus.
SLOTS, PROBES = 1 << 21, 3
#: The filter is fitted on about so many labelled documents of each language (a bound; texts are read whole).
FIT_DOCS = 4000
#: An n-gram is put in for a language where it is at least this often as frequent there as where it is most frequent.
SHARE = 0.25
#: ... and where it was met so often.
LEAST_COUNT = 3
#: Languages of one word of a mask; there are as many words as it takes.
WORD_BITS = 64
#: Code points that are worked on at once; a longer text is taken in parts of as many.
SLICE = 400_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: is it a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams within words, blanks at either end included; the text each is of; which texts have letters."""
    low = [t.lower() for t in texts]
    raw = "\x00" + "\x00\x00".join(low) + "\x00"
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in low], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = letters()[code]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters stays, as a blank
    keep[0] = True
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    found, of = [], []
    for n in LENGTHS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = (h ^ code[k : k + m]) * _MIX[0]
            h ^= h >> np.uint64(29)
        ok = letter[1 : 1 + m].copy()  # blanks only at the ends
        for k in range(2, n - 1):
            ok &= letter[k : k + m]
        found.append(h[ok])
        of.append(owner[1 : 1 + m][ok])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    return np.concatenate(found), np.concatenate(of), has


def slots(h: np.ndarray, probe: int, n_slots: int = SLOTS) -> np.ndarray:
    x = h * _MIX[probe]
    return ((x ^ (x >> np.uint64(32))) & np.uint64(n_slots - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # words, slots
    chance: np.ndarray  # by language: how often a gram that isn't its own has its bit

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language or und, score, margin to the second) of each."""
        if not self.languages or not texts:
            return [("und", 0.0, 0.0)] * len(texts)
        cut, owner = [], []
        for k, t in enumerate(texts):
            for p in pieces(t or "", SLICE):
                cut.append(p)
                owner.append(k)
        h, of, has_piece = grams(cut)
        of = np.array(owner, np.int64)[of]
        has = np.zeros(len(texts), bool)
        has[np.array(owner, np.int64)[has_piece]] = True
        at = [slots(h, probe, self.masks.shape[1]) for probe in range(PROBES)]
        mask = []
        for word in self.masks:
            m = word[at[0]]
            for place in at[1:]:
                m &= word[place]
            mask.append(m)
        total = np.bincount(of, minlength=len(texts))
        share = np.zeros((len(self.languages), len(texts)))
        kind = self.masks.dtype.type
        for k in range(len(self.languages)):
            hit = np.bincount(of[(mask[k // WORD_BITS] >> kind(k % WORD_BITS)) & kind(1) == 1], minlength=len(texts))
            share[k] = np.clip((hit / np.maximum(total, 1) - self.chance[k]) / (1 - self.chance[k]), 0, 1)
        best = share.argmax(0)
        top = share.max(0)
        second = np.partition(share, -2, 0)[-2] if len(self.languages) > 1 else np.zeros(len(texts))
        return [(self.languages[b], float(s), float(s - z)) if ok else ("und", 0.0, 0.0) for b, s, z, ok in zip(best, top, second, has, strict=True)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _count_grams(batch_iterator):
    import pyarrow as pa

    for batch in batch_iterator:
        rows = [(lang, p) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) for p in pieces(text, SLICE)]
        for part in batches(rows, lambda r: len(r[1]) + 2, SLICE):
            names = sorted({r[0] for r in part})
            h, of, _ = grams([r[1] for r in part])
            lang = np.array([names.index(r[0]) for r in part], np.int64)[of]
            for k, name in enumerate(names):
                gram, n = np.unique(h[lang == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> LanguageFilter:
    """From rows with a language and a text; a text counts once for a language, however often it repeats. Of languages with
    more than fit_docs rows, the texts whose hashes are lowest are taken, fit_docs at most in expectation. Any number of
    languages; the driver gets counts by language and at
    most SLOTS masks. An empty table, or one without languages, gives a filter that answers `und`."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    names = sorted(counts)
    words = max(1, -(-len(names) // WORD_BITS))
    kind = np.uint8 if len(names) <= 8 else np.uint64
    if not names:
        return LanguageFilter([], np.zeros((1, SLOTS), kind), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, float(min(1.0, fit_docs / counts[k])))])
    sample = known.filter((F.pmod(F.xxhash64(text), F.lit(1 << 20)) / F.lit(1 << 20)) < share[F.col(lang)])
    once = sample.groupBy(F.col(lang).alias("lang"), F.xxhash64(F.lit(1), text).alias("h")).agg(F.first(text).alias("text"))
    counted = once.select("lang", "text").mapInArrow(tidy(_count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "langid-grams")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    place = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    total = F.create_map(*[F.lit(x) for k in names for x in (k, float(max(1, totals.get(k, 0))))])
    uses = counted.select("gram", F.struct(place[F.col("lang")].alias("i"), "n", (F.col("n") / total[F.col("lang")]).alias("rate")).alias("x"))
    own = F.expr(let("array_max(transform(uses, y -> y.rate))", "top", f"filter(uses, x -> x.n >= {LEAST_COUNT} and x.rate >= {SHARE}D * top)"))
    # An entry for each language that uses the n-gram, at most; set bits by word.
    owned = uses.groupBy("gram").agg(F.collect_list("x").alias("uses")).select("gram", own.alias("own")).filter(F.size("own") > 0)
    mask = F.expr(f"transform(sequence(0, {words - 1}), w -> aggregate(filter(own, x -> x.i div {WORD_BITS} = w), 0L, (s, x) -> s | shiftleft(1L, x.i % {WORD_BITS})))")

    def places(batch_iterator):
        import pyarrow as pa

        for batch in batch_iterator:
            gram = batch["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            m = batch["mask"].flatten().to_numpy(zero_copy_only=False).reshape(-1, words)
            where = np.concatenate([slots(gram, p) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(where), *[pa.array(np.tile(m[:, w], PROBES)) for w in range(words)]], names=["slot", *[f"m{w}" for w in range(words)]])

    cols = [f"m{w}" for w in range(words)]
    placed = owned.select("gram", mask.alias("mask")).mapInArrow(places, "slot long, " + ", ".join(f"{c} long" for c in cols))
    rows = placed.groupBy("slot").agg(*[F.bit_or(c).alias(c) for c in cols]).toArrow()
    masks = np.zeros((words, SLOTS), kind)
    for w, c in enumerate(cols):
        masks[w, rows["slot"].to_numpy()] = rows[c].to_numpy().view(np.uint64).astype(kind)
    chance = np.array([((masks[i // WORD_BITS] >> kind(i % WORD_BITS)) & kind(1)).mean() ** PROBES for i in range(len(names))])
    return LanguageFilter(names, masks, chance)


def _predict(model):
    def run(batch_iterator):
        import pyarrow as pa

        known = model.value
        for batch in batch_iterator:
            at = 0
            for part in batches(batch["text"].to_pylist(), lambda t: len(t or "") + 2, SLICE):
                found = known.predict(part)
                cols = [pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.slice(at, len(part)).columns, strict=True)], *cols], names=[*batch.schema.names, "lang_pred", "score", "margin"])
                at += len(part)

    return run


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep` with text, lang_pred (a learned language; und for null texts and those without a
    letter, and where nothing was learned), score (0 to 1) and margin. Nothing but text is looked at. Languages that
    tie: the first in order. Rows stay as they are, repeated ones too; an empty table gives no rows."""
    shared = share(docs.sparkSession, model)
    rows = docs.select(*keep, F.col(text).alias("text"))
    return rows.mapInArrow(tidy(_predict(shared)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double, margin double")


def fit_split(docs: DataFrame) -> LanguageFilter:
    """From the rows that aren't held out."""
    return fit(docs.filter(~held_out()))


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit_split(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")
