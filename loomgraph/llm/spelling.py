"""Spelling variants by an even-partition pigeonhole join.

Of two words one edit apart, the shorter one (or the lesser of equally long ones) is cut into two even segments. The
edit touches one of them at most, so the other one stands in the longer word: at its own place if it's the first, and
shifted by the difference of the lengths if it's the second. Words are indexed by both segments; a word probes the
indexes of its own length and of one less with its substrings at those places. Candidates are verified by one edit.

A segment that too many words share is cut on: what it leaves open of the word is halved in turn, and the edit again
spares one half, which joins the segment. So no key stays frequent, and no word is left out: in the end all but one
place of a word is its key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread, tidy

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A code point of a word goes where its hash with the document's id is divisible by this.
SLIP = 199
#: Pairs that one key may have compared; keys with more are cut on.
MOST_PAIRS = 1 << 20
#: Up to so many frequent keys are sent to all tasks; with more, rows are joined with them.
BROADCAST_KEYS = 100_000
#: Words that a task counts before it passes them on, and code points of a text that it looks at at once.
HELD_WORDS, SLICE = 400_000, 1 << 20

#: Fixed: letters are A to Z, a to z and U+00C0 to U+00FF; A to Z are lower-cased, all else is a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")


def _slices(text: str):
    """Very long texts come in parts that end with a word."""
    at = 0
    while len(text) - at > SLICE and (m := _NO_LETTER.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def slipped(doc_id, run: bytes, slip: int = SLIP) -> bytes:
    """run, lower-cased, in Latin-1, without a code point where its hash says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, slip: int):
    def run(batch_iterator):
        import pyarrow as pa

        def out(counts: Counter):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in batch_iterator:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                begin, crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32
                for part in _slices(text or ""):
                    words = part.encode("latin-1", "replace").translate(_LETTERS).split()
                    for w, n in Counter(words).items():
                        if len(w) >= least:
                            if crc(w if w.isascii() else w.decode("latin-1").encode(), begin) % slip:
                                total[w] += n
                            elif len(w) > least:
                                total[slipped(doc_id, w, slip)] += n
                if len(total) > HELD_WORDS:
                    yield out(total)
                    total = Counter()
        yield out(total)

    return run


def count_words(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): distinct results of at least so many code points and occurrences over all documents."""
    rows = spread(docs.select("doc_id", F.col(text).alias("text")))
    counted = rows.mapInArrow(tidy(_counted(least_length, slip)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


#: Rows of the join: a word in a role. An index row (more = 0, probe false) stands for its own length; a probe row looks
#: among words of `size` code points, `more` fewer than its own. All of it but [a, b) of the shorter word is its key.
_ROLES = "inline(filter(array(struct(false as probe, 0 as more, w as size), struct(true as probe, 0 as more, w as size), struct(true as probe, 1 as more, w - 1 as size)), x -> x.size >= {least}))"
_HALVES = "inline(array(struct((a + b) div 2 as a2, b as b2), struct(a as a2, (a + b) div 2 as b2)))"
_KEY = "xxhash64(size, a, b, substring(word, 1, a), substring(word, b + more + 1))"


def _halved(rows: DataFrame) -> DataFrame:
    halves = rows.selectExpr("word", "n", "probe", "more", "size", "a", "b", _HALVES)
    known = halves.selectExpr("word", "n", "probe", "more", "size", "cast(a2 as int) as a", "cast(b2 as int) as b")
    return known.withColumn("key", F.expr(_KEY))


def _verified(rows: DataFrame) -> DataFrame:
    """(x, y, n_x, n_y) of rows that share a key and are one edit apart; x is the shorter or lesser one."""
    index = rows.filter("not probe").select("key", F.col("word").alias("x"), F.col("n").alias("n_x"))
    probe = rows.filter("probe").select(F.col("key").alias("k"), F.col("word").alias("y"), F.col("n").alias("n_y"), "more")
    near = (index["key"] == probe["k"]) & ((F.col("more") == 1) | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1)
    return index.join(probe, near).select("x", "y", "n_x", "n_y")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(x, y, n_x, n_y): all pairs of words (distinct, of at least so many code points) one edit apart, each once."""
    roles = words.withColumn("w", F.length("word")).selectExpr("word", "n", _ROLES.format(least=least_length))
    rows = _halved(roles.selectExpr("word", "n", "probe", "more", "size", "0 as a", "size as b"))
    found = None
    while True:
        rows = materialize(rows, "spelling-keys")
        open_ = F.col("b") - F.col("a") > 1  # fewer places open: a key has as many words as there are letters
        sizes = rows.filter(open_).groupBy("key").agg(F.count_if(~F.col("probe")).alias("i"), F.count_if("probe").alias("p"))
        frequent = materialize(sizes.filter(F.col("i") * F.col("p") > most_pairs).select("key"), "spelling-frequent")
        n = frequent.count()
        side = F.broadcast(frequent) if n <= BROADCAST_KEYS else frequent
        now = _verified(rows.filter(~open_).unionByName(rows.filter(open_).join(side, "key", "left_anti").select(*rows.columns)) if n else rows)
        found = now if found is None else found.unionByName(now)
        if not n:
            return found.distinct()  # both segments may have been spared
        rows = _halved(rows.filter(open_).join(side, "key", "left_semi").drop("key"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where each word's forms end. Each round doubles how far a word has looked; forms are
    several times as frequent as their words, so ways are short and have no cycles."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        state = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return state


def group_variants(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with its most frequent near word (ties: the least in code-point
    order) if that is at least `ratio` times as frequent, and where following forms ends.

    Texts are read whole, very long ones in parts that end with a word. Null and empty texts have no words. A null doc_id
    is hashed as an empty one; repeated ids and rows count each time. A table without words gives no rows. Other columns
    aren't read. Counts of a task's words are shuffled, never texts.
    """
    words = materialize(count_words(docs, text, least_length, least_count, slip), "spelling-words")
    pairs = near_words(words, least_length, most_pairs)
    ways = "inline(array(struct(x as word, n_x as n, struct(-n_y as n, y as w) as near), struct(y as word, n_y as n, struct(-n_x as n, x as w) as near)))"
    both = pairs.selectExpr(ways)
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    high = -F.col("near.n") >= ratio * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(high, F.col("near.w")).alias("form"), F.when(high, -F.col("near.n")).alias("form_n")), "spelling-near")
    ends = roots(best.filter("form is not null"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
