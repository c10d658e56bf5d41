"""Spelling variants, best-fit packing and centroid clustering against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import best_fit, clustering, spelling
from loomgraph.llm.common import materialize, scratch, share, ship_package
from loomgraph.llm.packing import vocabulary


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(rows, slip=199):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        near = sorted((-n[x], x) for x in n if one_edit(w, x))
        best = near[0] if near and -near[0][0] >= 5 * n[w] else None
        form[w] = best and best[1]
        out[w] = (n[w], len(near), best and -best[0])
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (form[w], r, *out[w])
    return out


def texts_with_slips(rng):
    base = ["wonder", "wander", "wonders", "mississippi", "Étaient", "étaient", "letter", "better", "aaaaaa", "aaaaaaa", "naïvely", "longestword" * 3, "unrelated"]
    rows = []
    for k in range(60):
        words = []
        for w in base:
            for _ in range(rng.randint(1, 12)):
                v, x = list(w), rng.random()
                if x < 0.15:
                    v[rng.randrange(len(v))] = rng.choice("abcé")
                elif x < 0.25:
                    del v[rng.randrange(len(v))]
                elif x < 0.35:
                    v.insert(rng.randrange(len(v) + 1), rng.choice("abzÿ"))
                words.append("".join(v))
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", ", ", "中", "\n", "_"]).join(words)))
    return [*rows, (None, "wonder " * 7), (60, None), (61, ""), (62, "x ×÷ 1234 \U0001d400"), (5, rows[5][1]), (63, "Wonder" * 5000), (64, ("wanter " * 40_000) + "wonder")]


@pytest.mark.parametrize("most_pairs", [1 << 20, 6, 0])
def test_spelling_against_brute_force(spark, monkeypatch, most_pairs):
    """most_pairs 6 and 0: keys are cut on several times, down to a single open place."""
    ship_package(spark)
    monkeypatch.setattr(spelling, "SLICE", 1000)
    rows = texts_with_slips(random.Random(4))
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(docs, most_pairs=most_pairs).collect()}
    assert got == brute_variants(rows) and any(f and r != f for f, r, *_ in got.values())
    assert spelling.group_variants(docs.limit(0), most_pairs=most_pairs).count() == 0


def test_spelling_slips(spark):
    """Code points go by the hash of document and lower-cased word; many documents, so that some do."""
    ship_package(spark)
    rows = [(k, "Slipping Étourdi") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(docs, slip=19).collect()}
    assert got == brute_variants(rows, slip=19) and len(got) > 8


def optimum(items, c):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, c - items[i]])

    go(0, [])
    return best[0]


def total(patterns):
    out = Counter()
    for group, times in patterns:
        for s in group:
            out[s] += times
    return out


def test_reduction_keeps_the_optimum():
    rng, fixed_sets = random.Random(3), Counter()
    for t in range(1200):
        c = rng.choice([7, 10, 12, 20, 30])
        items = [rng.randint(max(1, c // 5) if t % 3 else 1, c) for _ in range(rng.randint(0, 10))]
        counts = [items.count(s) for s in range(c + 1)]
        fixed, left = best_fit.reduce_instance(counts, c)
        rest = [s for s, n in enumerate(left) for _ in range(n)]
        assert all(sum(g) <= c for g in fixed) and total(fixed.items()) + Counter(rest) == Counter(items)
        assert sum(fixed.values()) + optimum(rest, c) == optimum(items, c)
        fixed_sets.update(len(g) for g in fixed)
        patterns, n_fixed = best_fit.plan(counts, c)
        assert total(patterns) == Counter(items) and n_fixed == sum(fixed.values()) and all(sum(g) <= c for g, _ in patterns)
    assert set(fixed_sets) >= {1, 2, 3}


def test_equal_pieces_are_fixed_together():
    """The steps depend on sizes: a billion pieces of each take no longer, and give what copies of a small instance give."""
    small = [0, 3, 0, 9, 5, 8, 7, 2, 0, 6, 4]
    many = [n * 10**9 for n in small]
    fixed, left = best_fit.reduce_instance(many, 10)
    assert total(fixed.items()) + Counter({s: n for s, n in enumerate(left) if n}) == Counter({s: n for s, n in enumerate(many) if n})
    patterns, _ = best_fit.plan(many, 10)
    assert sum(n for _, n in patterns) <= -(-sum(s * n for s, n in enumerate(many)) // 10) * 1.05 and len(patterns) < 60


def test_best_fit_takes_the_fullest():
    counts = [0] * 11
    counts[6], counts[3], counts[5], counts[2] = 1, 1, 1, 2
    got = Counter(best_fit.best_fit(counts, 10))
    assert got == {(6, 3): 1, (5, 2, 2): 1}


def test_best_fit_packing(spark):
    ship_package(spark)
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["one", "two  three", "été", "x\ny", "don't", "<|endoftext|>"]) for _ in range(rng.randint(0, 120)))) for k in range(200)]
    rows += [(None, "no id"), (None, None), (7, rows[7][1]), (300, ""), (301, "word " * 30_000), (302, " \n\t ")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, number int, task int").repartition(3)
    got = best_fit.pack_best_fit(docs, path, window=64).toPandas()
    known = Tokenizer.from_file(path)
    want = Counter((d, bytes(np.array([*known.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))) for d, t in rows)
    held = got.sort_values(["sequence_id", "offset"])
    assert (held.groupby("sequence_id").length.cumsum() - held.length == held.offset).all() and held.groupby("sequence_id").length.sum().max() <= 64
    assert sorted(held.sequence_id.unique()) == list(range(held.sequence_id.nunique()))
    one = got[~got.doc_id.isin([7]) & got.doc_id.notna()].sort_values(["doc_id", "piece"])
    assert {(int(d), b"".join(p.ids)) for d, p in one.groupby("doc_id")} == {k for k in want if k[0] not in (None, 7)}
    assert all((p.length[1:] == 64).all() and list(p.piece) == list(range(len(p))) and list(p.start) == [0, *p.length.cumsum()[:-1]] for _, p in one.groupby("doc_id"))
    assert got.length.sum() == sum(len(b) // 4 * n for (_, b), n in want.items()) and len(got[got.doc_id.isna()]) == 2
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2
    assert best_fit.pack_best_fit(docs.limit(0), path).count() == 0


def plain_clusters(rows, k, rounds):
    kept = [(i, tuple(int(np.floor(np.float64(256) * np.float64(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    ordered = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in ordered[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), c


@pytest.mark.parametrize(("k", "coarse"), [(9, False), (9, True), (1, True), (500, True)])
def test_clusters_against_all_distances(spark, k, coarse):
    """coarse: components of few values, so that distances tie and vectors repeat."""
    ship_package(spark)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(160, 64)) + np.repeat(rng.normal(size=(8, 64)) * 2, 20, 0)
    v = np.round(v) / 64 if coarse else v
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [*[0.5] * 63, None]), (904, [*[0.5] * 63, float("nan")]), (905, [*[0.5] * 63, float("inf")]), (906, [-0.0] * 64), (907, rows[3][1])]
    table = spark.createDataFrame([(i, x, 1, 1.0) for i, x in rows], "vec_id long, embedding array<float>, cluster int, upper double").repartition(3)
    found, centroids = clustering.cluster(table, k=k, rounds=4)
    want, c = plain_clusters(rows, k, 4)
    assert Counter(map(tuple, found.collect())) == want and [tuple(x) for x in centroids.tolist()] == c
    assert clustering.cluster(table.limit(0))[0].count() == 0


def test_exponion_compares_few():
    rng = np.random.default_rng(3)
    middle = rng.integers(-3000, 3000, (40, 64))
    v = np.repeat(middle, 50, 0) + rng.integers(-40, 40, (2000, 64))
    first = clustering.Exponion(middle)
    cluster, upper, lower, n = first.assign(v, np.full(2000, -1), np.zeros(2000), np.zeros(2000))
    assert n == 2000 * 40 and (cluster == np.repeat(np.arange(40), 50)).all()
    new = middle + rng.integers(-9, 9, middle.shape)
    moved = np.sqrt(((new - middle) ** 2).sum(1).astype(float)) * (1 + clustering.SLACK)
    again, upper, lower, n = clustering.Exponion(new, moved).assign(v, cluster, upper, lower)
    d = ((v[:, None] - new[None]) ** 2).sum(2)
    assert (again == d.argmin(1)).all() and n < 2000 and (upper >= np.sqrt(d.min(1))).all()
    # Vectors between centroids: bounds don't settle them, balls hold few.
    v = rng.integers(-200, 200, (500, 64))
    near = clustering.Exponion(rng.integers(-200, 200, (40, 64)))
    c, u, lo, _ = near.assign(v, np.full(500, -1), np.zeros(500), np.zeros(500))
    d = np.sqrt(((v[:, None] - near.c[None]) ** 2).sum(2))
    assert (c == d.argmin(1)).all() and (lo <= np.sort(d, 1)[:, 1]).all()


def test_clustering_query_against_sql(spark):
    ship_package(spark)
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(clustering.SQL).df()
    got = clustering.query(spark, "/root/testdata/sf0.001").toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(got.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_runs_own_what_they_make(spark):
    """Two runs side by side: the end of one takes nothing from the other, nor from tables outside of runs."""
    outside = materialize(spark.range(3), "t")
    with scratch(spark) as a:
        mine = materialize(spark.range(5), "t")
        with scratch(spark):
            inner = materialize(spark.range(7), "t")
            value = share(spark, [1])
            assert inner.count() == 7 and value.value == [1]
        assert mine.count() == 5 and len(a.tables) == 1
        with pytest.raises(Exception, match="(?i)path|file"):
            spark.read.parquet(inner.inputFiles()[0]).count()
    with pytest.raises(Exception, match="(?i)path|file"):
        mine.select(F.sum("id")).collect()
    assert outside.count() == 3
