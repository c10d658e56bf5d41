import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, jaccard, sharding
from loomgraph.llm.common import ship_package


def brute_components(rows, words=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "short"), [(1024, 128), (16, 4), (8, 1)])
def test_jaccard_against_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    ship_package(spark)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(20)]
    base = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(50)] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(rng.choice(vocab[:3]) for _ in range(rng.randint(0, 17)))) for k in range(150)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "A b"), (404, "a\tB"), (405, "É b"), (406, "é b"), (7, rows[7][1]), (407, "one " * 3000)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, class string").repartition(3)
    got = jaccard.jaccard_components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_long_list_beside_short_one(spark, monkeypatch):
    """x meets the head of the long lists in a short list of the same part, too, but links to another member only."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
    ship_package(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = [f"t{k}" for k in range(600)]
    names = [names[k] for k in np.argsort(np.concatenate(jaccard.shingle_sets(names, 1)))]  # in order of lists
    low, rest = names[:7], iter(names[10:])
    long, tail = [low[0], *low[4:]], [next(rest) for _ in range(550)]
    x_m = tail[-33:]
    texts = [[*long, low[1], *tail[:34]], [*low, *x_m], [*names[7:10], *long, *x_m]] + [[*long, *tail[50 + 36 * k : 86 + 36 * k]] for k in range(8)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute_components(rows, words=1)
    assert [c for _, _, c in want] == [0, 1, 1, *range(3, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert sorted(tuple(r) for r in jaccard.jaccard_components(df, words=1).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jaccard_parts():
    for n in range(1, 12):
        sizes = {c for c, _ in jaccard.subsets(np.arange(n, dtype=np.uint64), 85)}
        assert sizes == set(range(-(-85 * n // 100), n + 1))
    assert jaccard.light_size({}) == 0 and 0 <= jaccard.light_size({5: 100, 12: 10}) <= jaccard.LIGHT_MOST
    v = np.unique(np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert (jaccard._from_deltas(jaccard._deltas(v)) == v).all()
    a = np.array([[True, False, True, False], [False, True, False, False], [True, False, True, True]])
    assert len(jaccard.spanning_links(a)) == 2


def test_components(spark):
    node = lambda k: k.to_bytes(16, "big")
    edges = [(k, k + 1) for k in range(200)] + [(300, 301), (301, 299)]
    df = spark.createDataFrame([(node(a), node(b)) for a, b in edges], "a binary, b binary").repartition(7)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in jaccard.components(df, "t").collect()}
    assert got == {k: 0 for k in range(201)} | dict.fromkeys((299, 300, 301), 299)


def test_components_end_with_stars_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1, raising=False)  # a bound on rounds would leave parts
    node = lambda k: k.to_bytes(16, "big")
    order = np.random.default_rng(3).permutation(400).tolist()
    df = spark.createDataFrame([(node(a), node(b)) for a, b in zip(order, order[1:], strict=False)], "a binary, b binary").repartition(40)
    assert {(int.from_bytes(r.node, "big"), int.from_bytes(r.comp, "big")) for r in jaccard.components(df, "t").collect()} == {(k, 0) for k in range(400)}


def check_shards(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    by = {h: sorted(r.slot for r in got if r.shard == h) for h in range(shards)}
    assert all(s == list(range(len(s))) for s in by.values())
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)


def test_sharding(spark):
    rows = [(k, f"text {k // 3 if k < 60 else k}") for k in range(150)] + [(200 + k, "hot") for k in range(70)] + [(300, None), (301, None), (302, ""), (5, "text 1"), (5, "text 1"), (None, "x")]
    df = spark.createDataFrame([(d, t, "g") for d, t in rows], "doc_id long, text string, shard string").repartition(3)
    got = sharding.shard_rows(df, shards=8).collect()
    check_shards(rows, got, 8)
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    groups = [zlib.crc32(f"text {k}".encode()) for k in range(20)]
    assert all(len(where[g]) == 1 for g in groups) and len(where[zlib.crc32(b"hot")]) < 8
    assert sharding.shard_rows(df.limit(0)).count() == 0
    every = [(k, "same") for k in range(41)]
    check_shards(every, sharding.shard_rows(spark.createDataFrame(every, "doc_id long, text string"), shards=8).collect(), 8)
    few = [(1, "a"), (2, "a")]
    check_shards(few, sharding.shard_rows(spark.createDataFrame(few, "doc_id long, text string")).collect(), 40)


def propagate_by_hand(state, quota, rounds):
    """One move after the other: each group's strays ask for its home, the best asker first, as long as there is room."""
    state = {k: n for k, n in state.items()}
    for _ in range(rounds):
        free = {h: max(0, q - sum(n for (_, s), n in state.items() if s == h)) for h, q in enumerate(quota)}
        asks = []
        for g in {g for g, _ in state}:
            mine = sorted(((-n, s) for (x, s), n in state.items() if x == g))
            home, gain = mine[0][1], -mine[0][0]
            asks += [(-gain, g, s, home, -n) for n, s in mine[1:]]
        moved = 0
        for _, g, s, home, n in sorted(asks):
            go = min(n, free[home])
            free[home] -= go
            moved += go
            state[g, s] -= go
            state[g, home] += go
        state = {k: n for k, n in state.items() if n}
        if not moved:
            break
    return state


def test_propagation_against_sequential(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 1)  # one part of each shard's askers: the order is theirs alone
    rng = random.Random(9)
    state = {}
    for g in range(40):
        for s in rng.sample(range(5), rng.randint(1, 4)):
            state[g, s] = rng.randint(1, 6)
    quota = sharding.targets(sum(state.values()) + 20, 5)
    df = spark.createDataFrame([(g, s, n) for (g, s), n in state.items()], "g long, shard int, n long")
    got = {(r.g, r.shard): r.n for r in sharding.propagate(df, quota, 3).collect()}
    assert got == propagate_by_hand(state, quota, 3)


def test_hot_groups_and_cut_links(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"text {k // 6}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = None
    for hot in (512, 10):
        monkeypatch.setattr(sharding, "HOT_ROWS", hot)
        got = sharding.shard_rows(df, shards=8)
        check_shards(rows, got.collect(), 8)
        cut = sharding.cut_links(got).first()
        assert cut.links == 599 + 150 and 4 <= cut.cut < 200  # without slack few moves fit
        placed = sorted((r.doc_id, r.shard, r.slot) for r in got.collect())
        want = want or placed
        assert placed == want


def test_numbering(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") < 400, 0).otherwise(F.col("id")))
    got = sharding.numbered(df, ["k"], [F.col("id")], "n", parts=8).collect()
    assert sorted(r.n for r in got if r.k == 0) == list(range(400)) and all(r.n == 0 for r in got if r.k)


def test_ann_recall_and_ties(spark):
    ship_package(spark)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[100:160] = x[40]  # ties
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [None] + [1.0] * 23), (9080, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("c")).repartition(4)
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20)) and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        s = x @ x[q]
        assert np.allclose(part.score, s[part.vec_id]) and list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert [(-a, b) for a, b in zip(part.score.round(12), part.vec_id, strict=True)] == sorted((-a, b) for a, b in zip(part.score.round(12), part.vec_id, strict=True))
        s[q] = -np.inf
        hits += len(set(part.vec_id) & set(np.lexsort((np.arange(3000), -s))[:20]))
    assert hits / (20 * 150) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest_neighbours(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    some = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(40)], "vec_id long, embedding array<double>")
    all_of = ann.nearest_neighbours(some, F.col("vec_id") % 20 == 0, k=60).toPandas()
    assert (all_of.groupby("query_id").size() == 39).all() and len(all_of) == 78
    assert ann.nearest_neighbours(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest_neighbours(few.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def brute_neighbours(rows, k, asked):
    """Exact neighbours of rows (id, vector), ties to the smaller id."""
    out = []
    for q, v in rows:
        if asked(q):
            best = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_ann_equal_ragged_and_repeated_vectors(spark):
    """Vectors that are equal by the hundred, of other lengths, and of ids that repeat."""
    ship_package(spark)
    rng = np.random.default_rng(6)
    kinds = rng.integers(-3, 4, size=(6, 4)).astype(float) + 0.5
    rows = [(k, kinds[0 if k < 200 else k % 6].tolist()) for k in range(320)]
    odd = [(1000, [1.0, 2.0]), (1020, [1.0] * 5), (40, [9.0, 9.0, 9.0, 9.0]), (40, rows[40][1]), (2000, [-0.0, 0.5, 0.5, 0.5]), (2001, [0.0, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    keep = dict(rows) | {2000: odd[-2][1], 2001: odd[-1][1]}
    keep[40] = min(rows[40][1], odd[2][1])
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    want = brute_neighbours(sorted(keep.items()), 20, lambda q: q % 20 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(500)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(same, F.col("vec_id") % 100 == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(q, n + 1, [i for i in range(5) if i != q][n]) for q in range(0, 500, 100) for n in range(3)]


def test_ann_many_cells(spark):
    x = np.random.default_rng(1).normal(size=(9000, 8)).astype(np.float32)
    c = ann._kmeans(x, 1100, 3, np.random.default_rng(2))
    assert 1000 <= len(c) <= 1200 and np.isfinite(c).all()
    index = ann.fit(x, 9000)
    assert index.least_scores(x[:5], 21).shape == (5,) and all((x @ x[k] >= index.least_scores(x[k : k + 1], 21)[0]).sum() >= 21 for k in range(5))
    assert np.allclose(ann.exact_scores(x[:9], x[9:18]), (x[:9].astype(float) * x[9:18]).sum(1))


def test_sketches_never_rule_out_a_link():
    """Bits that differ are at most the shingles that one set alone has, whatever the sizes."""
    rng = np.random.default_rng(8)
    for n, m in ((5, 6), (500, 520), (500, 900), (3000, 3300)):
        for shared in (0, min(n, m) // 2, min(n, m)):
            pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
            raw = [np.frombuffer(jaccard.sketch(x), "<u8").reshape(1, -1) for x in (a, b)]
            width = min(r.shape[1] for r in raw)
            differ = int(np.bitwise_count(jaccard._folded(raw[0], width) ^ jaccard._folded(raw[1], width)).sum())
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_ann_finds_the_nearest_of_very_long_and_very_short_vectors(spark):
    rng = np.random.default_rng(5)
    for size in (1e25, 1e-25):
        x = (rng.normal(size=(3000, 16)) * size).astype(np.float32)
        df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
        got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).toPandas()
        hits = 0
        for q, of in got.groupby("query_id"):
            true = x.astype(np.float64) @ x[q].astype(np.float64)
            true[q] = -np.inf
            hits += len(set(of["vec_id"]) & set(np.argsort(-true)[:20].tolist()))
        assert hits >= 0.9 * 20 * 30
