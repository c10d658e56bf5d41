"""What the fourth review found in the training-data operators."""

import random
from collections import Counter

import numpy as np

from loomgraph.llm import jaccard


def test_rare_shingles_first(spark):
    """a set enters no list of a shingle that a few others have, while it has enough that no other has; how common
    shingles are is never told too low."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    passages = [" ".join(word() for _ in range(12)) for _ in range(6)]
    texts = [" ".join([word() for _ in range(30)] + [passages[k % 6]]) for k in range(60)]
    texts += [t + " " + word() for t in texts[:5]]  # near copies: all but one of their shingles are another's
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    corpus = jaccard.corpus_shingles(docs, 4, 3)
    sets = jaccard.shingle_sets(texts, 4)
    met = Counter(np.concatenate(sets).tolist())
    for s in sets:
        assert (jaccard.levels_of(s, corpus) >= np.log2([met[x] for x in s.tolist()]).astype(int)).all()
    heads = [jaccard._prefix(s, corpus, 85) for s in sets]
    assert all(len(h) == 0 for h in heads[5:60])
    assert all(set(heads[k].tolist()) & set(heads[60 + k].tolist()) for k in range(5))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: k - 60 if k >= 60 else k for k in range(65)}
