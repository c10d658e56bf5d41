"""Table functions, packs of files, and snapshots compared by trees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.extract import tables
from loomgraph.operators import glossary, incremental


def test_extractors_of_a_callers_own(spark):
    def shout(content, path):
        if "bad" in content:
            raise ValueError("unreadable")
        return {"functions": [{"name": w, "line_start": k} for k, w in enumerate(content.split())], "loud": [{"word": w.upper(), "n": len(w)} for w in content.split()]}

    tables.register(spark, [tables.Extractor("words", shout, {"loud": "word string, n int"})])
    rows = [("a", "words", "one three"), ("b", "words", "bad"), ("c", "words", None), ("d", "python", "def f(x):\n    g(x)\n"), ("e", "python", "def broken(:\n"), ("f", None, "x")]
    spark.createDataFrame(rows, "path string, language string, content string").createOrReplaceTempView("own_files")
    ask = lambda kind: spark.sql(f"SELECT f.path, x.* FROM own_files f, LATERAL extract_facts(f.path, f.language, f.content, '{kind}') x")
    assert ask("loud").columns == ["path", "word", "n"] and sorted(map(tuple, ask("loud").collect())) == [("a", "ONE", 3), ("a", "THREE", 5)]
    assert sorted((r.path, r.name, r.line_start, r.parent_class) for r in ask("functions").collect() if r.path in "ad") == [("a", "one", 0, None), ("a", "three", 1, None), ("d", "f", 1, None)]
    assert [(r.path, r.callee_name) for r in ask("calls").filter("path = 'd'").collect()] == [("d", "g")]
    with pytest.raises(Exception, match="kind is one of"):
        ask("nonsense").collect()


def test_packs_are_read_from_files(spark, tmp_path):
    files = {"trade.json": {"domain": "trade", "terms": [{"source_term": "sku", "target_phrase": "article", "usage_count": 3}, {"source_term": None, "target_phrase": "x"}, {"source_term": "dup", "target_phrase": "first"}]},
             "plain.json": {"terms": [{"source_term": "sku", "target_phrase": "by name of file"}]}, "general.json": {"domain": "general", "terms": [{"source_term": "sku", "target_phrase": "general"}, {"source_term": "api", "target_phrase": "door", "confidence": 0.5}]}, "odd.json": [1, 2], "none.json": {"domain": "none"}}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "notes.txt").write_text("{}")
    packs = glossary.read_packs(spark, str(tmp_path))
    assert sorted((r["pack"], r["source_term"], r["target_phrase"]) for r in packs.collect()) == [("general", "api", "door"), ("general", "sku", "general"), ("plain", "sku", "by name of file"), ("trade", "dup", "first"), ("trade", "sku", "article")]
    own = packs.filter("false").drop("pack")
    say = lambda d: {r["source_term"]: r["target_phrase"] for r in glossary.resolve(glossary.packed_layers(own, packs, d)).collect()}
    assert say("trade") == {"sku": "article", "dup": "first", "api": "door"} and say(None) == say("general") == {"sku": "general", "api": "door"}


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_find_what_changed(spark, seed):
    rng = random.Random(seed)
    paths = sorted({"/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + f"/f{k}.py" for k in range(60)} | {"top.py"})
    old = {p.strip("/"): rng.choice("xyz") for p in paths}
    new = dict(old)
    for p in rng.sample(sorted(old), 4):
        new[p] = "changed"
    for p in rng.sample(sorted(old), 2):
        new.pop(p, None)
    new["deep/er/still/new.py"] = "n"
    make = lambda d: spark.createDataFrame([(p, h) for p, h in d.items()], "path string, sha256 string")
    a, b = make(old), make(new)
    got, dirs = incremental.changes_by_tree(a, b, incremental.hash_tree(a), incremental.hash_tree(b))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.changes(a, b).collect()))
    every = incremental.hash_tree(a).count()
    assert 0 < dirs.count() <= every + 3 and incremental.hash_tree(a).filter("dir = ''").first()["n"] == len(old)
    same, none = incremental.changes_by_tree(a, a, incremental.hash_tree(a), incremental.hash_tree(a))
    assert same.count() == 0 and none.count() == 0
    gone, _ = incremental.changes_by_tree(a, a.limit(0), incremental.hash_tree(a), incremental.hash_tree(a.limit(0)))
    assert gone.filter(F.col("change") == "removed").count() == len(old)
