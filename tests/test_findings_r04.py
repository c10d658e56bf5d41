"""What the fourth review found."""

import random

import pyarrow as pa

import pytest

from loomgraph.operators import flows, render, triples
from loomgraph.plans import bind_graph, bind_more

SF = "/root/testdata/sf0.001"


def test_paths_through_are_all_that_meet(spark):
    """of all simple paths none that has one of the nodes is left out, whether it ends early or goes in circles."""
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(34)} | {(20, 3), (3, 21), (21, 20), (22, 22)})
    edges = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "src long, dst long")
    entries = spark.createDataFrame([(0,), (1,), (2,), (20,), (20,), (22,)], "node_id long")
    for depth in (1, 2, 4):
        every = [r["path"] for r in flows.simple_paths(entries.distinct(), edges, depth).collect()]
        assert any(len(p) <= depth for p in every) or depth == 1
        for through in ([5, 9], [0, 20], [13], [99]):
            got = [r["path"] for r in flows.paths_through(entries, edges, spark.createDataFrame([(x,) for x in through], "node_id long"), depth).collect()]
            assert sorted(got) == sorted(p for p in every if set(p) & set(through))


def test_branches_of_all_calls(spark):
    """branch_flows lists paths over calls that aren't in the slice, backward ones too."""
    known = {(r["src"], r["dst"]) for r in bind_graph.sparse_edges(spark, SF).collect()}
    number = {r["node_id"]: r["ord"] for r in bind_graph.nodes(spark, SF).collect()}
    paths = [r["path"].split(">") for r in bind_more.branch_flows(spark, SF).limit(2000).collect()]
    steps = {x for p in paths for x in zip(p, p[1:], strict=False)}
    assert len(paths) == 2000 and steps - known and any(number[a] > number[b] for a, b in steps)


def test_picture_is_one_text_only(spark):
    """no aggregation gathers a picture's texts; its task goes through them in order, and holds the text that they become."""
    lines = [(p, f"k{a:03}", f"x{b}", f"{p}:{a}:{b}é") for p in (1, 0) for a in range(60) for b in range(4)] + [(0, "nothing", "", None)]
    rows = spark.createDataFrame(lines, "part int, k1 string, k2 string, line string").repartition(7)
    got = render.joined(rows, "head")
    assert got.collect() == [("\n".join(["head", *(x[3] for x in sorted(x for x in lines if x[3]))]),)] and got.columns == ["mermaid"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[]" not in plan and "MapInArrow" in plan and "Sort [part" in plan
    assert [r[0] for r in render.joined(rows.limit(0)).collect()] == ["graph TD"]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in (["a", "é"], [], [None, "c", ""])]
    assert next(render._whole(batches))["mermaid"].to_pylist() == ["aéc"]


@pytest.mark.parametrize("most", [256, 1])
def test_few_words_need_no_lists(spark, monkeypatch, most):
    """few different words are looked for in the texts; lists are made for more, and give the same."""
    monkeypatch.setattr(triples, "FEW_WORDS", most)
    docs = spark.createDataFrame([(1, "No Way"), (2, "way out"), (3, None), (4, "nothing"), (4, "nothing")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, [["no", "out"], ["way"], ["way", None, "gone"]][q % 3]) for q in range(7)], "question long, words array<string>")
    made = []
    got = triples.matches(lambda: made.append(1) or triples.index(docs, "doc_id", "text"), docs, "doc_id", "text", asked)
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q in range(7) for d in ((1, 2) if q % 3 else (1, 2, 4)))
    assert len(made) == (most == 1)
