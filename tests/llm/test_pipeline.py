import numpy as np
import pytest
from pyspark.sql import functions as F

from test_set_operators import brute_components

from loomgraph.llm import packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the thing with other then there that from where".split(), "fr": "les choses avec leur autre où été dans pour".split()}
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "fr"
        rows.append((k, "menu of site\n" + " ".join(rng.choice(words[lang], 80)) + ".", lang, "s1"))
    rows += [(100, rows[3][1] + " extra", "en", "s1"), (101, rows[3][1], "en", "s1"), (102, None, "en", "s1"), (103, "12345", "en", "s1"), (104, "the thing token=abcdefgh12 there " + " ".join(rng.choice(words["en"], 80)), None, "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_by_one(spark):
    docs = make(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    first = corpus_pipeline.language(spark, docs, "").cache()
    assert first.columns == COLUMNS and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - {102, 103}
    assert first.filter("doc_id = 104").first().lang == "en"
    second = corpus_pipeline.lines(spark, first, "").cache()
    assert second.columns == COLUMNS and second.count() == first.count() and not [r for r in second.collect() if "menu of site" in r.text] and all(r.n_chars == len(r.text) for r in second.collect())
    third = corpus_pipeline.near_duplicates(spark, second.unionByName(second.filter("doc_id = 7")), "").cache()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(r.doc_id for r in third.collect()) == sorted({c for _, _, c in brute_components(rows)}) and third.columns == COLUMNS
    assert not {100, 101} & {r.doc_id for r in third.collect()}
    fourth = corpus_pipeline.redact(spark, third, "").cache()
    assert fourth.columns == COLUMNS and "the thing [SECRET] there" in fourth.filter("doc_id = 104").first().text
    assert fourth.filter("doc_id != 104").exceptAll(third.filter("doc_id != 104")).count() == 0
    last = corpus_pipeline.pack(spark, fourth, "")
    assert last.groupBy("doc_id").agg(F.sum("length") == F.first("doc_tokens")).count() == fourth.count()


def test_near_duplicates_take_five_words_and_80_percent(spark):
    def copy(k, n, more=0, cut=0):
        words = [f"w{k}x{j}" for j in range(n)]
        return " ".join(words[: n - cut] + [f"m{k}x{j}" for j in range(more)])

    rows = []
    for k, (more, cut) in enumerate([(20, 0), (24, 0), (27, 0), (0, 17), (0, 19), (0, 24), (0, 0)]):
        rows += [(2 * k, copy(k, 100)), (2 * k + 1, copy(k, 100, more, cut))]
    want = sorted({c for _, _, c in brute_components(rows, words=5, percent=80)})
    assert want == [0, 2, 4, 5, 6, 8, 10, 11, 12] and len({c for _, _, c in brute_components(rows)}) == 13
    docs = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_near_duplicates_null_and_repeated_ids(spark):
    def text(k, more=""):
        return " ".join(f"w{k}x{j}" for j in range(60)) + more

    rows = [(1, text(1)), (None, text(1)), (None, text(1, " end")), (None, text(2)), (None, text(2)), (None, text(2, " end")), (None, text(3)), (5, text(1, " more")), (5, text(4)), (6, text(5)), (6, text(5)), (6, text(6)), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    two = [r for r in got if r[1].startswith("w2x")]
    assert len(two) == 1 and two[0] in {(None, text(2)), (None, text(2, " end"))}
    assert sorted(got, key=str) == sorted([(1, text(1)), *two, (None, text(3)), (5, text(4)), (6, text(5)), (6, text(6)), (None, "")], key=str)


def test_run_equals_its_stages(spark, tmp_path):
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= packing.WINDOW).all() and not {100, 101, 102, 103} & set(got.doc_id)
    empty = tmp_path / "empty"
    make(spark).limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


CLASHING = ("gone_id", "gone_key", "__gone_id", "key", "comp", "place", "stays", "lang_pred", "score", "margin", "line", "host", "__host", "__rules", "__left", "n_lines", "n_dropped", "piece", "start", "length", "ids", "n", "class", "text_key", "__t", "__d", "linked", "nth", "last")


def odd_rows(spark):
    """Nulls in each column, empties, repeats, ties, a very long text."""
    rng = np.random.default_rng(5)
    words = "the thing with other then there that from where".split()
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, f"shared head\n{say(60)} token=abcdefgh{k}x there.\n{say(20)}", "en", "s1") for k in range(12)]
    rows += [(k, say(70), None, None) for k in range(20, 26)] + [(None, say(50), "en", "s1"), (None, None, None, None), (30, "", "en", "s1"), (31, None, "en", None), (3, rows[3][1], "en", "s1"), (3, say(40), "en", "s2"), (40, (say(9) + " \n") * 6000 + "secret=0123456789abcdef", "en", "s1")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_each_stage_with_odd_rows_and_clashing_columns(spark, stage):
    docs = odd_rows(spark)
    run = lambda df: stage(spark, df, "")
    shown = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))  # noqa: E731  which sequence is free
    plain = run(docs)
    more = docs
    for name in CLASHING:
        more = more.withColumn(name, F.lit("x"))
    clashing = run(more)
    assert clashing.columns == plain.columns and (stage is corpus_pipeline.pack or plain.columns == COLUMNS)
    assert shown(clashing) == shown(plain) and plain.count() > 0
    empty = run(docs.limit(0))
    assert empty.columns == plain.columns and empty.count() == 0
    if stage in (corpus_pipeline.lines, corpus_pipeline.redact):
        assert plain.count() == docs.count() and plain.filter("text is null").count() == 2
    if stage is corpus_pipeline.redact:
        assert plain.filter("doc_id = 40").first().text.endswith("[SECRET]") and not plain.filter("text like '%token=%'").count()
    if stage is corpus_pipeline.pack:
        assert plain.filter("doc_id = 40").agg(F.sum("length")).first()[0] == plain.filter("doc_id = 40").first().doc_tokens > 6000


def brute_pipeline(rows):
    """What stays of rows (doc_id, text, source), step by step and in plain Python, up to packing; all are in a known language."""
    hosts = {}
    for _, _, s in rows:
        hosts[s] = hosts.get(s, 0) + 1
    on = {}
    for k, (_, t, s) in enumerate(rows):
        for line in t.split("\n"):
            on.setdefault((s, line.strip(" \t\r")), set()).add(k)
    drop = {key for key, ks in on.items() if key[1] and len(ks) >= 5 and len(ks) > 0.2 * hosts[key[0]]}
    rows = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in drop)) for d, t, s in rows]
    stays = {c for _, _, c in brute_components(rows, words=5, percent=80)}
    return {d: t.replace("token=abcdefgh12", "[SECRET]") for d, t in rows if d in stays}


def test_whole_run_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = "the thing with other then there that from where which about their would these could after".split()
    base = [(k, "menu of site\n" + " ".join(rng.choice(words, 90)) + (" token=abcdefgh12 end." if k % 5 == 0 else "."), f"s{k % 2}") for k in range(50)]
    rows = base + [(100 + k, base[k][1].replace(".", " more."), "s0") for k in range(0, 20, 3)] + [(200, base[7][1], "s1")]
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    want = {d: [*known.encode(t, add_special_tokens=False).ids, packing.END_ID] for d, t in brute_pipeline(rows).items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas().sort_values(["doc_id", "start"])
    assert {d: np.frombuffer(b"".join(p.ids), "<u4").tolist() for d, p in got.groupby("doc_id")} == want and len(want) < len(rows)
    assert (got.groupby("sequence_id").length.sum() <= packing.WINDOW).all()
