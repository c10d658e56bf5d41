"""Context for many questions at once: of each question's texts, by priority, as many as its budget holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import CONTEXT_CHARS


def fill_budgets(texts: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(question, context, labels, left) of texts (question, place, label, text, run).

    Texts are taken in order of place (ties: label, text). One that is larger than what is left is left out, and smaller
    ones after it may still fit; but of a run of texts (run not null) the first that doesn't fit ends the run. Null and
    empty texts are passed over. A question without any text that fits has an empty context. left: code points.

    What fits depends on what was left out before, so each question's texts, which are few, are folded in order: one
    shuffle by question and one aggregate of built-in functions.
    """
    sizes = texts.filter("length(text) > 0").select("question", F.struct("place", "label", "text", "run").alias("t"))
    ordered = sizes.groupBy("question").agg(F.array_sort(F.collect_list("t")).alias("texts"))
    step = f"""aggregate(texts, struct({budget} as left, cast(array() as array<string>) as ended, cast(array() as array<int>) as taken, 0 as k), (s, t) -> struct(
      if(array_contains(s.ended, coalesce(t.run, '')) or length(t.text) > s.left, s.left, s.left - length(t.text)) as left,
      if(t.run is not null and not array_contains(s.ended, t.run) and length(t.text) > s.left, array_append(s.ended, t.run), s.ended) as ended,
      if(array_contains(s.ended, coalesce(t.run, '')) or length(t.text) > s.left, s.taken, array_append(s.taken, s.k)) as taken,
      s.k + 1 as k))"""
    done = ordered.withColumn("s", F.expr(step)).withColumn("own", F.expr("transform(s.taken, k -> texts[k])"))
    out = done.select("question", F.expr("array_join(transform(own, t -> t.text), '\\n')").alias("context"), F.expr("transform(own, t -> t.label)").alias("labels"), F.col("s.left").alias("left"))
    empty = texts.select("question").distinct().join(ordered.select("question"), "question", "left_anti")
    none = F.array().cast("array<string>")
    return out.unionByName(empty.select("question", F.lit("").alias("context"), none.alias("labels"), F.lit(budget).alias("left")))
