"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas.

Documents link when their texts are equal. A group's documents differ only by id, so what moves is a count: the
state is (group, shard, documents of it there). Each round groups look where most of their documents are and ask
to move the rest there; a shard takes as many as its quota of documents leaves. Then whoever has no links fills the
shards up, so counts differ by one at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
#: A group is hot beyond so many rows, or beyond this share of all: so hot groups are at most 1 / HOT_SHARE.
HOT_ROWS, HOT_SHARE = 512, 1e-4
#: Parts that each shard's or group's documents are dealt to when they are numbered.
PARTS = 64


def numbered(df: DataFrame, key: list[str], order: list, name: str, parts: int = PARTS, spread: Column | None = None) -> DataFrame:
    """df with a number from 0, gapless in each key. Each key's rows are numbered in `parts` parts, so no task holds
    a whole key; the parts' sizes (a small table: keys times parts at most) give where each begins. A key with one
    row needs no more than its own row."""
    spread = spread if spread is not None else F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    dealt = df.withColumn("__part", spread)
    sizes = dealt.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sizes.select(*key, "__part", before.alias("__begin"))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*key, "__part").orderBy(*order)) - 1)
    return own.join(begin, [*key, "__part"]).withColumn(name, (F.col("__own") + F.col("__begin")).cast("long")).drop("__part", "__own", "__begin")


def targets(n: int, shards: int) -> list[int]:
    return [n // shards + (h < n % shards) for h in range(shards)]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def propagate(state: DataFrame, quota: list[int], rounds: int | None = None) -> DataFrame:
    """state (g, shard, n) when nothing moves any more, or after `rounds` rounds; no shard takes in more than its quota
    leaves. It ends: a group's homes only gain, so each round leaves fewer documents away from home."""
    shards = len(quota)
    at_home = Window.partitionBy("g").orderBy(F.desc("n"), "shard")
    for _ in count() if rounds is None else range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        free = [max(0, quota[h] - load.get(h, 0)) for h in range(shards)]
        # A group's home is where most of it is; one larger than a shard has as many homes as it fills, filled in order.
        ranked = state.withColumn("rank", F.row_number().over(at_home)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
        homes = F.ceil(F.col("all") / F.lit(max(1, min(quota)))).cast("int")
        room = F.when(homes > 1, F.greatest(F.element_at(_array(quota), F.col("shard") + 1) - F.col("n"), F.lit(0)))
        home = ranked.filter(F.col("rank") <= homes).withColumn("room", room)
        upto = F.sum("room").over(Window.partitionBy("g").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        home = home.select("g", F.col("shard").alias("to"), F.coalesce(upto - F.col("room"), F.lit(0)).alias("lo"), F.coalesce(upto, F.lit(1 << 62)).alias("hi"), F.col("n").alias("gain"))
        away = ranked.filter(F.col("rank") > homes)
        end = F.sum("n").over(Window.partitionBy("g").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        away = away.select("g", "shard", "n", end.alias("end"))
        # One row for each group, home and shard that it would leave: shards squared for a group at most.
        want = away.join(home, (away["g"] == home["g"]) & (away["end"] > home["lo"]) & (away["end"] - away["n"] < home["hi"])).select(away["g"], "shard", "to", (F.least("end", "hi") - F.greatest(F.col("end") - F.col("n"), F.col("lo"))).alias("ask"), "gain")
        order = [F.desc("gain"), F.col("g"), F.col("shard")]
        part = F.pmod(F.xxhash64("g"), F.lit(PARTS)).cast("int")
        sums = want.withColumn("part", part)
        before = sums.groupBy("to", "part").agg(F.sum("ask").alias("asked"))
        before = before.select("to", "part", F.coalesce(F.sum("asked").over(Window.partitionBy("to").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
        running = F.coalesce(F.sum("ask").over(Window.partitionBy("to", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        granted = sums.withColumn("own", running).join(before, ["to", "part"])
        left = F.element_at(_array(free), F.col("to") + 1) - F.col("begin") - F.col("own")
        granted = materialize(granted.withColumn("go", F.least(F.col("ask"), F.greatest(left, F.lit(0)))).filter("go > 0").select("g", "shard", "to", "go"), "shard-moves")
        moved = granted.agg(F.sum("go")).first()[0] or 0
        if not moved:
            break
        change = state.unionByName(granted.select("g", "shard", (-F.col("go")).alias("n"))).unionByName(granted.select("g", F.col("to").alias("shard"), F.col("go").alias("n")))
        state = materialize(change.groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-state")
    return state


def _by_group(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with table's columns by g (left). Hot groups' entries, at most 1 / HOT_SHARE, go to all tasks, so their rows
    stay where they are; only the others are dealt by g."""
    few = F.broadcast(table.join(F.broadcast(hot), "g", "left_semi").withColumn("__hot", F.lit(True)))
    met = rows.join(few, "g", "left")
    cold = met.filter("__hot is null").select(*rows.columns).join(table, "g", "left")
    return met.filter("__hot").select(*cold.columns).unionByName(cold)


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: links (a group's documents less one, summed) and cut (groups' shards less one, summed): how many links
    between documents of equal text lead to another shard, in the least way of joining them."""
    by = sharded.filter("size > 16").groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n")).groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.count("*").alias("shards"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("shards") - 1), F.lit(0)).alias("cut"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`: counts of shards are at most one apart), shard, slot, grown_shard (null).

    Null texts link with nothing, size 16, crc32 0; empty texts are equal texts. Ids may be null or repeat: rows
    alike in id and text are interchangeable. Other columns aren't read. An empty table gives no rows. Texts aren't
    shuffled: their hashes are, and of hot groups not even these before they are numbered in parts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.col(text))).alias("g")), "shard-rows")
    groups = materialize(rows.filter("g is not null").groupBy("g").agg(F.count("*").alias("members")).filter("members > 1"), "shard-groups")
    quota = targets(rows.count(), shards)
    hot = groups.filter(F.col("members") > max(HOT_ROWS, int(rows.count() * HOT_SHARE))).select("g")
    marked = materialize(_by_group(rows, groups, hot), "shard-marked")
    linked = materialize(numbered(marked.filter("members is not null"), ["g"], [F.col("doc_id")], "k"), "shard-linked")
    first = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")
    state = propagate(materialize(linked.withColumn("shard", first).groupBy("g", "shard").agg(F.count("*").alias("n")), "shard-state"), quota, rounds)

    # What a shard holds over its quota goes to the pool of documents that fill shards up.
    part = F.pmod(F.xxhash64("g"), F.lit(PARTS)).cast("int")
    cut = state.withColumn("part", part)
    begin = cut.groupBy("shard", "part").agg(F.sum("n").alias("s")).select("shard", "part", F.coalesce(F.sum("s").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "part").orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("own", own).join(begin, ["shard", "part"])
    stay = F.least(F.col("n"), F.greatest(F.element_at(_array(quota), F.col("shard") + 1) - F.col("begin") - F.col("own"), F.lit(0)))
    settled = materialize(cut.select("g", "shard", stay.alias("n")).filter("n > 0"), "shard-settled")
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    steps = settled.select("g", "shard", upto.alias("upto")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("steps"))  # a step per shard at most
    placed = _by_group(linked, materialize(steps, "shard-steps"), hot).withColumn("shard", F.expr("get(filter(steps, s -> s.upto > k), 0).shard")).select("doc_id", "size", "text_crc32", "shard")
    single = marked.filter("members is null").select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("shard"))
    both = materialize(placed.unionByName(single), "shard-placed")

    held = {r["shard"]: r["n"] for r in both.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    gaps, total = [], 0
    for h in range(shards):
        total += quota[h] - held.get(h, 0)
        gaps.append(total)
    pool = numbered(both.filter("shard is null").drop("shard").withColumn("one", F.lit(0)), ["one"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "k", parts=1024).drop("one")
    fill = F.size(F.filter(_array(gaps), lambda x: x <= F.col("k"))).cast("int")
    out = both.filter("shard is not null").unionByName(pool.withColumn("shard", fill).drop("k"))
    out = numbered(materialize(out, "shard-out"), ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
