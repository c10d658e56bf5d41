"""Chat formatting with a grammar round trip.

Grammar of the rendered text (any text of Unicode characters can stand as a body):

    conversation := turn*
    turn         := "<s>" role mark "\n" body "</s>"
    mark         := ""   the role and body stand as they are
                  | "&"  in both, & < [ and newlines of the role are written as entities

The text is first rendered with no turn escaped, reparsed and compared with the source; where they differ or a
body holds a control string, the conflicting turns are escaped and the round trip is made anew; where that is not
enough, all turns are. Built-in expressions only; one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_starts, substrings

#: Fixed: strings that must not stand unescaped inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ENCODE = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_DECODE = "replace(replace(replace({x}, '&#91;', '['), '&lt;', '<'), '&amp;', '&')"
_ENCODE_ROLE = f"replace({_ENCODE}, '\\n', '&#10;')"
_DECODE_ROLE = _DECODE.format(x="replace({x}, '&#10;', '\\n')")


def _parse(column: str) -> str:
    """Expression for array<struct<role,text>> recovered from a rendered text; null where it is no conversation."""
    part = f"slice(split({column}, '</s>', -1), 1, greatest(size(split({column}, '</s>', -1)) - 1, 0))"
    head = "substring(p, 4, instr(p, '\\n') - 4)"
    body = "substring(p, instr(p, '\\n') + 1)"
    role = f"if(endswith({head}, '&'), {_DECODE_ROLE.format(x=f'substring({head}, 1, length({head}) - 1)')}, {head})"
    text = f"if(endswith({head}, '&'), {_DECODE.format(x=body)}, {body})"
    turns = f"transform({part}, p -> if(startswith(p, '<s>') and instr(p, '\\n') > 0, struct({role} as role, {text} as text), null))"
    return f"if({column} = '' or endswith({column}, '</s>'), {turns}, null)"


def _render(escaped: str) -> str:
    """Expression for array<string> of rendered turns; escaped: a condition on the turn x."""
    raw = "concat('<s>', x.role, '\\n', x.text, '</s>')"
    safe = f"concat('<s>', {_ENCODE_ROLE.format(x='x.role')}, '&\\n', {_ENCODE.format(x='x.text')}, '</s>')"
    return f"transform(turns, x -> if({escaped}, {safe}, {raw}))"


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted (string), level (0: nothing escaped, 1: conflicting turns,
    2: all), turns (array of role and text as reparsed from `formatted`), loss_mask (array of start and length in
    code points of `formatted`, one for each turn of train_role) and round_trip (boolean: `turns` equal the source).

    Turns are ordered by turn, role, text, nulls first, and repeated rows are kept. Null roles and texts count as
    empty; a row without conv_id is a conversation of its own; other columns are dropped. An empty table gives no rows.
    A conversation's turns meet in one row: its size is that of one training example.
    """
    own = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    df = rows.withColumn("own__", own).groupBy(F.col(conv_id).alias("conv_id"), "own__").agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("rows"))
    df = df.select("conv_id", F.expr("transform(rows, x -> struct(x.role as role, x.text as text))").alias("turns"))
    odd = " or ".join(f"instr(x.text, '{c}') > 0 or instr(x.role, '{c}') > 0" for c in CONTROL) + " or instr(x.role, '\\n') > 0 or endswith(x.role, '&')"
    df = df.withColumn("conflicts", F.expr(f"exists(turns, x -> {odd})"))
    df = df.withColumn("pieces0", F.expr(_render("false"))).withColumn("out0", F.expr("array_join(pieces0, '')"))
    df = df.withColumn("ok0", F.expr(f"not conflicts and ({_parse('out0')}) <=> turns"))
    df = df.withColumn("pieces1", F.expr(f"if(ok0, pieces0, {_render(odd)})")).withColumn("out1", F.expr("array_join(pieces1, '')"))
    df = df.withColumn("ok1", F.expr(f"ok0 or ({_parse('out1')}) <=> turns"))
    df = df.withColumn("pieces", F.expr(f"if(ok1, pieces1, {_render('true')})")).withColumn("formatted", F.expr("array_join(pieces, '')"))
    df = df.withColumn("level", F.expr("if(ok0, 0, if(ok1, 1, 2))")).withColumn("back", F.expr(_parse("formatted")))
    df = df.withColumn("starts", F.expr(running_starts("transform(pieces, p -> length(p))")))
    mask = f"filter(transform(pieces, (p, i) -> if(back[i].role = '{train_role}', struct(starts[i] + instr(p, '\\n') as start, length(p) - instr(p, '\\n') - 4 as length, endswith(substring_index(p, '\\n', 1), '&') as escaped), null)), m -> m is not null)"
    df = df.withColumn("loss_mask", F.expr(mask)).withColumn("round_trip", F.expr("back <=> turns"))
    return df.select("conv_id", "formatted", "level", F.col("back").alias("turns"), "loss_mask", "round_trip")


def masked_text() -> str:
    """Expression for the unescaped text that `loss_mask` marks in `formatted`."""
    pieces = substrings("formatted", "loss_mask")
    return f"array_join(transform({pieces}, (p, i) -> if(loss_mask[i].escaped, {_DECODE.format(x='p')}, p)), '')"


def query(spark, sf_dir: str) -> DataFrame:
    """All of conversations, and conversation -1, whose two turns are control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_chats(rows.unionByName(extra)).withColumn("loss", F.expr(masked_text()))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ODD = " OR ".join(f"contains(text, '{c}') OR contains(role, '{c}')" for c in CONTROL) + " OR contains(role, chr(10)) OR role LIKE '%&'"
SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, ({_ODD}) AS odd, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS safe,
   replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS safe_role FROM r)
SELECT conv_id, count(*) AS n_turns,
   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
   CAST(sum(CASE WHEN odd THEN length(safe_role) + 1 + length(safe) ELSE length(role) + length(text) END + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
