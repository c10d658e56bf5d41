"""Text functions on documents, part names and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming, text
from ..operators import search
from . import facts as f
from .bind_graph import flat

QUESTION = "'where is the ' || replace(p_name, ' ', '_') || ' of ' || p_brand || 'HandlerForUser'"


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def keywords(spark, d):
    """Of questions about each part."""
    p = _parts(spark, d)
    return flat(p.select("p_partkey", text.keywords(F.expr(QUESTION)).alias("keywords")), "keywords")


_STOP = "[" + ", ".join("'" + w + "'" for w in text.STOP_WORDS) + "]"


def _keywords_sql(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '" + text.TOKEN_GAP.replace("'", "''") + "', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    parts = f"list_transform(regexp_split_to_array({spaced}, '[ _]'), lambda t: lower(t))"
    kept = f"list_filter({parts}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def document_keywords(spark, d):
    """How often each keyword stands in how many documents."""
    k = _documents(spark, d).select(F.explode(text.keywords(F.coalesce("text", F.lit("")))).alias("keyword"))
    return k.groupBy("keyword").agg(F.count("*").alias("documents"))


def _modules(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return f.facts(spark, d, f.MODULES).join(s.select(F.col("s_suppkey").alias("ord"), "s_name"), "ord").select("name", F.lower("s_name").alias("body"), F.lit("订单管理模块").alias("title"), "ord")


def module_search(spark, d):
    return search.match_modules(_modules(spark, d), "sup1 订单管理 supplier", 5).select("name", "score", "ord")


_M = f"SELECT m.name, lower(s_name) AS body, '订单管理模块' AS title, m.ord FROM ({f.for_sql(f.MODULES)}) m JOIN supplier ON s_suppkey = m.ord"
_T = "name || ' ' || body || ' ' || title"
_WORDS = ("sup1", "订单管理", "supplier")
_RUNS = ("订单管理", "订单", "单管", "管理")
_MSCORE = " + ".join([f"CASE WHEN contains(lower(name), '{w}') THEN 3.0 WHEN contains(lower({_T}), '{w}') THEN 1.0 ELSE 0.0 END" for w in _WORDS] + [f"CASE WHEN contains(name, '{w}') THEN 4.0 WHEN contains({_T}, '{w}') THEN 2.0 ELSE 0.0 END" for w in _RUNS] + ["CASE WHEN " + " OR ".join(f"contains(lower({_T}), '{w}')" for w in ("sup1 订单管理 supplier", *_WORDS)) + " THEN 0.5 ELSE 0.0 END"])


def business_names(spark, d):
    p = _parts(spark, d)
    path = F.concat(F.lit("src/"), F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("p_partkey") % len(_SEGMENTS) + 1).cast("int")))
    return naming.business_names(p.select("p_partkey", path.alias("path"))).select("p_partkey", "name", "verb")


_SEGMENTS = ("auth", "user_cache", "my_orders", "zzqx", "loggers", "payment_api", "h5k", "xx_billing_yy", "Config")


def _either(x: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{k}') OR contains('{k}', {x}) THEN '{v}'" for k, v in table.items()) + " END"


def _exact(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_SEG = "lower([" + ", ".join(f"'{s}'" for s in _SEGMENTS) + f"][p_partkey % {len(_SEGMENTS)} + 1])"
BUSINESS = f"SELECT p_partkey, coalesce({_exact(_SEG, naming.SEGMENTS)}, {_either(_SEG, naming.SEGMENTS)}, {_SEG}) AS name, coalesce({_exact(_SEG, naming.CONNECTIONS)}, {_either(_SEG, naming.CONNECTIONS)}, '调用') AS verb FROM part"


def function_explanations(spark, d):
    p = _parts(spark, d)
    name = F.concat(F.element_at(F.array(*map(F.lit, _VERBS)), (F.col("p_partkey") % len(_VERBS) + 1).cast("int")), F.lit("_users"))
    none = F.lit(None).cast("string")
    told = naming.function_explanation(name, F.array(F.lit("a"), F.lit("b")), F.lit("int"), none)
    return p.select("p_partkey", told.alias("told"), naming.plain_description(told).alias("plain"), naming.flow_name(name).alias("flow"))


#: All known verbs, and one that isn't.
_VERBS = (*naming.VERBS, "odd")
_V = "[" + ", ".join(f"'{v}'" for v in _VERBS) + f"][p_partkey % {len(_VERBS)} + 1]"
_ACT = f"coalesce({_exact(_V, naming.VERBS)}, '处理')"
_FLOW = f"coalesce('用户管理' || {_exact(_V, naming.FLOW_VERBS)} || '流程', {_V} || '_users流程')"
EXPLAIN = f"SELECT p_partkey, {_ACT} || ' 用户管理，参数为 a, b，返回 int' AS told, {_ACT} || ' 用户管理' AS plain, {_FLOW} AS flow FROM part"


def module_descriptions(spark, d):
    p = _parts(spark, d).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("lines"))
    return p.select("p_brand", naming.module_description(F.lower("p_brand"), F.array(F.lit("get_a"), F.lit("save_b"), F.lit("get_c")), F.col("n") % 3, F.col("n"), F.col("lines")).alias("description"))


DESCRIBE = "SELECT p_brand, lower(p_brand) || '模块，提供获取/保存等功能' || CASE WHEN count(*) % 3 > 0 THEN '，包含 ' || count(*) % 3 || ' 个类' ELSE '' END || '，共 ' || count(*) || ' 个文件、' || CAST(sum(p_size) AS BIGINT) || ' 行代码。' AS description FROM part GROUP BY 1"


def json_extract(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" it is")))
    return e.select("event_id", text.json_from_text(wrapped).alias("json"))


def content_hashes(spark, d):
    t = _documents(spark, d)
    return t.select("doc_id", text.content_hash(F.col("text")).alias("sha256"), text.line_count(F.col("text")).alias("lines"), text.repo_key(F.concat(F.lit("https://host/"), "source")).alias("repo_key"))


HASHES = "SELECT doc_id, coalesce(sha256(text), '') AS sha256, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines, left(sha256('https://host/' || source), 16) AS repo_key FROM documents"


def scalar_texts(spark, d):
    p = _parts(spark, d)
    url = F.concat(F.lit("https://host/team/"), F.lower("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ".git").otherwise("/"))
    return p.select("p_partkey", text.project_name(url).alias("project"), text.slug(F.col("p_name")).alias("slug"), text.html_escape(F.concat(F.lit("<b>"), "p_name", F.lit("</b> & 'x'"))).alias("escaped"), text.fill_template(F.lit("{name}: {size} {other}"), {"name": F.col("p_name"), "size": F.col("p_size").cast("string")}).alias("filled"), text.numbered(F.concat("p_name", F.lit("\n"), "p_brand"), 9).alias("numbered"))


SCALARS = """SELECT p_partkey, lower(p_brand) AS project, trim(regexp_replace(lower(p_name), '[^a-z0-9一-鿿]+', '-', 'g'), '-') AS slug,
 '&lt;b&gt;' || replace(p_name, '&', '&amp;') || '&lt;/b&gt; &amp; &#x27;x&#x27;' AS escaped, p_name || ': ' || p_size || ' {other}' AS filled,
 '   9 | ' || p_name || chr(10) || '  10 | ' || p_brand AS numbered FROM part"""

QUERIES = {
    "keywords": (keywords, f"SELECT p_partkey, array_to_string(k, ',') AS keywords FROM (SELECT p_partkey, {_keywords_sql(QUESTION)} AS k FROM part) q"),
    "document_keywords": (document_keywords, f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '{text.TOKEN_GAP.replace("'", "''")}', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[ _]')) AS w FROM documents),
      u AS (SELECT DISTINCT doc_id, lower(w) AS keyword FROM t WHERE length(w) >= 2) SELECT keyword, count(*) AS documents FROM u WHERE NOT list_contains({_STOP}, keyword) GROUP BY 1"""),
    "module_search": (module_search, f"SELECT name, CAST({_MSCORE} AS DOUBLE) AS score, ord FROM ({_M}) m ORDER BY score DESC, ord LIMIT 5"),
    "business_names": (business_names, BUSINESS),
    "function_explanations": (function_explanations, EXPLAIN),
    "module_descriptions": (module_descriptions, DESCRIBE),
    "json_extract": (json_extract, "SELECT event_id, trim(props) AS json FROM events"),
    "content_hashes": (content_hashes, HASHES),
    "scalar_texts": (scalar_texts, SCALARS),
}
