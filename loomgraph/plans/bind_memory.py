"""Logs and glossaries on conversations: a conversation's user turns are questions about the module conv_id % 40."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TOPIC_STOP_WORDS
from ..operators import glossary, memory

_LOG = """SELECT 'mod' || CAST({c}.conv_id % 40 AS STRING) AS module_name, CASE WHEN turn % 4 = 0 THEN 'diagnosis' ELSE 'qa' END AS kind, text AS query,
  text AS summary, CAST((conv_id % 10) AS DOUBLE) / 10 AS confidence, conv_id * 1000 + turn AS ord FROM {c} WHERE role = 'user'"""


def log(spark, d):
    return spark.sql(_LOG.replace("{c}.", "").replace("{c}", "{conversations}"), conversations=spark.read.parquet(f"{d}/conversations.parquet"))


L = _LOG.replace("{c}.", "").replace("{c}", "conversations")
_TOPIC_STOP = "[" + ", ".join(f"'{w}'" for w in TOPIC_STOP_WORDS) + "]"
_TOPICS = f"SELECT module_name, query, trim(w, '.,!?;:') AS topic FROM (SELECT module_name, query, unnest(regexp_split_to_array(lower(query), '\\s+')) AS w FROM ({L}) l) q WHERE NOT list_contains({_TOPIC_STOP}, w) AND length(trim(w, '.,!?;:')) >= 3"
HOTSPOTS = f"SELECT t.module_name, topic, count(*) AS question_count FROM ({_TOPICS}) t JOIN (SELECT module_name, count(*) AS n FROM ({L}) l GROUP BY 1) m USING (module_name) WHERE n >= 3 GROUP BY t.module_name, topic, n HAVING count(*) >= n * 0.5"


def hotspots(spark, d):
    return memory.hotspots(log(spark, d))


def typical_questions(spark, d):
    rows = log(spark, d)
    return memory.typical_questions(rows, memory.hotspots(rows))


TYPICAL = f"SELECT module_name, topic, rank, query FROM (SELECT h.module_name, topic, query, CAST(row_number() OVER (PARTITION BY h.module_name, topic ORDER BY length(query) DESC, ord) AS INT) AS rank FROM ({HOTSPOTS}) h JOIN ({L}) l ON l.module_name = h.module_name AND contains(lower(query), topic)) q WHERE rank <= 3"


def session_findings(spark, d):
    return memory.session_summary(log(spark, d))[0]


def session_unresolved(spark, d):
    return memory.session_summary(log(spark, d))[1]


_FIRST = f"SELECT module_name, min(ord) AS f FROM ({L}) l GROUP BY 1"
FINDINGS = f"SELECT module_name, summary FROM (SELECT *, row_number() OVER (PARTITION BY module_name ORDER BY ord DESC) AS k FROM ({L}) l WHERE kind = 'diagnosis') q JOIN ({_FIRST}) x USING (module_name) WHERE k <= 3 AND summary <> '' ORDER BY f, ord LIMIT 5"
UNRESOLVED = f"SELECT module_name, query FROM ({L}) l JOIN ({_FIRST}) x USING (module_name) WHERE kind = 'qa' AND confidence < 0.7 AND query <> '' ORDER BY f, ord LIMIT 5"


def understanding(spark, d):
    return memory.understanding(log(spark, d).withColumn("ts", F.col("ord")))


def last_records(spark, d):
    return memory.last_records(log(spark, d), 5).select("module_name", "ord")


# Terms: nations as a project's glossary (every fifth a correction), regions and segments as packs.
_TERMS = """SELECT lower(n_name) AS source_term, n_name AS target_phrase, '' AS context, 'trade' AS domain, CASE WHEN n_nationkey % 5 = 0 THEN 'user_correction' WHEN n_nationkey % 5 = 1 THEN 'inferred' ELSE 'default' END AS source,
  CASE WHEN n_nationkey % 5 = 0 THEN 1.0 ELSE 0.7 END AS confidence, CAST(0 AS BIGINT) AS usage_count, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}"""
_PACK = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'x_' || lower(n_name) END AS source_term, 'P ' || n_name AS target_phrase, 'pack' AS context, '{dom}' AS domain, 'domain_pack' AS source, 0.8 AS confidence, CAST(0 AS BIGINT) AS usage_count, CAST(n_nationkey AS BIGINT) AS ord
  FROM {nation} WHERE n_nationkey % {k} < 2"""


def _sql(spark, d, text):
    out = spark.sql(text, nation=spark.read.parquet(f"{d}/nation.parquet"))
    return out.withColumn("confidence", F.col("confidence").cast("double"))


def terms(spark, d):
    return _sql(spark, d, _TERMS)


def pack(spark, d, dom, k):
    return _sql(spark, d, _PACK.replace("{dom}", dom).replace("{k}", str(k)))


T = _TERMS.replace("{nation}", "nation")
P1, P2 = (_PACK.replace("{dom}", a).replace("{k}", str(k)).replace("{nation}", "nation") for a, k in (("trade", 3), ("general", 4)))
RESOLVED = f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_term ORDER BY layer, o) AS k FROM (
  SELECT *, 0 AS layer, -ord AS o FROM ({T}) t WHERE source = 'user_correction' AND confidence = 1.0 UNION ALL SELECT *, 1, ord FROM ({T}) t UNION ALL SELECT *, 2, ord FROM ({P1}) p UNION ALL SELECT *, 3, ord FROM ({P2}) p) u) q WHERE k = 1"""


def _resolved(spark, d):
    return glossary.resolve(glossary.project_layers(terms(spark, d), pack(spark, d, "trade", 3), pack(spark, d, "general", 4)))


def term_resolution(spark, d):
    return _resolved(spark, d).select("source_term", "target_phrase", "domain", "source", "confidence", "layer")


def term_stats(spark, d):
    return glossary.statistics(_resolved(spark, d))


def term_corrections(spark, d):
    t = terms(spark, d)
    fixes = t.filter("ord % 4 = 0").select("source_term", F.concat(F.lit("fixed "), "target_phrase").alias("target_phrase"), F.lit("c").alias("context"), F.lit("general").alias("domain"), "ord")
    return glossary.correct(t, fixes).select("source_term", "target_phrase", "source", "confidence", "ord")


CORRECTIONS = f"""WITH t AS ({T}) SELECT source_term, target_phrase, source, CAST(confidence AS DOUBLE) AS confidence, ord FROM t WHERE NOT (ord % 4 = 0 AND source = 'user_correction')
 UNION ALL SELECT source_term, 'fixed ' || target_phrase, 'user_correction', 1.0, CASE WHEN source = 'user_correction' THEN ord ELSE (SELECT max(ord) FROM t) + 1 + ord END FROM t WHERE ord % 4 = 0"""


def pack_import(spark, d):
    return glossary.import_pack(terms(spark, d), pack(spark, d, "general", 4), "general").select("source_term", "target_phrase", "domain", "source", "ord")


IMPORT = f"""WITH t AS ({T}), p AS ({P2}), n AS (SELECT p.* FROM p WHERE source_term NOT IN (SELECT source_term FROM t WHERE source = 'user_correction'))
SELECT source_term, target_phrase, domain, source, ord FROM t
UNION ALL SELECT source_term, target_phrase, 'general', 'domain_pack', (SELECT max(ord) FROM t) + 1 + ord FROM n WHERE source_term NOT IN (SELECT source_term FROM t)"""


def term_usage(spark, d):
    used = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("source_term"))
    return glossary.count_usage(terms(spark, d), used).select("source_term", "usage_count")


def _history(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    q, a = c.filter("role = 'user'"), c.filter("role = 'assistant'")
    return q.select("conv_id", "turn", F.col("text").alias("question")).join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_summary")), ["conv_id", "turn"])


def term_inference(spark, d):
    return glossary.infer(_history(spark, d)).select("source_term", "target_phrase", F.round("confidence", 6).alias("confidence"), "times")


_GEN = "[" + ", ".join(f"'{w}'" for w in glossary.GENERIC) + "]"
INFER = f"""WITH h AS (SELECT q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'),
x AS (SELECT row_number() OVER () AS r, * FROM h WHERE question <> '' AND answer <> ''),
w AS (SELECT DISTINCT r, lower(t) AS target_phrase FROM (SELECT r, unnest(regexp_split_to_array(question, '\\s+')) AS t FROM x) q WHERE length(t) > 3 AND regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains({_GEN}, lower(t))),
n AS (SELECT DISTINCT r, s AS source_term FROM (SELECT r, unnest(regexp_extract_all(answer, '[\\p{{L}}\\p{{N}}_]+')) AS s FROM x) q WHERE regexp_matches(s, '{glossary.IDENTIFIER}') AND (contains(s, '_') OR regexp_matches(s, '^[A-Z]')))
SELECT source_term, target_phrase, round(least(0.79, 0.7 + 0.05 * (count(*) - 1)), 6) AS confidence, count(*) AS times FROM w JOIN n USING (r) GROUP BY 1, 2"""

QUERIES = {
    "hotspots": (hotspots, HOTSPOTS),
    "typical_questions": (typical_questions, TYPICAL),
    "session_findings": (session_findings, FINDINGS),
    "session_unresolved": (session_unresolved, UNRESOLVED),
    "understanding": (understanding, f"SELECT module_name, count(*) FILTER (kind = 'view') AS view_count, count(*) FILTER (kind = 'diagnosis') AS diagnose_count, count(*) FILTER (kind = 'qa') AS ask_count, max(ord) AS last_accessed FROM ({L}) l GROUP BY 1"),
    "last_records": (last_records, f"SELECT module_name, ord FROM (SELECT module_name, ord, row_number() OVER (PARTITION BY module_name ORDER BY ord DESC) AS k FROM ({L}) l) q WHERE k <= 5"),
    "term_resolution": (term_resolution, f"SELECT source_term, target_phrase, domain, source, CAST(confidence AS DOUBLE) AS confidence, layer FROM ({RESOLVED}) r"),
    "term_stats": (term_stats, f"SELECT count(*) AS total_terms, count(*) FILTER (source = 'user_correction') AS user_corrections, count(*) FILTER (source = 'domain_pack') AS domain_pack_terms, count(*) FILTER (source = 'inferred') AS inferred_terms, count(*) FILTER (source = 'default') AS default_terms FROM ({RESOLVED}) r"),
    "term_corrections": (term_corrections, CORRECTIONS),
    "pack_import": (pack_import, IMPORT),
    "term_usage": (term_usage, "SELECT lower(n_name) AS source_term, count(c_custkey) AS usage_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "term_inference": (term_inference, INFER),
}
