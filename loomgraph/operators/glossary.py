"""Terms in layers. terms: source_term, target_phrase, context, domain, source, confidence, usage_count, ord."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRECTION, PACK, INFERRED = "user_correction", "domain_pack", "inferred"
#: Words that name no business concept.
GENERIC = ("how", "what", "when", "where", "why", "this", "that")
#: Words of an answer, and (fixed) those that are identifiers.
WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"^([a-z_][a-z0-9_]*|[a-z][a-zA-Z0-9]*|[A-Z][A-Z0-9_]*)$"


def _first(df: DataFrame, key: list[str], *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__k = 1").drop("__k")


def correct(terms: DataFrame, fixes: DataFrame) -> DataFrame:
    """terms with corrections put in or over earlier ones of the same term, the latest of each. fixes: source_term,
    target_phrase, context, domain, ord. A replaced correction keeps its place in order."""
    last = _first(fixes, ["source_term"], F.desc("ord")).withColumns({"source": F.lit(CORRECTION), "confidence": F.lit(1.0), "usage_count": F.lit(0).cast("long")})
    was = terms.filter(F.col("source") == CORRECTION).groupBy("source_term").agg(F.min("ord").alias("was"))
    top = terms.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    placed = last.join(was, "source_term", "left").crossJoin(F.broadcast(top)).withColumn("ord", F.coalesce("was", F.col("top") + 1 + F.col("ord"))).drop("was", "top")
    rest = terms.join(last.select("source_term", F.lit(CORRECTION).alias("source")), ["source_term", "source"], "left_anti")
    return rest.unionByName(placed.select(rest.columns))


def import_pack(terms: DataFrame, pack: DataFrame, domain: str = "general") -> DataFrame:
    """terms with a pack's (source_term, target_phrase, context, ord). Corrections stay; a known term is renewed
    unless a general pack meets one of another domain; others are added."""
    pack = _first(pack.filter("source_term is not null and target_phrase is not null"), ["source_term"], F.desc("ord"))
    fixed = terms.filter(F.col("source") == CORRECTION).select("source_term").distinct()
    new = pack.join(fixed, "source_term", "left_anti").select("source_term", F.col("target_phrase").alias("p_target"), F.coalesce("context", F.lit("")).alias("p_context"), F.col("ord").alias("p_ord"))
    first = _first(terms.filter(F.col("source") != CORRECTION), ["source_term"], "ord").select("source_term", "ord", F.lit(True).alias("is_first"))
    j = terms.join(first, ["source_term", "ord"], "left").join(new, "source_term", "left")
    renew = F.col("p_target").isNotNull() & F.coalesce("is_first", F.lit(False)) & (F.col("source") != CORRECTION) & ((F.lit(domain) != "general") | (F.col("domain") == "general"))
    kept = j.select("source_term", F.when(renew, F.col("p_target")).otherwise(F.col("target_phrase")).alias("target_phrase"), F.when(renew, F.col("p_context")).otherwise(F.col("context")).alias("context"), F.when(renew, F.lit(domain)).otherwise(F.col("domain")).alias("domain"), F.when(renew, F.lit(PACK)).otherwise(F.col("source")).alias("source"), "confidence", "usage_count", "ord")
    top = terms.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    added = new.join(terms.select("source_term").distinct(), "source_term", "left_anti").crossJoin(F.broadcast(top))
    added = added.select("source_term", F.col("p_target").alias("target_phrase"), F.col("p_context").alias("context"), F.lit(domain).alias("domain"), F.lit(PACK).alias("source"), F.lit(0.8).alias("confidence"), F.lit(0).cast("long").alias("usage_count"), (F.col("top") + 1 + F.col("p_ord")).alias("ord"))
    return kept.unionByName(added)


PACK_FILE = "domain string, terms array<struct<source_term:string,target_phrase:string,context:string,domain:string,source:string,confidence:double,usage_count:long>>"


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(pack, source_term, target_phrase, context, domain, source, confidence, usage_count, ord) of a folder's JSON files,
    each {domain, terms}. pack: the file's domain, its name where it has none. A file that is no such object has no terms;
    terms without a source or a target are left out; what a term doesn't say is taken as a pack's usual."""
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("name"), F.from_json("value", PACK_FILE).alias("p"))
    each = texts.select(F.coalesce("p.domain", F.regexp_replace("name", r"\.json$", "")).alias("pack"), F.posexplode("p.terms").alias("ord", "t"))
    sound = each.filter("t.source_term is not null and t.target_phrase is not null")
    return sound.select("pack", "t.source_term", "t.target_phrase", F.coalesce("t.context", F.lit("")).alias("context"), F.coalesce("t.domain", "pack").alias("domain"), F.coalesce("t.source", F.lit(PACK)).alias("source"), F.coalesce("t.confidence", F.lit(0.8)).alias("confidence"), F.coalesce("t.usage_count", F.lit(0)).cast("long").alias("usage_count"), F.col("ord").cast("long").alias("ord"))


def packed_layers(terms: DataFrame, packs: DataFrame, domain: str | None = None) -> list[DataFrame]:
    """project_layers() with the packs of a folder: that of the project's domain, then the general one."""
    columns = terms.columns
    of = lambda d: packs.filter(F.col("pack") == d).select(*columns)
    return project_layers(terms, of(domain) if domain and domain != "general" else None, of("general"))


def resolve(layers: list[DataFrame]) -> DataFrame:
    """Layers of terms, the first one's wins. project_layers() makes them of a glossary and packs."""
    tagged = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    return _first(reduce(DataFrame.unionByName, tagged), ["source_term"], "layer", "ord")


def project_layers(terms: DataFrame, domain_pack: DataFrame | None = None, general_pack: DataFrame | None = None) -> list[DataFrame]:
    own = [terms.filter((F.col("source") == CORRECTION) & (F.col("confidence") == 1.0)).withColumn("ord", -F.col("ord")), terms]  # of several corrections the last
    return own + [p for p in (domain_pack, general_pack) if p is not None]


def by_priority(resolved: DataFrame) -> DataFrame:
    return resolved.orderBy(F.desc("confidence"), F.col("source") != CORRECTION, "layer", "ord")


def statistics(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("*").alias("total_terms"), *[F.count_if(F.col("source") == s).alias(n) for s, n in ((CORRECTION, "user_corrections"), (PACK, "domain_pack_terms"), (INFERRED, "inferred_terms"), ("default", "default_terms"))])


def count_usage(terms: DataFrame, used: DataFrame) -> DataFrame:
    """terms with usage_count raised by how often each is in used (source_term); the first entry of a term counts."""
    n = used.groupBy("source_term").agg(F.count("*").alias("n"))
    first = _first(terms, ["source_term"], "ord").select("source_term", "ord", F.lit(1).alias("hit"))
    j = terms.join(first, ["source_term", "ord"], "left").join(n, "source_term", "left")
    return j.withColumn("usage_count", F.col("usage_count") + F.when(F.col("hit") == 1, F.coalesce("n", F.lit(0))).otherwise(0)).drop("hit", "n")


def find_term(terms: DataFrame, source_term: str) -> DataFrame:
    return terms.filter(F.col("source_term") == source_term).orderBy("ord").limit(1)


def set_domain(terms: DataFrame, domain: str) -> DataFrame:
    return terms.withColumn("domain", F.lit(domain))


def infer(history: DataFrame, domain: str = "general") -> DataFrame:
    """Terms from (question, answer_summary): words of a question with identifiers of its answer; 0.7, and 0.05 more
    for each time that both meet again, 0.79 at most."""
    words = F.array_distinct(F.transform(F.filter(F.split("question", r"(?U)\s+"), lambda w: (F.length(w) > 3) & w.rlike(r"^[\p{L}]+$")), lambda w: F.lower(w)))
    words = F.filter(words, lambda w: ~w.isin(*GENERIC))
    names = F.array_distinct(F.filter(F.regexp_extract_all("answer_summary", F.lit(WORD), F.lit(0)), lambda x: x.rlike(IDENTIFIER) & (x.contains("_") | x.rlike("^[A-Z]"))))
    met = history.filter("question != '' and answer_summary != ''").select(F.explode(words).alias("target_phrase"), names.alias("names")).select("target_phrase", F.explode("names").alias("source_term"))
    n = met.groupBy("source_term", "target_phrase").agg(F.count("*").alias("times"))
    return n.select("source_term", "target_phrase", F.lit(domain).alias("domain"), F.lit(INFERRED).alias("source"), F.least(F.lit(0.79), F.lit(0.7) + F.lit(0.05) * (F.col("times") - 1)).alias("confidence"), "times")


def as_text(resolved: DataFrame) -> DataFrame:
    """One row: the glossary as lines for a prompt, by priority. A project's glossary: it is read as a whole."""
    row = F.struct((-F.col("confidence")).alias("a"), (F.col("source") != CORRECTION).alias("b"), "layer", "ord", F.concat(F.lit("- "), "source_term", F.lit(" → "), "target_phrase").alias("line"))
    return resolved.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.line), "\n").alias("glossary"))
