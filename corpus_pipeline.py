"""Training-corpus pipeline over documents: language ID, line dedup, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import jaccard, langid, line_dedup, packing, secrets
from loomgraph.llm.common import materialize, scratch, ship_package, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this percentage of their word shingles of this size; the op4 query keeps its own contract (4, 85).
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Up to so many copies' keys are sent to all executors, so texts stay where they are: 24 bytes each, so 24 MB at most.
BROADCAST_GONE = 1_000_000
#: Below this share of known n-grams a text is in no learned language.
LEAST_SCORE = 0.1


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or in no learned language, go; a missing lang is filled in.

    Null and empty texts go; null ids, lang and source and repeated rows stay as they are, texts of any length are read
    whole, an empty table gives none, and columns beyond those of documents are dropped.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    found = langid.predict(docs, langid.fit_split(docs), keep=("doc_id", "lang", "source", "n_chars"))
    known = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of a source go. All rows stay, those with null or empty texts and repeated
    ones too, and null ids; texts of any length are read whole; a null source is a source; an empty table gives none;
    columns beyond those of documents are dropped first."""
    return _columns(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one with the least doc_id (null: after all others) and, of
    rows with that id, with the least hash of its text; of rows alike in id and text, one, null ids being alike.

    Rows are told apart by id and text, so rows with null ids are compared and removed as all others, and of a
    repeated id only the texts that are copies go.

    Null and empty texts are linked with nothing, but of rows alike in id and text, null ones too, one stays. Texts of
    any length are read whole; an empty table gives none; columns beyond those of documents are dropped first, so their
    names don't matter. Linked are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 at least,
    not op4's four words and 0.85.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    rows = jaccard.row_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT, keyed=True)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    linked = rows.filter("comp is not null").withColumn("place", place)
    stays = materialize(linked.groupBy("comp").agg(F.min("place").alias("stays")), "pipeline-stays")
    gone = linked.join(stays, "comp").filter("place != stays").select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct()
    gone = materialize(gone, "pipeline-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    left = docs.join(side, docs["doc_id"].eqNullSafe(F.col("__gone_id")) & (F.unhex(F.md5("text")) == F.col("__gone_key")), "left_anti")
    ids = rows.agg(F.count("*"), F.countDistinct(F.struct("doc_id", "key"))).first()
    return _columns(left if ids[0] == ids[1] else left.dropDuplicates(["doc_id", "text"]))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, null and empty texts as they are, null and repeated ids too. Texts of
    any length are read whole. An empty table gives none; columns beyond those of documents are dropped first."""
    return _columns(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, by piece: null and empty texts give their end id, null ids come first, rows with the same
    id, alike or not, follow each other, texts of any length are cut into as many pieces as they fill, an empty table
    gives none, other columns are dropped first."""
    ship_package(spark)
    return packing.pack_documents(docs.select(*COLUMNS), packing.vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", redact), ("packing", pack)]

#: Language ID, the join and packing aren't expressible in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each is a run of its own: its tables and broadcasts go, with its input, as soon as its result is
    written. Only the last one's table stays."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as own:
            docs, place = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
            own.tables += [last] * (last is not None)
        last = place
    return docs
