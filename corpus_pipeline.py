"""From raw documents to packed sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import common, decontaminate, language, neardup, packing, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A best cosine of no more than this names no language.
LEAST_SCORE = 0.02
#: Units whose ids a worker remembers while it packs: other stages share its memory.
REMEMBERED = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells a row apart from others with another text: key, a doc_id that is not null, and text_hash."""
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID))).withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is recognised: null texts, texts without a letter, texts like no prototype.

    Rows are judged one by one, so null and repeated ids change nothing. Where no language can be learned, none is left."""
    model = language.learn(language.held_out(docs).where(~F.col("held_out")))
    found = language.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least doc_id, of each group of near duplicates: five words, similarity 0.8.

    Every row is a node of its own, so rows without an id, or that repeat one with another text, stay unless they are near
    copies. A null id sorts first; of equal ids the text with the least hash is kept."""
    rows = common.stored(keyed(docs.select(*COLUMNS)).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    order = rows.select("row", F.struct("key", "text_hash", "row").alias("place"))
    least = found.join(order, "row").groupBy("component_id").agg(F.min("place").alias("least")).select("least.row")
    return rows.join(least, "row", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that occur elsewhere; a document of which nothing is left goes.

    A row is found by its id, null or not, and its text, so rows that repeat an id with another text each keep their own
    rest; rows that are repeated in full are copies of each other like any others. A null text stays as an empty one."""
    cut = suffix_dedup.suffix_dedup(docs, with_text=True).withColumn("key", F.coalesce("doc_id", F.lit(common.NULL_ID)))
    cut = cut.select("key", "text_hash", "kept_text", "n_removed").dropDuplicates(["key", "text_hash"])
    rest = keyed(docs.select(*COLUMNS)).drop("text", "n_chars").join(cut, ["key", "text_hash"])
    rest = rest.where("n_removed = 0 OR length(trim(kept_text)) > 0")
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any window of eight words of a benchmark item occurs.

    A row is found by its id, null or not, and its text: others with that id or without an id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark, with_hash=True).where("n_items > 0")
    found = found.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("key"), "text_hash").distinct()
    return keyed(docs.select(*COLUMNS)).join(found, ["key", "text_hash"], "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; every row is packed, with a null id or a repeated one too."""
    return packing.pack(docs, 1024, remembered=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, sketches and models are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage leaves in the shared folder is deleted when the next one is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(common.scratch_tables())
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.clean(spark, docs, since=since)
    return docs
