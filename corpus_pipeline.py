"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Every stage but the last returns the columns of its input.  Nulls: a document with a null or empty
text passes all filters; one with a null doc_id takes part where its text decides (all stages but the
suffix stage, which needs an order of documents and leaves it as it is).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chosenpath, decontaminate, packing, suffixes, toxicity
from lattica.llm.common import remove_folder, shared_folder, table
from lattica.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_frame(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), model, keep=("row",))
    return scored.where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by doc_id, nulls last; rows of one id and text count once."""
    first = chosenpath.near_duplicates(docs).where("first").select(chosenpath.id_key(F.col("doc_id")).alias("key"), "digest").distinct()
    rows = docs.select(chosenpath.id_key(F.col("doc_id")).alias("key"), chosenpath.text_digest(F.col("text")).alias("digest"), F.struct(*docs.columns).alias("row"))
    return rows.join(first, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat an earlier string of 100 bytes; ``n_chars``, where there is one, follows the text."""
    others = [c for c in docs.columns if c != "text"]
    cut = suffixes.repeated_bytes(docs.select("doc_id", "text", F.struct(*others).alias("__row")), keep=("__row",))
    known = cut.select("__row.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        known = known.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return known.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of ten consecutive words of a benchmark item."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    found = decontaminate.contamination(rows.select("key", "row.text"), table(spark, sf_dir, "benchmark"), width=10, doc_id="key")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(hit, "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, word_tokenizer(), capacity=4096, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. A stage's folder goes once the next one is written; the last one stays, as the result is read from it."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
