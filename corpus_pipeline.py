"""Corpus preparation in stages: each takes the documents that the one before kept.

Columns of documents: doc_id, text, lang, source, n_chars; others are dropped by the first stage. Null texts count as
empty, and n_chars follows the text where a stage changes it. Stages that judge rows by doc_id leave rows with a null
doc_id alone. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import jaccard, packing, pii, quality, substring
from reckoner.llm.common import saved, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores THRESHOLD or more."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.training_rows())
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links join, the document with the least doc_id. A doc_id goes only if none of its rows is kept."""
    small_batches(spark)
    gone = jaccard.join(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    gone = saved(gone, "gone")
    return docs.select(*COLUMNS).join(F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_IDS else gone, "doc_id", "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages, the others joined by one space; documents without any keep their text as it is."""
    small_batches(spark)
    found = substring.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return found.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    small_batches(spark)
    found = saved(pii.candidates(docs.select(*COLUMNS)), "candidates")
    clean = pii.redact(pii.classify(found, pii.fit(found)))
    return clean.select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2,048 tokens."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
