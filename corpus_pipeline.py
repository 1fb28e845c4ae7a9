"""From raw documents to a token store, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last returns what it read back from the store. Stages read their helper
tables (labels, benchmark) from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakline.llm import decontaminate, jaccard, mixing, tokenstore, toxicity
from breakline.llm.common import maybe_broadcast, new_path, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle, similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the machine is learnt from the labels of these documents."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where(toxicity.predicted() == 0).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the smallest doc_id.

    Rows of one doc_id are one document and stay together; rows without doc_id stay.
    """
    found = jaccard.similar(docs, SHINGLE, SIMILARITY)
    extra = saved(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(maybe_broadcast(extra, extra.count()), "doc_id", "left_anti")
    return kept.select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: none, once or more."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"), docs)
    rated = mixing.mixed(docs, labels, mixing.TARGETS, mixing.BUDGET)
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return rated.select(*COLUMNS, repeated.alias("copy")).select(*COLUMNS)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, read back from the store."""
    where = new_path(spark, "pipeline-tokens")
    tokenstore.write_store(docs, where, tokenstore.vocabulary())
    return tokenstore.digests(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_store", store_tokens),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
