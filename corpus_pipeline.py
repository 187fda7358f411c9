"""Raw documents to packed training sequences.

Language identification drops what no model knows, SimHash keeps one document of each group of near-duplicates,
substring deduplication removes word windows that occurred before, decontamination drops what holds benchmark items,
and packing cuts the rest into sequences. Each stage takes (spark, docs, sf_dir), and all but the last one return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, packing, simhash, substring_dedup
from quarry.llm.queries import held_out
from quarry.llm.runtime import Workspace, dropped_behind
from quarry.llm.tokenizing import byte_bpe_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, models)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's text becomes the words that are left, and n_chars its length; one that loses all its words goes."""
    kept = substring_dedup.deduplicate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_index(docs, vocabulary=byte_bpe_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("packing", sequences),
]

#: Language models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder and read by the next one; its own tables, and
    its predecessor's result, are dropped then."""
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    before = None
    for name, stage in filters:
        with dropped_behind():
            docs = workspace.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            workspace.drop(before)
        before = name
    return last(spark, docs, sf_dir)
