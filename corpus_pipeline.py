"""The corpus pipeline: documents to a mix of clean, distinct documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the
last return the columns of documents. No stage can be told in SQL as a whole (nearest centroids, fingerprints and latent
retrieval can't), so ORACLE_SQL is None and the stages are tested against brute force.

Nulls, empty texts, repeated rows and empty tables behave as each operator's docstring says; a row with a null id is kept by the
stages that decide by id. Extra columns go along until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, langid, line_dedup, mixing, near_dedup
from evidentia.llm.common import materialize, without

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from the labelled rows outside the test fold."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model, keep=tuple(docs.columns)).filter("not rejected").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in many others; n_chars follows the text."""
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: 5-word shingles, similarity 0.8 or more."""
    found = materialize(near_dedup.near_components(docs), "near-duplicates")
    return without(docs, found.filter(F.col("doc_id") != F.col("component")).select(F.col("doc_id").alias("id"))).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select(F.col("doc_id").alias("id"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("near_dedup", near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
