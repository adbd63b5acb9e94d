"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import op3_jaccard, op5_mixing, op7_language, op8_toxicity, op9_packing
from retentio.llm.common import saved


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """The row as one column and the columns a stage reads: no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity vote calls toxic go; learned from every label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = op8_toxicity.learn(docs, labels)
    return op8_toxicity.with_toxicity(boxed(docs, "text"), index).where(F.col("score") < op8_toxicity.THRESHOLD).select("_row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go. How sure the prediction is does not
    matter: a short text that several languages explain equally well is still a text of one of them."""
    model = op7_language.learn(docs)
    return op7_language.with_language(boxed(docs, "text"), model).where(F.col("lang_pred") != "und").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return op3_jaccard.keep_one(boxed(docs, "doc_id", "text"), 5, 80).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes."""
    return op5_mixing.mix_documents(boxed(docs, "doc_id", "text", "source")).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_packing.op9_query(docs)


def run_all(spark: SparkSession, docs: DataFrame, sf_dir: str, stages) -> DataFrame:
    """Each stage's rows are written as Parquet and reread as the next one's documents."""
    for name, stage in stages[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return stages[-1][1](spark, docs, sf_dir)
