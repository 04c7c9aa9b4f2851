"""A training corpus from raw documents: each stage takes the documents that the one before it kept.

Every stage is a function of (spark, docs, sf_dir) over one operator of ``streamworks.llm``. A stage's result is written as
Parquet to the shared folder and read again as the next stage's documents, so a lost executor repeats a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamworks.llm import linededup, nearcopies, packing, pii, quality, simhash
from streamworks.llm.common import free_name, table
from streamworks.llm.queries import tokenizer_path
from streamworks.shared import new_folder

#: The columns of documents; stages but the last return them (and any others that came along).
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars is that of the text as it is now; null texts have 0."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality, learnt from the labelled ones that aren't held out. Only those are measured twice."""
    labels = table(spark, sf_dir, "labels")
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id").distinct()
    model = quality.fit_on_labels(quality.measured(docs.filter(~quality.held_out()).join(known, "doc_id", "left_semi")), labels)
    score = free_name(docs, "score")
    return quality.with_text_score(docs, model, out=score).filter(F.col(score) >= 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later copies of repeated runs."""
    return _counted(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the least by id (null first), then by a hash of the text. Equal rows are one.

    Two documents link at 4 or fewer bits of SimHash (as in op10) or at a five-word Jaccard similarity of 0.8 or more.
    """
    key = free_name(docs, "near_key")
    own = docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64("text").alias("k")))
    found = nearcopies.merged(own, simhash.near_duplicates(own, id_col=key), key)
    kept = found.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias(f"{key}_kept")).distinct()
    return own.join(kept, F.col(key) == F.col(f"{key}_kept"), "left_semi").dropDuplicates([key]).drop(key)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    spans = free_name(docs, "spans")
    return _counted(pii.with_spans(docs, out=spans, masked="text").drop(spans))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("pii", mask_pii),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, SimHash or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
