"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes and returns documents; its input is what the stage before it
kept, read back from Parquet. The last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronofact.llm import bpe, jaccard, mixing, quality, toxicity
from chronofact.llm.columns import words
from chronofact.llm.near import stored
from chronofact.session import scratch_scope
from chronofact.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and every rule of the cascade accept."""
    return quality.keep(docs).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    found = toxicity.detect(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.where("predicted = 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest id, whatever ids are null or repeat.

    Rows are told apart by a number of their own, so different texts of one id
    all stay and copies without an id go.
    """
    rows = jaccard.numbered(docs, "near-copies")
    found = jaccard.row_classes(rows.select("_row", F.col("doc_id").alias("_key"), F.col("text").cast("string").alias("_text")))
    return rows.join(found.where("first").select("_row"), "_row").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, whole, in training order. Words are counted once and kept beside the texts."""
    sized = stored(docs.withColumns({"_words": F.size(words(F.col("text"))).cast("bigint"), "_content": F.md5(F.coalesce("text", F.lit("")))}), "mixture")
    mixed = mixing.mix(sized, F.col("_words"), content=F.col("_content"), rows=sized.count())
    return mixing.emit(mixed).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"))
    exact = F.col("decoded").eqNullSafe(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return coded.select("doc_id", "source", "n_tokens", F.col("packed_ids").alias("token_ids"), exact.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture), ("byte-level BPE encoding and decoding", encoding),
]

#: The toxicity classifier is learned, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next.

    What a stage made on its way, and its input, is deleted once its result is
    stored. The input of the last stage stays: the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch_scope(spark) as scope:
        for at, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if at < len(STAGES) - 1:
                docs = stored(docs, f"pipeline-{at}")
                scope.release(keep=scope.paths[-1:])
    return docs
