"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps with the columns of ``documents``; the last returns the packing. Every decision of a
stage is made on all rows of its own input. The stages need subwords and a trained classifier, so no SQL says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, packing, quality, simhash, substring, token_counts
from feedloom.llm.queries import QUALITY_LINE, WORD_BPE, held_out, vocabulary_path
from feedloom.llm.words import quoted
from feedloom.session import settle

ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """Id and text of every document, and all its columns as one that no other name can clash with."""
    return docs.select("doc_id", "text", F.struct("*").alias("_whole"))


def _apart(docs: DataFrame) -> DataFrame:
    """The same with the text only once, beside its other columns, for steps that hand the text on as it is."""
    return docs.select("doc_id", "text", F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("_rest"))


def _together(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, scores at the line or above."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, ~held_out(4))
    scored = quality.quality_scores(_apart(docs), weights, ["_rest", "text"])
    return _together(scored.where(F.col("score") >= QUALITY_LINE), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of equal ids, the smallest text hash).

    Near copies have fingerprints of their three-word shingles that link within two bits; a null id comes after all others.
    """
    last, print_ = F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.xxhash64("text")
    groups = simhash.near_duplicates(docs.select(last.alias("_id"), print_.alias("_print"), "text"), ["_id", "_print"], id_column="_id")
    kept = groups.groupBy("component_id").agg(F.min(F.struct("_id", "_print")).alias("one")).select("one.*")
    whole = docs.select(F.struct("*").alias("_whole"), last.alias("_id"), print_.alias("_print"))
    # Rows equal in id and text are one document; they are combined before anything moves.
    return whole.dropDuplicates(["_id", "_print"]).join(kept, ["_id", "_print"], "left_semi").select("_whole.*")


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; those of which nothing stays go."""
    cut = substring.remove_repeats(_whole(docs), ["_whole"])
    text = F.when(F.col("n_removed") == 0, F.col("_whole.text")).otherwise(F.col("kept"))
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[changed.get(c, F.col("_whole").getField(c)).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_apart(docs), items, ["_rest", "text"])
    return _together(found.where("NOT contaminated"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in its bin, by token counts."""
    return packing.pack(token_counts.token_counts(docs, vocabulary_path(WORD_BPE), ["doc_id"]))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", repeats_removed),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
