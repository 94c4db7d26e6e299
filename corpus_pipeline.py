"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrolla.llm import near_dedup, packing, quality_model, secrets, substring_dedup
from corrolla.llm.common import discard, discard_since, mark_written, read_documents, written

#: A document stays from this score on.
KEEP_SCORE = 0.3
WINDOW = 1024


def _with_lengths(docs: DataFrame) -> DataFrame:
    """n_chars as the text has now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at KEEP_SCORE or more, as they are.

    Each row is scored by its own text: null and empty texts have a score, too; repeated ids and rows stay as often as
    they come; columns that share a name with one of the model's are kept apart from it. Labels of ids that are not in
    docs, and null labels, teach nothing. An empty table gives an empty one.
    """
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score_documents(docs, model, score_col="_score").where(F.col("_score") >= KEEP_SCORE).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Texts of one id are judged each by itself, of repeated rows one stays; null ids come last in their group. Documents
    without words stay. An empty table gives an empty one.
    """
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that have no word left go.

    Spans belong to one text of an id, so its other texts stay whole. Null texts and ids stay as they are, empty texts
    go. n_chars, if there, counts the text as it is now. An empty table gives an empty one.
    """
    cut = substring_dedup.cut_passages(docs, substring_dedup.substring_duplicates(docs))
    return _with_lengths(cut.where(F.col("text").isNull() | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the secrets' kinds.

    Every row is scanned by itself, whatever its id; null texts stay null, empty ones empty. n_chars, if there, counts the
    text as it is now. An empty table gives an empty one.
    """
    return _with_lengths(secrets.redact_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most WINDOW tokens.

    A null or empty text is packed as its closing id alone; null and repeated ids and repeated rows are packed each by
    itself. An empty table gives an empty result.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secret spans", secret_spans),
    ("packing", packed),
]
#: No stage but the reading is expressible in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next. What a stage wrote on its way goes once its result is
    written, and so does its input."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        mark, before = mark_written(), docs
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard_since(mark, keep=docs)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
