"""A corpus pipeline of five of the training-data operators, each over all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; each is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``docs``, whatever they are
besides doc_id, text and source, and n_chars where the text changes. An empty table gives no rows
at every stage; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, files, line_rules, mixing, near_dedup, quality_mil, sentencepiece_codec
from tessella.llm.queries import table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null and empty texts are scored as one empty passage; repeated rows have one score and stay or
    go together; null ids are never learned from.
    """
    made = quality_mil.classify(docs, table(spark, sf_dir, "labels"))
    return made.where("predicted = 1").select(*map(common.quoted, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines they remove.

    Null and empty texts have too few words and go; a null source is a source of its own; repeated
    rows count once and are judged alike.
    """
    made = line_rules.judge(docs).where("kept")
    return made.withColumns({"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast("long")}).select(*map(common.quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Texts without words are copies of nothing, and rows with a null id too: they stay. Rows that
    repeat an id are one document and stay or go together.
    """
    gone = near_dedup.link(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(common.quoted, docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and aren't taken; a null source is the last one; repeated
    rows are decided one by one.
    """
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, a row a row; null texts count as empty."""
    made = sentencepiece_codec.round_trip(docs.select("doc_id", "source", "text"), vocabulary("piece_bpe_32k.model"))
    return made.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: The classifier, the mix's random draws and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the stages write is removed once the last is saved."""
    folder = common.scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        return common.saved(docs)
    finally:
        files.delete(spark, folder)
