"""The registered queries of the training-data operators: each applies one to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.oracles import ORACLES


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import sentencepiece_codec as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.round_trip(docs, vocabulary("piece_bpe_32k.model")).drop("text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import files
    from tessella.llm import warc as op

    folder = common.scratch(spark, "warc")
    try:
        archives = op.write(table(spark, sf_dir, "pages"), folder)
        rows = op.read(spark, archives, split_bytes=4 << 20, payloads=False)
        key = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(.*)$", 1), F.lit("")).cast("long")
        return common.saved(rows.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to_id").alias("refers_to")))
    finally:
        files.delete(spark, folder)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import files
    from tessella.llm import media as op

    folder = common.scratch(spark, "media")
    try:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        op.store(docs).select("doc_id", "n_bytes", "media").write.option("compression", "none").parquet(folder)
        seen = op.features(spark.read.parquet(folder))
        return common.saved(seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
    finally:
        files.delete(spark, folder)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality_mil as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import chat as op

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)
    out = op.render(op.fold(op.events_of(rows)))
    out = out.withColumns({"t": op.turns(F.col("formatted")), "loss": op.masked(F.col("formatted"), F.col("loss_spans"))})
    joined = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import near_dedup as op

    return op.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import url_filter as op

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return op.judge(pages, op.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import mixing as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return op.decide(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import files
    from tessella.llm import token_files as op

    folder = common.scratch(spark, "tokens")
    try:
        made = op.write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
        return common.saved(op.read(spark, made))
    finally:
        files.delete(spark, folder)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import line_rules as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return op.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import spelling as op

    return op.group(table(spark, sf_dir, "documents").select("doc_id", "text"), damage=op.DAMAGE)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import conversation_repair as op

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return op.report(op.repair(op.damaged(rows)), rows)


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import embedding_dedup as op

    return op.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_warc, op3_media, op4_quality, op5_chat, op6_near_dedup, op7_url_filter, op8_mixing, op9_token_files, op10_quality_rules, op11_spelling, op12_repair, op13_vectors)}
