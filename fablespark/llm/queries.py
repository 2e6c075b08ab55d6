"""The registered queries of the corpus operators: name to (spark, folder) function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.llm import capture_index, chat_format, decontaminate, filter_audit, html_extract, license_scan, mixing, quality, simhash, topk_search, toxicity, turn_repair, url_filter
from fablespark.llm.common import held_out, literal_rows, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, columns=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, columns=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    special = literal_rows(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said)], ["conv_id", "turn", "role", "text"])
    return chat_format.read_back(chat_format.format_conversations(talks.unionByName(special)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = capture_index.write_captures(pages)
    captures = capture_index.find_captures(index, capture_index.url_keys(pages))
    return capture_index.read_captures(index, captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_topk": op2_topk,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_html": op5_html,
        "op6_decontaminate": op6_decontaminate,
        "op7_url_filter": op7_url_filter,
        "op8_simhash": op8_simhash,
        "op9_chat_format": op9_chat_format,
        "op10_license_scan": op10_license_scan,
        "op11_filter_audit": op11_filter_audit,
        "op12_warc": op12_warc,
        "op13_turn_repair": op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {
        "op2_topk": topk_search.ORACLE_SQL,
        "op3_mixing": mixing.oracle_sql(),
        "op6_decontaminate": decontaminate.ORACLE_SQL,
        "op7_url_filter": url_filter.ORACLE_SQL,
        "op9_chat_format": chat_format.ORACLE_SQL,
        "op10_license_scan": license_scan.oracle_sql(),
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_warc": capture_index.ORACLE_SQL,
        "op13_turn_repair": turn_repair.ORACLE_SQL,
    }
