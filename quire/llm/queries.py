"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.urls import site_key
from quire.llm.p1_forms import consistent_text, same_looking_pairs
from quire.llm.p2_lines import drop_lines, line_templates, repeated_lines
from quire.llm.p3_markup import clean_texts, markup_residue, wrappers
from quire.llm.p4_residue import residue_records
from quire.llm.p5_encoding import garbled_fields
from quire.llm.p6_main import furniture_lines, main_bodies, train
from quire.llm.p7_packing import pack, token_counts
from quire.llm.p8_leaks import leaked_items
from quire.llm.p9_sentences import sentence_starts, sentences
from quire.operators.shared import materialize
from quire.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = same_looking_pairs(table(spark, d, "pipeline_contexts"), "ctx_id", "title_clean", "content")
    return pairs.select(F.col("id_a").alias("ctx_id_a"), F.col("id_b").alias("ctx_id_b"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pipeline_contexts").select("ctx_id", "title_clean", "content")
    return consistent_text(df, ["title_clean", "content"]).select("ctx_id", "title_clean_norm", "content_norm")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines(table(spark, d, "pipeline_contexts"), "ctx_id", site_key(F.col("url")), "content")
    return found.select(F.col("id").alias("ctx_id"), "line_no")


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    return line_templates(table(spark, d, "pipeline_contexts"), site_key(F.col("url")), "content")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pipeline_contexts").select("ctx_id", "url", "content")
    lines = repeated_lines(df, "ctx_id", site_key(F.col("url")), "content")
    return drop_lines(df, "ctx_id", "content", lines, "content_clean").select("ctx_id", "content_clean")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup_residue(table(spark, d, "pipeline_contexts"), table(spark, d, "raw_documents"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_texts(table(spark, d, "pipeline_contexts"), table(spark, d, "raw_documents"))


def p3_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return wrappers(table(spark, d, "raw_documents"), "source_url", "html")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = residue_records(table(spark, d, "pipeline_contexts"), "ctx_id", "html", "status_code")
    return found.select(F.col("id").alias("ctx_id"), "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = garbled_fields(table(spark, d, "pipeline_contexts"), "ctx_id", ["content", "title_raw"])
    return found.select(F.col("id").alias("ctx_id"), "field")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    found = garbled_fields(table(spark, d, "pipeline_contexts"), "ctx_id", ["content", "title_raw"], restored=True)
    return found.select(F.col("id").alias("ctx_id"), "field", "text", "whole")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    contexts, raw = table(spark, d, "pipeline_contexts"), table(spark, d, "raw_documents")
    return furniture_lines(contexts, raw, *train(contexts, raw))


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    contexts, raw = table(spark, d, "pipeline_contexts"), table(spark, d, "raw_documents")
    return main_bodies(contexts, raw, *train(contexts, raw))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, table(spark, d, "pack_targets"), "id", "tokens", "loss").withColumnRenamed("id", "doc_id")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """For each target: documents placed, and containers or documents that break a limit or miss a part (none may)."""
    targets = table(spark, d, "pack_targets").select("target_id", "capacity_tokens")
    packed = materialize(p7_packed(spark, d), "p7-packed")
    full = packed.groupBy("target_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss"))
    full = full.join(targets, "target_id").groupBy("target_id").agg(
        F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_tokens"),
        F.count_if(F.col("segments") > 64).alias("over_segments"),
        F.count_if(F.col("loss") > F.floor(F.col("capacity_tokens") * 0.99)).alias("over_loss"),
    )
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("tokens").alias("all"))
    whole = packed.groupBy("target_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.max("part").alias("last"))
    whole = whole.join(sizes, "doc_id").groupBy("target_id").agg(
        F.count("*").alias("documents"), F.count_if((F.col("tokens") != F.col("all")) | (F.col("parts") != F.col("last"))).alias("not_whole")
    )
    return full.join(whole, "target_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each target are."""
    packed = p7_packed(spark, d).groupBy("target_id", "container").agg(F.sum("tokens").alias("used"))
    targets = table(spark, d, "pack_targets").select("target_id", "label", "capacity_tokens")
    return (
        packed.groupBy("target_id")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
        .join(targets, "target_id")
        .select("target_id", "label", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")
    return found.select(F.col("id").alias("doc_id"), "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = sentence_starts(table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "sent_start")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_consistent, p2_found, p2_templates, p2_clean, p3_found, p3_clean, p3_wrappers, p4_found, p5_found, p5_restored,
        p6_found, p6_main, p7_packed, p7_limits, p7_fill, p8_found, p9_found, p9_sentences,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """What SQL can state of these operators; the rest is tested against brute force, round trips and held-out rows in
    tests/llm, as SQL has neither the normal forms, nor the parsers, nor the models."""
    return {
        "p7_limits": """select target_id, 0 as over_tokens, 0 as over_segments, 0 as over_loss, (select count(*) from documents where text <> '') as documents,
          0 as not_whole from pack_targets""",
    }
