"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import (
    byte_network, decontamination, hard_negatives, language_id, license_scan, merkle, mixing, near_dedup, private_data,
    quality_rules, token_files, toxicity, url_filter,
)
from wardflow.llm.common import crc_bucket, table

TOKENIZER = "word_bpe_49k.json"

#: The rules of the URL query.
RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
         url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
         url_filter.Rule("block", "com", "/de/")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, from the written files."""
    docs = table(spark, sf_dir, "documents")
    return token_files.pack(docs, token_files.shared_path(spark, "tokens"), public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by rules, then by the language-model ratio."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(pages, RULES)
    return url_filter.filter_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's share of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and templates."""
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows."""
    out = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                             keep=["doc_id"])
    hit = decontamination.contaminated_words()
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (hit > 0).alias("contaminated"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at 3-word shingles and similarity 0.85."""
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data."""
    out = private_data.find_private(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in private_data.KINDS[:4]],
                      F.sha2(private_data.span_text("base").cast("binary"), 256).alias("base_sha256"),
                      private_data.span_text("spans").alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.training_rows(docs)))
    held = docs.select("doc_id", "text", (~language_id.training_rows(docs)).alias("held_out"))
    return language_id.identify(held, model, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    net = byte_network.fit(docs, labels)
    return byte_network.score_quality(docs.withColumn("held_out", held), net, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and its root again after line feeds were deleted from half of the texts."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(crc_bucket("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [changed if f == "text" else F.col(f) for f in merkle.FIELDS]
    out = merkle.build(docs, carry={"now": merkle.leaf(*values)})
    folded = merkle.fold(F.col("now"), "path")
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof("path").alias("proof_sha256"),
                      folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_files, op2_url_filter, op3_toxicity, op4_mixing, op5_quality_rules, op6_license_scan,
             op7_decontamination, op8_near_dedup, op9_private_data, op10_language_id, op11_quality_classifier,
             op12_merkle_manifest, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in every}
