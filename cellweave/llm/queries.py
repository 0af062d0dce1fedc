"""One thin query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.decontaminate import contained_items
from cellweave.llm.gif_media import gif_digests
from cellweave.llm.jaccard_join import jaccard_components
from cellweave.llm.language_crf import fit_language, predict_language
from cellweave.llm.merkle_manifest import merkle_manifest
from cellweave.llm.mixing import label_weights, mix
from cellweave.llm.quality import fit_quality, held_out, quality_scores
from cellweave.llm.secret_scan import scan_secrets
from cellweave.llm.shared import table
from cellweave.llm.simhash_ring import simhash_components
from cellweave.llm.suffix_dedup import suffix_dedup
from cellweave.llm.token_alignment import align_tokenizers
from cellweave.llm.token_counts import section_tokens
from cellweave.llm.warc import convert_pages

#: Where the public vocabularies are on the driver; their bytes go to the tasks.
TOKENIZERS = Path("/opt/tokenizers")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), keep=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return quality_scores(docs, forest).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = convert_pages(table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = fit_language(docs, ~held_out("doc_id", 4, 2))
    return predict_language(docs, field).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = section_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("section_tokens", F.array_join(F.col("section_tokens").cast("array<string>"), ",")).drop("field_tokens")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ((TOKENIZERS / name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(table(spark, sf_dir, "documents"), a, b)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], key="doc_id", group="lang", probe={"text": tampered})


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_gif_media,
        op3_quality_classifier,
        op4_ngram_jaccard_join,
        op5_arc_to_warc,
        op6_language_id_crf,
        op7_token_counts,
        op8_benchmark_decontamination,
        op9_secret_scan,
        op10_source_mixing,
        op11_cross_tokenizer_alignment,
        op12_merkle_manifest,
        op13_simhash_near_dedup,
    )
}
