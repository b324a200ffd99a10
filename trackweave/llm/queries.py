"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import audit, bpe, decontaminate, divergence, jaccard, langid, licenses, media, mixing, quality, sharding, suffixes, urls
from trackweave.llm.common import scratch_path, table

SHARDS = sharding.regular_tree(40)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.corpus_files(table(spark, sf_dir, "documents")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), path)
    read = media.with_features(media.read_archives(spark, path))
    tail = F.crc32(F.substring("payload", -16, 16))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("class")


def vocabulary() -> str:
    """Where the public vocabulary file lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.page_labels(table(spark, sf_dir, "labels")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_tree(table(spark, sf_dir, "documents"), SHARDS, sharding.grow(SHARDS))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_media": op4_media,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_urls": op7_urls,
    "op8_repeats": op8_repeats,
    "op9_sharding": op9_sharding,
    "op10_langid": op10_langid,
    "op11_audit": op11_audit,
    "op12_divergence": op12_divergence,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op2_quality": quality.oracle(),
    "op3_licenses": licenses.oracle(),
    "op7_urls": urls.oracle(),
    "op9_sharding": sharding.oracle(SHARDS, sharding.grow(SHARDS)),
    "op11_audit": audit.oracle(),
    "op12_divergence": divergence.oracle(),
    "op13_decontamination": decontaminate.oracle(),
}
