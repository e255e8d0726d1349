"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import centroids, chat, decontam, langid, mixing, quality_mil, secrets, sentence_pieces, simhash, spelling, substring_dedup, syncmers, token_store
from pitchlake.llm.shared import crc_of_id, documents


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id() % 3 == 1
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id() % 4 == 2
    model = quality_mil.train(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return quality_mil.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir), tokenizer_file())


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(documents(spark, sf_dir))


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.pairs_by_id(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.span_text(F.col("base_spans")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans")
    )


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = sentence_pieces.Model.read(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.digests(sentence_pieces.encode(documents(spark, sf_dir), model), model)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op6_decontaminate": op6_decontaminate,
        "op3_quality_classifier": op3_quality_classifier,
        "op10_token_store": op10_token_store,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op4_syncmer_fingerprints": op4_syncmer_fingerprints,
        "op9_preference_chat": op9_preference_chat,
        "op7_mix_sources": op7_mix_sources,
        "op8_secret_scan": op8_secret_scan,
        "op11_sentence_pieces": op11_sentence_pieces,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.DEDUP_SQL,
        "op7_mix_sources": mixing.MIX_SQL,
        "op9_preference_chat": chat.PREFERENCE_SQL,
        "op13_centroid_clusters": centroids.CLUSTER_SQL,
    }
