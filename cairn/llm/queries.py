"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import chat, language, media, packing, pieces, pii, quality, simhash, suffix, topk
from cairn.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), path)
    return pieces.digest(encoded, path).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_case(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(turns))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return packed.withColumnRenamed("id", "doc_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select(
        F.col("id").alias("doc_id"), language.held_out(F.col("id"), 3, 1).alias("held_out"), "score", "predicted"
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.write_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), "packets"),
        F.concat(F.lit("units="), F.size("times")),
        F.concat(F.lit("points="), F.array_join("points", ",")),
        F.concat(F.lit("last_pts="), F.element_at("times", -1)),
        F.concat(F.lit("errors="), "errors"),
    )
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, pii.fit(docs)))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.nearest(rows, rows.where("vec_id % 20 = 0"), k=10)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_pii": op9_pii,
    "op10_exact_top_k": op10_exact_top_k,
}

ORACLE_SQL = {"op3_chat_format": chat.SQL, "op7_suffix_array_dedup": suffix.SQL, "op10_exact_top_k": topk.SQL}
