"""A pipeline over documents: each stage applies one operator to all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import language, packing, pii, similar, suffix
from cairn.llm.common import release, shared_dir, written
from cairn.llm.queries import tokenizer_path

#: A document whose language is less likely than this is rejected.
LEAST_SCORE = 0.5
#: Words of a shingle; texts that share ``similar.LEAST`` of their shingles, 0.8, are near-duplicates.
WORDS = 5
CAPACITY = 2048


def with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``row`` with another text, and its number of characters."""
    made = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those of no likely language.

    What was learned of a row's own label never decides on it: labels are no input of a prediction.
    Repeated rows and repeated or null ids are judged row by row. An empty table stays empty.
    """
    found = language.identify(docs, keep_row=True)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the one with the smallest id, by the text's hash where ids are equal.

    SimHash blocks find most of what belongs together, a prefix filter the rest; every link is verified
    on whole shingle sets. A row without an id stays only where its whole group has none. Ids need not
    be unique: rows of one id with different texts are judged apart; of rows equal in id and text one
    stays. An empty table stays empty.
    """
    groups = similar.near_duplicates(docs, words=WORDS)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")).alias("first")
    stay = groups.groupBy("root").agg(first).select(F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    named = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h")), "left_semi")
    return named.dropDuplicates(["doc_id", "__h"]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; every document stays, perhaps with an empty text.

    Null texts become empty. Rows are judged whatever their ids; an empty table stays empty.
    """
    return with_text(suffix.remove_repeats(docs, keep_row=True), docs.columns, F.col("kept"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``<kind>`` in the place of each span of personal data; every document stays.

    Null texts become empty. Rows are judged whatever their ids; an empty table stays empty.
    """
    return with_text(pii.find(docs, pii.fit(docs)), docs.columns, pii.redacted())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences of ``CAPACITY`` tokens.

    Null and empty texts are one piece of the closing token alone; ids are passed on, repeated or
    null; an empty table gives no row.
    """
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=CAPACITY)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the language model nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents are written to the shared folder; what one
    stage wrote goes once the next has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{folder}/{name}")
            if before is not None:
                release(before)
            before = docs
    return docs
