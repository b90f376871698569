"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_batches

UNKNOWN = "und"
#: Rows to learn from at most, about, of those allowed; which ones is settled by a hash of the id.
SAMPLE_ROWS = 20_000
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Code points handled at once within a batch.
TOGETHER = 1 << 20
PLAIN_LETTER = re.compile("[A-Za-z]")


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` of the rows at most, chosen by a hash of ``key``: the same ones wherever they lie."""
    n = rows.count()
    if n <= most:
        return rows
    grain = 1 << 30
    return rows.where(F.pmod(F.xxhash64(key), F.lit(grain)) < int(grain * most / n))


def has_letter(text: str) -> bool:
    """Whether a character is a letter by Unicode, of whatever script; numbers like ½ are none."""
    return bool(PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of all texts, and how many each text has (a sparse matrix's rows).

    Each text is lower-cased and stands between two spaces, so that no n-gram crosses texts.
    """
    parts = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    found, counts = [], np.zeros(len(texts), np.int64)
    keep = np.ones(len(codes), bool)
    h = np.zeros(len(codes), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    rows = []
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            keep = keep[: len(codes) - n + 1].copy()
            inner = ends[:-1] - n + 1  # the n-gram that begins here is the first to cross
            keep[inner[(inner >= 0) & (inner < len(keep))]] = False
            h = h[: len(keep)]
        h = (h + codes[n - 1 : n - 1 + len(h)] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if n in ORDERS:
            found.append((h[keep] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
            rows.append(row[: len(keep)][keep])
    for r in rows:
        counts += np.bincount(r, minlength=len(texts))
    if len(texts) == 1:
        return np.concatenate(found), counts
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(found)[order], counts


def runs(texts: list[str]) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from all ``rows``: counts by language and bucket are summed on the executors.

    What comes to the driver is a count for each language and bucket, whatever the rows. Rows with a
    null text or language teach nothing; without any row the model knows no language.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        total = np.zeros((len(names), 1 << BUCKET_BITS), np.int64)
        docs = np.bincount([names.index(x) for x in langs], minlength=len(names))
        for k, name in enumerate(names):
            own = [t for t, x in zip(texts, langs) if x == name]
            for a, z in runs(own):
                total[k] += np.bincount(ngram_buckets(own[a:z])[0], minlength=1 << BUCKET_BITS)
        k, b = np.nonzero(total)
        # bucket -1 counts the documents
        ks, bs = np.r_[k, np.arange(len(names))], np.r_[b, np.full(len(names), -1)]
        n = np.r_[total[k, b], docs]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, object)[ks], pa.string()), pa.array(bs, pa.int32()), pa.array(n, pa.int64())],
            ["lang", "bucket", "n"],
        )

    picked = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    counts = map_batches(picked, count, "lang string, bucket int, n bigint")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got.lang.unique())
    table = np.full((1 << BUCKET_BITS, len(languages)), smoothing)
    prior = np.zeros(len(languages))
    at = got.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = got.bucket.to_numpy(), got.n.to_numpy()
    table[bucket[bucket >= 0], at[bucket >= 0]] += n[bucket >= 0]
    prior[at[bucket < 0]] = n[bucket < 0]
    log_prior = np.log(prior / prior.sum()) if len(prior) else prior
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), log_prior)


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    out = np.empty((len(texts), len(model.languages)))
    for a, z in runs(texts):
        buckets, counts = ngram_buckets(texts[a:z])
        starts = np.cumsum(counts) - counts
        for k in range(len(model.languages)):
            out[a:z, k] = np.add.reduceat(model.log_prob[:, k][buckets], starts, dtype=np.float64)
    return out + model.log_prior


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False
) -> DataFrame:
    """``(id, lang_pred, score)`` per row; with ``keep_row`` also ``row``, all columns as a struct.

    ``score`` is the posterior probability of the language named; of equal ones the first by name.
    Text that is null or has no letter, and any text where no language was learned, is ``und``
    with score 0. Texts are read whole. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, batch.column(0).to_pylist()
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and m.languages and has_letter(t)]
        if known:
            ll = log_likelihoods(m, [texts[i] for i in known])
            p = np.exp(ll - ll.max(axis=1, keepdims=True))
            best = ll.argmax(axis=1)
            score[known] = p[np.arange(len(known)), best] / p.sum(axis=1)
            for i, k in zip(known, best):
                lang[i] = m.languages[k]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(lang), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"]
        )

    row = [F.struct(*docs.columns).alias("row")] * keep_row
    picked = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *row)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return map_batches(picked, one, f"{kinds}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep_row: bool = False,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Learn from the rows that are not held out and predict all; adds ``held_out``.

    Rows without a text or a language teach nothing, nor do those whose id leaves 2 of 4 by crc32; a
    null id is not held out. About ``sample_rows`` rows at most teach, chosen by a hash of the id, so
    that what is learned does not depend on how rows lie. Repeated rows are predicted each, alike.
    Columns of any name ride along in ``row``. An empty table gives no row; a table without a row to
    learn from gives ``und`` throughout.
    """
    allowed = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), 4, 2))
    model = fit(sampled(allowed, id_col, sample_rows), text_col, lang_col)
    return predict(docs, model, id_col, text_col, keep_row).withColumn("held_out", held_out(F.col("id"), 4, 2))
