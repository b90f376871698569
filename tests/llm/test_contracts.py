"""The registered queries on the smallest tables: their columns and rows by plain means."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from cairn.llm import queries

from tests.llm.test_operators import BASE, brute_components, brute_fingerprint, brute_removed

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{DIR}/documents.parquet'").fetchall()
    return {i: (t or "", lang) for i, t, lang in rows}


def run(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    return df, {r[0]: r for r in df.collect()}


def columns(df, wanted):
    assert [f"{n} {t}" for n, t in df.dtypes] == wanted.split(", ")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, docs):
    _, rows = run(spark, "op1_sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(rows) == set(docs)
    for i, (t, _) in docs.items():
        ids = sp.encode(t)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (rows[i].n_ids, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(raw), sha(sp.decode(ids).encode()))


def test_op2(spark, docs):
    df, rows = run(spark, "op2_language_id")
    columns(df, "doc_id bigint, held_out boolean, lang_pred string, score double")
    assert set(rows) == set(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in rows.items() if r.held_out) == sorted(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    known = [i for i in held if docs[i][1] and rows[i].lang_pred != "und"]
    assert sum(rows[i].lang_pred == docs[i][1] for i in known) >= 0.95 * len(known) > 0


def test_op4(spark, docs):
    df, _ = run(spark, "op4_best_fit_packing")
    columns(df, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    rows = df.collect()
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = set(), 0
    for i, (text, _) in docs.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.add((i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(by) <= -(-total // 2048) + df.rdd.getNumPartitions()


def test_op5(spark, docs):
    df, rows = run(spark, "op5_simhash_near_dedup")
    columns(df, "doc_id bigint, fingerprint string, component_id bigint")
    fps = {i: brute_fingerprint(t, 3) for i, (t, _) in docs.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(fps, 3)


def test_op6(spark, docs):
    df, rows = run(spark, "op6_quality_classifier")
    columns(df, "doc_id bigint, held_out boolean, score double, predicted int")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    assert set(rows) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [i for i in labels if i in rows and rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.8 * len(held) > 0


def test_op7(spark, docs):
    df, rows = run(spark, "op7_suffix_array_dedup")
    columns(df, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    ids, raw = list(docs), [t.encode() for t, _ in docs.values()]
    for i, t, gone in zip(ids, raw, brute_removed(raw, 200)):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert tuple(rows[i])[1:] == (len(t), sum(gone), spans, sha(kept)), i


def test_op8(spark, docs):
    df, rows = run(spark, "op8_media_columns")
    columns(
        df,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint,"
        " media_sha256 string, feature string",
    )
    by_text = {}
    for i, (t, _) in docs.items():
        raw, r = t.encode(), rows[i]
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), sha(padded))
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes % 188 == 0 and r.feature.endswith("errors=0")
        assert by_text.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]


def test_op9(spark, docs):
    df, rows = run(spark, "op9_pii")
    columns(df, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    for i, (t, _) in docs.items():
        found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t, re.A) if ok(m.group())]
        count = Counter(k for _, k, _ in found)
        assert tuple(rows[i])[1:5] == tuple(count[k] for k in range(4))
        said = [f"{BASE[k][0]}:{a}:{z}" for a, k, z in sorted(found)]
        assert rows[i].base_sha256 == sha(",".join(said).encode()) and set(said) <= set(rows[i].spans.split(",")) | set()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(r) for r in df.select(names).collect()), key=key) == sorted(got.fetchall(), key=key)
