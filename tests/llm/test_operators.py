"""Each operator against brute force, with nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from cairn.llm import chat, language, media, packing, pieces, pii, quality, simhash, suffix, topk
from cairn.llm.common import connected_components

#: Columns whose names the operators use inside.
EXTRA = "id string, row string, __text string, key string, score string, fp string, ids string"


def table(spark, texts, lang=None):
    rows = [(i, t, (lang or {}).get(i), *["x"] * 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {EXTRA}")


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    return ["", None, " ", "\n\n", "a", "é ü 日本語 🎉", "12 34", words(rng, 30), words(rng, 30), words(rng, 4000), "A" * 3000]


def test_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(1)
    texts = odd_texts() + ["".join(rng.choice("ab e  \n\t▁é日語𝄞thein12.,'\x00") for _ in range(60)) for _ in range(300)]
    texts += ["same text"] * 3 + [" " * 70 + "x"]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(table(spark, texts), path)
    found = {r.id: r.ids for r in got.collect()}
    assert found == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = {r.id: r.text for r in pieces.decode(got, path).collect()}
    assert back == {i: sp.decode(sp.encode(t or "")) for i, t in enumerate(texts)}
    assert pieces.digest(pieces.encode(table(spark, []), path), path).count() == 0


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcde", "bb": "cdefgh", "cc": "xyz"}
    texts, lang = [None, "", "123 !"], {}
    for i in range(240):
        k = rng.choice(sorted(kinds))
        lang[len(texts)] = k if i % 9 else None
        texts.append(" ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(20)))
    docs = table(spark, texts, lang)
    rows = language.identify(docs, keep_row=True).collect()
    assert len(rows) == len(texts)
    by = {r.id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in range(3))
    assert all(by[i].lang_pred == k for i, k in lang.items() if k)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in by)
    assert by[5].row.text == texts[5] and 0 <= by[5].score <= 1
    assert language.identify(docs.limit(0)).count() == 0


def test_language_held_out_rows_teach_nothing(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    texts = ["abc abc" if i not in out else "xyz xyz" for i in range(200)]
    docs = table(spark, texts, {i: "aa" if i not in out else "zz" for i in range(200)})
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"aa"}


def brute_language(rows, texts):
    """Naive Bayes in plain loops over the same kind of features."""
    import math
    from collections import Counter

    mask = (1 << 32) - 1

    def grams(t):
        c = [ord(x) for x in f" {t.lower()} "]
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = 0
                for j, x in enumerate(c[i : i + n]):
                    h = (h + x + j + 1) * 0x9E3779B1 & mask
                    h ^= h >> 15
                yield (h * 0x85EBCA6B & mask) >> 16

    counts, docs = {}, Counter()
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
        docs[lang] += 1
    out = []
    for t in texts:
        ll = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * 65536
            ll[lang] = math.log(docs[lang] / len(rows)) + sum(math.log((c[g] + 0.5) / total) for g in grams(t))
        best = min(ll, key=lambda x: (-ll[x], x))
        out.append((best, 1 / sum(math.exp(ll[x] - ll[best]) for x in ll)))
    return out


def test_language_against_plain_loops(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcdé", "bb": "cdefgh", "cc": "xyza"}
    lang = {i: rng.choice(sorted(kinds)) for i in range(60)}
    texts = [" ".join("".join(rng.choice(kinds[lang[i]]) for _ in range(4)) for _ in range(1 + i % 5)) for i in range(60)]
    taught = [(texts[i], lang[i]) for i in lang if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.id: r for r in language.identify(table(spark, texts, lang)).collect()}
    for i, (name, score) in enumerate(brute_language(taught, texts)):
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-4


def test_what_a_letter_is(spark):
    texts = ["½ ²", "Ⅳ ①", "_", "9", "é", "日", "ª", "ª1", "\U0001d49c", "🎉"]
    rows = table(spark, texts + ["ab"] * 20, {i: "aa" for i in range(len(texts), len(texts) + 20)})
    got = {r.id: r.lang_pred for r in language.identify(rows).collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 4 + ["aa"] * 5 + ["und"]


def test_samples_are_bounded_and_settled(spark):
    df = table(spark, ["t"] * 3000)
    one = sorted(r.doc_id for r in language.sampled(df, "doc_id", 500).collect())
    two = sorted(r.doc_id for r in language.sampled(df.repartition(7), "doc_id", 500).collect())
    assert one == two and 400 < len(one) < 600
    texts, lang = ["abc"] * 300, dict.fromkeys(range(300), "aa")
    assert {r.lang_pred for r in language.identify(table(spark, texts, lang), sample_rows=50).collect()} == {"aa"}


def test_ngram_buckets_do_not_cross_texts():
    texts = ["ab", "c", "déf g", ""]
    all_, counts = language.ngram_buckets(texts)
    ends = np.cumsum(counts)
    for t, a, z in zip(texts, ends - counts, ends):
        one, n = language.ngram_buckets([t])
        assert sorted(all_[a:z]) == sorted(one) and n[0] == z - a


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi\\l < [INST]"), (1, 1, "user", None), (1, 2, "assistant", "</s>[/INST]\\"), (1, 3, "tool<x", "r"),
        (4, 0, "tool>x", "hello"), (4, 1, "a\\g<b>[c]", "\\g > x"),
        (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, None, None, "n"), (3, 1, "system", "b"), (3, 0, "system", "a<sep>"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("t", F.lit(1))
    formatted = chat.format_conversations(df)
    for r in formatted.collect():
        marks = re.sub(r"<role [^>]*>|</role>|</?s>|<sep>|</?out>|<</?SYS>>|\[/?INST\]", "", r.formatted)
        assert "<" not in marks and "[" not in marks
    parsed = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_conversations(formatted).collect()}
    assert parsed[1] == [("user", "hi\\l < [INST]"), ("user", ""), ("assistant", "</s>[/INST]\\"), ("tool<x", "r")]
    assert parsed[2] == [("assistant", "")] * 2 and parsed[None] == [("", "n")]
    assert parsed[3] == [("system", "a<sep>"), ("system", "b")]
    assert parsed[4] == [("tool>x", "hello"), ("a\\g<b>[c]", "\\g > x")]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = odd_texts() + ["it's 5 o'clock <|endoftext|> naïve café"] * 2 + ["a<|startoftext|>b <|ENDOFTEXT|>", "nul \0 in it", "v" * 50_000]
    rows = packing.pack(table(spark, texts).repartition(3), path, capacity=256, window=8, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(r.length == 256 for r in own[:-1]) and [r.start for r in own] == [256 * k for k in range(len(own))]
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(table(spark, []), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    p = packing.Packer(100, 3, 2500, rule, (1.0, 0.5, 0.5))
    used: dict[int, list[int]] = {}
    for _ in range(5):
        sizes = rng.integers(1, 51, 60)
        where, offset = p.add(sizes)
        for n, w in zip(sizes.tolist(), where.tolist()):
            used.setdefault(w, []).append(n)
    assert all(sum(x) <= 100 and len(x) <= 3 and sum(n * n for n in x) <= 2500 for x in used.values())


@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), packing.WEIGHTS])
def test_few_sequences(weights):
    rng = np.random.default_rng(4)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1)
    p = packing.Packer(2048, None, None, "norm", weights)
    for i in range(0, len(sizes), 7000):  # more windows than one, and no sequence with room is given up
        p.add(sizes[i : i + 7000])
    assert p.opened <= 1.002 * sizes.sum() / 2048 + 1


def test_choice_is_the_least_residual():
    rng = np.random.default_rng(5)
    p = packing.Packer(64, 8, 900, "norm", (1.0, 2.0, 3.0))
    bins: list[list[int]] = []
    sizes = rng.integers(1, 30, 80)
    where, _ = p.add(sizes)
    for i in np.argsort(-sizes, kind="stable").tolist():  # every bin is tried
        n = int(sizes[i])
        after = [(64 - sum(b) - n, 8 - len(b) - 1, 900 - sum(x * x for x in b) - n * n) for b in bins]
        fit = [(w, j) for j, r in enumerate(after) if min(r) >= 0 for w in [sum(c * x * x / m**2 for c, x, m in zip((1, 2, 3), r, (64, 8, 900)))]]
        j = min(fit)[1] if fit else len(bins)
        bins += [[]] * (j == len(bins))
        bins[j] = [*bins[j], n]
        assert where[i] == j


def test_slices_of_arrow_arrays():
    import pyarrow as pa

    whole = pa.array(["Ünder the BRIDGE", "two words", None, "café au lait", "x"] * 5)
    for tok in (packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")), pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))):
        want = [x.tolist() for x in tok.ids(whole)]
        got = [x.tolist() for a in range(0, 25, 3) for x in tok.ids(whole[a : a + 3])]
        assert got == want


def brute_fingerprint(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    sh = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,distance", [(3, 3), (5, 6)])
def test_simhash(spark, k, distance):
    rng = random.Random(4)
    base = [words(rng, 300).split() for _ in range(6)]
    texts = odd_texts()
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    texts += [texts[-1]] * 5
    got = simhash.near_duplicates(table(spark, texts), words=k, distance=distance).collect()
    fps = {i: brute_fingerprint(t or "", k) for i, t in enumerate(texts)}
    assert {r.id: r.fp % (1 << 64) for r in got} == fps
    assert {r.id: r.component for r in got} == brute_components(fps, distance)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_dense_cluster_of_fingerprints(spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    cluster = {center}
    while len(cluster) < 3000:
        x = center
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        cluster.add(x)
    apart = {rng.getrandbits(64) for _ in range(500)}
    chain = [rng.getrandbits(64)]
    for i in range(40):
        chain.append(chain[-1] ^ 7 << i)
    signed = [x - (1 << 64) * (x >> 63) for x in cluster | apart | set(chain)]
    for agree in (None, 3):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 3, agree)
        rows = found.collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in rows)
        assert len(rows) < 40 * len(signed)
        fps = {x: x & (1 << 64) - 1 for x in signed}
        roots = {r.node: r.root for r in connected_components(found).collect()}
        near = {x for x, u in fps.items() if u in cluster}
        assert len({roots[x] for x in near}) == 1
        assert len({roots[c - (1 << 64) * (c >> 63)] for c in chain}) == 1


def test_null_ids_name_no_component(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "only")], "doc_id bigint, text string")
    assert sorted((r.component is None, r.component) for r in simhash.near_duplicates(df).collect()) == [
        (False, 7), (False, 7), (True, None),
    ]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300), (None, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 150: 100}


def test_quality(spark):
    rng = random.Random(6)
    texts = odd_texts()
    first = len(texts)
    texts += [words(rng, 60) if i % 2 else words(rng, 30).upper().replace(" ", "!! ") for i in range(300)]
    rows = [(i, (i - first) % 2, 0) for i in range(first, len(texts))] + [(None, 1, 0), (3, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    docs = table(spark, texts)
    got = {r.id: r for r in quality.classify(docs, quality.learn(docs, labels)).collect()}
    held = [i for i in range(first, len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == len(texts) and len(held) > 50
    assert np.mean([got[i].predicted == (i - first) % 2 for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert quality.classify(docs.limit(0), quality.learn(docs, labels)).count() == 0
    quality.learn(docs, labels.limit(0))


def test_pairs_are_learned():
    rng = np.random.default_rng(7)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :2] = rng.random((2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


def test_score_is_a_sum_of_entries():
    rng = np.random.default_rng(8)
    x = rng.random((400, len(quality.FEATURES)))
    m = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, score in zip(x[:50], m.score(x[:50])):
        total = m.intercept
        for k, table_ in enumerate(m.tables):
            total += table_[sum(1 for e in m.edges[k] if e <= row[k])]
        for (i, j), table_ in zip(m.pairs, m.pair_tables):
            total += table_[sum(1 for e in m.coarse[i] if e <= row[i]), sum(1 for e in m.coarse[j] if e <= row[j])]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def brute_tree(g, h, leaves):
    """The best split of any leaf, time after time, every cut tried."""
    parts = [(0, len(g))]
    worth = lambda a, z: sum(g[a:z]) ** 2 / (sum(h[a:z]) + quality.RIDGE)
    while len(parts) < leaves:
        tried = [(worth(a, m) + worth(m, z) - worth(a, z), -a, -m) for a, z in parts for m in range(a + 1, z)]
        gain, a, m = max(tried, default=(0, 0, 0))
        if gain <= 1e-9:
            break
        z = next(z for x, z in parts if x == -a)
        parts = sorted([p for p in parts if p[0] != -a] + [(-a, -m), (-m, z)])
    return [sum(g[a:z]) / (sum(h[a:z]) + quality.RIDGE) for a, z in parts for _ in range(z - a)]


def test_trees_against_all_cuts():
    rng = np.random.default_rng(9)
    for _ in range(50):
        g, h = rng.standard_normal(12), rng.random(12)
        assert np.allclose(quality.tree(g, h, 4), brute_tree(g.tolist(), h.tolist(), 4))


def test_suffix_array():
    rng = random.Random(8)
    for _ in range(1500):
        n, a = rng.randrange(40), rng.choice([1, 2, 3, 8])
        s = [rng.randrange(1, 1 + a) for _ in range(n)]
        s = (s[: rng.randrange(1, 6)] * 8)[:30] if rng.random() < 0.3 else s
        s.append(0)
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_zeros_at_the_end_of_texts(spark):
    p = "p" * 60
    texts = [f"{x * 30}{p}{z}" for x in "abcdefgh" for z in ("", "\0" * 30, "\0" * 90)] + ["\0" * 500, "\0" * 120]
    got = {r.id: r for r in suffix.remove_repeats(table(spark, texts), length=80).collect()}
    raw = [t.encode() for t in texts]
    for i, gone in enumerate(brute_removed(raw, 80)):
        assert got[i].n_removed == sum(gone), i


def brute_removed(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("length,most_items", [(40, 2), (40, 100), (200, 100), (200, 1)])
def test_repeats(spark, length, most_items):
    rng = random.Random(9)
    shared = [words(rng, 40) for _ in range(4)]
    texts = odd_texts()
    for _ in range(60):
        parts = [words(rng, rng.randrange(30)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randrange(60) : 150 + rng.randrange(90)])
        texts.append("é".join(parts))
    texts += [texts[-1]] * 3 + ["xy" * 300, "x" * length, "x" * (length + 1)]
    got = {r.id: r for r in suffix.remove_repeats(table(spark, texts), length=length, most_items=most_items).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute_removed(raw, length))):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(t), sum(gone), spans, kept), i
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_media(spark):
    texts = odd_texts() + ["z" * n for n in (63, 64, 65, 4096, 4097, 33_000)] * 2
    rows = {r.id: r for r in media.read_media(media.write_media(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        p = media.pad((t or "").encode())
        r = rows[i]
        assert len(p) % 64 == 0 and r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest()
        assert r.errors == 0 and len(r.times) == -(-len(p) // media.UNIT) and r.tail_crc32 == zlib.crc32(p[-64:])
        assert len(r.points) == -(-len(r.times) // media.POINTS)
    assert media.read_media(media.write_media(table(spark, []))).count() == 0


def test_broken_media_touch_no_other_row(spark):
    good = media.mux([media.pad(b"q" * 9000)])[0]
    short = good[: 188 * 2]
    no_map = good[:188] + good[2 * 188 :]
    bad_size = bytearray(good)
    bad_size[2 * 188 + 12 + 4] ^= 1
    stored = [good, None, b"", good[:-1], b"x" + good[1:], short, no_map, bytes(bad_size), bytes(188 * 3), good]
    rows = [(i if i else None, 9000, bytearray(m) if m is not None else None, "x") for i, m in enumerate(stored)]
    df = spark.createDataFrame(rows, "id bigint, n_bytes bigint, media binary, error string").coalesce(1)
    got = {r.id: r for r in media.read_media(df).collect()}
    assert [i for i in got if got[i].error is None] == [None, 9]
    assert all(r.payload_bytes == (0 if r.error else 9024) for r in got.values())
    assert media.read_media(df.limit(0)).count() == 0
    rng = random.Random(1)
    for _ in range(300):  # whatever bytes are damaged, only ValueError is raised
        m = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            m[rng.randrange(len(m))] = rng.randrange(256)
        media.demuxed([bytes(m), good])


def test_times_wrap_at_33_bits():
    ticks = np.array([0, (1 << 33) - 1, 1 << 32])
    raw = media.stamp(ticks).astype(np.int64)
    back = (raw[:, 0] & 0x0E) << 29 | raw[:, 1] << 22 | (raw[:, 2] & 0xFE) << 14 | raw[:, 3] << 7 | raw[:, 4] >> 1
    assert back.tolist() == ticks.tolist()


def test_media_is_checked():
    good = media.mux([media.pad(b"q" * 9000)])[0]
    assert media.demux([good])[0]["payload"].rstrip(b"\0") == b"q" * 9000
    twice = good[: 3 * 188] + good[2 * 188 : 3 * 188] + good[3 * 188 :]
    assert media.demux([twice])[0]["payload"] == media.demux([good])[0]["payload"]  # a repeated packet is skipped
    bumped = bytearray(good)
    bumped[10 * 188 + 3] ^= 5
    assert media.demux([bytes(bumped)])[0]["errors"] > 0
    with pytest.raises(ValueError):
        media.demux([good[:188] + b"\0" + good[189:]])
    broken = bytearray(good)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        media.demux([bytes(broken)])


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub(r"\D", "", x)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub(r"\D", "", x)) <= 15),
]


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    rng = random.Random(10)
    bits = ["a@b.c", "x.y@z", "d@e.f-g.h@i.j", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 010-9999", "+12", "é", " ", "\n", "@", "++", "12", "a_b@c.d", "0" * 14, "ab", "-", "."]
    texts = odd_texts() + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["mail me a@b.co " * 300, "9" * 5000, "+1" * 2000, "a" * 4000 + "@"]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in pii.report(pii.find(docs, pii.fit(docs))).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t or "", re.A) if ok(m.group())]
        said = ",".join(f"{BASE[k][0]}:{a}:{z}" for a, k, z in sorted(found))
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, r.spans)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in found) for k in range(4)]
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_secrets(spark):
    rng = random.Random(12)
    texts = odd_texts() + [f'and token = "{rng.getrandbits(160):040x}" {words(rng, 9)}' for _ in range(20)]
    texts += [f"{words(rng, 9)} of 123456789012345 here, version-2-of-something {words(rng, 5)}" for _ in range(40)]
    docs = table(spark, texts)
    found = pii.find(docs, pii.fit(docs))
    rows = {r.doc_id: r for r in pii.report(found).collect()}
    assert [i for i, r in rows.items() if "secret:" in r.spans] == [i for i, t in enumerate(texts) if t and "token =" in t]
    clean = {r.doc_id: r.text for r in found.select("row.doc_id", pii.redacted().alias("text")).collect()}
    assert clean == {i: re.sub('"[0-9a-f]{40}"', '"<secret>"', t or "") for i, t in enumerate(texts)}


def test_top_k(spark):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((300, 64))
    vectors[50:90] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist()), (300, None), (None, vectors[0].tolist()), (301, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit("x"))
    got = topk.nearest(df, df.where("vec_id % 20 = 0"), k=7).collect()
    codes = (vectors > 0).astype(int)
    for q in range(0, 300, 20):
        d = (codes != codes[q]).sum(axis=1)
        want = sorted((int(x), i) for i, x in enumerate(d) if i != q)[:7]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert len(got) == 15 * 7
    assert topk.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 96, 200])
def test_top_k_of_any_size(spark, size):
    rng = np.random.default_rng(size)
    vectors = rng.standard_normal((200, size))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, vectors[1].tolist()[:-1]), (201, [float("nan")] * size)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    codes = np.zeros((202, size), int)
    codes[:200] = vectors > 0
    codes[200, : size - 1] = codes[1, : size - 1]
    for q in range(0, 202, 20):
        want = sorted((int((codes[q] != c).sum()), i) for i, c in enumerate(codes) if i != q)[:5]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_secret_candidates_of_late_second_kind(spark):
    texts = [f"key = {'q' * 70}7 end", f"key = {'5' * 200}x end", "q" * 70, "5" * 70, "a" * 2_000_000 + "1", "ab-" * 500_000]
    rows = table(spark, texts).select("doc_id", F.col("text").alias("__text"))
    got = {r.doc_id: [(c.start, c.stop) for c in r.candidates] for r in pii.described(rows).collect()}
    assert got == {0: [(6, 77)], 1: [(6, 207)], 2: [], 3: [], 4: [(0, 2_000_001)], 5: []}
