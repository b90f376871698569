import random

import corpus_pipeline
from cairn.llm import packing, queries


def documents(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "ve", "lo", "mi"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, copy = text(80), text(120)
    rows = [(0, "123 456", "en"), (1, None, "en"), (2, copy, "en"), (3, copy, "en"), (4, text(60) + " " + shared, "en")]
    rows += [(5, shared + " " + text(60), "en"), (6, f"{text(50)} mail me at some.one@example.com {text(20)}", "en"), (6, "", None)]
    rows += [(10 + i, text(100), "en") for i in range(30)]
    df = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return df


def test_stages(spark, tmp_path):
    docs = documents(spark, tmp_path)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {n: sorted(r.doc_id for r in rows) for n, rows in kept.items()}
    assert ids["language_id"] == [2, 3, 4, 5, 6, *range(10, 40)]
    assert ids["simhash_near_dedup"] == [2, 4, 5, 6, *range(10, 40)]
    texts = {r.doc_id: r for r in kept["suffix_array_dedup"]}
    assert len(texts[4].text) < 430 and texts[4].n_chars == len(texts[4].text)
    clean = {r.doc_id: r.text for r in kept["pii"]}
    assert "<email>" in clean[6] and "example.com" not in clean[6]
    assert sorted({r.doc_id for r in kept["best_fit_packing"]}) == ids["pii"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["best_fit_packing"])


def test_registry():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_duplicates_keep_a_row_of_each_group(spark):
    one, other, third = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, one), (5, other), (3, one), (None, other), (None, third), (None, third), (None, third + " end"), (9, "z"), (9, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert ids == [(False, 3), (False, 5), (False, 9), (True, 0)]
    assert {r.doc_id: r.text for r in kept if r.doc_id} == {3: one, 5: other, 9: "z"}


def test_each_stage_on_the_smallest_table(spark):
    """Every stage against plain means, on all that the one before it kept."""
    import re

    import public_tokenizers
    import tokenizers

    from tests.llm.test_operators import BASE, brute_removed
    from tests.llm.test_similar import brute

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        rows = stages[name](spark, docs, folder).collect()
        docs = spark.createDataFrame(rows, docs.schema) if name != "best_fit_packing" else docs
        return rows

    kept = {r.doc_id: r.text for r in step("language_id")}
    assert all(any(map(str.isalpha, t)) for t in kept.values()) and all(texts[i] == t for i, t in kept.items())
    assert all(i in kept for i, t in texts.items() if len(re.findall(r"[^\W\d_]{3,}", t)) >= 20)

    order = sorted(kept)
    groups, _ = brute([kept[i] for i in order])
    single = {r.doc_id: r.text for r in step("simhash_near_dedup")}
    assert sorted(single) == [order[i] for i in sorted(set(groups))]

    order = sorted(single)
    raw = [single[i].encode() for i in order]
    cut = {r.doc_id: (r.text, r.n_chars) for r in step("suffix_array_dedup")}
    assert sorted(cut) == order
    for i, t, gone in zip(order, raw, brute_removed(raw, 200)):
        left = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert cut[i] == (left, len(left))

    clean = {r.doc_id: r.text for r in step("pii")}
    assert sorted(clean) == order
    for i, t in clean.items():
        before = cut[i][0]
        spans = [m.span() for _, p, ok in BASE for m in re.finditer(p, before, re.A) if ok(m.group())]
        assert all(before[a:z] not in t or before.count(before[a:z]) > len(spans) for a, z in spans)
        marks = len(re.findall("<(?:email|ip|card|phone|secret)>", t))
        assert (t == before) if not marks else marks >= bool(spans)

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed, used = {}, {}
    for r in step("best_fit_packing"):
        packed.setdefault(r.doc_id, []).append(r.length)
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert {i: sum(n) for i, n in packed.items()} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in clean.items()}
    assert max(used.values()) <= 2048


def test_empty_tables_stay_empty(spark, tmp_path):
    docs = documents(spark, tmp_path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_nulls_in_any_column_pass_every_stage(spark):
    rows = [(None, "some words of a text", None, None, None), (1, None, None, None, None), (1, "some words of a text", "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.text for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {"some words of a text"}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text is None) for r in kept) == [(1, False), (1, True)]
    assert corpus_pipeline.drop_repeats(spark, docs, "").count() == 6
    assert corpus_pipeline.redact_personal_data(spark, docs, "").count() == 6
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 6


def test_workers_drop_what_packing_learned_once_they_do_other_work(spark):
    import sys

    import public_tokenizers
    import pyarrow as pa

    from cairn.llm.common import map_batches

    def held(batch):
        known = getattr(sys.modules.get("cairn.llm.packing"), "_tokenizers", {}).values()
        kept = getattr(sys.modules["cairn.llm.common"], "_learned", {}).values()
        n = sum(len(t.known) for t in [*known, *kept])
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(400)], "doc_id bigint, text string").repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    before = sorted(map(tuple, packing.pack(docs, path).select("id", "length", "ids_crc32").collect()))
    tasks = spark.range(0, 64, 1, 16)
    assert {r.n for r in map_batches(tasks, held, "n bigint").collect()} == {0}
    assert sorted(map(tuple, packing.pack(docs, path).select("id", "length", "ids_crc32").collect())) == before
