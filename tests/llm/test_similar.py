import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import xxhash
from cairn.llm import similar


def brute(texts, words=5):
    """The components of all pairs of a similarity of 0.8 or more, over the words themselves."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                linked += a != b
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], linked


def texts():
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    out, license_ = ["", None, " ", "a", "A", "one two three", "one two three four five six"], words(60)
    for n in (40, 120, 400):
        for _ in range(8):
            base = words(n)
            for edits in (0, 1, 1, n // 60, n // 50, n // 45, n // 40, n // 20):
                c = list(base)
                for _ in range(edits):
                    c[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                out.append(" ".join(c))
    out += [" ".join(license_ + words(k % 25)) for k in range(80)]
    return out


def test_every_pair_at_the_bound_is_linked(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    groups = {}
    for r in similar.near_duplicates(df).collect():
        groups.setdefault(r.root, []).append(r.id)
    want, linked = brute(rows)
    assert linked > 300
    assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(want))
    cols = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    kept = corpus_pipeline.drop_near_duplicates(spark, cols, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_common_shingles_change_the_order_only():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a = np.unique(pool[: rng.integers(1, 60)])
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], pool[80 : 80 + rng.integers(0, 5)]])
        common = np.unique(rng.choice(pool, rng.integers(0, 40)))
        counts = rng.integers(4, 9, len(common))
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            p, q = (similar.prefix(x, common, counts, Fraction(4, 5)) for x in (a, b))
            assert len(np.intersect1d(p, q))
        differ = np.bitwise_count((similar.sketch(a) ^ similar.sketch(b)).view(np.uint64)).sum()
        assert differ <= len(a) + len(b) - 2 * shared


def join_rows(spark, run):
    """What ``run`` returns, and the most rows that a join made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, done = 0, store.executionsList(int(before), 1 << 30)
    for i in range(done.size()):
        at = done.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_near_copies_whose_least_is_far_from_most(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, rows = words(140), []
    for k in range(500):
        c = list(base)
        for _ in range(1 + k % 8):
            c[rng.randrange(140)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(c))
    # the least node is a copy that is linked to few
    node = lambda t: xxhash.xxh64_intdigest(similar.shingle_set(t.encode(), 5).tobytes(), similar.SEED) ^ 1 << 63
    least = min(map(node, rows))
    while True:
        c = list(base)
        for at in rng.sample(range(140), 6):
            c[at] = f"y{rng.randrange(10**6)}"
        if node(" ".join(c)) < least:
            break
    rows.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    got, most = join_rows(spark, lambda: similar.near_duplicates(df).collect())
    groups = {}
    for r in got:
        groups.setdefault(r.root, []).append(r.id)
    want, linked = brute(rows)
    assert linked > 5_000 and len(set(want)) > 10
    assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(want))
    assert most < 40 * len(rows), most
