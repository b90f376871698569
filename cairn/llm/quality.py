"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature after the other, in turns, on binned features, and add
up to one lookup table per feature; pairs of features get a table each in the same way. A score is
then a sum of table entries.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_batches
from cairn.llm.language import held_out, sampled

#: Labelled rows to learn from at most, about.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 60, 30, 0.15, 4, 1.0

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
HIGH = np.arange(256) >= 128
MARK = ~(UPPER | LOWER | DIGIT | SPACE | HIGH)
CLASSES = np.stack([UPPER, DIGIT, SPACE, HIGH, MARK]).astype(float)
FEATURES = (
    "log_bytes upper digits space high marks commas stops bars top_mark word_length word_spread distinct_words"
    " repeated_words distinct_lines line_length compressed marked_words"
).split()
MARKS = np.flatnonzero(MARK)
#: Text compressed at a time; the ratio is of all of it.
PART = 1 << 16


def features(text: bytes) -> list[float]:
    """What is known of a whole text; an empty one has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, space, high, marks = (CLASSES @ bytes_ / n).tolist()
    words = text.split()
    count = max(1, len(words))
    sizes = np.array([len(w) for w in words] or [0])
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    packed = sum(len(zlib.compress(text[i : i + PART], 1)) for i in range(0, n, PART))
    marked = sum(1 for w in words if w[-1] in b"!*&%$#|;:" or w[0] in b"!*&%$#|<{")
    return [
        float(np.log1p(n)),
        upper,
        digits,
        space,
        high,
        marks,
        float(bytes_[44]) / count,
        float(bytes_[46]) / count,
        float(bytes_[124]) / count,
        float(bytes_[MARKS].max()) / n,
        float(sizes.mean()),
        float(sizes.std()),
        len(set(words)) / count**0.8,
        repeated / count,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        packed / n,
        marked / count,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: bins are looked up and their entries added."""
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[
                np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step function of up to ``leaves`` steps over ordered bins, split greedily by Newton gain."""
    cuts = [0, len(g)]
    sg, sh = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, z: (sg[z] - sg[a]) ** 2 / (sh[z] - sh[a] + RIDGE)
    while len(cuts) <= leaves:
        best, where = 1e-9, None
        for a, z in zip(cuts, cuts[1:]):
            if z - a > 1:
                m = np.arange(a + 1, z)
                gain = worth(a, m) + worth(m, z) - worth(a, z)
                if gain.max() > best:
                    best, where = gain.max(), int(m[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, z in zip(cuts, cuts[1:]):
        out[a:z] = (sg[z] - sg[a]) / (sh[z] - sh[a] + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross of one cut on either feature: four steps, and its gain."""
    sg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sh = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return np.zeros_like(g), 0.0

    def corners(s):
        a, b, c, d = s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], 0
        return a, b, c, s[-1, -1] - a - b - c - d

    gain = sum(x**2 / (y + RIDGE) for x, y in zip(corners(sg), corners(sh)))
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    a, b = a + 1, b + 1
    out = np.empty_like(g)
    for rows in (slice(None, a), slice(a, None)):
        for cols in (slice(None, b), slice(b, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return out, float(gain.max() - sg[-1, -1] ** 2 / (sh[-1, -1] + RIDGE))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables; without rows, or with one label only, scores are that label's share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [edges_of(x[:, k], BINS) for k in range(x.shape[1])]
    coarse = [edges_of(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Model(edges, coarse, tables, [], [], base)
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            n = len(tables[k])
            step = RATE * tree(np.bincount(b, g, n), np.bincount(b, h, n), LEAVES)
            tables[k] += step
            total += step[b]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def sums(i, j):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = small[i] * shape[1] + small[j]
        g, h = slopes()
        size = shape[0] * shape[1]
        return np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape), at

    gains = {(i, j): pair_tree(*sums(i, j)[:2])[1] for i, j in combinations(range(x.shape[1]), 2)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            g, h, at = sums(i, j)
            step = RATE * pair_tree(g, h)[0]
            pair_tables[k] += step
            total += step.ravel()[at]
    return Model(edges, coarse, tables, pairs, pair_tables, base)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(picked, one, f"id {kind}, x array<double>")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on labelled rows that are not held out, about ``sample_rows`` of them at most.

    Labels of one id are averaged, 0.5 counting as 1; null ids and labels teach nothing. An id that
    stands on several documents labels each. Without a labelled document every score is one half.
    Only the features of the sample come to the driver.
    """
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    )
    chosen = sampled(marked, "id", sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded, so each task can hold its ids.
    got = described(texts.join(F.broadcast(chosen), "id", "left_semi"), "id", "text").join(F.broadcast(chosen), "id")
    rows = got.select("x", "y").toPandas()
    x = np.array(rows.x.tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort(np.c_[x, rows.y.to_numpy(float)].T)  # rows come in any order
    return fit(x[order], rows.y.to_numpy(float)[order])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` per row; null text is an empty one, and empty texts score too.

    Repeated rows stay, a null id stays null, other columns are ignored, an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())])
        s = shared.value.score(x)
        cols = [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["id", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(picked, one, f"id {kind}, score double, predicted int")
