"""Personal data, with DataFrame functions only.

Four kinds have fixed patterns. Further spans, of kind ``secret``, come from weak supervision:
regular-expression, gazetteer and context labelers vote on candidate tokens, expectation-
maximisation estimates how reliable each labeler is, and a span classifier is trained on the
posteriors. The counts of votes and features are the corpus's; their number of kinds is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each matches what its plain pattern does, leftmost and without overlap, in time linear in the
#: text: where a run of characters can only match from its beginning (or from where the match
#: before ended), a look-behind says so, and possessive counts spare returns that cannot succeed.
#: A card has 12 digits at least, so a shorter run is no match to begin with.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "secret"]
#: A token of letters, digits, - and _ with a digit and a letter anywhere. Only where a run begins
#: does anything look ahead, and never past the run, so this is linear too.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+"
GAZETTEER = ("password", "passwd", "passphrase", "pwd", "token", "secret", "apikey", "api_key", "api-key", "credential", "bearer")
CONTEXT = 24
BLOCK = 64


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(number) - 1), F.lit(0), add) % 10 == 0


def accepted(kind: str, hit: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.char_length(p) < 3) | (F.char_length(p) == 3) & (p <= "255"))
    if kind == "card":
        n = F.char_length(digits(hit))
        return F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(hit)).between(9, 15)
    return F.lit(True)


def starts(gaps: Column, hits: Column) -> Column:
    """Where each hit begins: sums of the lengths before it, by blocks, so that many stay cheap."""
    n = F.size(hits)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: g + F.char_length(h))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.transform(blocks, lambda b: total(F.slice(sums, F.lit(1), b)))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(before, F.floor(i / BLOCK).cast("int"))
        + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        + F.get(gaps, i),
    )


SPAN = "array<struct<start:int,rank:int,stop:int>>"


def spans(kind: str) -> Column:
    """(start, rank of the kind, stop) of accepted hits, in code points."""
    hits, places = F.col(f"{kind}_hits"), F.col(f"{kind}_starts")
    all_ = F.zip_with(
        hits,
        places,
        lambda h, s: F.struct(
            s.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s + F.char_length(h)).alias("stop"), h.alias("text")
        ),
    )
    kept = F.filter(all_, lambda x: accepted(kind, x["text"]))
    out = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop")))
    return F.when(F.size(hits) > 0, out).otherwise(F.array().cast(SPAN))


def hits(kind: str, pattern: str, guard: Column) -> Column:
    found = F.regexp_extract_all("__text", F.lit(pattern), 0)
    return F.when(guard, found).otherwise(F.array().cast("array<string>")).alias(f"{kind}_hits")


def gaps(kind: str, pattern: str) -> Column:
    lengths = F.transform(F.split("__text", pattern, -1), F.char_length)
    return F.when(F.size(f"{kind}_hits") > 0, lengths).alias(f"{kind}_gaps")


def located(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds ``<kind>_hits`` and ``<kind>_starts`` for each pattern."""
    digit = F.col("__text").rlike("[0-9]")
    guards = {"email": F.col("__text").contains("@"), "phone": F.col("__text").contains("+")}
    rows = rows.select("*", *[hits(k, p, guards.get(k, digit)) for k, p in kinds.items()])
    rows = rows.select("*", *[gaps(k, p) for k, p in kinds.items()])
    return rows.select(
        "*",
        *[
            F.when(F.size(f"{k}_hits") > 0, starts(F.col(f"{k}_gaps"), F.col(f"{k}_hits"))).alias(f"{k}_starts")
            for k in kinds
        ],
    )


VOTES = ("hex", "gazetteer", "assigned", "shape")
TRAITS = ("length", "digit_share", "quoted", "case")


def described(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: place, votes (-1, 0, 1) and traits of each candidate token."""
    rows = located(rows, {"token": TOKEN})
    before = F.when(F.size("token_hits") > 0, F.split("__text", TOKEN, -1))

    def one(i: Column) -> Column:
        hit, start = F.get("token_hits", i), F.get("token_starts", i)
        left = F.lower(F.right(F.get("token_before", i), F.lit(CONTEXT)))
        right = F.left(F.get("token_before", i + 1), F.lit(1))
        n, k = F.char_length(hit), F.char_length(digits(hit))
        named = F.lit(False)
        for word in GAZETTEER:
            named = named | left.contains(word)
        return F.struct(
            start.alias("start"),
            (start + n).alias("stop"),
            F.when(hit.rlike("^[0-9]+$"), -1)
            .when(hit.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & (n >= 16), 1)
            .otherwise(0)
            .alias("hex"),
            F.when(named, 1).otherwise(-1).alias("gazetteer"),
            F.when(left.rlike(r"[=:]\s*[\"']?$"), 1).when(left.rlike(r"[\w.,;]\s+$"), -1).otherwise(0).alias("assigned"),
            F.when((n >= 16) & k.between(2, n - 2), 1).when(k < 2, -1).otherwise(0).alias("shape"),
            F.least(F.floor(n / 8), F.lit(6)).cast("int").alias("length"),
            F.floor(4 * k / n).cast("int").alias("digit_share"),
            right.isin('"', "'").cast("int").alias("quoted"),
            (hit.rlike("[A-Z]").cast("int") + 2 * hit.rlike("[a-z]").cast("int")).alias("case"),
        )

    listed = F.transform(F.sequence(F.lit(0), F.size("token_hits") - 1), one)
    kind = "start:int,stop:int," + ",".join(f"{c}:int" for c in VOTES + TRAITS)
    return rows.withColumn("token_before", before).withColumn(
        "candidates", F.when(F.size("token_hits") > 0, listed).otherwise(F.array().cast(f"array<struct<{kind}>>"))
    )


@dataclass
class Model:
    """Log-odds of a candidate being personal data: a constant and one weight for each trait's value."""

    constant: float
    weights: dict[str, dict[int, float]]
    reliability: dict[str, dict[tuple[int, int], float]]

    def log_odds(self, c: Column) -> Column:
        out = F.lit(self.constant)
        for trait, by in self.weights.items():
            w = F.lit(0.0)
            for value, weight in by.items():
                w = F.when(c[trait] == value, weight).otherwise(w)
            out = out + w
        return out


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], float, dict]:
    """Posterior of each pattern of votes, the share of positives, and P(vote | class) per labeler.

    It starts from the labelers' majority; a labeler's table is smoothed by one count per vote. A
    labeler is taken to be no worse than chance: where its votes would tell against what they say,
    they tell nothing.
    """
    total = sum(counts.values())
    post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in counts}
    share, tables = 0.5, {}
    for _ in range(rounds):
        share = (sum(post[v] * n for v, n in counts.items()) + 1) / (total + 2)
        tables = {}
        for j, name in enumerate(VOTES):
            by = {(y, x): 1.0 for y in (0, 1) for x in (-1, 0, 1)}
            for v, n in counts.items():
                by[1, v[j]] += post[v] * n
                by[0, v[j]] += (1 - post[v]) * n
            if by[1, 1] * (by[0, 0] + by[0, -1]) < by[0, 1] * (by[1, 0] + by[1, -1]):
                by = {(y, x): by[0, x] + by[1, x] for y, x in by}
            tables[name] = {(y, x): c / sum(by[y, z] for z in (-1, 0, 1)) for (y, x), c in by.items()}
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(
                math.log(tables[name][1, x] / tables[name][0, x]) for name, x in zip(VOTES, v)
            )
            post[v] = 1 / (1 + math.exp(-max(-500, min(500, odds))))
    return post, share, tables


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count votes and traits over all candidates of all texts, then estimate and train.

    The driver gets one row per kind of candidate: 54 patterns of votes times 320 of traits at most.
    Repeated rows count each; null texts have no candidate; other columns are ignored; without any
    candidate, an empty table among such, the classifier has a constant alone and finds nothing.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    each = described(rows).select(F.explode("candidates").alias("c")).select(*[f"c.{c}" for c in VOTES + TRAITS])
    got = [tuple(r) for r in each.groupBy(*VOTES, *TRAITS).count().collect()]
    counts: dict[tuple, int] = {}
    for r in got:
        v = r[: len(VOTES)]
        counts[v] = counts.get(v, 0) + r[-1]
    post, share, tables = expectation_maximisation(counts)
    weights: dict[str, dict[int, float]] = {}
    # The classifier sees traits and votes; it is trained on posteriors, not on any true label.
    pos = 1 + sum(post[r[: len(VOTES)]] * r[-1] for r in got)
    neg = 1 + sum((1 - post[r[: len(VOTES)]]) * r[-1] for r in got)
    for j, name in enumerate(VOTES + TRAITS):
        values = sorted({r[j] for r in got})
        p, q = dict.fromkeys(values, 1.0), dict.fromkeys(values, 1.0)
        for r in got:
            p[r[j]] += post[r[: len(VOTES)]] * r[-1]
            q[r[j]] += (1 - post[r[: len(VOTES)]]) * r[-1]
        n = len(values)
        weights[name] = {x: math.log(p[x] / (pos + n)) - math.log(q[x] / (neg + n)) for x in values}
    return Model(math.log(pos / neg), weights, tables)


def find(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``(row, text, base, spans)``: all columns as a struct, and two arrays of (start, rank, stop).

    ``rank`` is a place in ``KINDS``; places count code points, ``stop`` is exclusive. Base spans
    stay whatever the classifier says. Null text counts as empty and has no span. Spans that begin
    together go by rank. Repeated rows are found each, alike; ids are not looked at; columns of any
    name ride along in ``row``; texts are read whole; an empty table gives no row.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = described(located(rows, PATTERNS))
    rank = F.lit(KINDS.index("secret"))
    more = F.transform(
        F.filter("candidates", lambda c: model.log_odds(c) > 0),
        lambda c: F.struct(c["start"].alias("start"), rank.alias("rank"), c["stop"].alias("stop")),
    )
    base = F.sort_array(F.concat(*[spans(k) for k in PATTERNS]))
    rows = rows.select("row", F.col("__text").alias("text"), base.alias("base"), more.cast(SPAN).alias("more"))
    return rows.select("row", "text", "base", F.sort_array(F.concat("base", "more")).alias("spans"))


def listed(col: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.col(col), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ","
    )


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("bigint")
    return found.select(
        F.col("row")[id_col].alias(id_col),
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted() -> Column:
    """The text of a row of ``find`` with ``<kind>`` for each span's; overlapping spans are merged
    under the first one's kind."""
    names, text = F.array(*map(F.lit, KINDS)), F.col("text")

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        kept = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        mark = F.concat(F.lit("<"), F.get(names, s["rank"]), F.lit(">"))
        return F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(kept, mark))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(
        "spans",
        start,
        step,
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size("spans") > 0, joined).otherwise(text)
