"""Best-fit packing of tokenized documents into sequences, under several capacities at once."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.chunks import ChunkTokenizer, own, runs
from cairn.llm.common import learned, map_arrow

#: A chunk that is one word and perhaps some punctuation: Latin letters only, so that it is known to
#: be composed and one word to the tokenizer too.
WORD = re.compile("([a-zß-öø-ɏ]+)([.,!*&%$#|;:]*)")


class WordTokenizer(ChunkTokenizer):
    """Ids of a word-end BPE tokenizer that lower-cases and drops white space.

    Chunks between ASCII white space are tokenized alone, each distinct one once. Arrow lower-cases,
    splits and numbers them; words are encoded many to a call and told apart by the end-of-word ids.
    A text that may hold a special token's string, in whatever case, is encoded as a whole instead.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # each word comes once
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.ascii_lower(texts))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        out = super().ids(texts)
        for special in self.special:
            held = pc.match_substring(own(texts), special, ignore_case=True)
            for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist():
                out[i] = self._encode([texts[i].as_py()])[0]
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, words: list[str]) -> None:
        for w, ids in zip(words, self._encode(words)):
            self.known[w] = ids.tobytes()

    def _words(self, words: list[str]) -> None:
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = self._encode([" ".join(part)])[0]
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(part):
                self._one_by_one(part)
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, ends.tolist()):
                self.known[w] = raw[at:e]
                at = e

    def learn(self, chunks: list[str]) -> None:
        known, bare, odd, parted = self.known, set(), set(), []
        for c in chunks:
            if m := WORD.fullmatch(c):
                body, tail = m.groups()
                if body not in known:
                    bare.add(body)
                if tail:
                    parted.append((c, body, tail))
                    if tail not in known:
                        odd.add(tail)
            else:
                odd.add(c)
        self._words(list(bare))
        self._one_by_one(list(odd))
        for c, body, tail in parted:
            known[c] = known[body] + known[tail]


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that what it has learned serves the next task of packing too."""
    return learned(path, lambda: WordTokenizer(path))


class Packer:
    """Vector best-fit: a bin's residual tokens, documents and attention cost select it.

    A piece goes to a bin that holds it under every capacity: with ``rule`` "norm" the one whose
    weighted residual is shortest once the piece is in, with "dot" the one whose weighted residual
    has the largest dot product with the piece. Ties go to the oldest bin; no such bin opens a new
    one. A piece of n tokens costs n tokens, one document and n * n of attention. A bin stays open
    until it is full.
    """

    def __init__(self, tokens: int, docs: int | None, attention: int | None, rule: str, weights: tuple[float, float, float]):
        if rule not in ("norm", "dot"):
            raise ValueError("rule must be norm or dot")
        # A sequence of single-token documents reaches the other two capacities only if they are set lower.
        self.caps = np.array([tokens, docs or tokens, attention or tokens * tokens], float)
        self.scale = np.array(weights, float) / self.caps**2
        self.rule = rule
        self.left = np.empty((0, 3))
        self.name = np.empty(0, np.int64)
        self.opened = 0

    def add(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece; the longest are placed first."""
        where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        n = len(self.name)
        left = np.vstack([self.left, np.zeros((len(lengths), 3))])
        name = np.concatenate([self.name, np.zeros(len(lengths), np.int64)])
        for i in np.argsort(-lengths, kind="stable").tolist():
            size = int(lengths[i])
            item = np.array([size, 1.0, float(size) * size])
            if (item > self.caps).any():
                raise ValueError(f"a piece of {size} tokens exceeds a capacity")
            fits = np.flatnonzero(left[:n, 0] >= size)
            if len(fits):
                fits = fits[(left[fits, 1] >= 1) & (left[fits, 2] >= item[2])]
            if len(fits):
                r = left[fits]
                if self.rule == "dot":
                    at = fits[np.argmax(r @ (self.scale * item))]
                else:
                    at = fits[np.argmin(((r - item) ** 2) @ self.scale)]
            else:
                at, n = n, n + 1
                left[at], name[at] = self.caps, self.opened
                self.opened += 1
            where[i], offset[i] = name[at], self.caps[0] - left[at, 0]
            left[at] -= item
        room = np.flatnonzero((left[:n] >= 1).all(axis=1))
        self.left, self.name = left[room], name[room]
        return where, offset


#: Weights of the residual tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 1.0, 1.0)
#: Pieces that a task places together, longest first.
WINDOW = 65_536

SCHEMA = "id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    most_docs: int | None = None,
    most_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it begins in its document and where it lies in its sequence.

    A document is its ids and a closing 0, cut only where it exceeds ``capacity``. Tokens, documents
    and attention cost (the square of a piece's tokens) are held under ``capacity``, ``most_docs``
    and ``most_attention``; ``weights`` say how much each residual counts when a sequence is chosen.
    Each task packs the rows it reads, ``window`` pieces at a time, longest first, and carries every
    sequence that has room over to the next window; so nothing is shuffled, and a task run again
    gives the same rows. A task holds a window's pieces and four numbers for each open sequence.

    ``sequence_id`` is unique over all tasks. Null text counts as empty (one piece of length 1), a
    text of any length is encoded whole, pieces of equal length go in the order they are read,
    repeated rows are packed each, a null id stays null, other columns are ignored whatever their
    names, and an empty table gives no row. ``with_ids`` adds the ids themselves as ``ids``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 32
        bins = Packer(capacity, most_docs, most_attention, rule, weights)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, piece, start, length, crc, raw = (list(x) for x in zip(*held))
            held.clear()
            where, offset = bins.add(np.array(length))
            cols = [
                pa.array(ids, id_type),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc, where + task, offset)),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in raw], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            id_type, ids = batch.schema.field(0).type, batch.column(0)
            texts = batch.column(1).cast(pa.large_string())
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            for i, z in runs(sizes):
                for doc, own_ids in zip(ids[i:z].to_pylist(), tok.ids(texts[i:z])):
                    raw = own_ids.tobytes() + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        held.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                if len(held) >= window:
                    yield flush()
        if held:
            yield flush()

    schema = SCHEMA.format(kind=kind) + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema, keeps=True)
