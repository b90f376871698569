"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts, one after the other, are indexed by a suffix array, every piece is binary-searched
for the range of its occurrences, the resulting edges are sorted by position and relaxed. Suffixes are
ordered by their first 16 bytes, so occurrences of longer pieces are looked at in full. The model is a BPE one, so an
edge relaxes by what BPE's merges would do rather than by a sum of scores: the pieces of a prefix
are settled, and a piece may follow the last of them only if merging both texts together gives just
these two. One piece can end at each position that way, and the path to the end is the encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.chunks import gather, own, runs
from cairn.llm.common import map_arrow, map_batches

SPACE = "▁"
#: Marks where chunks part; a text that holds it itself is split another way.
CUT = "\ue000"
KEY = 16
#: Bytes of text indexed together (a longer chunk goes alone).
INDEXED = 1 << 16
NONE = np.int64(1 << 40)
#: Compatible pairs remembered, by a direct-mapped table.
SLOTS = 1 << 21


@dataclass
class Pieces:
    """What encoding needs of a model. Symbols are ids; ``unknown`` is any character without a piece."""

    texts: list[bytes]  # of matchable pieces
    ids: np.ndarray  # their ids
    order: np.ndarray  # by id: when merging makes it, -1 for a single character
    left: np.ndarray  # by id: the two halves of its last merge
    right: np.ndarray
    pair_keys: np.ndarray  # of all pairs that merge, sorted
    pair_order: np.ndarray
    unknown: int
    byte_ids: np.ndarray
    spelled: list[bytes]  # by id: the bytes it decodes to


def load(path: str) -> Pieces:
    """Read a BPE model with byte fallback, the identity normaliser and a dummy prefix."""
    sp = spm.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
    byte_ids = np.full(256, -1)
    spelled = []
    for i in range(size):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            spelled.append(bytes([int(sp.id_to_piece(i)[3:-1], 16)]))
        else:
            spelled.append(b"" if special[i] else sp.id_to_piece(i).replace(SPACE, " ").encode())
    plain = {sp.id_to_piece(i): i for i in range(size) if not special[i] and not sp.is_byte(i)}
    scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
    rank = {s: k for k, s in enumerate(scores)}
    score = {t: rank[sp.get_score(i)] for t, i in plain.items()}
    order, left, right = np.full(size + 1, -1), np.arange(size + 1), np.arange(size + 1)
    pairs: dict[int, int] = {}
    usable = {}
    for t, i in plain.items():
        for k in range(1, len(t)):
            if t[:k] in plain and t[k:] in plain:
                pairs[plain[t[:k]] * (size + 1) + plain[t[k:]]] = score[t]
        parts = last_merge(t, score)
        if len(t) == 1:
            usable[t] = i
        elif parts:
            usable[t], order[i] = i, score[t]
            left[i], right[i] = plain[parts[0]], plain[parts[1]]
    keys = np.array(sorted(pairs), np.int64)
    return Pieces(
        [t.encode() for t in usable],
        np.array(list(usable.values())),
        order,
        left,
        right,
        keys,
        np.array([pairs[k] for k in keys.tolist()], np.int64),
        size,
        byte_ids,
        spelled,
    )


def last_merge(text: str, score: dict[str, int]) -> tuple[str, str] | None:
    """The two symbols whose merge gives ``text`` at last; None if merging its characters doesn't."""
    parts = list(text)
    while len(parts) > 2:
        best = min(((score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
        if best is None:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Encoder:
    """No piece has a space but at its beginning, or a line feed: texts are cut before each run of
    spaces and around each line feed, and all chunks are relaxed abreast."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        texts = np.array([t[:KEY] for t in pieces.texts], f"S{KEY}")
        self.low = texts
        self.high = np.array([t[:KEY].ljust(KEY, b"\xff") for t in pieces.texts], f"S{KEY}")
        self.head_low = np.array([int.from_bytes(t[:8].ljust(8, b"\0"), "big") for t in pieces.texts], np.uint64)
        self.head_high = np.array([int.from_bytes(t[:8].ljust(8, b"\xff"), "big") for t in pieces.texts], np.uint64)
        self.size = np.array([len(t) for t in pieces.texts], np.int32)
        self.symbol = pieces.ids.astype(np.int32)
        self.more, self.long = np.flatnonzero(self.size > 8), np.flatnonzero(self.size > KEY)
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(SLOTS, bool)

    def split(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(texts, SPACE, " ")  # the same to the model
        if pc.any(pc.match_substring(texts, CUT)).as_py():
            return pa.array([self._split_one(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        full = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
        cut = pc.replace_substring_regex(pc.replace_substring(full, "\n", f"{CUT}\n{CUT}"), " +", CUT + r"\0")
        return pc.split_pattern(cut, CUT)

    @staticmethod
    def _split_one(text: str) -> list[str]:
        out: list[str] = []
        for k, line in enumerate((" " + text if text else "").split("\n")):
            out += ["\n"] * bool(k)
            at = 0
            for i in range(1, len(line)):
                if line[i] == " " != line[i - 1]:
                    out.append(line[at:i])
                    at = i
            out.append(line[at:])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of symbols a and b leaves just a and b.

        The merges that made both are undone from the last to the first; a merge across the border
        that would have come before the one just undone shows that BPE had done something else.
        """
        p, n = self.p, len(self.p.order)
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NONE)
        while len(at):
            key = a * n + b
            k = np.minimum(np.searchsorted(p.pair_keys, key), len(p.pair_keys) - 1)
            merged = np.where(p.pair_keys[k] == key, p.pair_order[k], NONE)
            bad = merged < limit
            ok[at[bad]] = False
            oa, ob = p.order[a], p.order[b]
            go = ~bad & ((oa >= 0) | (ob >= 0))
            a, b, oa, ob, at = a[go], b[go], oa[go], ob[go], at[go]
            first = oa > ob
            limit = np.where(first, oa, ob + 1)
            a, b = np.where(first, p.right[a], a), np.where(first, b, p.left[b])
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible``, remembered; a of -1 is a chunk's beginning, which any piece may follow."""
        key = a.astype(np.int64) * len(self.p.order) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        ok = self.slot_ok[slot]
        miss = np.flatnonzero((self.slot_key[slot] != key) & (a >= 0))
        if len(miss):
            keys, back = np.unique(key[miss], return_inverse=True)
            found = self.compatible(keys // len(self.p.order), keys % len(self.p.order))
            ok[miss] = found[back]
            where = slot[miss]
            self.slot_key[where] = key[miss]
            # several keys may share a slot: what is stored last must be stored for both arrays
            kept = self.slot_key[where] == key[miss]
            self.slot_ok[where[kept]] = ok[miss[kept]]
        return ok | (a < 0)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the piece) of every occurrence of every piece."""
        starts = np.flatnonzero((text & 0xC0) != 0x80).astype(np.int32)
        # eight bytes from each place on, as one number that orders as they do
        wide = np.r_[text, np.zeros(KEY, np.uint8)]
        word = np.zeros(len(text) + KEY // 2, np.uint64)
        for j in range(8):
            word |= wide[j : j + len(word)].astype(np.uint64) << np.uint64(56 - 8 * j)
        head, tail = word[starts], word[starts + 8]
        order = np.lexsort((tail, head))
        suffixes, head, tail = starts[order], head[order], tail[order]
        low, high = np.searchsorted(head, self.head_low, "left"), np.searchsorted(head, self.head_high, "right")
        # of pieces of more than eight bytes, those whose first eight are there at all
        more = self.more[high[self.more] > low[self.more]]
        if len(more):
            keys = np.stack([head, tail], axis=1).astype(">u8").view(f"S{KEY}").ravel()
            low[more] = np.searchsorted(keys, self.low[more], "left")
            high[more] = np.searchsorted(keys, self.high[more], "right")
        count = np.maximum(high - low, 0)
        at, _ = gather(suffixes, low, count)
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        if len(self.long) and count[self.long].any():
            long = np.flatnonzero(self.size[piece] > KEY)
            good = np.ones(len(piece), bool)
            for k in long.tolist():
                t = self.p.texts[piece[k]]
                good[k] = text[at[k] : at[k] + len(t)].tobytes() == t
            at, piece = at[good], piece[good]
        return at, piece

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none. Chunks are indexed together up to ``INDEXED`` bytes,
        whatever texts they are of, so a long text takes no more than its longest chunk."""
        chunks = self.split(own(texts))
        per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        flat = pc.replace_substring(chunks.flatten(), " ", SPACE)
        # every chunk is followed by a zero, which no piece holds
        flat = pc.binary_join_element_wise(flat, pa.scalar("", pa.large_string()), pa.scalar("\0", pa.large_string()))
        if not len(flat):
            return [np.empty(0, "<u4") for _ in range(len(per_text))]
        offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
        data = np.frombuffer(flat.buffers()[2], np.uint8)
        cuts = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(INDEXED, offsets[-1], INDEXED)), len(flat)]).tolist()
        parts = [self._index(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]) for a, z in zip(cuts, cuts[1:])]
        counts = np.concatenate([c for _, c in parts])
        total = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(per_text)]]
        return np.split(np.concatenate([x for x, _ in parts]), total[1:-1])

    def _index(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        p = self.p
        begin, end = offsets[:-1], offsets[1:] - 1
        start, piece = self.edges(text)
        stop, symbol = start + self.size[piece], self.symbol[piece]
        # A character without a piece of its own is an edge too.
        first = np.flatnonzero((text & 0xC0) != 0x80).astype(np.int32)
        width = np.diff(first, append=np.int32(len(text)))
        covered = np.zeros(len(text) + 1, bool)
        single = np.zeros(len(text) + 1, np.int32)
        single[first] = width
        covered[start[stop - start == single[start]]] = True
        covered[end] = True
        bare = ~covered[first]
        start = np.r_[start, first[bare]]
        stop = np.r_[stop, first[bare] + width[bare]]
        symbol = np.r_[symbol, np.full(bare.sum(), p.unknown, np.int32)]
        # Relax in order of position within the chunk, all chunks abreast.
        chunk = np.repeat(np.arange(len(begin), dtype=np.int32), end + 1 - begin)
        depth = stop - np.repeat(begin.astype(np.int32), end + 1 - begin)[start]
        deepest = int(depth.max(initial=0))
        small = np.uint8 if deepest < 1 << 8 else np.uint16 if deepest < 1 << 16 else np.int64
        by = np.argsort(depth.astype(small), kind="stable")
        start, stop, symbol = start[by], stop[by], symbol[by]
        last = np.full(len(text) + 1, -2, np.int32)
        came = np.zeros(len(text) + 1, np.int32)
        last[begin] = -1
        sizes = np.bincount(depth)
        cuts = np.r_[0, np.cumsum(sizes[sizes > 0])].tolist()
        for a, z in zip(cuts[:-1], cuts[1:]):
            before = last[start[a:z]]
            at = np.flatnonzero(before > -2)
            at = at[self.follows(before[at], symbol[a:z][at])] + a
            last[stop[at]], came[stop[at]] = symbol[at], start[at]
        ends = np.zeros(len(text) + 1, bool)
        at = end[end > begin]
        while len(at):
            ends[at] = True
            at = came[at]
            at = at[at != begin[chunk[at]]]
        ends = np.flatnonzero(ends)
        symbol, came = last[ends], came[ends]
        # An unknown character gives a byte piece for each of its bytes.
        unknown = symbol == p.unknown
        count = np.where(unknown, ends - came, 1)
        bytes_, _ = gather(p.byte_ids[text], came[unknown], count[unknown])
        ids = np.repeat(symbol, count)
        ids[np.repeat(unknown, count)] = bytes_
        # A chunk's end is the separator after it, so `chunk` tells whose it is.
        counts = np.bincount(chunk[ends], count, minlength=len(begin)).astype(np.int64)
        return ids.astype("<u4"), counts


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per Python worker: the model is read once."""
    return Encoder(load(path))


class Decoder:
    """Ids to text: pieces are spelled, ``▁`` is a space, the one put before the text goes."""

    def __init__(self, pieces: Pieces):
        self.count = np.array([len(s) for s in pieces.spelled])
        self.start = np.cumsum(self.count) - self.count
        self.pool = np.frombuffer(b"".join(pieces.spelled), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        flat, _ = gather(self.pool, self.start[ids], self.count[ids])
        raw = flat.tobytes()
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(4)
def decoder(path: str) -> Decoder:
    return Decoder(load(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` per row. Null and empty texts have no id; repeated rows stay; a null id stays
    null; other columns are ignored; an empty table gives no row. Texts are encoded whole."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            for a, z in runs(sizes):
                parts = e.ids(texts[a:z])
                offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], ids], ["id", "ids"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(id, text)`` of each row ``(id, ids)``; null ids give empty text. Bytes that are no UTF-8
    become replacement characters."""
    kind = encoded.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts_of(batch.column(1), model_path), pa.string())], ["id", "text"]
        )

    return map_batches(encoded.select("id", "ids"), one, f"id {kind}, text string")


def texts_of(ids: pa.ListArray, model_path: str) -> list[str]:
    d = decoder(model_path)
    flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    return [d.text(flat[a:z]) for a, z in zip(offsets, offsets[1:])]


def digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(id, n_ids, ids_sha256, decoded_sha256)`` per row: ids little-endian and 32 bits wide."""
    kind = encoded.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(1)
        flat, offsets = col.values.to_numpy(), col.offsets.to_numpy()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        cols = [
            batch.column(0),
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([sha(flat[a:z].astype("<u4").tobytes()) for a, z in zip(offsets, offsets[1:])]),
            pa.array([sha(t.encode()) for t in texts_of(col, model_path)]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_ids", "ids_sha256", "decoded_sha256"])

    return map_batches(encoded, one, f"id {kind}, n_ids bigint, ids_sha256 string, decoded_sha256 string")
