"""Tokenizing texts chunk by chunk: each distinct chunk is learned once and remembered."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers; beyond that it forgets all and begins anew.
REMEMBERED = 600_000
#: Bytes of text tokenized together (a longer text goes alone).
TOGETHER = 4 << 20


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that begin at ``start``, one after the other, and where each ends."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - count), count) + np.arange(total)], ends


def runs(sizes: list[int], together: int = TOGETHER) -> list[tuple[int, int]]:
    """Consecutive texts of about ``together`` bytes."""
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= together:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(sizes))] * (start < len(sizes))


def own(texts: pa.Array) -> pa.Array:
    """Texts, null as empty, in an array that begins at its buffers' beginning: Arrow's kernels for
    ASCII text give wrong results for a slice that doesn't."""
    texts = texts.cast(pa.large_string())
    return texts.take(pa.array(np.arange(len(texts)))).fill_null("")


class ChunkTokenizer(ABC):
    """Cuts texts into chunks that are tokenized apart from each other."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {"": b""}

    @abstractmethod
    def split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text."""

    @abstractmethod
    def learn(self, chunks: list[str]) -> None:
        """Put the ids of these distinct chunks, little-endian and 32 bits wide, into ``known``."""

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        chunks = self.split(own(texts))
        per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [c for c in distinct if c not in self.known]
        if len(self.known) + 2 * len(missing) > REMEMBERED:
            self.known, missing = {"": b""}, [c for c in distinct if c]
        if missing:
            self.learn(missing)
        of_chunk = [self.known[c] for c in distinct]
        count = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk)) // 4
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, ends = gather(np.frombuffer(b"".join(of_chunk), "<u4"), (np.cumsum(count) - count)[index], count[index])
        return np.split(flat, np.r_[0, ends][np.cumsum(per_text)[:-1]]) if len(per_text) else []
