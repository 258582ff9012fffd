"""Arrow and numpy helpers shared by the operators of this subpackage. All run on executors, a bounded batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: Characters of text handled at once, so that a batch of long texts takes no more memory than one of short texts.
BATCH_CHARS = 4_000_000
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def batches(it: Iterator[pa.RecordBatch], text: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches of ``it``, cut so that column ``text`` holds about ``most`` bytes in each; a longer text stands alone."""
    for batch in it:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, run = 0, 0
        for i, n in enumerate(sizes):
            if run and run + n > most:
                yield batch.slice(at, i - at)
                at, run = i, 0
            run += n
        yield batch.slice(at)


def binary(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose value i is the bytes of flat[starts[i]:starts[i + 1]]."""
    width = flat.dtype.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int32)), pa.py_buffer(flat)])


def flat_binary(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls as one array, and the starts of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype=dtype), (offsets - offsets[0]) // size


def word_shingles(texts: list[str | None], k: int, hashes: WordHashes, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of ``k`` words of each text: (rows, hashes), in text order, with repetitions.

    A text with fewer than ``least_words`` or ``k`` words, or null, gives none.
    """
    flat: list[int] = []
    rows, counts = [], []
    for i, s in enumerate(texts):
        if s:
            words = WORD.findall(s.lower())
            if len(words) >= max(least_words, k):
                flat += [hashes[w] for w in words]
                rows.append(i)
                counts.append(len(words))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.array(flat, dtype=np.uint64)
    doc = np.repeat(np.array(rows, dtype=np.int64), counts)
    m = len(h) - k + 1
    s = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        s = mix((s ^ h[j : m + j]) * _GOLDEN + np.uint64(j + 1))
    inside = doc[:m] == doc[k - 1 :]
    return doc[:m][inside], s[inside]
