"""Words of whole texts, an Arrow batch at a time.

A byte table lower-cases A-Z and turns every separator into a space; UTF-8 sequences of other letters
pass unchanged, so one C-speed pass over the column's buffer prepares all texts of a batch.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def _table(separators: set[int]) -> bytes:
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words are runs of anything but ASCII white space.
BLANK_WORDS = _table({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, ASCII letters and everything beyond ASCII.
ALNUM_WORDS = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most`` text bytes; a longer text stays whole, in a piece of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum()
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """``codes`` of all words in order, indices into ``vocab``; document d has words ``start[d]:start[d+1]``."""

    def __init__(self, texts: pa.Array, table: bytes):
        at, data = cleaned(texts, table)
        clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.tobytes()), pa.py_buffer(data))
        lists = pc.ascii_split_whitespace(clean)
        words = lists.flatten()
        found = np.asarray(pc.greater(pc.binary_length(words), 0))
        n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        before = np.concatenate([[0], found.cumsum()])
        self.start = before[np.concatenate([[0], n.cumsum()])]
        coded = words.filter(pa.array(found)).dictionary_encode()
        self.codes = np.asarray(coded.indices).astype(np.int64)
        self.vocab = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.start) - 1), self.counts)


#: One 64-bit number for each byte, and an odd base, for word hashes.
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def cleaned(texts: pa.Array, table: bytes) -> tuple[np.ndarray, bytes]:
    """Offsets of the texts in one buffer, and the buffer with lower-case words and blanks (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return at - at[0], b"" if raw is None else raw[int(at[0]):int(at[-1])].to_pybytes().translate(table)


def word_hashes(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the first word of each text (one more entry at the end).

    A hash is a polynomial in the word's bytes modulo 2**64, from one running sum over the whole buffer.
    """
    at, data = cleaned(texts, table)
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    up, down = _powers(1 << max(22, len(b).bit_length()))
    word = b != 32
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < len(b))]                          # a text ends the word before it
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    run = np.cumsum(_BYTE[b] * up[:len(b)], dtype=np.uint64)
    before = np.where(first > 0, run[first - 1], np.uint64(0))
    return mix((run[last] - before) * down[first] + (last - first).astype(np.uint64)), np.searchsorted(first, at)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finishing steps of a public counter-based generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
