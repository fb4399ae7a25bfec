"""Vectorised text kernel shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; everything else separates words.  Null text has no words.

Hashes are 64-bit polynomial hashes taken from prefix sums (so every window of a text
costs O(1)) and finished with a bijective mixer.  They are used as identities of words
and of word n-grams; the chance that two given n-grams collide is about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_WORD[128:] = True
#: Bytes of text handled at once; it bounds the memory of the kernel and changes no result.
CHUNK_BYTES = 1 << 20
#: The same definition of a word as a regular expression for SQL engines with RE2.
WORD_SQL = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def _inverse(a: int) -> U:
    return U(pow(int(a), -1, 1 << 64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 12)
        both = []
        for b in (base, _inverse(base)):
            x = np.full(size, b, dtype=U)
            x[0] = 1
            both.append(np.cumprod(x))
        have = _powers[int(base)] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, dtype=U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c) over all pairs."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, counts) + np.arange(total)


@dataclass
class Words:
    """The words of a few texts, in order: offsets[i]:offsets[i + 1] are those of text i."""

    offsets: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans start:end."""
    up, down = powers(_P, len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])


def words(texts: pa.Array, lower: bool = True) -> Words:
    data, off = flat(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    w = np.zeros(n + 2, dtype=bool)
    w[1:-1] = _WORD[data]
    first, last = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first[edge] |= w[edge + 1]
    last[edge - 1] |= w[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(np.searchsorted(start, off), span_hash(data, start, end), data, start, end)


def grams(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, text by text, and their offsets by text.

    short: a text of 1 to k - 1 words has one window, all its words; else it has none.
    """
    n = w.counts
    h = w.hashes
    count = np.maximum(n - k + 1, 0)
    at = ranges(w.offsets[:-1], count)
    width = np.full(len(at), k, dtype=np.int64)
    if short and (few := (n > 0) & (n < k)).any():
        at, width = np.concatenate([at, w.offsets[:-1][few]]), np.concatenate([width, n[few]])
        order = np.argsort(at, kind="stable")
        at, width = at[order], width[order]
        count = np.where(few, 1, count)
    up, down = powers(_Q, len(h))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, dtype=U)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        g = mix((sums[at + width] - sums[at]) * down[at])
    return g, np.concatenate([[0], np.cumsum(count)])


def chunks(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `size` bytes of text each, or one row."""
    size = size or CHUNK_BYTES
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sets(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-gram hashes of each text in rising order, and their offsets by text."""
    g, off = grams(w, k, short)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(off)))
