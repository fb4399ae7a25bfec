"""Byte-pair encoding and decoding by per-prefix dynamic programming.

The byte-pair encoding of a piece of text (a pre-token) is built prefix by prefix.  Every
prefix has exactly one last token: of the vocabulary tokens that end there, found by an
automaton over all token suffixes, it is the one that could follow the last token of the
prefix before it, that is, whose pair no merge rule would have joined or split otherwise
(pair_fits).  The table of last tokens is followed back from the end to the ids, which are
exactly those of the merge loop.

Distinct pieces repeat a lot, so a worker keeps the ids of pieces it has met, up to
CACHE_PIECES, then starts anew.  The vocabulary file's path is a parameter; the file is read
on the driver and its merge table, whose size is fixed by the vocabulary, is broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import corpus, load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_PIECES, CACHE_PAIRS = 300_000, 500_000
_NEVER = 1 << 60
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED = "doc_id long, ids array<int>, n_tokens long, exact boolean"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("exact", pa.bool_())])


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """{"tokens": bytes by id, "merges": [(left, right, merged)] by rank} of a byte-level BPE file.

    A vocabulary without a token for each byte can't encode every text: ValueError.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters, vocab = byte_letters(), model["vocab"]
    as_bytes = lambda t: bytes(letters[c] for c in t)
    tokens: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if all(c in letters for c in t):
            tokens[i] = as_bytes(t)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    reached = {m for _, _, m in merges}
    tokens = [t if t is not None and (len(t) == 1 or i in reached) else None for i, t in enumerate(tokens)]
    lacking = 256 - len({t for t in tokens if t is not None and len(t) == 1})
    if lacking:
        raise ValueError(f"the vocabulary has no token for {lacking} of the 256 bytes")
    return {"tokens": tokens, "merges": merges}


class Encoder(dict):
    """Maps a piece to its ids, packed as 32-bit integers; computes and keeps those not yet met."""

    def __init__(self, vocabulary: dict, cache: int = CACHE_PIECES):
        super().__init__()
        self.tokens, self.cache = vocabulary["tokens"], cache
        # ids by order of merging, in which pairs are compared; base tokens come first
        base = [i for i, t in enumerate(self.tokens) if t is not None and len(t) == 1]
        order = base + [m for _, _, m in vocabulary["merges"] if self.tokens[m] is not None]
        self.rank = {t: r for r, t in enumerate(dict.fromkeys(order))}
        self.real = list(dict.fromkeys(order))
        self.left, self.right = list(range(len(self.real))), list(range(len(self.real)))
        self.pair: dict[tuple[int, int], int] = {}
        for a, b, m in vocabulary["merges"]:
            ra, rb, rm = self.rank[a], self.rank[b], self.rank[m]
            if (ra, rb) not in self.pair:
                self.pair[ra, rb] = rm
            if self.left[rm] == rm:
                self.left[rm], self.right[rm] = ra, rb
        self.ends: dict[int, list[int]] = {}
        self.heads: dict[int, list[int]] = {}
        # a token that the merge loop never makes of its own bytes is in no encoding
        made = [r < len(base) for r in range(len(self.real))]
        for (a, b), m in self.pair.items():
            made[m] = made[m] or made[a] and made[b] and self._joined_at(a, b) == (a, b)
        self.size = [len(self.tokens[t]) for t in self.real]
        self.packed = [np.int32(t).tobytes() for t in self.real]
        self.automaton = ahocorasick.Automaton()
        for r, t in ((r, t) for r, t in enumerate(self.real) if made[r]):
            self.automaton.add_word(self.tokens[t].decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _edge(self, token: int, inner: list[int], kept: dict[int, list[int]]) -> list[int]:
        """What stands at a token's edge while it is merged, from the byte to the token itself."""
        have = kept.get(token)
        if have is None:
            have, t = [token], token
            while inner[t] != t:
                t = inner[t]
                have.append(t)
            have.reverse()
            kept[token] = have
        return have

    def _joined_at(self, a: int, b: int) -> tuple[int, int] | None:
        """What of a's end and b's beginning the merge loop joins across the border of tokens a, b (by rank), if anything.

        Both are followed from their bytes on, the earlier merge first.  At each step the pair
        across the border comes before the next merge on either side or waits; of equal merges
        the one on the left comes first.
        """
        left, right = self._edge(a, self.right, self.ends), self._edge(b, self.left, self.heads)
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.pair.get((left[i], right[j]), _NEVER)
            if across < next_left and across <= next_right and across != _NEVER:
                return left[i], right[j]
            if next_left == next_right == _NEVER:
                return None
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether the merge loop leaves tokens a, b side by side."""
        return self._joined_at(a, b) is None

    def last_tokens(self, raw: bytes) -> list[int]:
        """The rank of the last token of each prefix of raw, from length 1."""
        size, fits, many = self.size, self.fits, len(self.real)
        last: list[int] = [-1] * len(raw)
        for end, r in self.automaton.iter(raw.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - size[r]
            if before < 0:
                last[end] = r
                continue
            key = last[before] * many + r
            ok = fits.get(key)
            if ok is None:
                ok = self.pair_fits(last[before], r)
                if len(fits) >= CACHE_PAIRS:
                    fits.clear()
                fits[key] = ok
            if ok:
                last[end] = r
        return last

    def encode_piece(self, raw: bytes) -> bytes:
        last = self.last_tokens(raw)
        out, at = [], len(raw) - 1
        while at >= 0:
            out.append(self.packed[last[at]])
            at -= self.size[last[at]]
        return b"".join(reversed(out))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.cache:
            self.clear()
        ids = self.encode_piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_worker: list[tuple] = []


def _tools(shared, cache: int) -> tuple:
    """The encoder, the piece pattern and the flat token bytes, made once in a worker."""
    v = shared.value
    if not _worker or _worker[0][0] is not v:
        tokens = [t or b"" for t in v["tokens"]]
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        _worker[:] = [(v, (Encoder(v, cache), regex.compile(PIECES), np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(size) - size, size))]
    return _worker[0][1]


def decode_ids(ids: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    return flat[K.ranges(start[ids], size[ids])].tobytes()


def _encode(shared, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces, flat, start, size = _tools(shared, cache)
        find, get = pieces.findall, encoder.__getitem__
        for batch in batches:
            for c in K.chunks(batch):
                texts = c.column("text").to_pylist()
                packed = [b"".join(map(get, find(t))) if t else b"" for t in texts]
                ids = np.frombuffer(b"".join(packed), dtype=np.int32)
                off = np.cumsum([0, *map(len, packed)]) // 4
                back = decode_ids(ids, flat, start, size)
                cuts = np.concatenate([[0], np.cumsum(size[ids])])[off]
                exact = [back[cuts[i] : cuts[i + 1]] == t.encode() if t else True for i, t in enumerate(texts)]
                known = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids), mask=known)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), lists, pa.array(np.diff(off), pa.int64()), pa.array(exact)], schema=_ENCODED)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, cache: int = CACHE_PIECES) -> DataFrame:
    """doc_id, ids, n_tokens, and exact: whether decoding the ids gives the text again.

    docs has doc_id and text; other columns are ignored.  Null text gives null ids and 0
    tokens, empty text no ids.  Rows without a doc_id are left out, repeated rows give
    repeated results, and an empty table gives none.  Special tokens in a text are ordinary text.
    """
    docs = corpus(docs)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return docs.mapInArrow(_encode(shared, cache), ENCODED)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null text, an id outside the vocabulary is an error."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, flat, start, size = _tools(shared, CACHE_PIECES)
        for batch in batches:
            texts = []
            for x in batch.column("ids"):
                ids = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False)
                if ids is not None and len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                texts.append(None if ids is None else decode_ids(ids, flat, start, size).decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": (op4_bpe, None)}
