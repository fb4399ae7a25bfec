"""Substring dedup: fixed-block anchors extended to maximal exact repeats.

A repeat is a run of at least MIN_WORDS words that occurs at another place, in another
document or the same one.  With blocks of BLOCK = MIN_WORDS / 2 words, at multiples of BLOCK
in every document, any repeat of MIN_WORDS words covers a whole block of the other place, so
no repeat is missed:

1. index the non-overlapping blocks of all documents and probe them with every rolling
   window of BLOCK words (packed exchange by hash);
2. around the hits, and only there, take the hashes of MIN_WORDS-word windows with their
   places; those that meet another of the same hash are repeats (second exchange);
3. join consecutive repeated windows to maximal spans.

Texts come back to their hits by a shuffle join on doc_id, packed; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .exchange import BLOB, Packer, buckets_for, cut, gather, meet
from .tables import corpus, load, unpack, with_texts

MIN_WORDS = 50
SPANS = "doc_id long, start_word long, end_word long, n_words long, is_copy boolean"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64()), ("is_copy", pa.bool_())])
_HITS = pa.schema([("doc_id", pa.int64()), ("hits", pa.binary())])


def _head(ids: pa.Array, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(windows, pa.int64())], names=["doc_id", "windows"])


def _probe(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, flagged=True)
        for batch in batches:
            for c in K.chunks(batch):
                g, off = K.grams(K.words(c.column("text")), block)
                pos = K.ranges(np.zeros(len(off) - 1, np.int64), np.diff(off))
                anchored = (g & ~np.uint64(1)) | (pos % block == 0).astype(np.uint64)
                yield from packer.add(anchored, np.arange(len(g)), _head(c.column("doc_id"), np.diff(off)), len(g))
        yield from packer.flush()

    return run


def _anchored(keys: np.ndarray, numbers: np.ndarray, at: None) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal a block of another place, and the blocks they equal."""
    h = keys >> np.uint32(1)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.diff(np.append(first, len(h)))
    hit = (np.add.reduceat(numbers[order].astype(np.int64), first) > 1) & (np.maximum.reduceat(keys[order] & np.uint32(1), first) > 0)
    keep = np.sort(order[np.repeat(hit, count)])
    return keep, np.zeros(len(keep), np.uint8)


def _hits(table: pa.Table) -> pa.Table:
    head, refs, _ = gather(table)
    ends = np.cumsum(head["windows"].to_numpy())
    doc = np.searchsorted(ends, refs, side="right")
    at, ids = np.searchsorted(doc, np.arange(len(ends) + 1)), head["doc_id"].to_numpy()
    some = np.flatnonzero(np.diff(at))
    starts = ends - head["windows"].to_numpy()
    return pa.Table.from_arrays([pa.array(ids[some], pa.int64()), pa.array([(refs[at[d] : at[d + 1]] - starts[d]).astype(np.int32).tobytes() for d in some], pa.binary())], schema=_HITS)


def _around(words: int, buckets: int):
    block = words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, placed=True)
        for batch in batches:
            for c in (c for part in unpack(batch) for c in K.chunks(part)):
                g, off = K.grams(K.words(c.column("text")), words)
                n = np.diff(off)
                wanted = np.zeros(len(g) + 1, dtype=np.int32)
                for d, lists in enumerate(c.column("hits").to_pylist()):
                    if not n[d]:
                        continue
                    p = np.frombuffer(b"".join(lists), dtype=np.int32).astype(np.int64)
                    lo, hi = np.clip(p - (words - block), 0, n[d]), np.clip(p + 1, 0, n[d])
                    np.add.at(wanted, off[d] + lo, 1)
                    np.add.at(wanted, off[d] + hi, -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
                doc = np.searchsorted(off, at, side="right") - 1
                places = np.column_stack([c.column("doc_id").to_numpy()[doc], at - off[doc]])
                yield from packer.add(g[at], at, _head(c.column("doc_id"), n), len(g), places)
        yield from packer.flush()

    return run


def _repeated(keys: np.ndarray, numbers: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur at two places; a mark of 1 on all but the first place, the lowest (doc_id, word)."""
    doc, pos = at
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    order = order[same[1:] | same[:-1] | (numbers[order] > 1)]  # the others meet none
    if not len(order):
        return order, np.zeros(0, np.uint8)
    order = order[np.lexsort((pos[order], doc[order], keys[order]))]
    k, doc, pos = keys[order], doc[order], pos[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    last = np.append(first[1:], len(k)) - 1
    size = last - first + 1
    copy = (doc != np.repeat(doc[first], size)) | (pos != np.repeat(pos[first], size))
    other = (doc[first] != doc[last]) | (pos[first] != pos[last]) | (np.maximum.reduceat(numbers[order], first) > 1)
    some = np.repeat(other, size)
    keep, mark = order[some], copy[some].astype(np.uint8)
    back = np.argsort(keep)
    return keep[back], mark[back]


def _spans(words: int):
    def run(table: pa.Table) -> pa.Table:
        head, refs, marks = gather(table)
        if head is None or not len(refs):
            return _SPANS.empty_table()
        n = head["windows"].to_numpy()
        ends = np.cumsum(n)
        doc = np.searchsorted(ends, refs, side="right")
        pos = refs - (ends - n)[doc]
        new = np.ones(len(refs), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (marks[1:] != marks[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(refs)) - 1
        end = pos[last] + words
        return pa.Table.from_arrays([pa.array(head["doc_id"].to_numpy()[doc[first]]), pa.array(pos[first]), pa.array(end), pa.array(end - pos[first]), pa.array(marks[first] > 0)], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each maximal run of words, min_words (even) or longer, that occurs at another place too.

    start_word and end_word (exclusive) count the document's words from 0.  is_copy is false
    where the run's windows are the first of their kind, by (doc_id, word), and true where an
    earlier place has them; a run changes where that changes.  docs has doc_id and text; other
    columns are ignored.  Null, empty and shorter texts have no spans, rows without a doc_id are
    left out, and rows that repeat a doc_id and its text are one document, not repeats of each
    other (each row gives the spans).  Overlapping places of one document count: in a text of
    one word over and over, every run but the first is a copy, which leaves its first word.
    """
    if min_words < 2 or min_words % 2:
        raise ValueError("min_words must be even")
    docs = corpus(docs)
    buckets = buckets_for(docs)
    blobs = docs.mapInArrow(_probe(min_words // 2, buckets), BLOB)
    hits = cut(meet(blobs, _anchored).groupBy("unit").applyInArrow(_hits, "doc_id long, hits binary").groupBy("doc_id").agg(F.collect_list("hits").alias("hits")))
    blobs = with_texts(docs, hits).mapInArrow(_around(min_words, buckets), BLOB)
    return meet(blobs, _repeated).groupBy("unit").applyInArrow(_spans(min_words), SPANS)


def remove_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every copied span cut from its text; the first place of each keeps it.

    A span goes with the separators behind it.  A document of which no word is left goes
    unless it had none before; n_chars, if there is such a column, is counted anew.
    """
    copies = repeated_spans(docs, min_words).filter("is_copy").groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("__cut"))
    schema = docs.schema
    joined = docs.join(copies, docs["doc_id"] == copies["__of"], "left").drop("__of")
    text, cuts = schema.fieldNames().index("text"), len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(cuts)
            touched = np.flatnonzero(np.asarray(spans.is_valid()))
            texts, keep = batch.column(text).to_pylist() if len(touched) else None, np.ones(batch.num_rows, dtype=bool)
            for i in touched:
                texts[i], keep[i] = _cut(texts[i], [(s["start_word"], s["end_word"]) for s in spans[i].as_py()])
            columns = [pa.array(texts, batch.schema.field(text).type) if j == text and texts is not None else batch.column(j) for j in range(cuts)]
            out = pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            yield out if keep.all() else out.filter(pa.array(keep))

    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, bool]:
    w = K.words(pa.array([text]), lower=False)
    raw, n = text.encode(), len(w.start)
    gone = np.zeros(n + 1, dtype=np.int64)
    for s, e in spans:
        gone[min(s, n)] += 1
        gone[min(e, n)] -= 1
    left = np.cumsum(gone[:n]) == 0
    if left.all():
        return text, True
    edge = np.append(w.start, len(raw))
    parts = [raw[: edge[0]]] + [raw[edge[i] : edge[i + 1]] for i in np.flatnonzero(left)]
    return b"".join(parts).decode(), bool(left.any())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(load(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS is_copy, count(*) OVER (PARTITION BY h) AS c FROM g),
s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS run FROM r WHERE c > 1)
SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, max(p) + 50 - min(p) AS n_words, is_copy
FROM s GROUP BY doc_id, is_copy, run
"""
QUERIES = {"op6_substring_dedup": (op6_substring_dedup, SQL)}
