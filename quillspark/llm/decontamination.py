"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents hold a benchmark item?  Both are sets of word k-gram hashes (shingles).  The
share of an item's shingles that a document holds is the item's *containment*.  Jaccard
similarity is no help where a short item lies in a long document, so documents are put into
size classes, class c holding 2**(c-1) < n <= 2**c distinct shingles, and each class has a
one-permutation MinHash of its own with 2**c bins: the bin of a hash is its top c bits, the
bin's value its smallest hash.  With at most one shingle a bin on average, a shingle that the
document shares with the item is the bin's minimum on both sides with probability 0.63 or
more, whatever the document's length; an item of s shared shingles is missed with
probability 0.37**s (1e-4 for 9).  Items of fewer than EXACT_BELOW shingles are a class of
their own whose every shingle has its own bin, so they are never missed.  An item of 1 to
k - 1 words has one shingle, all its words, and documents are searched for windows of the
lengths that occur among such items too.

Every item that meets a document in a bin is verified in place by exact containment, so no
text is shuffled.  Items are broadcast in blocks of at most BLOCK_SHINGLES shingles; more
items mean more passes, not larger broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import corpus, load, pick

BLOCK_SHINGLES = 2_000_000
EXACT_BELOW = 9
SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


class ItemIndex:
    """The MinHash of a block of items for every size class, and their shingles."""

    def __init__(self, ids: list[int], texts: list[str], k: int, short: bool = True):
        w = K.words(pa.array(texts, pa.string()))
        g, off = K.sets(w, k)
        self.ids, self.off, self.hash = np.array(ids, dtype=np.int64), off, g
        #: by length in words under k: the hashes of such items in rising order, and the items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, k if short else 1):
            if len(own := np.flatnonzero(w.counts == m)):
                own = own[np.argsort(g[off[own]], kind="stable")]
                self.short[m] = g[off[own]], own
        item = np.repeat(np.arange(len(ids)), np.diff(off))
        # the lowest class from which a shingle is its bin's minimum: one more than the bits it shares with the shingle before it
        from_class = np.zeros(len(g), dtype=np.uint8)
        if len(g) > 1:
            common = 64 - _bits(g[1:] ^ g[:-1])
            same = item[1:] == item[:-1]
            from_class[1:] = np.where(same, common + 1, 0)
        from_class[np.diff(off)[item] < EXACT_BELOW] = 255
        order = np.argsort(g, kind="stable")
        order = order[w.counts[item[order]] >= k]
        self.key, self.item, self.from_class = g[order], item[order], from_class[order]
        self.distinct = np.unique(self.key)
        self.seen = np.zeros(1 << 21, dtype=bool)
        self.seen[(self.distinct & np.uint64((1 << 21) - 1)).astype(np.int64)] = True

    def candidates(self, g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs whose signatures meet; g has each text's shingles in rising order."""
        n = np.diff(off)
        top = np.ceil(np.log2(np.maximum(n, 1))).astype(np.uint8)
        at = np.flatnonzero(self.seen[(g & np.uint64((1 << 21) - 1)).astype(np.int64)])
        at = at[np.isin(g[at], self.distinct)]
        text = np.searchsorted(off, at, side="right") - 1
        before = g[np.maximum(at - 1, 0)]
        is_min = (at == off[text]) | (64 - _bits(g[at] ^ before) < top[text])
        lo, hi = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        e = K.ranges(lo, hi - lo)
        text, is_min = np.repeat(text, hi - lo), np.repeat(is_min, hi - lo)
        ok = (self.from_class[e] == 255) | (is_min & (self.from_class[e] <= top[text]))
        pairs = np.unique(text[ok] * len(self.ids) + self.item[e[ok]]) if ok.any() else np.zeros(0, np.int64)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def short_hits(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs of the items of fewer than k words that a text holds."""
        texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, (key, own) in self.short.items():
            g, off = K.grams(w, m)
            lo = np.searchsorted(key, g, "left")
            at = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == g)
            n = np.searchsorted(key, g[at], "right") - lo[at]
            pairs = np.unique(np.repeat(np.searchsorted(off, at, side="right") - 1, n) * len(self.ids) + own[K.ranges(lo[at], n)])
            texts.append(pairs // len(self.ids)), items.append(pairs % len(self.ids))
        return np.concatenate(texts), np.concatenate(items)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of 64-bit integers."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def _blocks(items: DataFrame, k: int, short: bool = True) -> Iterator[ItemIndex]:
    """Indexes of items dealt to blocks of at most BLOCK_SHINGLES words each, which is counted; an item of more words has a block of its own."""
    part = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    words = items.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9[^\x00-\x7F]]+"), F.lit(0))))
    parts = 1
    while True:
        blocks = words.groupBy(part(parts)).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        if (blocks.filter("n > 1").agg(F.max("words")).first()[0] or 0) <= BLOCK_SHINGLES:
            break
        parts *= 2
    for p in range(parts):
        rows = (items if parts == 1 else items.filter(part(parts) == p)).collect()
        rows.sort(key=lambda r: (r[0], r[1]))
        if rows or not p:
            yield ItemIndex([r[0] for r in rows], [r[1] for r in rows], k, short)


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """A row for each document and benchmark item at least `threshold` of whose k-gram shingles the document holds.

    docs has doc_id and text, items has item_id and text; other columns are ignored, whatever
    their names.  Null or empty texts hold nothing; an item of 1 to k - 1 words has one shingle,
    all its words in a row; rows with a null id are left out.  Repeated item rows count once, and a
    repeated document gives its rows again.  Empty tables give no rows.
    """
    spark, docs = docs.sparkSession, corpus(docs)
    items = pick(items, item_id="long", text="string").dropna().distinct()
    found = [docs.mapInArrow(_search(spark.sparkContext.broadcast(index), k, threshold), SCHEMA) for index in _blocks(items, k)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(shared, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for c in K.chunks(batch):
                w = K.words(c.column("text"))
                g, off = K.sets(w, k, short=False)
                texts, items = index.candidates(g, off)
                ids = c.column("doc_id").to_numpy(zero_copy_only=False)
                rows = [(int(ids[t]), int(index.ids[i]), 1, 1, 1.0) for t, i in zip(*index.short_hits(w))]
                for t, i in zip(texts, items):
                    own = index.hash[index.off[i] : index.off[i + 1]]
                    have = g[off[t] : off[t + 1]]
                    at = np.minimum(np.searchsorted(have, own), len(have) - 1)
                    shared_n = int((have[at] == own).sum())
                    if shared_n >= threshold * len(own):
                        rows.append((int(ids[t]), int(index.ids[i]), len(own), shared_n, shared_n / len(own)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.6, short: bool = False) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns, in place: no shuffle.

    Each row is judged by its own text, also where its doc_id is null or repeated, and items
    need no item_id.  short: items of fewer than k words are searched too.
    """
    schema, spark = docs.schema, docs.sparkSession
    text = schema.fieldNames().index("text")
    items = pick(items, text="string").dropna().distinct().select(F.lit(0).cast("long").alias("item_id"), "text")

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(shared, k, threshold)
            for batch in batches:
                bare = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text)], names=["doc_id", "text"])
                keep = np.ones(batch.num_rows, dtype=bool)
                for found in search(iter([bare])):
                    keep[found.column("doc_id").to_numpy()] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        return run

    for index in _blocks(items, k, short):
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast(index)), schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
few AS (SELECT DISTINCT item_id, len(w) AS m, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN 1 AND 4),
dm AS (SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM few), unnest(range(1, len(w) - m + 2)) AS t(i))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.6 * n
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM dm JOIN few USING (m, s)
"""
QUERIES = {"op1_decontamination": (op1_decontamination, SQL)}
