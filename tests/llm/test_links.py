"""Classes and links of similar documents against all pairs; hot tokens and passages in many small buckets."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import exchange, ngram_join, substring_dedup

from .brute import copied_words, keep_one, similar

TEXT = "the quick brown fox jumps over the lazy dog near the old mill by the river at noon"
OTHER = "completely different words appear in this second text so that nothing here is shared"
ROWS = [(1, TEXT), (2, TEXT), (3, TEXT), (4, TEXT + " today"), (5, TEXT + " today"), (6, "a " + TEXT), (7, OTHER), (8, OTHER), (9, "alone"), (10, None), (3, TEXT)]
DDL = "doc_id long, text string"


def want(rows):
    pairs = similar(rows)
    links = Counter(d for p in pairs for d in p)
    root = {d: d for d in links}
    for _ in links:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {(d, root[d], n) for d, n in links.items()}


def got(df):
    return {tuple(r) for r in ngram_join.linked(df).select("doc_id", "class_id", "n_links").collect()}


def test_links_of_all_copies(spark):
    assert got(spark.createDataFrame(ROWS, DDL)) == want(ROWS)
    assert got(spark.createDataFrame([], DDL)) == set()


def test_a_document_of_several_texts(spark):
    rows = [(1, TEXT), (2, TEXT), (1, TEXT + " today"), (3, TEXT + " today")]
    assert got(spark.createDataFrame(rows, DDL)) == {(1, 1, 6), (2, 1, 3), (3, 1, 3)}


def made(n):
    """Documents that all share a passage, and near copies of one another in groups."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for d in range(n):
        own = [f"w{d % 9}x{i}" for i in range(40)]
        own[rng.randrange(40)] = f"y{d}"
        rows.append((d, f"{passage} {' '.join(own)} " + " ".join(f"z{d}v{i}" for i in range(d % 4 * 60))))
    return rows


@pytest.mark.parametrize("split", [4096, 3])
def test_one_passage_in_every_document(spark, monkeypatch, split):
    """Every document holds the same tokens; groups, buckets and units are small, and cut."""
    monkeypatch.setattr(ngram_join, "GROUP_SPLIT", split)
    monkeypatch.setattr(exchange, "FLUSH", 500)
    monkeypatch.setattr(exchange, "MOST_FLUSH", 500)
    rows = made(80)
    df = spark.createDataFrame(rows, DDL)
    assert got(df) == want(rows)
    left = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect())
    assert left == sorted(keep_one(rows))


def test_one_passage_in_every_document_is_found_at_each(spark, monkeypatch):
    monkeypatch.setattr(exchange, "FLUSH", 500)
    monkeypatch.setattr(exchange, "MOST_FLUSH", 500)
    rows = made(60)
    places = {}
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, DDL)).filter("is_copy").collect():
        places.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert places == copied_words(rows)


class _Task:
    def partitionId(self):
        return 0


def packed(monkeypatch, hashes, buckets):
    monkeypatch.setattr(exchange.TaskContext, "get", staticmethod(_Task))
    packer, out = exchange.Packer(buckets), []
    for part in np.array_split(hashes, 64):
        head = pa.RecordBatch.from_arrays([pa.array([0])], names=["d"])
        out += packer.add(part, np.arange(len(part)), head, len(part))
    return [r for b in [*out, *packer.flush()] for r in b.to_pylist()]


def size(rows):
    """Bytes of rows in a shuffle: their blobs, and about 100 for each row itself."""
    return sum(100 + sum(len(r[c]) for c in ("refs", "keys", "head") if r[c]) for r in rows)


def test_bytes_do_not_grow_with_the_buckets(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 6_500_000).astype(np.uint64)
    few, many = (size(packed(monkeypatch, hashes, b)) / len(hashes) for b in (4096, 65536))
    assert many < 2 * few < 14


def test_a_hot_hash_is_one_entry_a_unit(monkeypatch):
    hashes = np.full(1_000_000, 12345 << 40, dtype=np.uint64)
    rows = packed(monkeypatch, hashes, 64)
    assert [r["n"] for r in rows if r["n"]] == [1] and rows[0]["marks"] == b"\xff"
