"""The quality classifier's features, one token after another; merges of tiny vocabularies; short benchmark items."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontamination, quality

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff \t\r\n\f\v\0]+")
_hash: dict[str, int] = {}


def number(token):
    if token not in _hash:
        _hash[token] = int(quality.tokens(pa.array([token]))[0][0])
    return _hash[token]


def slot(token):
    return number(token) & (quality.VOCABULARY - 1)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: TOKEN.findall(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_vectors(texts):
    place, sign = quality.random_vectors()
    out = np.zeros((quality.VOCABULARY, quality.DIMENSIONS))
    for ts in texts.values():
        for i, t in enumerate(ts):
            for j in range(max(0, i - quality.WINDOW), min(len(ts), i + quality.WINDOW + 1)):
                if i != j:
                    for p, x in zip(place[slot(ts[j])], sign[slot(ts[j])]):
                        out[slot(t), p] += x
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def test_word_vectors(spark, texts):
    got = quality.word_vectors(spark.read.parquet(f"{SF}/documents.parquet"))
    assert np.allclose(got, plain_vectors(texts), atol=1e-6)


def test_evidence_and_pooling(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    vectors = quality.word_vectors(docs)
    rows = docs.join(labels, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))
    evidence = quality._evidence(rows.select("text", F.col("quality").cast("double"), F.col("toxic").cast("double"), "half"))[2]
    label = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts}
    n = Counter(t for d in label for t in set(texts[d]))
    yes = [Counter(t for d, y in label.items() if y[j] for t in set(texts[d])) for j in range(2)]
    total = [sum(y[j] for y in label.values()) for j in range(2)]

    def said(t, j):
        if n[t] < quality.LEAST_DOCS:
            return 0.0
        return math.log((yes[j][t] + 0.5) / (total[j] + 1)) - math.log((n[t] - yes[j][t] + 0.5) / (len(label) - total[j] + 1))

    vocabulary = sorted(n)
    got = evidence.of(np.array([number(t) for t in vocabulary], dtype=np.uint64))
    assert np.allclose(got, [[said(t, 0), said(t, 1)] for t in vocabulary], atol=1e-5)
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = sorted(by)[:60]
    x, size = quality.pooled(pa.array([by[d] for d in some]), vectors, evidence)
    for row, k, d in zip(x, size, some):
        ts = texts[d]
        assert k == len(ts)
        if not ts:
            assert not row.any()
            continue
        v = np.array([vectors[slot(t)] for t in ts], dtype=np.float64)
        want = [v.mean(axis=0), v.std(axis=0), [math.log1p(len(ts))], [sum(slot(a) == slot(b) for a, b in zip(ts, ts[1:])) / len(ts)]]
        for j in range(2):
            w = np.array([said(t, j) if abs(said(t, j)) > quality.SAYS else 0.0 for t in ts])
            plus, minus = np.maximum(w, 0).sum(), np.maximum(-w, 0).sum()
            want += [(v * w[:, None]).sum(axis=0) / max(plus + minus, 1e-6), [math.log1p(100 * plus / len(ts)), math.log1p(100 * minus / len(ts))], [math.log1p(plus)]]
        assert np.allclose(row, np.concatenate(want), atol=2e-3)


def merged(raw, merges):
    """The merge loop itself: of all pairs the earliest merge, leftmost first."""
    parts = [bytes([b]) for b in raw]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_tokens_of_every_prefix_are_the_merge_loops(seed):
    rng = random.Random(seed)
    tokens, merges = [bytes([b]) for b in range(256)], []
    made = [b"a", b"b", b"c"]
    for _ in range(25):
        x, y = rng.choice(made), rng.choice(made)
        if x + y not in tokens and len(x + y) < 9:
            merges.append((x, y))
            tokens.append(x + y)
            made.append(x + y)
    own = {t: i for i, t in enumerate(tokens)}
    encoder = bpe.Encoder({"tokens": tokens, "merges": [(own[a], own[b], own[a + b]) for a, b in merges]})
    for _ in range(300):
        raw = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24)))
        got = [tokens[i] for i in np.frombuffer(encoder.encode_piece(raw), dtype=np.int32)]
        assert got == merged(raw, merges)


def test_a_vocabulary_without_all_bytes(tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {"a": 0}, "merges": []}}))
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(tmp_path / "v.json"))


def test_items_are_dealt_to_blocks_of_counted_size(spark, monkeypatch):
    rows = [(i, " ".join(f"i{i}w{j}" for j in range(i % 9 + 1))) for i in range(40)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(100 + i, f"x {t} y") for i, t in rows], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 20)
    blocks = list(decontamination._blocks(items, 5))
    assert len(blocks) > 8 and all(len(b.ids) < 2 or sum(i % 9 + 1 for i in b.ids) <= 20 for b in blocks)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, items).collect()}
    assert got == {(100 + i, i) for i in range(40)}
