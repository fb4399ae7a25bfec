"""Quality classifier: random-indexing word vectors and a small calibrated network.

Random indexing.  Every token has a fixed sparse random vector: NONZERO signs at random
places.  A token's learned vector is the sum of the random vectors of its neighbours, WINDOW
to each side, over the whole corpus.  Tokens (words, or runs of other marks, as written)
share VOCABULARY slots by hash, so the table has a fixed size; partial sums of the tasks are
added slot block by slot block.

A document is pooled four times: the mean and the spread of its tokens' vectors, and for each
label the mean weighted by what the tokens say about it, with the strength of that.  What a
token says (its evidence) is the log odds of its document counts by label.  A network of two
layers, fitted by Adam, gives the probabilities of good quality and of toxic content; while it
is fitted, each half of the labelled documents is pooled by the evidence of the other half, as
new documents are by evidence that isn't from them.  On a held-out part each probability gets
a temperature that calibrates it.  At most TRAIN_DOCS labelled documents are used, those of the
lowest hashes of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import corpus, load, pick

VOCABULARY, DIMENSIONS, NONZERO, WINDOW = 1 << 15, 32, 2, 2
TRAIN_DOCS, HIDDEN = 12_000, 48
LEAST_DOCS, SAYS = 3, 1.5
SLOT_BLOCK = 1 << 10
SCHEMA = "doc_id long, p_quality double, p_toxic double, n_tokens long, kept boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("p_quality", pa.float64()), ("p_toxic", pa.float64()), ("n_tokens", pa.int64()), ("kept", pa.bool_())])
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[K._WORD] = 1
_KIND[[*b" \t\r\n\f\v\0"]] = 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, as written, and their offsets by text."""
    data, off = K.flat(texts)
    kind = np.concatenate([[0], _KIND[data], [0]]).astype(np.int8)
    border = np.zeros(len(data) + 1, dtype=bool)
    border[off] = True
    change = (kind[1:] != kind[:-1]) | border
    start = np.flatnonzero(change[:-1] & (kind[1:-1] > 0))
    end = np.flatnonzero(change[1:] & (kind[1:-1] > 0)) + 1
    return K.span_hash(data, start, end), np.searchsorted(start, off)


def slots(h: np.ndarray) -> np.ndarray:
    return (h & K.U(VOCABULARY - 1)).astype(np.int64)


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every slot's random vector."""
    h = K.mix(np.arange(VOCABULARY * NONZERO, dtype=K.U) + K.U(12345))
    return (h % K.U(DIMENSIONS)).astype(np.int64).reshape(-1, NONZERO), np.where(h >> K.U(63), 1.0, -1.0).reshape(-1, NONZERO)


def index_corpus(texts: Iterator[pa.Array]) -> np.ndarray:
    """Sums of neighbours' random vectors by slot, over some texts."""
    place, sign = random_vectors()
    total = np.zeros(VOCABULARY * DIMENSIONS)
    for part in texts:
        h, off = tokens(part)
        slot = slots(h)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for gap in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
            for a, b in ((slot[near], slot[near + gap]), (slot[near + gap], slot[near])):
                for j in range(NONZERO):
                    total += np.bincount(a * DIMENSIONS + place[b, j], weights=sign[b, j], minlength=len(total))
    return total.reshape(VOCABULARY, DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The learned vectors of all slots, of length 1 where the slot was met, from the whole table.

    Null and empty texts add nothing, repeated rows count again, and an empty table gives zeros.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = index_corpus(c.column("text") for b in batches for c in K.chunks(b, size=4 << 20))
        for s in range(0, VOCABULARY, SLOT_BLOCK):
            part = total[s : s + SLOT_BLOCK].astype(np.int64)
            if part.any():
                size = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(part).max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.astype(size).tobytes()], pa.binary())], names=["slot", "total"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLOT_BLOCK * DIMENSIONS, dtype=np.int64)
        for x in t["total"]:
            raw = x.as_py()
            total += np.frombuffer(raw, dtype=f"i{len(raw) // len(total)}")
        return pa.table({"slot": t["slot"][:1], "total": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(sums, "slot int, total binary").groupBy("slot").applyInArrow(add, "slot int, total binary").collect()
    out = np.zeros((VOCABULARY, DIMENSIONS))
    for r in rows:
        out[r["slot"] : r["slot"] + SLOT_BLOCK] = np.frombuffer(r["total"], dtype=np.int64).reshape(-1, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Evidence:
    """What tokens say about quality and toxic content: log odds by token hash, 0 for those not known."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order].astype(np.float32)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hashes & K.U((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(h), 2), dtype=np.float32)
        some = np.flatnonzero(self.seen[(h & K.U((1 << 20) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            known = self.hashes[at] == h[some]
            out[some[known]] = self.weights[at[known]]
        return out


N_FEATURES = 4 * DIMENSIONS + 2 + 6


def pooled(texts: pa.Array, vectors: np.ndarray, evidence: Evidence) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and its number of tokens."""
    h, off = tokens(texts)
    n = np.diff(off)
    out = np.zeros((len(n), N_FEATURES), dtype=np.float32)
    some = np.flatnonzero(n)
    if len(some):
        slot, start = slots(h), off[:-1][some]
        x = vectors[slot]
        count = n[some, None]
        mean = np.add.reduceat(x, start, axis=0) / count
        square = np.add.reduceat(x * x, start, axis=0) / count
        again = np.zeros(len(slot) + 1)
        np.cumsum(np.append(False, slot[1:] == slot[:-1]), out=again[1:])
        parts = [mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(count), (again[off[1:]] - again[off[:-1]])[some, None] / count]
        w = evidence.of(h)
        for j in range(2):
            strong = np.where(np.abs(w[:, j]) > SAYS, w[:, j], 0)
            at = np.flatnonzero(strong)
            pool, total = np.zeros((len(n), DIMENSIONS)), np.zeros((len(n), 2))
            if len(at):
                doc = np.searchsorted(off, at, side="right") - 1
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                pool[doc[first]] = np.add.reduceat(x[at] * strong[at, None], first, axis=0)
                total[doc[first], 0] = np.add.reduceat(np.maximum(strong[at], 0), first)
                total[doc[first], 1] = np.add.reduceat(np.maximum(-strong[at], 0), first)
            rate = total[some] / count
            parts += [pool[some] / np.maximum(total[some].sum(axis=1, keepdims=True), 1e-6), np.log1p(100 * rate), np.log1p(total[some, :1])]
        out[some] = np.concatenate(parts, axis=1)
    return out, n


@dataclass
class Network:
    """relu(x W1 + b1) W2 + b2, divided by the temperatures, through the logistic function: quality, toxic."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray, t: float) -> float:
    z = z / t
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60, held_out: float = 0.2) -> Network:
    """y has two columns of 0 and 1: quality and toxic."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut_at = max(1, int(len(x) * (1 - held_out)))
    train, rest = order[:cut_at], order[cut_at:] if cut_at < len(x) else order
    net = Network(x[train].mean(axis=0), x[train].std(axis=0) + 1e-6, rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 2)) * 0.1, np.zeros(2), np.ones(2))
    names = ["w1", "b1", "w2", "b2"]
    m, v, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    share = np.clip(y[train].mean(axis=0), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            u = (x[part] - net.centre) / net.scale
            h = np.maximum(u @ net.w1 + net.b1, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[part]) * weight[part] / len(part)
            dh = (d @ net.w2.T) * (h > 0)
            grad = {"w1": u.T @ dh + 1e-3 * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-3 * net.w2, "b2": d.sum(axis=0)}
            step += 1
            for n in names:
                m[n] = 0.9 * m[n] + 0.1 * grad[n]
                v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
                setattr(net, n, getattr(net, n) - 0.003 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))
    net.b2 = net.b2 + np.log(share / (1 - share))  # back to the shares of the sample
    z = net.logits(x[rest])
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
    net.temperature = np.array([min(grid, key=lambda t: _loss(z[:, j], y[rest, j], t)) for j in range(2)])
    return net


def _evidence(rows: DataFrame) -> tuple[Evidence, Evidence, Evidence]:
    """From rows (text, quality, toxic, half): document counts of every token by label, for tokens of LEAST_DOCS documents or more; of half 0, of half 1, of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b):
                h, off = tokens(c.column("text"))
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                take = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *(c.column(x).take(take) for x in ("quality", "toxic", "half"))], names=["h", "quality", "toxic", "half"])

    sums = []
    for half in (0, 1):
        own = F.col("half") == half
        sums += [F.count_if(own).alias(f"n{half}"), *(F.sum(F.when(own, F.col(c)).otherwise(0.0)).alias(f"{c[0]}{half}") for c in ("quality", "toxic"))]
    size = rows.agg(*sums).first()
    by = rows.select("text", "quality", "toxic", "half").mapInArrow(run, "h long, quality double, toxic double, half long").groupBy("h").agg(*sums).filter(F.col("n0") + F.col("n1") >= LEAST_DOCS).toArrow()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        total = lambda c: sum(by[f"{c}{x}"].to_numpy() for x in halves)  # noqa: B023, E731
        whole = lambda c: sum(size[f"{c}{x}"] or 0 for x in halves)  # noqa: B023, E731
        n, docs = total("n"), whole("n")
        odds = [np.log((total(c) + 0.5) / (whole(c) + 1)) - np.log((n - total(c) + 0.5) / (docs - whole(c) + 1)) for c in "qt"]
        enough = n >= LEAST_DOCS
        out.append(Evidence(by["h"].to_numpy().view(K.U)[enough], np.stack(odds, axis=1)[enough]))
    return tuple(out)


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_docs: int = TRAIN_DOCS) -> tuple[Evidence, Network | None]:
    """Evidence and a network from the max_docs labelled documents of the lowest hashes of their doc_id.

    Rows with a null doc_id or label are left out; of rows that repeat a doc_id the lowest
    quality and the highest toxic count, and its texts are examples each.  A null or empty text
    is an example without tokens.  Without any labelled document there is no network.
    """
    docs = corpus(docs)
    chosen = pick(labels, doc_id="long", quality="double", toxic="double").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)))
    *halves, evidence = _evidence(rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, halves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, halves = shared.value
        for b in batches:
            for c in K.chunks(b):
                half = c.column("half").to_numpy()
                both = [pooled(c.column("text"), vectors, e)[0] for e in halves]
                x = np.where(half[:, None] == 1, both[0], both[1])
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("quality"), c.column("toxic"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "toxic", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality double, toxic double, x binary").collect()
    if not got:
        return evidence, None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return evidence, fit(np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got]).astype(np.float64), np.array([[r["quality"], r["toxic"]] for r in got]))


def classify(docs: DataFrame, trained: tuple[Evidence, Network | None], vectors: np.ndarray, least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """Calibrated probabilities for each document, and whether to keep it.

    kept: p_quality is at least `least` and p_toxic under most_toxic.  A text with no token
    (null, empty or blank) has p_quality 0 and p_toxic 0 and is not kept.  Where nothing could
    be learned, other texts have null probabilities and are kept.  docs has doc_id and text; other columns are ignored; rows without a doc_id are left out, repeated rows give
    repeated results, and an empty table gives none.
    """
    docs = corpus(docs)
    shared = docs.sparkSession.sparkContext.broadcast((*trained, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, net, vectors = shared.value
        for b in batches:
            for c in K.chunks(b):
                x, n = pooled(c.column("text"), vectors, evidence)
                p = (net.probabilities(x.astype(np.float64)) if net else np.zeros((len(n), 2))) * (n > 0)[:, None]
                unknown, kept = (n > 0) & (net is None), (n > 0) & ((net is None) | (p[:, 0] >= least) & (p[:, 1] < most_toxic))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(p[:, 0], mask=unknown), pa.array(p[:, 1], mask=unknown), pa.array(n, pa.int64()), pa.array(kept)], schema=_OUT)

    return docs.mapInArrow(run, SCHEMA)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    vectors = word_vectors(docs)
    return classify(docs, train(docs, labels, vectors), vectors)


QUERIES = {"op9_quality": (op9_quality, None)}
