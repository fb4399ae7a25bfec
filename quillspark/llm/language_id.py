"""Language identification: a linear-chain conditional random field over words.

Each word of a sentence gets a language, so code-switched text is labelled word by word.  A
word's score for a language is the sum of learned weights of its affixes (1 to 3 bytes),
its 2- and 3-grams of bytes with word edges, and its lexicon entry (the languages whose
training text has the word, each with its share of one, times a matrix of weights); weights of
n-grams and affixes live in a hashed table of fixed size.  Learned transitions tie neighbouring
words together; forward-backward gives each word's posterior.  A sentence ends at . ! ? or a
line end, however long it is: the steps of BLOCK words are multiplied to one matrix each, all
blocks at once, so a long chain takes few steps.

Besides the languages of the training labels there is one label, OTHER, for words of no
language, learned from random strings.  The chain is fitted by Adagrad on sentences cut from
a bounded sample of labelled documents (TRAIN_DOCS documents of at most TRAIN_CHARS
characters, those of the lowest hashes of their doc_id), half of them spliced from two
languages.
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

OTHER, UNKNOWN = "zxx", "und"
TABLE = 1 << 16
TRAIN_DOCS, TRAIN_CHARS = 1200, 20_000
BLOCK = 128
MOST_OTHER = 0.5
SCHEMA = "doc_id long, language string, confidence double, n_words long, n_switches long, kept boolean, spans array<struct<start_word:int,end_word:int,language:string>>"
_SPAN = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("language", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64()), ("kept", pa.bool_()), ("spans", pa.list_(_SPAN))])
_STOP = np.zeros(256, dtype=np.int32)
_STOP[[*b".!?\n\r"]] = 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of the words data[start:end], word by word, and their offsets."""
    n = (end - start).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n + 2)])
    text = np.full(off[-1] + 2, 1, dtype=np.uint32)  # 1 stands for a word's edge
    inner = K.ranges(off[:-1] + 1, n)
    text[inner] = data[K.ranges(start, n)]
    two = text[:-1] * np.uint32(257) + text[1:]
    three = two[:-1] * np.uint32(257) + text[2:]
    spread = lambda x, seed: ((x.astype(np.uint32) * np.uint32(2654435761) + np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(16)).astype(np.int64)
    f2, f3 = spread(two, 1), spread(three ^ (three << np.uint32(7)), 2)
    affix = [spread(text[np.minimum(off[:-1] + 1 + j, off[1:] - 1)] + np.uint32(0) if j == 0 else _join(text, off, n, j), 3 + j) for j in range(3)]
    affix += [spread(_tail(text, off, n, j), 6 + j) for j in range(3)]
    count = (n + 1) + n + 6
    foff = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(foff[-1], dtype=np.int64)
    out[K.ranges(foff[:-1], n + 1)] = f2[K.ranges(off[:-1], n + 1)]
    out[K.ranges(foff[:-1] + n + 1, n)] = f3[K.ranges(off[:-1], n)]
    base = foff[:-1] + 2 * n + 1
    for j, a in enumerate(affix):
        out[base + j] = a
    return out, foff


def _join(text: np.ndarray, off: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
    x = np.zeros(len(n), dtype=np.uint32)
    for i in range(j + 1):
        x = x * np.uint32(8191) + np.where(i < n, text[np.minimum(off[:-1] + 1 + i, off[1:] - 1)], 0).astype(np.uint32)
    return x


def _tail(text: np.ndarray, off: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
    x = np.zeros(len(n), dtype=np.uint32)
    for i in range(j + 1):
        x = x * np.uint32(8191) + np.where(i < n, text[np.maximum(off[1:] - 2 - i, off[:-1])], 0).astype(np.uint32)
    return x


@dataclass
class Model:
    """lexicon: hashes of known words in rising order; shares: how much each counts for each language."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    shares: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros((0, len(self.labels)), np.float32)
        f, off = features(data, start, end)
        return np.add.reduceat(self.weights[f], off[:-1], axis=0) + self.known(hashes) @ self.lexicon_weights

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's row of shares; zeros where it isn't known."""
        if not len(self.lexicon):
            return np.zeros((len(hashes), self.shares.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == hashes)[:, None], self.shares[at], 0)


def sentences(w: K.Words) -> np.ndarray:
    """Offsets of the sentences in the words of a few texts."""
    n = len(w.start)
    if not n:
        return np.zeros(1, np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
    new = np.zeros(n, dtype=bool)
    new[1:] = stops[w.start[1:]] > stops[w.end[:-1]]
    new[w.offsets[:-1][w.offsets[:-1] < n]] = True
    return np.append(np.flatnonzero(new), n)


def _blocks(p: np.ndarray, t: np.ndarray, off: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts chains into blocks of at most BLOCK words: their offsets, each block's scores before its first word, and those from behind its last one, both up to a factor.

    A block's words and transitions make one matrix; the matrices are multiplied out for all
    blocks at once, and only vectors go along a chain.
    """
    n = np.diff(off)
    count = -(-n // BLOCK)
    k, of = K.ranges(np.zeros(len(n), np.int64), count), np.repeat(count, count)
    cuts = np.append(np.repeat(off[:-1], count) + BLOCK * k, off[-1])
    into, behind = np.tile(s.astype(p.dtype), (len(k), 1)), np.ones((len(k), p.shape[1]), p.dtype)
    long = np.flatnonzero(of > 1)
    if not len(long):
        return cuts, into, behind
    first, size = cuts[long], np.diff(cuts)[long]
    through = np.tile(np.eye(p.shape[1], dtype=p.dtype), (len(long), 1, 1))
    last = np.ones((len(long), p.shape[1]), p.dtype)
    for i in range(int(size.max())):
        m = np.flatnonzero(size > i)
        x = through[m] * p[first[m] + i][:, None, :]
        x /= x.max(axis=(1, 2), keepdims=True)
        ends = size[m] == i + 1
        last[m[ends]] = x[ends].sum(axis=2)
        through[m] = x @ t
    at = np.full(len(k), -1)
    at[long] = np.arange(len(long))
    scaled = lambda x: x / x.max(axis=1, keepdims=True)
    for i in range(1, int(count.max())):
        b = np.flatnonzero(k == i)
        into[b] = scaled((into[b - 1][:, None, :] @ through[at[b - 1]])[:, 0])
    ahead = np.empty_like(behind)  # of a block's first word, with its own score
    for i in range(int(count.max()) - 1, 0, -1):
        b = np.flatnonzero(k == i)
        ends = of[b] == i + 1
        ahead[b[ends]] = last[at[b[ends]]]
        rest = b[~ends]
        ahead[rest] = (through[at[rest]] @ ahead[rest + 1][:, :, None])[:, :, 0]
        ahead[b] = scaled(ahead[b])
        behind[b - 1] = scaled(ahead[b] @ t.T)
    return cuts, into, behind


def forward_backward(e: np.ndarray, off: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of chains e[off[i]:off[i + 1]], all chains at once; with pairs, also the expected transitions and the log likelihood's normalizer."""
    top = e.max(axis=1, keepdims=True) if len(e) else e
    p, t, s = np.exp(e - top), np.exp(transitions), np.exp(start)
    off, into, behind = (off, np.tile(s.astype(p.dtype), (len(off) - 1, 1)), np.ones((len(off) - 1, p.shape[1]), p.dtype)) if pairs else _blocks(p, t, off, s)
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    first, length, into, behind = off[:-1][order], n[order], into[order], behind[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    alpha, beta, scale = np.empty_like(p), np.empty_like(p), np.ones((len(p), 1), p.dtype)
    for i, m in enumerate(active):
        at = first[:m] + i
        a = p[at] * (into[:m] if not i else alpha[at - 1] @ t)
        z = a.sum(axis=1, keepdims=True)
        alpha[at], scale[at] = a / z, z
    beta[first + length - 1] = behind
    for i in range(len(active) - 1, 0, -1):
        at = first[: active[i]] + i
        beta[at - 1] = ((p[at] * beta[at]) @ t.T) / scale[at]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    if not pairs:
        return post
    expected = np.zeros_like(t)
    for i, m in enumerate(active[1:], 1):
        at = first[:m] + i
        expected += t * (alpha[at - 1].T @ (p[at] * beta[at] / scale[at]))
    return post, expected, float(np.log(scale).sum() + top.sum())


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 4) -> Model:
    rng = np.random.default_rng(seed)
    labels = [*sorted(set(langs)), OTHER]
    noise = ["".join(rng.choice([*"bcdfghjklmnpqrstvwxz0123456789"], size=rng.integers(1, 12))) for _ in range(2000)]
    w = K.words(pa.array([*texts, " ".join(noise)], pa.string()))
    label_of_doc = np.array([labels.index(x) for x in langs] + [len(labels) - 1])
    y_word = np.repeat(label_of_doc, w.counts)
    uniq, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    seen = np.zeros((len(uniq), len(labels)), dtype=np.int64)
    np.add.at(seen, (inverse, y_word), 1)
    strong = (seen[:, :-1].sum(axis=1) >= 5) & (seen[:, -1] == 0)
    has = (seen[strong, :-1] * 10 >= seen[strong, :-1].sum(axis=1, keepdims=True)).astype(np.float32)
    model = Model(labels, np.zeros((TABLE, len(labels)), np.float32), uniq[strong], has / has.sum(axis=1, keepdims=True), np.zeros((len(labels) - 1, len(labels)), np.float32), np.zeros((len(labels),) * 2, np.float32), np.zeros(len(labels), np.float32))
    # chains: runs of a document, half of them spliced with a run of any other document
    counts, base = w.counts, w.offsets[:-1]
    docs = np.flatnonzero(counts > 0)
    by_label = [docs[label_of_doc[docs] == c] for c in range(len(labels))]
    by_label = [x for x in by_label if len(x)]

    def run_of() -> np.ndarray:
        d = rng.choice(by_label[rng.integers(len(by_label))])
        size = min(int(counts[d]), int(rng.integers(2, 14)))
        return base[d] + rng.integers(0, counts[d] - size + 1) + np.arange(size)

    g = [np.full_like(x, 0.1) for x in (model.weights, model.lexicon_weights, model.transitions, model.start)]
    steps, size, rate = 40 * epochs, 256, 0.25
    for _ in range(steps):
        chains = [np.concatenate([run_of() for _ in range(1 + int(rng.random() < 0.5))]) for _ in range(size)]
        token = np.concatenate(chains)
        off = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
        u, back = np.unique(inverse[token], return_inverse=True)
        f, foff = features(w.data, w.start[at[u]], w.end[at[u]])
        lex = model.known(uniq[u])
        e = (np.add.reduceat(model.weights[f], foff[:-1], axis=0) + lex @ model.lexicon_weights)[back]
        post, expected, _ = forward_backward(e, off, model.transitions, model.start, pairs=True)
        y = y_word[token]
        d = post.copy()
        d[np.arange(len(y)), y] -= 1
        du = np.zeros((len(u), len(labels)), np.float32)
        np.add.at(du, back, d)
        slots, of = np.unique(f, return_inverse=True)
        by = np.argsort(of, kind="stable")
        rows = np.repeat(du, np.diff(foff), axis=0)[by]
        grad = [np.add.reduceat(rows, np.searchsorted(of[by], np.arange(len(slots))), axis=0), lex.T @ du, expected.astype(np.float32), d[off[:-1]].sum(axis=0)]
        inside = np.ones(len(y), dtype=bool)
        inside[off[:-1]] = False
        np.subtract.at(grad[2], (y[np.flatnonzero(inside) - 1], y[inside]), 1)
        for x, h, dx, at_ in zip((model.weights, model.lexicon_weights, model.transitions, model.start), g, grad, (slots, ..., ..., ...)):
            dx = dx / size
            h[at_] += dx * dx
            x[at_] -= rate * dx / np.sqrt(h[at_])
    return model


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model:
    """A model from the max_docs labelled documents (text and lang, at most max_chars long) of the lowest hashes of their doc_id.

    Rows with a null doc_id, text or lang, or a blank text, are left out; repeated rows count
    again.  Without any row left the model knows OTHER alone, and no document is kept.
    """
    own = pick(docs, doc_id="long", text="string", lang="string").dropna().filter((F.length("text") <= max_chars) & (F.trim("text") != ""))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    last = own.select("h").orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]  # hashes alone travel, not texts
    rows = [] if last is None else own.filter(F.col("h") <= last).orderBy("h", "doc_id", "text").limit(max_docs).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def label_words(model: Model, w: K.Words) -> np.ndarray:
    """Each word's posterior over model.labels."""
    if not len(w.hashes):
        return np.zeros((0, len(model.labels)), np.float32)
    uniq, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    e = model.emissions(uniq, w.data, w.start[at], w.end[at])[back]
    return forward_backward(e, sentences(w), model.transitions, model.start)


def _spelt(w: K.Words) -> np.ndarray:
    """1 for words without digits, else 0: numbers, addresses and keys are of no language, and don't speak against one."""
    digits = np.concatenate([[0], np.cumsum((w.data >= 48) & (w.data <= 57))])
    return (digits[w.end] == digits[w.start]).astype(np.float64)


def _predict(shared, most_other: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.labels, UNKNOWN], dtype=object)
        real = len(model.labels) - 1
        for batch in batches:
            for c in K.chunks(batch):
                w = K.words(c.column("text"))
                post = label_words(model, w)
                n = w.counts
                spelt = _spelt(w)
                sums = np.zeros((len(post) + 1, post.shape[1] + 1))
                np.cumsum(np.column_stack([post * spelt[:, None], spelt]), axis=0, out=sums[1:])
                mean = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
                votes = mean[:, -1].astype(np.int64)
                mean = mean[:, :-1] / np.maximum(votes, 1)[:, None]
                best = mean[:, :real].argmax(axis=1) if real else np.zeros(len(n), np.int64)
                share = mean[np.arange(len(n)), best] if real else np.zeros(len(n))
                kept = (votes > 0) & (mean[:, real] < most_other) & (real > 0)
                y = post.argmax(axis=1)
                doc = w.doc()
                new = np.ones(len(y), dtype=bool)
                new[1:] = (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                ends = np.append(first[1:], len(y))
                of = doc[first]
                spans = pa.StructArray.from_arrays([pa.array(first - w.offsets[of], pa.int32()), pa.array(ends - w.offsets[of], pa.int32()), pa.array(names[y[first]], pa.string())], fields=[*_SPAN])
                off = np.searchsorted(of, np.arange(len(n) + 1))
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(names[np.where(kept, best, -1)], pa.string()), pa.array(share.astype(np.float64)), pa.array(n, pa.int64()), pa.array(np.maximum(np.diff(off) - 1, 0), pa.int64()), pa.array(kept), pa.ListArray.from_arrays(pa.array(off, pa.int32()), spans, type=_OUT.field("spans").type)],
                    schema=_OUT,
                )

    return run


def identify(docs: DataFrame, model: Model, most_other: float = MOST_OTHER) -> DataFrame:
    """The language of each document and of its words.

    language is the one with the greatest mean posterior over the words without digits,
    confidence that mean.  Where OTHER's mean is most_other or more, or there is no such word
    (null or empty text, numbers only), the language is "und" and kept is false; text switching
    between languages is kept.  spans lists the runs of words of one label, from which n_switches
    counts the changes.  Ties go to the alphabetically first language.  docs has doc_id and
    text; other columns are ignored; rows without a doc_id are left out, repeated rows give
    repeated results, and an empty table gives none.
    """
    docs = corpus(docs)
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), most_other), SCHEMA)


def drop_unknown(docs: DataFrame, model: Model, most_other: float = MOST_OTHER) -> DataFrame:
    """The documents with an identified language, with all their columns, in place: no shuffle.

    Each row is judged by its own text, also where its doc_id is null or repeated; null, empty
    and blank texts and those of no language go, and an empty table stays empty.
    """
    schema, shared = docs.schema, docs.sparkSession.sparkContext.broadcast(model)
    text = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(shared, most_other)
        for batch in batches:
            bare = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text)], names=["doc_id", "text"])
            kept = [x.column("kept") for x in predict(iter([bare]))]
            yield batch.filter(pa.chunked_array(kept).combine_chunks()) if kept else batch

    return docs.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op3_language_id": (op3_language_id, None)}
