"""URL filter: host word segmentation and multinomial naive Bayes.

A host or path is cut into runs of letters; a run such as "freecasinobets" is split into
words by Viterbi over a unigram model.  The model's counts are those of all words in the
visible text of all pages; WORDS, a small bundled list, count as at least FLOOR of the corpus.
A substring that is no known word costs as much as a word of one occurrence, and
BYTE_COST more for each character.  Words of more than SHORT characters are looked up by their
first SHORT ones, so a run needs no table of all its substrings and no word is too long.

Hosts with a word of SEEDS between dots and hyphens are the bad examples, all other hosts
good ones.  Every page is an example: its words are counted by class and give smoothed word
odds, and a page's score is the sum over its words plus the class odds.  So hosts that only
run seed words together, or use the words that go with them, are found too.

Counting is by run first, with partial sums, so a hot host costs nothing special; words are
joined to candidate substrings by hash, and no table that grows is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .exchange import cut
from .tables import load, pick

SEEDS = ["casino", "poker", "bets", "pills", "viagra", "porn", "xxx", "adult", "spam", "ads", "warez", "malware", "phish"]
WORDS = [*SEEDS, *"the and for free win cheap farm track blog shop news bet best online sex video games game slots money loan crypto health pharmacy drugs store download crack click buy deal live cam girls hot home page index post article wiki forum mail mobile school library science university music sport travel food recipe garden history press daily world city book photo top ref page html php feed source utm id www example com net org tag category user profile image images static api docs help about contact login search".split()]
FLOOR, BYTE_COST = 1e-5, 2.3
SHORT, ALPHA = 20, 1.0
FLUSH = 1_000_000
SCHEMA = "page_id long, url string, host string, words array<string>, log_odds double, kept boolean"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user and port; "" where there is none."""
    return F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def runs_of(url: Column) -> Column:
    """The runs of letters of a host, without its last label, and of the path, in order, repeated ones too."""
    host = F.regexp_replace(host_of(url), r"\.[^.]*$", "")
    path = F.lower(F.regexp_replace(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""))
    return F.regexp_extract_all(F.concat_ws(" ", host, path), F.lit(r"(\p{L}+)"), F.lit(1))


def _long_words(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of more than SHORT characters, and the ends of their first SHORT ones."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.flatnonzero((w.data & 0xC0) != 0x80)  # where characters begin
    first = np.searchsorted(letters, w.start)
    some = np.flatnonzero(np.searchsorted(letters, w.end) - first > SHORT)
    return some, letters[first[some] + SHORT]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words by hash, and for long ones the hash of their beginning and their length in bytes."""
    held: list[np.ndarray] = []
    size = 0

    def merged() -> np.ndarray:
        x = np.concatenate(held)
        _, at, back = np.unique(x[:, 0], return_index=True, return_inverse=True)
        out = x[at]
        out[:, 1] = np.bincount(back, weights=x[:, 1]).astype(np.int64)
        return out

    def row(x: np.ndarray) -> pa.RecordBatch:
        long = x[:, 3] == 0
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2], mask=long), pa.array(x[:, 3], mask=long)], names=["h", "n", "head", "bytes"])

    for batch in batches:
        for c in K.chunks(batch):
            w = K.words(c.column("text"))
            x = np.zeros((len(w.hashes), 4), np.int64)
            x[:, 0], x[:, 1] = w.hashes.view(np.int64), 1
            some, end = _long_words(w)
            x[some, 2], x[some, 3] = K.span_hash(w.data, w.start[some], end).view(np.int64), (w.end - w.start)[some]
            held.append(x)
            held[-1] = merged() if len(held) == 1 else x
            size += len(x)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0])
                if size > FLUSH // 2:
                    yield row(held[0])
                    held, size = [], 0
    if held:
        yield row(merged())


def word_counts(pages: DataFrame) -> DataFrame:
    """h, n: the hashes of all words in the visible text of all pages, with their numbers; head and bytes: for long words, the hash of their first SHORT characters and their length."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select(text.alias("text")).mapInArrow(_count, "h long, n long, head long, bytes long").groupBy("h").agg(F.sum("n").alias("n"), F.max("head").alias("head"), F.max("bytes").alias("bytes"))


def hash_of(words: list[str]) -> np.ndarray:
    """The kernel's hashes of single words."""
    data, off = K.flat(pa.array(words, pa.string()))
    return K.span_hash(data, off[:-1], off[1:])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every substring of each run, up to SHORT characters, with its place and hash."""
    for batch in batches:
        for c in K.chunks(batch, "run", 1 << 14):
            runs = c.column("run").to_pylist()
            at = [np.cumsum([0, *(len(x.encode()) for x in r)]) for r in runs]
            data, off = K.flat(c.column("run"))
            i = [K.ranges(np.zeros(len(a) - 1, np.int64), np.minimum(np.arange(len(a) - 1, 0, -1), SHORT)) for a in at]
            first = [np.repeat(np.arange(len(a) - 1), np.minimum(np.arange(len(a) - 1, 0, -1), SHORT)) for a in at]
            last = [f + n + 1 for f, n in zip(first, i)]
            who = np.repeat(np.arange(len(runs)), [len(f) for f in first])
            start = np.concatenate([o + a[f] for o, a, f in zip(off, at, first)]) if runs else np.zeros(0, np.int64)
            end = np.concatenate([o + a[x] for o, a, x in zip(off, at, last)]) if runs else np.zeros(0, np.int64)
            h = K.span_hash(data, start, end)
            yield pa.RecordBatch.from_arrays([c.column("run").take(pa.array(who)), pa.array(np.concatenate(first) if runs else start, pa.int32()), pa.array(np.concatenate(last) if runs else end, pa.int32()), pa.array(h.view(np.int64))], names=["run", "i", "j", "h"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The long words that stand at a place of a run, of those with the same beginning."""
    for b in batches:
        rows = []
        for run, i, words in zip(*(b.column(c).to_pylist() for c in ("run", "i", "words"))):
            raw, at = run.encode(), len(run[:i].encode())
            data, found = np.frombuffer(raw, np.uint8), [w for w in words if at + w["bytes"] <= len(raw)]
            if found:
                end = np.array([at + w["bytes"] for w in found])
                h = K.span_hash(data, np.full(len(end), at), end).view(np.int64)
                rows += [(run, i, len(raw[:e].decode(errors="ignore")), w["n"]) for w, e, x in zip(found, end.tolist(), h.tolist()) if x == w["h"]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["run", "i", "j", "n"])


def viterbi(run: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """The best split of run, given (start, end, count) of its known substrings; on ties the longest last word, known ones before others."""
    n, floor = len(run), float(np.log(total))
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, c in known:
        by_end[j].append((i, floor - float(np.log(c))))
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    unknown, since = np.inf, 0  # the cheapest way to be inside a word that isn't known, and where that began
    for j in range(1, n + 1):
        unknown += BYTE_COST
        if best[j - 1] + floor + BYTE_COST < unknown - 1e-12:
            unknown, since = best[j - 1] + floor + BYTE_COST, j - 1
        best[j], back[j] = unknown, since
        for i, cost in sorted(by_end[j]):
            if (c := best[i] + cost) < best[j] - 1e-12 or (c < best[j] + 1e-12 and i <= back[j]):
                best[j], back[j] = c, i
    out, j = [], n
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run and its words, for the distinct runs of a table and word counts as of word_counts()."""
    bundled = [int(x) for x in hash_of(WORDS).view(np.int64)]
    total = max(2, counts.agg(F.sum("n")).first()[0] or 0)
    least = max(1, int(FLOOR * total))
    extra = runs.sparkSession.createDataFrame([(h, least) for h in bundled], "h long, n long")
    known = counts.select("h", "n").unionByName(extra).groupBy("h").agg(F.max("n").alias("n"))
    long = counts.filter("bytes is not null").groupBy(F.col("head").alias("h")).agg(F.collect_list(F.struct("h", "n", "bytes")).alias("words"))
    pieces = runs.mapInArrow(_pieces, "run string, i int, j int, h long")
    found = pieces.join(known, "h").select("run", "i", "j", "n").unionByName(pieces.filter(F.col("j") - F.col("i") == SHORT).join(long, "h").select("run", "i", "words").mapInArrow(_extended, "run string, i int, j int, n long"))
    found = found.groupBy("run").agg(F.collect_list(F.struct("i", "j", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [viterbi(r, [(k["i"], k["j"], k["n"]) for k in (ks or [])], total) for r, ks in zip(b.column("run").to_pylist(), b.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(rows, pa.list_(pa.string()))], names=["run", "words"])

    return runs.join(found, "run", "left").select("run", "known").mapInArrow(split, "run string, words array<string>")


def score_urls(pages: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """page_id, url, host, the words of host and path in rising order, log_odds of bad against good, and kept: no seed word in the host, and log_odds below 0.

    pages has page_id, url and html; other columns are ignored.  A null html adds no words; a
    null or empty url, or one without letters, has no words and the class odds alone.  Rows
    without a page_id are left out; rows that repeat are examples and results each.  Where no
    host has a seed word nothing can be learned, every log_odds is null and every page kept.
    An empty table gives no rows.
    """
    pages = pick(pages, page_id="long", url="string", html="string").filter("page_id is not null")
    counts = cut(word_counts(pages))
    seeded = "(^|[.-])(" + "|".join(SEEDS if seeds is None else seeds) + ")([.-]|$)"
    urls = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(runs_of(F.col("url")), F.array().cast("array<string>")).alias("runs"))
    urls = urls.withColumn("bad", F.col("host").rlike(seeded).cast("long"))
    sizes = urls.agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    bad, good = sizes["bad"] or 0, sizes["n"] - (sizes["bad"] or 0)
    by_run = cut(urls.select("bad", F.explode("runs").alias("run")).groupBy("run").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")))
    split = cut(segment(by_run.select("run"), counts))
    words = split.join(by_run, "run").select(F.explode("words").alias("word"), "bad", "good").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = cut(words)
    sums = words.agg(F.count("*").alias("v"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    v, all_bad, all_good = sums["v"], sums["bad"] or 0, sums["good"] or 0
    odds = F.log((F.col("bad") + ALPHA) / F.lit(all_bad + ALPHA * v + ALPHA)) - F.log((F.col("good") + ALPHA) / F.lit(all_good + ALPHA * v + ALPHA))
    scored = split.select("run", F.posexplode("words").alias("at", "word")).join(words.select("word", odds.alias("odds")), "word")
    scored = scored.groupBy("run").agg(F.collect_list(F.struct("word", "odds")).alias("parts"))
    rows = urls.withColumn("row", F.monotonically_increasing_id())  # names repeated rows, until the next shuffle
    by_page = rows.select("page_id", "url", "host", "row", F.explode_outer("runs").alias("run")).join(scored, "run", "left")
    prior = float(np.log((bad + ALPHA) / (good + ALPHA)))
    parts = F.array_sort(F.flatten(F.collect_list("parts")))
    total = F.aggregate(F.col("parts"), F.lit(prior), lambda a, x: a + x["odds"]) if bad else F.lit(None).cast("double")
    out = by_page.groupBy("row", "page_id", "url", "host").agg(parts.alias("parts"))
    return out.select("page_id", "url", "host", F.col("parts")["word"].alias("words"), F.round(total, 9).alias("log_odds")).withColumn("kept", ~F.col("host").rlike(seeded) & F.coalesce(F.col("log_odds") < 0, F.lit(True)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_urls(load(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filter": (op7_url_filter, None)}
