"""N-gram Jaccard self-join with a token-group matrix.

Which documents have word n-gram sets (tokens) of a Jaccard similarity of t or more?  The
join is exact.

1. Every partner of q shares t*|q| of q's tokens, so a document of which fewer tokens occur
   anywhere else has none.  One packed exchange gives every token of every document its
   number of documents (up to 255), and most documents leave here.
2. Documents with equal token sets are one set from here on, with their number.
3. Sets are partitioned into groups by their smallest token hash, which similar sets share
   with the probability of their similarity; groups over GROUP_SPLIT sets are split.
4. Token-group matrix.  q and a partner share a token among the |q| - ceil(t*|q|) + 1
   rarest of q's and among as many of its own (prefix filter; any fixed order of tokens is
   right, and rarest first keeps passages that many documents share out of it).  The matrix's
   rows for those tokens join queries to groups; q goes to each group met and to its own.
   Where more than GROUP_SPLIT queries meet a group, they are dealt to copies of it.
5. In a group, each block of BLOCK_SETS sets has the union of its tokens.  A block is opened
   for q only if q's overlap with the union reaches what q's least partner there would need;
   then overlaps with its sets are counted exactly.
6. A group gives no pairs but, for each of its sets and queries, how many documents it found
   them similar to, and one link to the lowest set they hang together with there; the links
   make classes, and both are joined back to the documents.
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

#: Where a share c of the words changes, (1 - c)**3 of the 3-grams stay: 10 % leave a similarity of about 0.57.
NGRAM, THRESHOLD = 3, 0.55
GROUP_SPLIT, BLOCK_SETS = 4096, 64
SETS = "name long, size long, n int, first long, tokens binary, prefix binary"
LINKS = "name long, root long, links long"
_LINKS = pa.schema([("name", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
_FOUND = "doc_id long, n int, fp1 long, fp2 long, df binary"


def _fingerprint(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a token set."""
    with np.errstate(over="ignore"):
        both = []
        for h in (g, K.mix(g + K.U(0x5851F42D4C957F2D))):
            sums = np.concatenate([np.zeros(1, K.U), np.cumsum(h, dtype=K.U)])
            both.append((sums[off[1:]] - sums[off[:-1]]).view(np.int64))
    return both[0], both[1]


def _tokens(c: pa.RecordBatch, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    return K.sets(K.words(c.column("text")), ngram)


def _least(t: float, n: np.ndarray | int) -> np.ndarray:
    """ceil(t * n) without the errors of floating point."""
    return np.ceil(t * np.asarray(n) - 1e-9).astype(np.int64)


def _emit(ngram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for c in K.chunks(batch):
                g, off = _tokens(c, ngram)
                n = np.diff(off)
                f1, f2 = _fingerprint(g, off)
                head = pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(n, pa.int32()), pa.array(f1), pa.array(f2)], names=["doc_id", "n", "fp1", "fp2"])
                yield from packer.add(g, np.arange(len(g)), head, len(g))
        yield from packer.flush()

    return run


def _shared(keys: np.ndarray, numbers: np.ndarray, at: None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several documents have, with their number, up to 255."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    total = np.add.reduceat(numbers[order].astype(np.int64), first)
    count = np.empty(len(k), dtype=np.int64)
    count[order] = np.repeat(total, np.diff(np.append(first, len(k))))
    keep = np.flatnonzero(count > 1)
    return keep, np.minimum(count[keep], 255).astype(np.uint8)


def _survivors(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        head, refs, marks = gather(table)
        n = head["n"].to_numpy().astype(np.int64)
        off = np.concatenate([[0], np.cumsum(n)])
        df = np.ones(off[-1], dtype=np.uint8)
        df[refs] = marks
        shared = np.concatenate([[0], np.cumsum(df > 1)])
        keep = np.flatnonzero((n > 0) & (shared[off[1:]] - shared[off[:-1]] >= _least(threshold, n)))
        return head.take(pa.array(keep)).append_column("df", pa.array([df[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary()))

    return run


def _fetch(ngram: int, threshold: float):
    """Token sets of the wanted documents, which come with the fingerprint, the size and the df of the set meant, and their prefixes without tokens of one document."""
    out = pa.schema([("name", pa.int64()), ("size", pa.int64()), ("n", pa.int32()), ("first", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in (c for part in unpack(batch) for c in K.chunks(part)):
                g, off = _tokens(c, ngram)
                f1, f2 = _fingerprint(g, off)
                n, rows = np.diff(off), []
                for i in np.flatnonzero((f1 == c.column("fp1").to_numpy()) & (f2 == c.column("fp2").to_numpy())):
                    own, df = g[off[i] : off[i + 1]], np.frombuffer(c.column("df")[i].as_py(), dtype=np.uint8)
                    rare = np.argsort(df, kind="stable")[: n[i] - int(_least(threshold, n[i])) + 1]
                    rare = rare[df[rare] > 1]
                    if len(rare):
                        rows.append((c.column("fp1")[i].as_py(), c.column("size")[i].as_py(), int(n[i]), int(own[:1].view(np.int64)[0]), own.tobytes(), own[rare].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("name", pa.int64()), ("gid", pa.int64()), ("token", pa.int64())])
    for b in batches:
        own = [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column("prefix")]
        if own:
            p = np.array([len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("name").to_numpy(), p)), pa.array(np.repeat(b.column("gid").to_numpy(), p)), pa.array(np.concatenate(own))], schema=out)


def _sets_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    names, at = np.unique(t["name"].to_numpy(), return_index=True)  # a repeated row gives its set again
    t = t.take(pa.array(at))
    return names, t["size"].to_numpy(), [np.frombuffer(x, dtype=K.U) for x in t["tokens"].to_pylist()]


def _verify(threshold: float):
    """name, root and links of a group's sets and queries: the documents found similar to each, and the lowest set it hangs together with.

    A pair is found by the side of the higher name, as the query, and only there.
    """

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        ids, weight, own = _sets_of(members)
        q_ids, q_weight, q_sets = _sets_of(queries)
        whole = len(members) and members["part"][0].as_py() == 0  # the copy of a group that meets its own sets
        names, links = np.concatenate([ids, q_ids]), np.zeros(len(ids) + len(q_ids), np.int64)
        label = np.arange(len(names))
        sides = [(len(ids), q_ids, q_weight, q_sets)] + [(0, ids, weight, own)] * bool(whole)
        for at in range(0, len(ids), BLOCK_SETS):
            block, block_ids, block_weight = own[at : at + BLOCK_SETS], ids[at : at + BLOCK_SETS], weight[at : at + BLOCK_SETS]
            sizes = np.array([len(x) for x in block])
            union = np.unique(np.concatenate(block))
            rows = np.zeros((len(block), len(union)), dtype=np.uint8)
            for r, x in enumerate(block):
                rows[r, np.searchsorted(union, x)] = 1
            for base, some_ids, some_weight, some in sides:
                for i in range(int(np.searchsorted(some_ids, block_ids[0], side="right")), len(some)):
                    q = some[i]
                    n = len(q)
                    fits = (sizes >= threshold * n - 1e-9) & (n >= threshold * sizes - 1e-9) & (block_ids < some_ids[i])
                    if not fits.any():
                        continue
                    here = np.searchsorted(union, q)
                    here = here[union[np.minimum(here, len(union) - 1)] == q]
                    if len(here) < _least(threshold / (1 + threshold), n + sizes[fits].min()):
                        continue
                    both = rows[:, here].sum(axis=1, dtype=np.int64)
                    found = np.flatnonzero(fits & (both >= threshold * (n + sizes - both) - 1e-9))
                    if len(found):
                        links[at + found] += some_weight[i]
                        links[base + i] += block_weight[found].sum()
                        met = np.unique(label[np.append(at + found, base + i)])
                        if len(met) > 1:
                            label[np.isin(label, met)] = met[0]
        some = np.flatnonzero(links)
        low = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(low, label, names)
        return pa.Table.from_arrays([pa.array(names[some]), pa.array(low[label[some]]), pa.array(links[some])], schema=_LINKS)

    return run


def _found(docs: DataFrame, ngram: int, threshold: float) -> DataFrame:
    blobs = docs.mapInArrow(_emit(ngram, buckets := buckets_for(docs)), BLOB)
    return cut(meet(blobs, _shared).groupBy("unit").applyInArrow(_survivors(threshold), _FOUND))


def _set_links(docs: DataFrame, classes: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """name, root and links, from every group that a set is in or goes to."""
    wanted = classes.select("doc_id", "fp1", "fp2", "df", "size")
    sets = cut(with_texts(docs, wanted).mapInArrow(_fetch(ngram, threshold), SETS))
    large = sets.groupBy("first").count().filter(F.col("count") > GROUP_SPLIT).withColumn("parts", F.ceil(F.col("count") / GROUP_SPLIT)).drop("count")
    grouped = sets.join(large, "first", "left").select("name", "size", F.when(F.col("parts").isNull(), F.col("first")).otherwise(F.xxhash64("first", F.pmod("name", "parts"))).alias("gid"), "tokens", "prefix")
    prefix = grouped.select("name", "gid", "prefix").mapInArrow(_prefixes, "name long, gid long, token long")
    rows = prefix.select("token", F.col("gid").alias("group")).distinct()
    met = cut(prefix.join(rows, "token").filter("gid <> group").select("name", "group").distinct())
    many = met.groupBy(F.col("group").alias("gid")).count().filter(F.col("count") > GROUP_SPLIT).select("gid", F.ceil(F.col("count") / GROUP_SPLIT).alias("deals"))
    asked = met.withColumnRenamed("group", "gid").join(many, "gid", "left").select("gid", "name", F.coalesce(F.pmod(F.xxhash64("name"), "deals"), F.lit(0)).alias("part"))
    queries = asked.join(grouped.select("name", "size", "tokens"), "name").select(*[F.col(c).alias(c) for c in ("gid", "part", "name", "size", "tokens")])
    members = grouped.join(many, "gid", "left").select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1)).alias("part"), "name", "size", "tokens")
    return cut(members.groupBy("gid", "part").cogroup(queries.groupBy("gid", "part")).applyInArrow(_verify(threshold), LINKS))


def components(edges: DataFrame) -> DataFrame:
    """name and the lowest name it is linked to through edges (a, b), for every name in an edge.

    Each round gives every name the lowest label among its neighbours' labels and its label's
    label, until none changes; the paths it has to follow are short, as similar sets are
    mostly similar to one another.
    """
    edges = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("m")).select("name", F.least("name", "m").alias("root"))
    while True:
        labels = cut(labels)
        near = edges.join(labels, edges["b"] == labels["name"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["name"] == near["a"]).select("name", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("name").alias("r"), F.col("root").alias("up"))
        step = cut(step.join(jump, step["root"] == jump["r"], "left").select("name", F.least("root", "up").alias("root"), "was"))
        if step.filter("root <> was").isEmpty():
            return step.select("name", "root")
        labels = step.select("name", "root")


def linked(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document that is similar to another: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their word n-gram sets is threshold or
    more; n_links is a document's number of links, exact copies and all others counted.
    class_id is the lowest doc_id that it is linked to, directly or through others.

    docs has doc_id and text; other columns are ignored.  A text of 1 to ngram - 1 words has
    one token, all its words; null and empty texts have none and are linked to nothing.  Rows
    without a doc_id are left out; rows that repeat a doc_id and its text count once.  A doc_id
    of several texts has one row, for all of them: its links are those of each, and texts of
    its own that are similar count as links.  An empty table gives no rows.
    """
    docs = corpus(docs)
    found = _found(docs, ngram, threshold)
    one = found.select("doc_id", "fp1", "fp2", "df").groupBy("fp1", "fp2", "doc_id").agg(F.first("df").alias("df"))
    classes = cut(one.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("df").alias("df")))
    parts = _set_links(docs, classes, ngram, threshold)
    member = found.select("doc_id", "fp1").distinct()
    lowest = member.groupBy("doc_id").agg(F.min("fp1").alias("a"), F.count("*").alias("n")).filter("n > 1")  # texts of one document hang together
    edges = parts.filter("name <> root").select(F.col("root").alias("a"), F.col("name").alias("b")).union(member.join(lowest, "doc_id").filter("a <> fp1").select("a", F.col("fp1").alias("b")))
    links = parts.groupBy("name").agg(F.sum("links").alias("links"))
    sets = classes.select(F.col("fp1").alias("name"), "doc_id", "size").join(links, "name", "left").join(components(edges), "name", "left")
    sets = sets.select("name", F.coalesce("root", "name").alias("root"), "doc_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    sets = cut(sets.filter("n_links > 0"))
    roots = sets.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = sets.select("name", "root", "n_links").join(roots, "root").select(F.col("name").alias("fp1"), "class_id", "n_links")
    return member.join(known, "fp1").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def keep_one(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class of linked documents the lowest doc_id stays.

    All columns stay.  Rows that repeat a doc_id with the same text all stay or all go; rows
    without a doc_id, and null and empty texts, stay.  An empty table stays empty.
    """
    gone = linked(docs, ngram, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(load(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT doc_id, s, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*))::DOUBLE >= 0.55::DOUBLE),
r(doc_id, root) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.root FROM r JOIN p ON r.doc_id = p.a),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a)
SELECT doc_id, class_id, n_links FROM c JOIN l USING (doc_id)
"""
QUERIES = {"op5_ngram_join": (op5_ngram_join, SQL)}
