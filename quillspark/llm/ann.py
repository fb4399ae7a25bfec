"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are put into cells around centroids.  A vector's residual from its centroid is
rotated by one random orthogonal matrix and keeps its signs, packed 64 to a word, and two
correction scalars: the residual's length and its inner product with its own code.  A query
is rotated the same way and cut to QUERY_BITS bits a dimension, so its inner product with a
code is a few ANDs and bit counts; divided by the code's scalar that is an unbiased estimate
of the inner product with the vector, with an error bound of order 1/sqrt(dimensions).

Two rounds.  In a query's PILOT nearest cells the vectors whose upper bound reaches what k
exactly scored ones there have are reranked; the k-th best score so far is the query's floor.
In its other cells only vectors whose upper bound reaches the floor are reranked.

Centroids are fitted on a bounded sample (FIT_SAMPLE vectors at most, those of the lowest
hashes of their id) and there are at most MOST_CELLS, about half the square root of the table
below that; every row is indexed.  How many cells to probe is measured: for SAMPLE_QUERIES
queries the exact neighbours are found in one pass over all vectors, and n_probe is the number
of nearest cells that holds TARGET of them.

A cell's vectors and its queries are cut into parts of about PART_ROWS, and each part of the
one meets each of the other in a group of its own, so no group grows with the table or a hot
cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .exchange import cut
from .tables import load

TOP_K, QUERY_BITS, EPSILON, TARGET = 10, 4, 1.9, 0.97
SAMPLE_QUERIES, ROUNDS, PILOT = 256, 4, 3
FIT_SAMPLE, MOST_CELLS, PART_ROWS = 1 << 18, 1 << 14, 1 << 15
RESULT = "vec_id long, neighbour_id long, score double, rank int"
_PART = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def rotation(d: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, 64 to an unsigned word."""
    rows, d = bits.shape
    wide = np.zeros((rows, -(-d // 64) * 64), dtype=np.uint8)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of the vectors of a cell."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.d = x.shape[1]
        self.x, self.centre, self.turn = x, centre, turn
        rotated = (x - centre) @ turn
        self.norm = np.linalg.norm(rotated, axis=1)
        bits = rotated > 0
        self.code, self.ones = pack(bits), bits.sum(axis=1)
        unit = rotated / np.maximum(self.norm, 1e-12)[:, None]
        self.own = np.maximum((np.abs(unit).sum(axis=1)) / np.sqrt(self.d), 1e-6)
        self.base = x @ centre - centre @ centre
        self.spread = self.norm * np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own / np.sqrt(max(1, self.d - 1))

    def estimate(self, q: np.ndarray, bits: int = QUERY_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries with the cell's vectors, and their error bounds."""
        rotated = (q - self.centre) @ self.turn
        low = rotated.min(axis=1, keepdims=True)
        step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / ((1 << bits) - 1), 1e-12)
        levels = np.rint((rotated - low) / step).astype(np.uint8)
        dots = np.zeros((len(q), len(self.x)))
        for b in range(bits):
            plane = pack((levels >> b) & 1)
            for w in range(plane.shape[1]):
                dots += np.bitwise_count(plane[:, w, None] & self.code[None, :, w]) * float(1 << b)
        # sum of signs * (low + step * level): signs are 2 * bit - 1
        total = levels.sum(axis=1, dtype=np.int64)[:, None]
        signed = step * (2 * dots - total) + low * (2 * self.ones[None, :] - self.d)
        residual = signed / np.sqrt(self.d) / self.own * self.norm
        length = np.linalg.norm(rotated, axis=1)[:, None]
        error = EPSILON * (length * self.spread + 0.5 * step * self.norm / self.own)
        return (q @ self.centre)[:, None] + self.base + residual, error


def _best(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors for each query, itself left out, that may reach its floor; ties go to the lower id.

    A floor of -inf is raised to the least exact score of the k highest estimates, a lower
    bound of the k-th best; vectors whose upper bound reaches the floor are reranked.
    """
    out: list[tuple] = []
    step, few = max(1, 500_000 // max(1, len(ids))), min(k + 1, len(ids))
    for at in range(0, len(q), step):
        qs, qi, floor = q[at : at + step], q_ids[at : at + step], floors[at : at + step].copy()
        score, error = codes.estimate(qs)
        same = qi[:, None] == ids[None, :]
        if (new := np.flatnonzero(floor == -np.inf)).size and len(ids) > few:
            top = np.argpartition(np.where(same[new], -np.inf, score[new]), len(ids) - few, axis=1)[:, len(ids) - few :]
            known = np.einsum("ij,ikj->ik", qs[new], codes.x[top])
            known[np.take_along_axis(same[new], top, 1)] = -np.inf
            floor[new] = np.sort(known, axis=1)[:, 1]  # of k + 1, one may be the query itself
        open_ = ~(score + error < (floor - 1e-9 * np.abs(floor))[:, None]) & ~same
        r, c = np.nonzero(open_)
        exact = np.empty(len(r))
        for s in range(0, len(r), 1 << 16):
            pair = slice(s, s + (1 << 16))
            exact[pair] = np.einsum("ij,ij->i", qs[r[pair]], codes.x[c[pair]])
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(qs)))
        keep = np.arange(len(r)) - first[r] < k
        out.append((qi[r[keep]], ids[c[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, nearest first."""
    far = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    n = min(n, len(centres))
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


def centroids(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly taken distinct vectors; a cell that loses all its vectors goes."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(np.int64)] if len(centres) else centres
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total[count > 0] / count[count > 0, None]
    return centres


def _lowest(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About `most` of n rows: those whose id has the lowest hashes; all where there are no more."""
    if n <= most:
        return rows
    return rows.filter(F.xxhash64("vec_id", F.lit(salt)) < int(-(1 << 63) + (1 << 64) * (most / n)))


def _probes(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, d: int, k: int, target: float) -> int:
    """How many of a query's nearest cells hold target of its exact neighbours, over a sample of queries; a task keeps k a query."""
    rows = queries.toArrow()
    q_ids, q = rows["vec_id"].to_numpy(), _matrix(rows["v"], d)
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q, centres))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, centres = shared.value
        order = _nearest(q, centres, len(centres))
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(centres))[None, :].repeat(len(q), 0), 1)
        best, cells = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("v"), d)
                score = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ x.T)
                near = np.broadcast_to(part.column("cell").to_numpy().astype(np.int64), score.shape)
                best, cells = np.concatenate([best, score], axis=1), np.concatenate([cells, near], axis=1)
                top = np.argpartition(-best, min(k, best.shape[1]) - 1, axis=1)[:, :k]
                best, cells = np.take_along_axis(best, top, 1), np.take_along_axis(cells, top, 1)
        if best.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, best.shape[1])), pa.array(np.take_along_axis(rank, cells, 1).ravel()), pa.array(best.ravel())], schema=_PART)

    parts = vectors.mapInArrow(exact, "q long, n long, score double")
    ranks = parts.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))).filter((F.col("r") <= k) & (F.col("score") > float("-inf"))).select("n").toArrow()["n"].to_numpy()
    return int(np.quantile(ranks, target, method="higher")) + 1 if len(ranks) else 1


def _spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (K.mix(ids.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


def _grid(cell: np.ndarray, ids: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in cells: the row, its part, and every part of the other side that it meets; own and other: the parts of each cell."""
    part, times = _spread(ids, own[cell]), other[cell]
    return np.repeat(np.arange(len(cell)), times), np.repeat(part, times), K.ranges(np.zeros(len(cell), np.int64), times)


def _round(members: DataFrame, queries: DataFrame, shared, d: int, k: int, first: int, last: int, sizes: np.ndarray) -> DataFrame:
    """q, n, score of one round: queries (vec_id, v, floor) in their nearest cells from `first` to before `last`."""

    def probed(b: pa.RecordBatch, centres: np.ndarray) -> np.ndarray:
        return _nearest(_matrix(b.column("v"), d), centres, last)[:, first:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[0]
        n = np.zeros(len(centres), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                n += np.bincount(probed(b.slice(at, 4096), centres).ravel(), minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])

    met = np.zeros(len(sizes), np.int64)
    for r in queries.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        met[r["cell"]] = r["n"]
    parts, q_parts = -(-sizes // PART_ROWS) * (met > 0), -(-met // PART_ROWS)

    def place_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                row, part, q_part = _grid(s.column("cell").to_numpy().astype(np.int64), s.column("vec_id").to_numpy(), np.maximum(parts, 1), q_parts)
                yield pa.RecordBatch.from_arrays([s.column("cell").take(pa.array(row)), pa.array(part), pa.array(q_part), s.column("vec_id").take(pa.array(row)), s.column("v").take(pa.array(row))], names=["cell", "part", "q_part", "vec_id", "v"])

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[0]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                cell = probed(s, centres)
                who = np.repeat(np.arange(s.num_rows), cell.shape[1])
                row, q_part, part = _grid(cell.ravel(), s.column("vec_id").to_numpy()[who], np.maximum(q_parts, 1), parts)
                take = pa.array(who[row])
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()[row]), pa.array(part), pa.array(q_part), s.column("vec_id").take(take), s.column("v").take(take), s.column("floor").take(take)], names=["cell", "part", "q_part", "vec_id", "v", "floor"])

    def search(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _PART.empty_table()
        centres, turn = shared.value
        order = np.argsort(members["vec_id"].to_numpy(), kind="stable")
        ids, x = members["vec_id"].to_numpy()[order], _matrix(members["v"], d)[order]
        codes = Codes(x, centres[members["cell"][0].as_py()], turn)
        q, n, s = _best(queries["vec_id"].to_numpy(), _matrix(queries["v"], d), queries["floor"].to_numpy(), ids, codes, k)
        return pa.Table.from_arrays([pa.array(q), pa.array(n), pa.array(s)], schema=_PART)

    left = members.mapInArrow(place_members, "cell long, part long, q_part long, vec_id long, v array<float>")
    right = queries.mapInArrow(place_queries, "cell long, part long, q_part long, vec_id long, v array<float>, floor double")
    keys = ["cell", "part", "q_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q long, n long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))).filter(F.col("rank") <= k)


def _search(rows: DataFrame, asks: Column, d: int, n: int, k: int, target: float, n_probe: int | None, cells: int | None) -> DataFrame:
    """The neighbours among vectors of one length."""
    spark = rows.sparkSession
    sample = _lowest(rows, n, FIT_SAMPLE, 0).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()
    centres = centroids(_matrix(sample["v"], d), cells or max(1, min(MOST_CELLS, int(np.ceil(np.sqrt(n) / 2)))))
    shared = spark.sparkContext.broadcast((centres, rotation(d)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(_matrix(s.column("v"), d), shared.value[0], 1)[:, 0], pa.int64()), s.column("vec_id"), s.column("v")], names=["cell", "vec_id", "v"])

    members = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(assign, "cell long, vec_id long, v array<float>"))
    sizes = np.zeros(len(centres), np.int64)
    for r in members.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    queries = members.filter(asks).select("vec_id", "v")
    if n_probe is None:
        n_probe = _probes(members, _lowest(queries, queries.count(), SAMPLE_QUERIES, 1), centres, d, k, target)
    n_probe, pilot = min(len(centres), n_probe), min(len(centres), n_probe, PILOT)
    near = cut(_ranked(_round(members, queries.withColumn("floor", F.lit(float("-inf"))), shared, d, k, 0, pilot, sizes), k))
    if pilot < n_probe:
        floors = near.filter(F.col("rank") == k).select(F.col("q").alias("vec_id"), F.col("score").alias("floor"))
        asked = cut(queries.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
        near = _ranked(near.select("q", "n", "score").unionByName(_round(members, asked, shared, d, k, pilot, n_probe, sizes)), k)
    return near.select(F.col("q").alias("vec_id"), F.col("n").alias("neighbour_id"), "score", "rank")


def neighbours(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = TOP_K, target: float = TARGET, n_probe: int | None = None, cells: int | None = None, asks: Column | None = None) -> DataFrame:
    """The k vectors of greatest inner product with each query: vec_id, neighbour_id, score, rank from 1.

    vectors has an id and an array of numbers; other columns are ignored.  Queries are all
    vectors, or those for which `asks`, a condition on vec_id, holds; all vectors are searched.
    Rows with a null id, a null or empty array, or an element that is null or not finite are
    left out.  Vectors of different lengths are no neighbours: each length is searched by
    itself.  Rows that repeat an id are one vector of each length, the lowest; equal vectors of
    other ids are neighbours like any.  Ties go to the lower id.  A vector is not its own
    neighbour; a table of one vector, or none, gives no rows.  Recall against brute force is
    about `target`.
    """
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<float>").alias("v"))
    v = v.filter("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    out = v.sparkSession.createDataFrame([], RESULT)
    for r in v.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        out = out.unionByName(_search(v.filter(F.size("v") == r["d"]), F.lit(True) if asks is None else asks, r["d"], r["count"], k, target, n_probe, cells))
    return out


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose vec_id is divisible by 100, against all."""
    return neighbours(load(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0)


QUERIES = {"op10_ann": (op10_ann, None)}
