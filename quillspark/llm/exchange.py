"""Packed all-to-all exchange of hashes, for operators that compare every n-gram of a corpus.

A row for each n-gram would cost Spark about 40 bytes in the shuffle.  Here a task packs the
hashes of a few million n-grams (a *unit*) into one binary row for each hash bucket, about
6 bytes an n-gram; a bucket's rows meet in one group, where numpy finds what the operator asks
for, and only the hits travel back to their unit, which names the documents.

Equal hashes of a unit are one entry with their number, so an n-gram that all documents have
costs its bucket one entry a unit and no bucket is hot; which places an entry stands for stays
with the unit's head, which travels once.  Where buckets are many, units are larger, so that a
row keeps some dozens of entries.

Lost tasks may be run again at any time, so a unit is named by its partition and ordinal;
the input must give the same rows in the same order when a partition is read again, which
holds for files and written tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .kernel import U

BLOB = "bucket int, unit long, n int, refs binary, keys binary, marks binary, places binary, head binary"
_BLOB = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("refs", "keys", "marks", "places", "head")])
MET = "unit long, n int, refs binary, marks binary, head binary"
_MET = pa.schema([("unit", pa.int64()), ("n", pa.int32()), ("refs", pa.binary()), ("marks", pa.binary()), ("head", pa.binary())])
#: Entries of a unit: the least, the most, and how many a bucket in between.
FLUSH, MOST_FLUSH, ROW_ENTRIES = 1_000_000, 8_000_000, 48
_MANY = 1 << 15


def buckets_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Hash buckets for a table: the session's shuffle partitions, more if they would be large.

    Beyond _MANY buckets (4 TB) their number and their size both grow with the square root of
    the table, so that units of MOST_FLUSH entries still fill their rows.  The size is the
    optimizer's estimate, so this starts no job; it changes no result.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    have = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    want = size // bytes_each + 1
    return max(have, want if want <= _MANY else min(1 << 20, int((want * _MANY) ** 0.5)))


def checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark's checkpoints at the folder the cluster names; only where none is named, at a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and cut from their lineage, whose shuffle files go at once."""
    checkpoint_dir(df.sparkSession)
    since = df.sparkSession.sparkContext._jsc.sc().newShuffleId()
    out = df.checkpoint()
    _drop_shuffles(df, since)
    return out


def _drop_shuffles(df: DataFrame, since: int) -> None:
    """Delete the files of the shuffles made for a frame that has been checkpointed; a later run of the frame itself would make them again."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    seen, todo = set(), [df._jdf.queryExecution().toRdd()] if cleaner.isDefined() else []
    while todo:
        rdd = todo.pop()
        level = rdd.getStorageLevel()
        if rdd.id() in seen or level.useMemory() or level.useDisk():
            continue
        seen.add(rdd.id())
        needs = rdd.dependencies()
        for i in range(needs.size()):
            need = needs.apply(i)
            if need.getClass().getSimpleName() == "ShuffleDependency" and need.shuffleId() > since:
                cleaner.get().doCleanupShuffle(need.shuffleId(), False)
            todo.append(need.rdd())


def narrow(x: np.ndarray) -> bytes:
    """Rising references as differences, 2 bytes each where they fit, else 4."""
    d = np.diff(x, prepend=0)
    return d.astype(np.uint16 if not len(d) or d.max() < 1 << 16 else np.uint32).tobytes()


def widen(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * n else np.uint32), dtype=np.int64)


class Packer:
    """Collects (hash, reference) entries of one task and yields packed rows."""

    def __init__(self, buckets: int, flagged: bool = False, placed: bool = False):
        """flagged: bit 0 of a hash is no part of it, and an entry has it if one of its places has.  placed: entries come with (doc_id, position), their keys keep all 64 bits, and the lowest place stands for its entry."""
        self.buckets, self.flagged, self.placed = buckets, flagged, placed
        self.limit = min(max(FLUSH, ROW_ENTRIES * buckets), MOST_FLUSH)
        self.unit = TaskContext.get().partitionId() << 32
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.refs, self.places, self.heads, self.size, self.base = [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, refs: np.ndarray, head: pa.RecordBatch, span: int, places: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """refs rise from 0 to span - 1; head has what the unit needs to read them again; places: rows of doc_id and position."""
        self.hashes.append(hashes)
        self.refs.append(refs + self.base)
        self.places.append(places)
        self.heads.append(head)
        self.size += len(hashes) + head.num_rows + (span >> 6)
        self.base += span
        if self.size >= self.limit:
            yield from self.flush()

    def _merged(self, h: np.ndarray, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of places of each entry (0: another one stands for it), that other one, and whether it has another place."""
        same = h >> U(1) if self.flagged else h
        order = np.argsort(same) if at is None else np.lexsort((at[:, 1], at[:, 0], same))
        first = np.ones(len(h), dtype=bool)
        first[1:] = same[order[1:]] != same[order[:-1]]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(h)))
        rep, by = np.repeat(order[start], size), np.empty(len(h), np.int64)
        by[order] = rep
        elsewhere = np.zeros(len(h), dtype=bool)
        if at is not None:
            elsewhere = (at[by] != at).any(axis=1)
            size = 1 + np.add.reduceat(elsewhere[order].astype(np.int64), start) if len(h) else size
        number = np.zeros(len(h), np.uint8)
        number[order[start]] = np.minimum(size, 255)
        if self.flagged and len(h):
            h[order[start]] |= np.maximum.reduceat(h[order] & U(1), start)
        return number, by, elsewhere

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.heads:
            return
        h, r = np.concatenate(self.hashes), np.concatenate(self.refs)
        at = np.concatenate(self.places) if self.placed else None
        number, by, elsewhere = self._merged(h, at)
        rest, own = np.flatnonzero(number == 0), np.flatnonzero(number)
        stands = narrow(r[rest]), (r[by[rest]].astype(np.uint32) << np.uint32(1) | elsewhere[rest]).astype(np.uint32).tobytes()
        h, r, number = h[own], r[own], number[own]
        b = ((h >> U(32)) % U(self.buckets)).astype(np.uint16 if self.buckets < 1 << 16 else np.uint32)
        order = np.argsort(b, kind="stable")
        b, r, key, number = b[order], r[order], h[order].astype(U if self.placed else np.uint32), number[order]
        doc, pos = (at[own][order, 0], at[own][order, 1].astype(np.int32)) if self.placed else (None, None)
        cuts = np.flatnonzero(np.diff(b.astype(np.int64), prepend=-1)) if len(b) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(b))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.heads[0].schema) as out:
            for x in self.heads:
                out.write_batch(x)
        home = (self.unit * 31 + (self.unit >> 32)) % self.buckets
        rows = [(int(b[s]), self.unit, int(e - s), narrow(r[s:e]), key[s:e].tobytes(), number[s:e].tobytes(), doc[s:e].tobytes() + pos[s:e].tobytes() if self.placed else None, None) for s, e in zip(cuts, ends)]
        rows.append((home, self.unit, 0, stands[0], stands[1], len(rest).to_bytes(8, "little"), None, sink.getvalue().to_pybytes()))
        for s in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[s : s + 64]), _BLOB)], schema=_BLOB)
        self.unit += 1
        self._clear()


def read_head(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _placed(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int32, n, 8 * n)


#: choose(keys, numbers of places, doc_ids and positions of the first) gives the rising entries to keep and a byte for each.
Choose = Callable[[np.ndarray, np.ndarray, "tuple[np.ndarray, np.ndarray] | None"], tuple[np.ndarray, np.ndarray]]


def meet(blobs: DataFrame, choose: Choose) -> DataFrame:
    """choose() in each bucket; the result has the kept entries for each unit and bucket, and each unit's head: MET."""

    def run(table: pa.Table) -> pa.Table:
        full, heads = [], []
        for r in table.to_pylist():
            (full if r["n"] else heads).append(r)
        res = [(r["unit"], 0, r["refs"] + r["keys"], r["marks"], r["head"]) for r in heads]
        if full:
            n = np.array([r["n"] for r in full], dtype=np.int64)
            keys = np.concatenate([np.frombuffer(r["keys"], dtype=U if r["places"] else np.uint32) for r in full])
            numbers = np.concatenate([np.frombuffer(r["marks"], dtype=np.uint8) for r in full])
            at = tuple(np.concatenate(x) for x in zip(*(_placed(r["places"], r["n"]) for r in full))) if full[0]["places"] else None
            keep, marks = choose(keys, numbers, at)
            ends = np.searchsorted(keep, np.concatenate([[0], np.cumsum(n)]))
            base = np.cumsum(n) - n
            res += [(r["unit"], int(e - s), narrow(widen(r["refs"], r["n"])[keep[s:e] - o]), marks[s:e].tobytes(), None) for r, s, e, o in zip(full, ends[:-1], ends[1:], base) if e > s]
        cols = list(zip(*res)) if res else [()] * 5
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _MET)], schema=_MET)

    return blobs.groupBy("bucket").applyInArrow(run, MET)


def gather(table: pa.Table) -> tuple[pa.Table | None, np.ndarray, np.ndarray]:
    """A unit's head, and its kept references and marks in order, with those that an entry stands for; to be used on the groups of meet() by unit.

    A place that differs from the one standing for it has the mark 1 where places are given.
    """
    head, refs, marks, rest, stands = None, [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], None, None
    for r in table.to_pylist():
        if r["n"]:
            refs.append(widen(r["refs"], r["n"]))
            marks.append(np.frombuffer(r["marks"], dtype=np.uint8))
        else:
            head, n = read_head(r["head"]), int.from_bytes(r["marks"], "little")
            rest, stands = widen(r["refs"][: len(r["refs"]) - 4 * n], n), np.frombuffer(r["refs"], np.uint32, n, len(r["refs"]) - 4 * n)
    refs, marks = np.concatenate(refs), np.concatenate(marks)
    order = np.argsort(refs)
    refs, marks = refs[order], marks[order]
    if rest is not None and len(rest) and len(refs):
        by = (stands >> np.uint32(1)).astype(np.int64)
        k = np.minimum(np.searchsorted(refs, by), len(refs) - 1)
        some = np.flatnonzero(refs[k] == by)
        mark = np.where(stands[some] & np.uint32(1), np.uint8(1), marks[k[some]])
        refs, marks = np.concatenate([refs, rest[some]]), np.concatenate([marks, mark])
        order = np.argsort(refs)
        refs, marks = refs[order], marks[order]
    return head, refs, marks
