"""Input handling shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast, under fixed names: further columns can't clash with ours."""
    return df.select(*[F.col(f"`{c}`").cast(columns[c]).alias(c) for c in columns])


def corpus(docs: DataFrame) -> DataFrame:
    """doc_id and text; rows without a doc_id can't be named in a result and are left out."""
    return pick(docs, doc_id="long", text="string").filter("doc_id is not null")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, which has doc_id, joined to the texts of docs; text comes as zstd-packed binary.

    Neither side is broadcast, whatever its size, so that cost is in proportion to the
    corpus; packed texts shuffle in about a third of their bytes.  unpack() gives them back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if t is None else pack(t.encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text binary").join(wanted, "doc_id")


def unpack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of with_texts(), in slices of some megabytes, its texts as strings."""
    at = batch.schema.get_field_index("text")
    for row in range(0, batch.num_rows, 512):
        part = batch.slice(row, 512)
        read = zstandard.ZstdDecompressor().decompress
        texts = pa.array([None if t is None else read(t).decode() for t in part.column(at).to_pylist()], pa.string())
        yield part.set_column(at, "text", texts)
