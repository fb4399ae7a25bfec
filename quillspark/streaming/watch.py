"""An extension: a folder of sources as a stream.

The scan has no state, so a stream of texts goes through the same plan as a table; each
micro-batch is added to the findings table, or compared with a snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import scan as S
from quillspark.operators import snapshot
from quillspark.sources.files import decode


def read(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return rows.filter(F.col("path").rlike(r"(?i)\.(?:sql|pks|pkb)$")).select(F.col("path").alias("source_file"), decode(F.col("content")).alias("source"))


def findings(sources: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    return S.scan(sources, detectors)


def run(sources: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Scan what is there and new since the last run, then stop; each gets the findings of a micro-batch and its number."""
    return S.scan(sources).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compare(baseline: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: snapshot.diff(baseline, snapshot.keyed(batch))
