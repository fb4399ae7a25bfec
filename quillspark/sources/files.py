"""Source files: which paths to read, and their texts as rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lexer import Source, normalise

SUFFIXES = (".sql", ".pks", ".pkb")
SCHEMA = "source_file string, source string, file_seq int"


def expand(paths: list[str]) -> tuple[list[str], list[str]]:
    """Files to read, and folders that hold none.

    A folder gives its files of the known suffixes, in any case, at any depth, by path; a file
    counts whatever its suffix, and a path that isn't there stays so that it can be reported.
    Of several spellings of one file the first counts.
    """
    files: list[str] = []
    empty: list[str] = []
    seen: set[str] = set()
    for path in map(Path, paths):
        inner = sorted(f for f in path.rglob("*") if f.is_file() and f.suffix.lower() in SUFFIXES) if path.is_dir() else [path]
        if not inner:
            empty.append(str(path))
        for f in inner:
            key = str(f.resolve())
            if key not in seen:
                seen.add(key)
                files.append(str(f))
    return files, empty


def decode(content):
    """Bytes as text: bad UTF-8 becomes U+FFFD, line ends \\n."""
    return normalise(F.make_valid_utf8(content.cast("string")))


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Named files as (source_file, source, file_seq), and the paths that aren't files or can't be read.

    Spark reads the bytes on the executors; only the names are on the driver.
    """
    there = [p for p in paths if Path(p).is_file() and os.access(p, os.R_OK)]
    missing = [p for p in paths if p not in there]
    if not there:
        return spark.createDataFrame([], SCHEMA), missing
    names = spark.createDataFrame([(str(Path(p).resolve()), p, i) for i, p in enumerate(there)], "full string, source_file string, file_seq int")
    rows = spark.read.format("binaryFile").load([str(Path(p).resolve()) for p in there])
    full = F.try_url_decode(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"\+", "%2B"))
    return rows.select(full.alias("full"), decode(F.col("content")).alias("source")).join(F.broadcast(names), "full").select("source_file", "source", "file_seq"), missing


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All source files below a folder of any file system, without listing them here; file_seq is 0, so files order by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.filter(F.col("path").rlike(r"(?i)\.(?:sql|pks|pkb)$")).dropDuplicates(["path"]).select(F.col("path").alias("source_file"), decode(F.col("content")).alias("source"), F.lit(0).alias("file_seq"))


_SLASH = re.compile(r"(?m)^[ \t]*/[ \t]*$")
_SEMICOLON = re.compile(";")
_STATEMENTS = pa.schema([("source_file", pa.string()), ("n", pa.int64()), ("statement", pa.string())])


def statements_of(text: str | None) -> list[str]:
    """The statements of a script: cut at lines of / alone, outside comments and literals, else at each semicolon; what is blank without comments and literals is left out."""
    s = Source(text)
    clean = s.clean.text
    cuts = [m.span() for m in _SLASH.finditer(clean)] or [m.span() for m in _SEMICOLON.finditer(s.text)]
    starts, ends = [0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(clean)]
    return [s.text[a:b].strip() for a, b in zip(starts, ends) if clean[a:b].strip()]


def split_statements(sources: DataFrame) -> DataFrame:
    """source_file, n from 0 and statement of SQL scripts; a null or empty source has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(batch.column(c) for c in (0, 1))):
                got = statements_of(text.as_py())
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array(got, pa.string())], schema=_STATEMENTS)

    return sources.select(F.col("source_file").cast("string"), F.col("source").cast("string")).mapInArrow(run, "source_file string, n long, statement string")
