"""Snapshots of findings: keys, saving, loading, difference, and verification after conversion."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry as R
from .findings import enrich, sort_keys

VERSION = 1
COLUMNS = "detector severity object_name line snippet message source_file gap_number failure_stage".split()
FIELDS = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in ["group_key", *COLUMNS])
SCHEMA = f"schema_version int, findings array<struct<{', '.join(f.replace(' ', ':') for f in FIELDS.split(', '))}>>"


class SnapshotError(ValueError):
    """A snapshot that can't be used; the message says why."""


def group_key() -> Column:
    """Names findings that are alike; line and message are left out, so keys repeat."""
    return F.substr(F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("detector", "source_file", "object_name", "snippet")])), F.lit(1), F.lit(12))


def keyed(findings: DataFrame) -> DataFrame:
    return enrich(findings).withColumn("group_key", group_key())


def save(findings: DataFrame, path: str, had_error: bool = False, baseline: str | None = None) -> bool:
    """Write a snapshot table (a folder of JSON lines, one finding each, with schema_version); false, and nothing written, after a scan with errors."""
    if baseline is not None and Path(path).resolve() == Path(baseline).resolve():
        raise SnapshotError("a snapshot can't replace the one it is compared with")
    if had_error:
        return False
    keyed(findings).select(F.lit(VERSION).alias("schema_version"), "group_key", *COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def save_document(findings: DataFrame, path: str, had_error: bool = False, baseline: str | None = None) -> bool:
    """The same as one JSON document, {"schema_version": 1, "findings": [...]}, in order of the findings; rows pass the driver one partition at a time."""
    if baseline is not None and Path(path).resolve() == Path(baseline).resolve():
        raise SnapshotError("a snapshot can't replace the one it is compared with")
    if had_error:
        return False
    rows = keyed(findings).orderBy(*sort_keys()) if "hit_seq" in findings.columns else keyed(findings).orderBy("source_file", "line", "detector")
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"schema_version": {VERSION}, "findings": [')
        for i, r in enumerate(rows.select(*COLUMNS, "group_key").toLocalIterator()):
            out.write((",\n" if i else "\n") + json.dumps(r.asDict(), ensure_ascii=False))
        out.write("\n]}\n")
    return True


def load(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a snapshot: a folder written by save(), or one JSON document with schema_version and findings.

    Unreadable, not UTF-8, not JSON, without findings, of another version, or with a finding
    that has no group_key or detector: SnapshotError.
    """
    at = Path(path)
    if at.is_dir():
        rows = spark.read.schema(f"schema_version int, {FIELDS}").option("mode", "FAILFAST").json(path)
        if not rows.filter("schema_version is distinct from 1 or group_key is null or detector is null").isEmpty():
            raise SnapshotError("a row of another version, or without group_key or detector")
        return rows.drop("schema_version")
    try:
        document = json.loads(at.read_text(encoding="utf-8"))
    except UnicodeDecodeError as e:
        raise SnapshotError("not UTF-8") from e
    except json.JSONDecodeError as e:
        raise SnapshotError("not JSON") from e
    except OSError as e:
        raise SnapshotError(f"can't be read: {e}") from e
    if not isinstance(document, dict) or not isinstance(document.get("findings"), list):
        raise SnapshotError("no list of findings")
    if document.get("schema_version") != VERSION or isinstance(document.get("schema_version"), bool):
        raise SnapshotError("of another version")
    if any(not isinstance(f, dict) or not {"group_key", "detector"} <= f.keys() for f in document["findings"]):
        raise SnapshotError("a finding without group_key or detector")
    rows = [tuple(f.get(c) for c in ["group_key", *COLUMNS]) for f in document["findings"]]
    return spark.createDataFrame(rows, FIELDS)


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Bag difference by group_key: status (new, resolved, unchanged), group_key and n, for n above 0."""
    sides = baseline.select("group_key", F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(current.select("group_key", F.lit(0).alias("b"), F.lit(1).alias("c")))
    sums = sides.groupBy("group_key").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    parts = F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in (("new", F.col("c") - F.col("b")), ("resolved", F.col("b") - F.col("c")), ("unchanged", F.least("b", "c")))])
    return sums.select("group_key", F.inline(parts)).filter("n > 0").select("status", "group_key", "n")


def diff_rows(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The findings themselves with their status: of equal keys the first on either side are matched, in order."""
    def counted(df: DataFrame, order: list) -> DataFrame:
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy("group_key").orderBy(*order)))

    b = counted(baseline, [F.col("line"), F.col("message")]).select("group_key", "__rn", F.struct(*COLUMNS).alias("b"))
    c = counted(current, sort_keys() if "hit_seq" in current.columns else [F.col("line"), F.col("message")]).select("group_key", "__rn", F.struct(*[x for x in COLUMNS if x in current.columns]).alias("c"))
    both = b.join(c, ["group_key", "__rn"], "full_outer")
    status = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("unchanged")
    return both.select(status.alias("status"), "group_key", *[F.coalesce(F.col(f"c.{x}"), F.col(f"b.{x}")).alias(x) for x in COLUMNS[:7]])


def verify(baseline: DataFrame, after: DataFrame) -> DataFrame:
    """For each detector of the snapshot: its findings before and after conversion, and whether they are still there."""
    spark = baseline.sparkSession
    before = baseline.groupBy("detector").agg(F.count("*").alias("baseline_count"))
    rescan = after.groupBy("detector").agg(F.count("*").alias("n"))
    gaps = R.gaps(spark).select("detector", F.col("number").alias("gap_number"))
    rows = before.join(rescan, "detector", "left").join(F.broadcast(R.modes(spark)), "detector", "left").join(F.broadcast(gaps), "detector", "left")
    count = F.coalesce("n", F.lit(0))
    status = F.when(F.coalesce("mode", F.lit("")) != "verbatim", "not_verifiable").when(count > 0, "still_present").otherwise("not_detected")
    return rows.select("detector", "gap_number", "baseline_count", count.alias("post_migration_count"), status.alias("status"))


def verification_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("still_present", "not_detected", "not_verifiable")])
