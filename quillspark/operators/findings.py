"""Relational work on findings.  Dimensions are small and fixed, so they are broadcast; findings never are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import registry as R

KEYS = ["file_seq", "source_file", "detector_seq", "hit_seq"]


def sort_keys() -> list[Column]:
    """Severity, object and line, then the order of emission."""
    return [R.rank(F.col("severity")), F.col("object_name"), F.col("line"), *map(F.col, KEYS)]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*sort_keys())


def numbered(findings: DataFrame) -> DataFrame:
    """seq: each finding's place in the order, from 1; ranges are sorted apart and their sizes added, so no task holds all.

    The ranges are kept, so that sizes and places are those of the same ones.
    """
    ranges = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = findings.repartitionByRange(ranges, *sort_keys()).sortWithinPartitions(*sort_keys()).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).persist()
    sizes = rows.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("__first"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(F.broadcast(starts), "__p").withColumn("seq", F.col("__i") - F.col("__first") + F.col("__start") + 1).drop("__p", "__i", "__first", "__start")


def enrich(findings: DataFrame) -> DataFrame:
    """With gap_number and failure_stage; null where the registry has no row."""
    gaps = R.gaps(findings.sparkSession).select("detector", F.col("number").alias("gap_number"), "failure_stage")
    return findings.join(F.broadcast(gaps), "detector", "left")


def translate(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Messages by texts (message, translated); those without a row stay."""
    texts = texts.select(F.col("message").alias("__m"), F.col("translated").alias("__t"))
    return findings.join(texts, F.col("message") == F.col("__m"), "left").withColumn("message", F.coalesce("__t", "message")).drop("__m", "__t")


def with_hint(findings: DataFrame) -> DataFrame:
    hints = R.hints(findings.sparkSession).filter("lang = 'en'").select("detector", "hint")
    return findings.join(F.broadcast(hints), "detector", "left").withColumn("hint", F.coalesce("hint", F.lit(R.GENERIC_HINT)))


def select(findings: DataFrame, severity: str | None = None, contains: str | None = None) -> DataFrame:
    """Display filter: severity by equality, object name by a substring in any case."""
    if severity is not None:
        findings = findings.filter(F.col("severity") == severity)
    if contains is not None:
        findings = findings.filter(F.upper("object_name").contains(contains.upper()))
    return findings


def gate(findings: DataFrame, threshold: str) -> DataFrame:
    """One row: failed, whether a finding is at least as severe as the threshold."""
    return findings.agg(F.coalesce(F.bool_or(R.rank(F.col("severity")) <= R.RANKS[threshold]), F.lit(False)).alias("failed"))


def gates(findings: DataFrame) -> DataFrame:
    """threshold and failed for every threshold, from one pass."""
    worst = findings.agg(F.min(R.rank(F.col("severity"))).alias("worst"))
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(F.col("worst") <= r, F.lit(False)).alias("failed")) for t, r in R.RANKS.items()])
    return worst.select(F.inline(rows))


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity and n for high, medium and low, with 0 too, and for other where there are any."""
    known = F.when(F.col("severity").isin(*R.RANKS), F.col("severity")).otherwise("other")
    counts = findings.groupBy(known.alias("severity")).agg(F.count("*").alias("n"))
    base = R.hours(findings.sparkSession).select("severity", F.lit(0).cast("long").alias("n"))
    return counts.unionByName(base).groupBy("severity").agg(F.sum("n").alias("n"))


def ordered_counts(findings: DataFrame) -> DataFrame:
    return severity_counts(findings).filter("n > 0").orderBy(R.rank(F.col("severity")), "severity")


def effort(findings: DataFrame) -> DataFrame:
    """lo, hi and mid hours: the first finding of each detector, in order, at its severity's range, the others at the flat range.

    The first is found by partial aggregation; findings are not sorted.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_keys())])
    each = findings.groupBy("detector").agg(F.count("*").alias("n"), F.min_by("severity", key).alias("severity"))
    price = each.join(F.broadcast(R.hours(findings.sparkSession)), "severity", "left")
    total = [F.coalesce(F.sum(F.coalesce(c, F.lit(first)) + (F.col("n") - 1) * more), F.lit(0.0)).alias(c) for c, first, more in zip(("lo", "hi"), R.OTHER_HOURS, R.REPEAT_HOURS)]
    return price.agg(*total).withColumn("mid", (F.col("lo") + F.col("hi")) / 2)


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count("*").alias("n"))


def distinct_detectors(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_distinct("detector").alias("n"))


def top_objects(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The objects with most findings: object_name, n, worst severity's rank, and the objects left out; none where there is one object only."""
    each = findings.groupBy("object_name").agg(F.count("*").alias("n"), F.min(R.rank(F.col("severity"))).alias("worst"))
    top = each.orderBy(F.desc("n"), "worst", "object_name").limit(limit)
    many = each.agg(F.count("*").alias("objects"))
    return top.crossJoin(F.broadcast(many)).filter("objects > 1").select("object_name", "n", "worst", F.greatest(F.col("objects") - limit, F.lit(0)).alias("left_out"))


def object_detectors(findings: DataFrame) -> DataFrame:
    """The inner level of the top objects: counts by object and detector, with the worst rank."""
    return findings.groupBy("object_name", "detector").agg(F.count("*").alias("n"), F.min(R.rank(F.col("severity"))).alias("worst"))


def recommendations(findings: DataFrame) -> DataFrame:
    """Detectors with their hints, by count, then by first appearance."""
    first = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_keys())])
    each = findings.groupBy("detector").agg(F.count("*").alias("n"), F.min(first).alias("__first"))
    return with_hint(each).orderBy(F.desc("n"), "__first").select("detector", "n", "hint")


def explanations(findings: DataFrame) -> DataFrame:
    """Messages with their detectors, by first appearance."""
    first = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_keys())])
    return findings.groupBy("detector", "message").agg(F.count("*").alias("n"), F.min(first).alias("__first")).orderBy("__first").select("detector", "message", "n")
