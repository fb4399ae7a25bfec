"""Integrity of the registry, as relational checks; each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry as R
from .specs import ALL, SPECS


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side and name of what only one of two one-column tables has."""
    a, b = left.toDF("name").distinct(), right.toDF("name").distinct()
    return a.exceptAll(b).select(F.lit("left").alias("side"), "name").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "name"))


def scanned(spark: SparkSession) -> DataFrame:
    """Detectors that are known but not in the scan, or the other way round; the one for generated code is known to be apart."""
    known = spark.createDataFrame([(s.name,) for s in ALL if s.mode != "generated_only"], "name string")
    return difference(known, spark.createDataFrame([(s.name,) for s in SPECS], "name string"))


def moded(spark: SparkSession) -> DataFrame:
    return difference(R.modes(spark).select("detector"), spark.createDataFrame([(s.name,) for s in ALL], "name string"))


def translated(spark: SparkSession, lang: str = "en") -> DataFrame:
    """Messages and hints that a language lacks."""
    messages, hints = R.messages(spark), R.hints(spark)
    no_text = messages.select("message_id").distinct().join(messages.filter(F.col("lang") == lang), "message_id", "left_anti").select(F.col("message_id").alias("name"))
    no_hint = hints.select("detector").distinct().join(hints.filter(F.col("lang") == lang), "detector", "left_anti").select(F.col("detector").alias("name"))
    return no_text.unionByName(no_hint)


def staged(spark: SparkSession) -> DataFrame:
    """Gaps whose stage is no stage, or missing where it may not be."""
    stage = F.col("failure_stage")
    return R.gaps(spark).filter((stage.isNotNull() & ~stage.isin(*R.STAGES)) | (stage.isNull() & ~F.col("detector").isin(*R.NO_STAGE))).select("detector", "failure_stage")


def versioned(confirmed: DataFrame, spark: SparkSession) -> DataFrame:
    """Of documented rows (number, status, converter_version, postgresql_version), the confirmed ones whose versions aren't the registry's."""
    own = R.gaps(spark).select("number", F.col("converter_version").alias("c"), F.col("postgresql_version").alias("p"))
    return confirmed.filter("status = 'confirmed'").join(F.broadcast(own), "number").filter("converter_version is distinct from c or postgresql_version is distinct from p").select("number")


def tested(files: DataFrame, spark: SparkSession) -> DataFrame:
    """gap number, tests and guards of test sources (file, source): a guard expects nothing to be found."""
    bodies = files.select("file", F.explode(F.slice(F.split("source", r"(?m)^def (?=test_)"), 2, 1 << 20)).alias("body"))
    counts = bodies.groupBy("file").agg(F.count("*").alias("tests"), F.count_if(F.col("body").rlike(r"==\s*\[\]|not\s+find_|len\([^)]*\)\s*==\s*0")).alias("guards"))
    own = R.gaps(spark).select("number", F.explode("test_files").alias("file"))
    return own.join(counts, "file", "left").groupBy("number").agg(F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"), F.coalesce(F.sum("guards"), F.lit(0)).alias("guards"))


def documented(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Documents (path) that no gap has, and gaps without their document."""
    names = files.select(F.regexp_extract("path", r"([^/]+)$", 1))
    own = R.gaps(spark).select(F.regexp_extract(R.research_doc(F.col("number"), F.col("slug")), r"([^/]+)$", 1))
    return difference(own, names)
