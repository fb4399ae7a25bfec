"""Dimension tables, all derived from the detector list; each has at most a few dozen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .specs import ALL

CONVERTER, TARGET = "25.0", "16"
STAGES = ("conversion", "deployment", "runtime", "semantic")
NO_STAGE = ("autonomous_tx", "object_type")
#: Hours for the first finding of a detector, by severity; and for each further one.
HOURS = {"high": (2.0, 8.0), "medium": (1.0, 4.0), "low": (0.25, 1.0)}
OTHER_HOURS, REPEAT_HOURS = (1.0, 4.0), (0.25, 1.0)
GENERIC_HINT = "Look at the construct by hand."
RANKS = {"high": 0, "medium": 1, "low": 2}


def gaps(spark: SparkSession) -> DataFrame:
    rows = [(s.gap, s.name, s.slug, list(s.test_files), CONVERTER, TARGET, s.stage) for s in ALL if s.gap]
    return spark.createDataFrame(sorted(rows), "number string, detector string, slug string, test_files array<string>, converter_version string, postgresql_version string, failure_stage string")


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.mode) for s in ALL], "detector string, mode string")


def hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, "en", s.hint) for s in ALL], "detector string, lang string, hint string")


def messages(spark: SparkSession) -> DataFrame:
    rows = [(f"{s.name}/{i}", "en", m) for s in ALL for i, m in enumerate(s.messages)]
    return spark.createDataFrame(rows, "message_id string, lang string, text string")


def hours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in HOURS.items()], "severity string, lo double, hi double")


def rank(severity: Column) -> Column:
    out = F.lit(99)
    for name, r in RANKS.items():
        out = F.when(severity == name, r).otherwise(out)
    return out


def gap_number(reference: Column) -> Column:
    """GAP-023, gap23 or 23 as 023; null for anything else."""
    digits = F.regexp_extract(F.trim(reference), r"(?i)^(?:GAP-?)?(\d{1,3})$", 1)
    return F.when(digits != "", F.lpad(digits, 3, "0"))


def explain(spark: SparkSession, reference: str) -> DataFrame:
    """The registry row of a gap, named by its number in any spelling or by its detector."""
    table = gaps(spark)
    return table.filter((F.col("number") == gap_number(F.lit(reference))) | (F.col("detector") == F.lit(reference.strip())))


def research_doc(gap: Column, slug: Column, base: str = "docs/research") -> Column:
    return F.concat(F.lit(f"{base}/gap-"), gap, F.lit("-"), slug, F.lit(".md"))
