"""Reports of the external converter: costs by function, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEAD = r"(?i)--\s*Function\s+(\S+)(?:\s+total)?\s+estimated\s+cost:\s*([0-9.]+)"
_PART = r"^\s*--\s*([A-Za-z_ ]+?)\s*=>\s*(\d+)"
_TOTAL = r"(?i)--\s*Total\s+estimated\s+cost(?:\s+for\s+package\s+(\S+))?:\s*([0-9.]+)\s*units,\s*([0-9.]+)\s*person-day"


def function_costs(reports: DataFrame) -> DataFrame:
    """source_file, name, total_cost and breakdown (last value of a key wins) of reports (source_file, source).

    A head line opens a function; the lines behind it belong to it up to the next.  The lines of
    a report are one group of the window, as their order is what binds them.
    """
    lines = reports.select("source_file", F.posexplode(F.split(F.coalesce("source", F.lit("")), r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("head", F.regexp_extract("line", _HEAD, 1)).withColumn("key", F.upper(F.regexp_extract("line", _PART, 1))).filter("head <> '' or key <> ''")
    by = Window.partitionBy("source_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("head") != "", F.struct("pos", F.col("head").alias("name"), F.regexp_extract("line", _HEAD, 2).cast("double").alias("cost"))), ignorenulls=True).over(by)
    rows = lines.withColumn("at", at).filter("at is not null")
    value = F.when(F.col("head") == "", F.struct("pos", F.regexp_extract("line", _PART, 2).cast("int").alias("n")))
    last = rows.groupBy("source_file", "at", F.when(F.col("head") == "", F.col("key")).alias("key")).agg(F.max(value).alias("v"))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", F.col("v.n")))
    each = last.groupBy("source_file", "at").agg(F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(pair)))).alias("breakdown"))
    return each.select("source_file", F.col("at.name").alias("name"), F.col("at.cost").alias("total_cost"), "breakdown")


def totals(reports: DataFrame) -> DataFrame:
    """source_file, package (or null), units and person_days of every total in a report."""
    text = F.coalesce(F.col("source"), F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(_TOTAL), F.lit(i)) for i in (1, 2, 3)]
    rows = reports.select("source_file", F.inline(F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("package", "units", "days"))])))
    return rows.toDF("source_file", "package", "units", "days").select("source_file", F.nullif(F.col("package"), F.lit("")).alias("package"), F.col("units").cast("double").alias("units"), F.col("days").cast("double").alias("person_days"))
