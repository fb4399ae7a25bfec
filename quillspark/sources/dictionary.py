"""The database's own dictionary as a source, by JDBC; the driver's jar is the user's to supply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIX = {"PACKAGE_BODY": ".pkb.sql", "TRIGGER": ".trg.sql"}


class DriverMissing(RuntimeError):
    """The JDBC driver can't be loaded."""


def _quoted(owner: str) -> str:
    return "'" + owner.upper().replace("'", "''") + "'"


def package_bodies_query(owner: str) -> str:
    """Invalid bodies are listed too, as they are part of what has to move."""
    return f"SELECT object_name FROM all_objects WHERE object_type = 'PACKAGE BODY' AND owner = {_quoted(owner)}"


def triggers_query(owner: str) -> str:
    return f"SELECT trigger_name AS object_name FROM all_triggers WHERE owner = {_quoted(owner)}"


def ddl_query(owner: str) -> str:
    """Every object with its DDL in one pass, so that the database does the work once."""
    parts = [f"SELECT '{kind}' AS kind, object_name, dbms_metadata.get_ddl('{kind}', object_name, {_quoted(owner)}) AS ddl FROM ({query})" for kind, query in (("PACKAGE_BODY", package_bodies_query(owner)), ("TRIGGER", triggers_query(owner)))]
    return " UNION ALL ".join(parts)


def read(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    try:
        spark._jvm.java.lang.Class.forName(options.get("driver", "oracle.jdbc.OracleDriver"))
    except Exception as e:
        raise DriverMissing("put the JDBC driver's jar on the class path") from e
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def list_objects(rows: DataFrame) -> DataFrame:
    return rows.select("object_name").orderBy("object_name")


def file_stem(name: Column) -> Column:
    """A name as a file name: other characters than letters, digits, _ $ # become _, none at the ends, lower case; "object" for what is left empty."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_$#]", "_"), r"^_+|_+$", ""))
    return F.when(stem == "", "object").otherwise(stem)


def exported(objects: DataFrame) -> DataFrame:
    """kind, object_name, source_file and source of (kind, object_name, ddl); empty DDL is left out.

    Names that fall together get _2, _3 and so on, by name.
    """
    rows = objects.filter(F.coalesce(F.trim("ddl"), F.lit("")) != "").withColumn("stem", file_stem(F.col("object_name")))
    n = F.row_number().over(Window.partitionBy("kind", "stem").orderBy("object_name"))
    suffix = F.when(F.col("kind") == "PACKAGE_BODY", SUFFIX["PACKAGE_BODY"]).otherwise(SUFFIX["TRIGGER"])
    file = F.concat("stem", F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), suffix)
    return rows.select("kind", "object_name", file.alias("source_file"), F.col("ddl").alias("source"))


def export(objects: DataFrame, folder: str) -> list[str]:
    """Write one file per object; the rows stream through the driver one partition at a time, as files are what is asked for."""
    from pathlib import Path

    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    written = []
    for r in exported(objects).orderBy("kind", "source_file").toLocalIterator():
        (at / r["source_file"]).write_text(r["source"], encoding="utf-8")
        written.append(str(at / r["source_file"]))
    return written
