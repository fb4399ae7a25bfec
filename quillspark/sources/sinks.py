"""Reports.  The rows of each are made by native expressions; write_* keep them distributed, *_document joins them into one text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import findings as O
from quillspark.operators import registry as R
from quillspark.operators.snapshot import COLUMNS, verification_totals

MARKDOWN = ["detector", "severity", "object_name", "line", "snippet", "source_file", "gap_number", "failure_stage"]
DOCS = "https://example.org/docs/research"


def _sorted(findings: DataFrame) -> DataFrame:
    return O.ordered(O.enrich(findings))


def json_rows(findings: DataFrame) -> DataFrame:
    """A JSON object of the nine columns for each finding, nulls kept, in order."""
    return _sorted(findings).select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("json"))


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_rows(findings: DataFrame) -> DataFrame:
    return _sorted(findings).select(*[F.col(c) if c == "line" else guarded(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("—")), r"\s*\n\s*", " "), F.lit("|"), F.lit(r"\|"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    return _sorted(findings).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(c)) for c in MARKDOWN]), F.lit(" |")).alias("row"))


def escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def html_rows(findings: DataFrame) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in COLUMNS]
    badge = F.when(F.col("severity").isin(*R.RANKS), F.col("severity")).otherwise("other")
    return _sorted(findings).select(F.concat(F.lit('<tr class="'), badge, F.lit('">'), *cells, F.lit("</tr>")).alias("row"))


def rule_id(detector: Column, message: Column) -> Column:
    return F.concat(detector, F.lit("/"), F.substr(F.sha1(message), F.lit(1), F.lit(8)))


def sarif_uri(path: Column) -> Column:
    """A path as a relative reference: / between its parts, the rest percent-encoded."""
    out = F.url_encode(F.replace(path, F.lit("\\"), F.lit("/")))
    for a, b in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "low", "note").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """id and rule, a JSON object, for each detector and message, by id."""
    rules = O.enrich(findings.select("detector", "message").distinct()).join(F.broadcast(R.gaps(findings.sparkSession).select("detector", "slug")), "detector", "left")
    spoken = F.replace("detector", F.lit("_"), F.lit(" "))
    title = F.concat(F.upper(F.substr(spoken, F.lit(1), F.lit(1))), F.lower(F.substr(spoken, F.lit(2))))
    uri = F.when(F.col("gap_number").isNotNull(), R.research_doc(F.col("gap_number"), F.col("slug"), DOCS))
    properties = F.when(F.col("gap_number").isNotNull(), F.struct(F.col("gap_number").alias("gapNumber"), F.col("failure_stage").alias("failureStage")))
    own = rule_id(F.col("detector"), F.col("message"))
    body = F.struct(own.alias("id"), F.struct(title.alias("text")).alias("shortDescription"), F.struct(F.col("message").alias("text")).alias("fullDescription"), uri.alias("helpUri"), properties.alias("properties"))
    return rules.select(own.alias("id"), F.to_json(body).alias("rule")).orderBy("id")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A JSON object for each finding, in order; line 0 has no region."""
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(sarif_uri(F.col("source_file")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat_ws(": ", "object_name", "message")
    body = F.struct(rule_id(F.col("detector"), F.col("message")).alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return O.ordered(findings).select(F.to_json(body).alias("result"))


def verification_json(rows: DataFrame) -> DataFrame:
    """One row with a JSON document: the four totals and the rows, by detector."""
    own = rows.agg(F.array_sort(F.collect_list(F.struct("detector", "gap_number", "baseline_count", "post_migration_count", "status"))).alias("detectors"))
    return verification_totals(rows).crossJoin(own).select(F.to_json(F.struct("total", "still_present", "not_detected", "not_verifiable", "detectors"), {"ignoreNullFields": "false"}).alias("json"))


# Whole documents, for people and tools that want one file.  Their size is that of the report.


def _texts(df: DataFrame) -> list[str]:
    return [r[0] for r in df.toLocalIterator()]


def json_document(findings: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in _texts(json_rows(findings))], ensure_ascii=False, indent=2)


def csv_document(findings: DataFrame) -> str:
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(COLUMNS)
    writer.writerows(list(r) for r in csv_rows(findings).toLocalIterator())
    return out.getvalue()


def summary(findings: DataFrame) -> str:
    counts = ", ".join(f"{r['severity']} {r['n']}" for r in O.ordered_counts(findings).collect())
    e = O.effort(findings).first()
    return f"{findings.count()} findings ({counts or 'none'}); {e['lo']:g} to {e['hi']:g} hours"


def markdown_document(findings: DataFrame) -> str:
    rows = _texts(markdown_rows(findings))
    if not rows:
        return "No findings.\n"
    head = ["| " + " | ".join(MARKDOWN) + " |", "|" + "---|" * len(MARKDOWN)]
    return "\n".join([f"# {summary(findings)}", "", *head, *rows, ""])


def html_document(findings: DataFrame) -> str:
    style = "table{border-collapse:collapse}td,th{border:1px solid #999;padding:3px}.high{background:#fdd}.medium{background:#ffd}"
    head = "".join(f"<th>{c}</th>" for c in COLUMNS)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Findings</title><style>{style}</style></head><body><p>{summary(findings)}</p><table><tr>{head}</tr>{"".join(_texts(html_rows(findings)))}</table></body></html>'


def sarif_document(findings: DataFrame) -> str:
    rules = [json.loads(r["rule"]) for r in sarif_rules(findings).collect()]
    run = {"tool": {"driver": {"name": "quillspark", "rules": rules}}, "results": [json.loads(x) for x in _texts(sarif_results(findings))]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, ensure_ascii=False, indent=2)


DOCUMENTS = {"json": json_document, "csv": csv_document, "markdown": markdown_document, "html": html_document, "sarif": sarif_document}
