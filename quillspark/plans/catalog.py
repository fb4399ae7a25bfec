"""The registered queries of the engine: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexer as L
from quillspark.operators import checks, costs, registry, scan, snapshot
from quillspark.operators import findings as O
from quillspark.operators.specs import SPECS
from quillspark.sources import dictionary, sinks
from quillspark.sources.files import split_statements

from . import ddl
from .expected import KNOWN

QUERIES: dict = {}
_FIELDS = ", ".join(scan.FINDING)
_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END"
_KEY = "substr(sha1(concat_ws(chr(31), detector, source_file, object_name, snippet)), 1, 12)"


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _found(spark: SparkSession, sf_dir: str, detectors: list[str] | None = None) -> DataFrame:
    return scan.scan(ddl.files(spark, sf_dir), detectors)


def _with(sql: str) -> str:
    return f"WITH {ddl.findings_sql()} {sql}"


def _detector(name: str):
    return lambda spark, sf_dir: _found(spark, sf_dir, [name]).select(*scan.FINDING)


for _spec in SPECS:
    QUERIES[f"det_{_spec.name}"] = (_detector(_spec.name), _with(f"SELECT {_FIELDS} FROM fs WHERE detector = '{_spec.name}'"))


@_register("det_connect_by", f"WITH {ddl.findings_sql(ddl.GENERATED)} SELECT {_FIELDS} FROM fs")
def _connect_by(spark, sf_dir):
    return scan.lint_generated(ddl.files(spark, sf_dir, ddl.GENERATED)).select(*scan.FINDING)


@_register("scan_findings", _with(f"SELECT {_FIELDS} FROM fs"))
def _scan(spark, sf_dir):
    return _found(spark, sf_dir).select(*scan.FINDING)


# --- lexical operators ---------------------------------------------------------------------------

_ATOM_SQL = r"--[^\n]*|(?m:^)[ \t]*REM[ \t][^\n]*|/\*(?s:.*?)\*/|q''\[(?s:.*?)\]''|''[^'']*''"
_CLEAN_SQL = f"array_to_string(list_transform(string_split(regexp_replace(text, '({_ATOM_SQL})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda p, i: CASE WHEN i % 2 = 0 THEN regexp_replace(p, '[^\\n]', ' ', 'g') ELSE p END), '')"


@_register("lex_clean_view", f"WITH {ddl.texts_sql()}, c AS (SELECT source_file, {_CLEAN_SQL} AS clean FROM ft) SELECT source_file, length(clean)::BIGINT AS n_chars, md5(clean) AS digest FROM c")
def _clean(spark, sf_dir):
    views = scan.with_views(ddl.files(spark, sf_dir))
    return views.select("source_file", F.length("clean").cast("long").alias("n_chars"), F.md5("clean").alias("digest"))


@_register("lex_visible_view", f"WITH {ddl.texts_sql()}, c AS (SELECT source_file, length(text) AS n, {_CLEAN_SQL.replace(chr(39) * 2 + '[^' + chr(39) * 2 + ']*' + chr(39) * 2, chr(39) * 2 + '[^' + chr(39) * 2 + ']*' + chr(39) * 2)} AS clean FROM ft) SELECT source_file, n::BIGINT AS n_chars, (length(clean) - length(replace(clean, 'EXECUTE IMMEDIATE', '')))::BIGINT // 17 * length('SELECT 1 FROM a OUTER APPLY f(x)') AS n_shown FROM c")
def _visible(spark, sf_dir):
    """What the dynamic view shows and the clean view hides, in characters between the quotes."""
    views = scan.with_views(ddl.files(spark, sf_dir))
    bare = lambda c: F.length(F.regexp_replace(c, r"[\s']", ""))
    blanks = F.length(F.lit("SELECT 1 FROM a OUTER APPLY f(x)")) - F.length(F.lit("SELECT1FROMaOUTERAPPLYf(x)"))
    shown = bare(F.col("visible")) - bare(F.col("clean"))
    return views.select("source_file", F.length("visible").cast("long").alias("n_chars"), (shown + F.when(shown > 0, (shown / F.length(F.lit("SELECT1FROMaOUTERAPPLYf(x)"))).cast("int") * blanks).otherwise(0)).cast("long").alias("n_shown"))


@_register("lex_containers", f"WITH {ddl.containers_sql()} SELECT source_file, line, kind, name FROM cs")
def _containers(spark, sf_dir):
    views = scan.with_views(ddl.files(spark, sf_dir))
    rows = views.select("source_file", "clean", F.explode("idx").alias("x"))
    # a routine's match may begin at the line end before it; its line is that of its word
    skip = F.length(F.regexp_extract(F.substr("clean", F.col("x.pos") + 1, F.lit(200)), r"^\s*", 0))
    return rows.select("source_file", L.line_at(F.col("clean"), F.col("x.pos") + skip).cast("int").alias("line"), "x.kind", "x.name")


@_register("lex_object_count", f"WITH {ddl.containers_sql()} SELECT source_file, count(*) FILTER (kind <> 'nested_routine') AS objects FROM cs GROUP BY source_file")
def _objects(spark, sf_dir):
    return scan.total_objects(scan.with_views(ddl.files(spark, sf_dir)))


@_register("agg_total_objects", f"WITH {ddl.containers_sql()} SELECT count(*) FILTER (kind <> 'nested_routine') AS objects FROM cs")
def _all_objects(spark, sf_dir):
    return scan.total_objects(scan.with_views(ddl.files(spark, sf_dir))).agg(F.sum("objects").alias("objects"))


_SINGLE = "WITH tx(tid, text) AS (VALUES " + ddl.values([(i, t.text) for i, t in enumerate(ddl.TEMPLATES)]) + f"), s AS (SELECT p_partkey AS k, text FROM part JOIN tx ON p_partkey % {ddl.N} = tid)"


@_register("lex_object_type", _SINGLE + " SELECT 'f' || k || '.sql' AS source_file, CASE WHEN contains(text, 'PACKAGE BODY') THEN 'PACKAGE' WHEN contains(text, 'CREATE TRIGGER') OR contains(text, 'CREATE OR REPLACE TRIGGER') THEN 'TRIGGER' WHEN starts_with(text, 'CREATE PROCEDURE') THEN 'PROCEDURE' WHEN starts_with(text, 'CREATE FUNCTION') THEN 'FUNCTION' WHEN starts_with(text, 'CREATE VIEW') OR starts_with(text, 'GRANT CREATE VIEW, CREATE MAT') THEN 'VIEW' WHEN starts_with(text, 'GRANT') THEN 'PROCEDURE' ELSE 'PACKAGE' END AS kind, contains(text, 'CONNECT BY') AS connect_by FROM s")
def _kinds(spark, sf_dir):
    views = scan.with_views(ddl.files(spark, sf_dir, per_file=1))
    return views.select("source_file", L.object_type(F.col("clean")).alias("kind"), L.has_connect_by(F.col("clean")).alias("connect_by"))


@_register("src_statements", f"WITH {ddl.texts_sql()}, p AS (SELECT source_file, unnest(string_split(text, ';')) AS s, generate_subscripts(string_split(text, ';'), 1) AS i FROM ft), k AS (SELECT * FROM p WHERE trim(regexp_replace(s, '{_ATOM_SQL}', '', 'g'), ' ' || chr(10)) <> '') SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY i) - 1 AS n, trim(s, ' ' || chr(10)) AS statement FROM k")
def _statements(spark, sf_dir):
    return split_statements(ddl.files(spark, sf_dir))


# --- filters, projections, joins -----------------------------------------------------------------


@_register("flt_severity_object", _with(f"SELECT {_FIELDS} FROM fs WHERE severity = 'medium' AND contains(object_name, 'X_1')"))
def _filtered(spark, sf_dir):
    return O.select(_found(spark, sf_dir), "medium", "x_1").select(*scan.FINDING)


@_register("flt_gate", _with(f"SELECT t AS threshold, (SELECT coalesce(bool_or({_RANK} <= r), false) FROM fs) AS failed FROM (VALUES ('high', 0), ('medium', 1), ('low', 2)) v(t, r)"))
def _gates(spark, sf_dir):
    return O.gates(_found(spark, sf_dir))


_GAPS = "g(detector, gap_number, failure_stage, slug) AS (VALUES " + ddl.values([(n, gap, stage, slug) for n, (_, gap, slug, stage, *_) in KNOWN.items() if gap]) + ")"
_HINTS = "h(detector, hint) AS (VALUES " + ddl.values([(n, k[5]) for n, k in KNOWN.items()]) + ")"
_MODES = "m(detector, mode) AS (VALUES " + ddl.values([(n, k[4]) for n, k in KNOWN.items()]) + ")"


@_register("join_enriched", _with(f", {_GAPS} SELECT {_FIELDS}, gap_number, failure_stage FROM fs LEFT JOIN g USING (detector)").replace(") , g", "), g"))
def _enriched(spark, sf_dir):
    return O.enrich(_found(spark, sf_dir)).select(*scan.FINDING, "gap_number", "failure_stage")


@_register("join_hints", _with(f", {_HINTS} SELECT object_name, line, source_file, hint FROM fs LEFT JOIN h USING (detector)"))
def _hinted(spark, sf_dir):
    return O.with_hint(_found(spark, sf_dir)).select("object_name", "line", "source_file", "hint")


@_register("prj_translate", _with("SELECT detector, object_name, line, source_file, CASE WHEN detector = 'sql_macro' THEN 'Makro' ELSE message END AS message FROM fs"))
def _translated(spark, sf_dir):
    texts = spark.createDataFrame([(s.messages[0], "Makro") for s in SPECS if s.name == "sql_macro"], "message string, translated string")
    return O.translate(_found(spark, sf_dir), texts).select("detector", "object_name", "line", "source_file", "message")


@_register("prj_group_key", _with(f"SELECT detector, object_name, line, source_file, {_KEY} AS group_key FROM fs"))
def _keys(spark, sf_dir):
    return snapshot.keyed(_found(spark, sf_dir)).select("detector", "object_name", "line", "source_file", "group_key")


@_register("prj_gap_number", "SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN 'GAP-' || p_size WHEN 1 THEN 'gap' || p_size WHEN 2 THEN '' || p_size ELSE 'x' || p_size END AS reference, CASE WHEN p_size % 4 < 3 THEN lpad(p_size::VARCHAR, 3, '0') END AS number FROM part")
def _numbers(spark, sf_dir):
    n = F.col("p_size").cast("string")
    reference = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("GAP-"), n)).when(F.col("p_size") % 4 == 1, F.concat(F.lit("gap"), n)).when(F.col("p_size") % 4 == 2, n).otherwise(F.concat(F.lit("x"), n))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", reference.alias("reference")).distinct().withColumn("number", registry.gap_number(F.col("reference")))


# --- aggregates, order ---------------------------------------------------------------------------

@_register("agg_severity", _with("SELECT s AS severity, count(fs.severity) AS n FROM (VALUES ('high'), ('medium'), ('low')) v(s) LEFT JOIN fs ON fs.severity = s GROUP BY s"))
def _severities(spark, sf_dir):
    return O.severity_counts(_found(spark, sf_dir))


@_register("agg_severity_ordered", _with("SELECT severity, count(*) AS n FROM fs GROUP BY severity"))
def _ordered_severities(spark, sf_dir):
    return O.ordered_counts(_found(spark, sf_dir))


@_register("agg_effort", _with("""SELECT sum(CASE WHEN rn > 1 THEN 0.25::DOUBLE WHEN severity = 'high' THEN 2 WHEN severity = 'medium' THEN 1 ELSE 0.25 END)::DOUBLE AS lo,
sum(CASE WHEN rn > 1 THEN 1 WHEN severity = 'high' THEN 8 WHEN severity = 'medium' THEN 4 ELSE 1 END)::DOUBLE AS hi, (lo + hi) / 2 AS mid FROM (SELECT severity, row_number() OVER (PARTITION BY detector ORDER BY object_name) AS rn FROM fs)"""))
def _effort(spark, sf_dir):
    return O.effort(_found(spark, sf_dir))


@_register("agg_distinct_detectors", _with("SELECT count(DISTINCT detector) AS n FROM fs"))
def _distinct(spark, sf_dir):
    return O.distinct_detectors(_found(spark, sf_dir))


@_register("agg_detectors", _with("SELECT detector, count(*) AS n FROM fs GROUP BY detector"))
def _detectors(spark, sf_dir):
    return O.detector_counts(_found(spark, sf_dir))


@_register("top_objects", _with(f"SELECT object_name, count(*) AS n, min({_RANK}) AS worst, greatest((SELECT count(DISTINCT object_name) FROM fs) - 10, 0) AS left_out FROM fs GROUP BY object_name ORDER BY n DESC, worst, object_name LIMIT 10"))
def _top(spark, sf_dir):
    return O.top_objects(_found(spark, sf_dir))


@_register("agg_object_detectors", _with(f"SELECT object_name, detector, count(*) AS n, min({_RANK}) AS worst FROM fs GROUP BY ALL"))
def _inner(spark, sf_dir):
    return O.object_detectors(_found(spark, sf_dir))


@_register("agg_recommendations", _with(f", {_HINTS} SELECT detector, count(*) AS n, any_value(hint) AS hint FROM fs JOIN h USING (detector) GROUP BY detector"))
def _advice(spark, sf_dir):
    return O.recommendations(_found(spark, sf_dir))


@_register("agg_explanations", _with("SELECT detector, message, count(*) AS n FROM fs GROUP BY ALL"))
def _explained(spark, sf_dir):
    return O.explanations(_found(spark, sf_dir))


@_register("srt_findings", _with(f"SELECT seq, severity, object_name, line FROM (SELECT row_number() OVER (ORDER BY {_RANK}, object_name, line, source_file) AS seq, * FROM fs)"))
def _sorted(spark, sf_dir):
    return O.numbered(_found(spark, sf_dir)).select("seq", "severity", "object_name", "line")


# --- snapshots -----------------------------------------------------------------------------------

_EVENT = "substr(sha1(concat_ws(chr(31), event_type, 'e.sql', user_id::VARCHAR, '')), 1, 12)"


def _event_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two bags of findings-like rows with many repeats: events of even and of odd numbers."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("detector"), F.lit("e.sql").alias("source_file"), F.col("user_id").cast("string").alias("object_name"), F.lit("").alias("snippet"))
    rows = rows.withColumn("group_key", snapshot.group_key())
    return rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")


@_register("set_bag_diff", f"WITH k AS (SELECT {_EVENT} AS group_key, count(*) FILTER (event_id % 2 = 0) AS b, count(*) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1) SELECT 'new' AS status, group_key, c - b AS n FROM k WHERE c > b UNION ALL SELECT 'resolved', group_key, b - c FROM k WHERE b > c UNION ALL SELECT 'unchanged', group_key, least(b, c) FROM k WHERE least(b, c) > 0")
def _bags(spark, sf_dir):
    return snapshot.diff(*_event_findings(spark, sf_dir))


@_register("set_diff_rows", _with(f", k AS (SELECT *, {_KEY} AS key FROM fs), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS rn FROM k WHERE line % 3 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS rn FROM k WHERE line % 3 <> 1) SELECT CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'resolved' ELSE 'unchanged' END AS status, coalesce(n.detector, o.detector) AS detector, coalesce(n.object_name, o.object_name) AS object_name, coalesce(n.line, o.line) AS line, coalesce(n.source_file, o.source_file) AS source_file FROM o FULL JOIN n ON o.key = n.key AND o.rn = n.rn"))
def _diff_rows(spark, sf_dir):
    found = snapshot.keyed(_found(spark, sf_dir)).persist()
    return snapshot.diff_rows(found.filter("line % 3 <> 0"), found.filter("line % 3 <> 1")).select("status", "detector", "object_name", "line", "source_file")


_VERIFY = _with(f", {_GAPS}, {_MODES}, v AS (SELECT detector, count(*) AS baseline_count, count(*) FILTER (source_file LIKE '%2.sql' AND line % 2 = 0) AS post_migration_count FROM fs GROUP BY detector), r AS (SELECT detector, gap_number, baseline_count, post_migration_count, CASE WHEN coalesce(mode, '') <> 'verbatim' THEN 'not_verifiable' WHEN post_migration_count > 0 THEN 'still_present' ELSE 'not_detected' END AS status FROM v LEFT JOIN g USING (detector) LEFT JOIN m USING (detector))")


def _verified(spark, sf_dir):
    found = _found(spark, sf_dir).persist()
    return snapshot.verify(found, found.filter("source_file like '%2.sql' and line % 2 = 0"))


@_register("join_verify", _VERIFY + " SELECT * FROM r")
def _verify(spark, sf_dir):
    return _verified(spark, sf_dir)


@_register("agg_verify_totals", _VERIFY + " SELECT count(*) AS total, count(*) FILTER (status = 'still_present') AS still_present, count(*) FILTER (status = 'not_detected') AS not_detected, count(*) FILTER (status = 'not_verifiable') AS not_verifiable FROM r")
def _verify_totals(spark, sf_dir):
    return snapshot.verification_totals(_verified(spark, sf_dir))


# --- registry and integrity ----------------------------------------------------------------------

@_register("reg_gaps", f"WITH {_GAPS} SELECT gap_number AS number, detector, slug, failure_stage FROM g")
def _gaps(spark, sf_dir):
    return registry.gaps(spark).select("number", "detector", "slug", "failure_stage")


@_register("reg_research_docs", f"WITH {_GAPS} SELECT detector, 'docs/research/gap-' || gap_number || '-' || slug || '.md' AS doc FROM g")
def _docs(spark, sf_dir):
    return registry.gaps(spark).select("detector", registry.research_doc(F.col("number"), F.col("slug")).alias("doc"))


# --- sinks ---------------------------------------------------------------------------------------

def _json_sql(*columns: str) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || " + (f"{c}" if c == "line" else f"coalesce(to_json({c})::VARCHAR, 'null')") for c in columns) + " || '}'"


@_register("snk_json", _with(f", {_GAPS} SELECT {_json_sql(*snapshot.COLUMNS)} AS json FROM fs LEFT JOIN g USING (detector)"))
def _json(spark, sf_dir):
    return sinks.json_rows(_found(spark, sf_dir))


@_register("snk_csv", "SELECT user_id, CASE event_id % 5 WHEN 0 THEN '''=' WHEN 1 THEN '''+' WHEN 2 THEN '''-' WHEN 3 THEN '''@' ELSE 'a' END || event_type AS snippet FROM events")
def _csv(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, "=+-@a")), (F.col("event_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", sinks.guarded(F.concat(mark, "event_type")).alias("snippet"))


@_register("snk_markdown", _with(f", {_GAPS} SELECT '| ' || concat_ws(' | ', detector, severity, object_name, line::VARCHAR, replace(snippet, '|', '\\|'), source_file, coalesce(gap_number, '—'), coalesce(failure_stage, '—')) || ' |' AS row FROM fs LEFT JOIN g USING (detector)"))
def _markdown(spark, sf_dir):
    return sinks.markdown_rows(_found(spark, sf_dir))


@_register("snk_sarif_rules", _with("SELECT DISTINCT detector || '/' || substr(sha1(message), 1, 8) AS id, detector, message FROM fs"))
def _rules(spark, sf_dir):
    found = _found(spark, sf_dir)
    return sinks.sarif_rules(found).select("id", F.substring_index("id", "/", 1).alias("detector"), F.get_json_object("rule", "$.fullDescription.text").alias("message"))


@_register("snk_sarif_results", _with("SELECT detector || '/' || substr(sha1(message), 1, 8) AS rule, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, source_file AS uri, line FROM fs"))
def _results(spark, sf_dir):
    r = sinks.sarif_results(_found(spark, sf_dir))
    get = lambda p: F.get_json_object("result", p)
    return r.select(get("$.ruleId").alias("rule"), get("$.level").alias("level"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), get("$.locations[0].physicalLocation.region.startLine").cast("int").alias("line"))


@_register("snk_html", _with(f", {_GAPS} SELECT '<tr class=\"' || severity || '\">' || array_to_string(list_transform([detector, severity, object_name, line::VARCHAR, snippet, message, source_file, gap_number, failure_stage], lambda c: '<td>' || replace(replace(replace(replace(replace(coalesce(c, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</td>'), '') || '</tr>' AS row FROM fs LEFT JOIN g USING (detector)"))
def _html(spark, sf_dir):
    return sinks.html_rows(_found(spark, sf_dir))


@_register("snk_export_names", "WITH s AS (SELECT 'PACKAGE_BODY' AS kind, p_name AS object_name, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9_$#]', '_', 'g'), '_')) AS stem FROM (SELECT DISTINCT p_name FROM part)), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY object_name) AS n FROM s) SELECT kind, object_name, (CASE WHEN stem = '' THEN 'object' ELSE stem END) || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.pkb.sql' AS source_file FROM r")
def _exported(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    return dictionary.exported(rows.select(F.lit("PACKAGE_BODY").alias("kind"), F.col("p_name").alias("object_name"), F.lit("x").alias("ddl"))).select("kind", "object_name", "source_file")


# --- converter reports ---------------------------------------------------------------------------

def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a nation: a function for each supplier, with a part that is given twice."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("\t-- Function pk.f"), key, F.lit(" total estimated cost: "), key, F.lit(".5\n\t\t-- Test => 1\n\t\t-- SIZE => "), key, F.lit(" (cost: 0.1)\n\t\t-- TEST => 2\n"))
    rows = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", text.alias("t")))), lambda x: x["t"]), "").alias("body"), F.count("*").cast("string").alias("n"))
    total = F.concat(F.lit("-- Total estimated cost for package p"), F.col("s_nationkey"), F.lit(": "), F.col("n"), F.lit(" units, 3 person-day(s).\n-- Total estimated cost: 7.25 units, 1 person-day(s).\n"))
    return rows.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("source_file"), F.concat(total, "body").alias("source"))


@_register("src_function_costs", "SELECT 'n' || s_nationkey AS source_file, 'pk.f' || s_suppkey AS name, s_suppkey + 0.5::DOUBLE AS total_cost, s_suppkey::INT AS size, 2 AS test FROM supplier")
def _costs(spark, sf_dir):
    return costs.function_costs(_reports(spark, sf_dir)).select("source_file", "name", "total_cost", F.col("breakdown")["SIZE"].alias("size"), F.col("breakdown")["TEST"].alias("test"))


@_register("src_cost_totals", "SELECT 'n' || s_nationkey AS source_file, 'p' || s_nationkey AS package, count(*)::DOUBLE AS units, 3.0::DOUBLE AS person_days FROM supplier GROUP BY s_nationkey UNION ALL SELECT DISTINCT 'n' || s_nationkey, NULL, 7.25::DOUBLE, 1.0::DOUBLE FROM supplier")
def _totals(spark, sf_dir):
    return costs.totals(_reports(spark, sf_dir))


@_register("set_difference", "SELECT 'left' AS side, name FROM (SELECT DISTINCT p_size AS name FROM part EXCEPT SELECT n_nationkey FROM nation) UNION ALL SELECT 'right', name FROM (SELECT DISTINCT n_nationkey AS name FROM nation EXCEPT SELECT p_size FROM part)")
def _difference(spark, sf_dir):
    return checks.difference(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size"), spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey"))


@_register("chk_registry", f"WITH {_GAPS}, {_MODES}, c(fault, n) AS (SELECT 'scan', count(*) FILTER (mode <> 'generated_only') FROM m UNION ALL SELECT 'mode', count(*) FROM m UNION ALL SELECT 'text', 40 + count(*) FROM m UNION ALL SELECT 'stage', count(*) FROM g) SELECT fault, n, 0::BIGINT AS faults FROM c UNION ALL SELECT 'text xx', n, n FROM c WHERE fault = 'text'")
def _checks(spark, sf_dir):
    """For each check, how much it looks at and how many faults it finds: none, but for a language that has no texts."""
    n = {"scan": len(SPECS), "mode": registry.modes(spark).count(), "text": registry.messages(spark).count() + registry.hints(spark).count(), "stage": registry.gaps(spark).count()}
    n["text xx"] = n["text"]
    faults = {"scan": checks.scanned(spark), "mode": checks.moded(spark), "text": checks.translated(spark), "stage": checks.staged(spark), "text xx": checks.translated(spark, "xx")}
    return spark.createDataFrame([(c, n[c], f.count()) for c, f in faults.items()], "fault string, n long, faults long")


@_register("src_distinct_files", "SELECT 'f' || min(p_partkey) || '.sql' AS source_file, p_partkey % 7 AS content FROM part GROUP BY p_partkey % 7")
def _distinct_files(spark, sf_dir):
    """Of several spellings of one file the first counts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 7).alias("content"))
    return rows.groupBy("content").agg(F.min_by("seq", "seq").alias("first")).select(F.concat(F.lit("f"), "first", F.lit(".sql")).alias("source_file"), "content")
