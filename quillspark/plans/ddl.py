"""A corpus of DDL files derived from the table `part`, and what must be found in it.

The test tables hold no source code, so each row of `part` becomes one statement: its key picks
a template and names the objects, and consecutive keys share a file.  Next to each template
stands what a reader would find in it.  The SQL side uses only these expectations, never the
texts, so it checks masking, scoping and attribution from outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expected import KNOWN


@dataclass(frozen=True)
class Template:
    """text; expected (detector, object, line, snippet, message number); containers (kind, name, line).  {k} is the row's key."""

    text: str
    expected: tuple[tuple[str, str, int, str, int], ...] = ()
    containers: tuple[tuple[str, str, int], ...] = ()


def _t(text: str, *expected: tuple, at: tuple = ()) -> Template:
    return Template(text, tuple((*e, 0)[:5] for e in expected), at)


def _in(kind: str, text: str, *expected: tuple, inner: tuple = ()) -> Template:
    """A template that is one container, whose name is the word with the key in its first line."""
    name = next(w for w in text.split() if "{k}" in w).upper().replace("{K}", "{k}")
    named = [(d, name if o is None else o, *r) for d, o, *r in expected]
    return _t(text, *named, at=((kind, name, 1), *inner))


V, P, T, G = "view", "standalone_routine", "trigger", "package"
TEMPLATES: tuple[Template, ...] = (
    _t("CREATE TABLE hr.ro_{k} (a NUMBER)\nREAD ONLY;", ("read_only_table", "RO_{k}", 2, "READ ONLY")),
    _t("CREATE TABLE rw_{k} (a NUMBER) -- READ ONLY\n;"),
    _t("CREATE TABLE pt_{k} (d DATE)\nPARTITION BY RANGE (d) (PARTITION p0 VALUES LESS THAN (MAXVALUE));", ("table_partitioning", "PT_{k}", 2, "PARTITION BY RANGE")),
    _in(V, "CREATE VIEW wv_{k} AS SELECT SUM(x) OVER (PARTITION BY g) s FROM t;"),
    _t("CREATE TABLE ps_{k} (d DATE) PARTITION BY SYSTEM\nPARTITIONS 4;", ("table_partitioning", "PS_{k}", 1, "PARTITION BY SYSTEM")),
    _t("CREATE GLOBAL TEMPORARY TABLE gt_{k} (a NUMBER);", ("global_temp_table", "GT_{k}", 1, "CREATE GLOBAL TEMPORARY TABLE")),
    _t("CREATE GLOBAL TEMPORARY TABLE gp_{k} (a NUMBER)\nON COMMIT PRESERVE ROWS;"),
    _t("CREATE SEQUENCE sq_{k}\n START WITH 1\n CYCLE;", ("sequence_cycle", "SQ_{k}", 3, "CYCLE")),
    _t("CREATE SEQUENCE sn_{k} NOCYCLE;"),
    _t("CREATE TABLE rt_{k} (id NUMBER,\n r  ROWID, u UROWID(20));", ("rowid_type", "RT_{k}", 2, "r ROWID"), ("rowid_type", "RT_{k}", 2, "u UROWID(20)")),
    _t("CREATE TABLE rs_{k} AS SELECT ROWID rid FROM t;"),
    _t("CREATE TABLE vc_{k} (a NUMBER,\n b NUMBER AS (a * 2));", ("virtual_column", "VC_{k}", 2, "AS (...)")),
    _t("CREATE TABLE id_{k} (a NUMBER GENERATED ALWAYS AS IDENTITY\n (START WITH 5));", ("identity_column", "ID_{k}", 1, "GENERATED ... AS IDENTITY (...)")),
    _t("CREATE TABLE ie_{k} (a NUMBER GENERATED BY DEFAULT ON NULL AS IDENTITY);", ("default_on_null", "IE_{k}", 1, "DEFAULT ON NULL")),
    _t("CREATE TABLE dn_{k} (a NUMBER\n DEFAULT  ON NULL 0);", ("default_on_null", "DN_{k}", 2, "DEFAULT ON NULL")),
    _t("CREATE TABLE et_{k} (a NUMBER)\nORGANIZATION EXTERNAL (TYPE oracle_loader);", ("external_table", "ET_{k}", 1, "ORGANIZATION EXTERNAL")),
    _t("CREATE TABLE io_{k} (a NUMBER PRIMARY KEY)\nORGANIZATION INDEX;", ("index_organized_table", "IO_{k}", 2, "ORGANIZATION INDEX")),
    _t("CREATE TABLE ic_{k} (a NUMBER, b NUMBER INVISIBLE,\n c NUMBER INVISIBLE NOT NULL);", ("invisible_column", "IC_{k}", 1, "INVISIBLE"), ("invisible_column", "IC_{k}", 2, "INVISIBLE")),
    _t("CREATE UNIQUE INDEX ix_{k} ON t (a)\nINVISIBLE;", ("invisible_index", "IX_{k}", 2, "INVISIBLE")),
    _t("CREATE INDEX iy_{k} ON t (a);"),
    _t("CREATE INDEX ct_{k} ON docs (body)\nINDEXTYPE IS CTXSYS.CONTEXT;", ("oracle_text", "CT_{k}", 2, "INDEXTYPE IS CTXSYS.CONTEXT")),
    _in(V, "CREATE VIEW cv_{k} AS SELECT id FROM docs\nWHERE CONTAINS(body, (q), 1) > 0;", ("oracle_text", None, 2, "CONTAINS(...)")),
    _in(V, "CREATE VIEW cw_{k} AS SELECT id FROM docs WHERE CONTAINS(body, q);"),
    _t("CREATE MATERIALIZED VIEW LOG ON ml_{k};", ("materialized_view_log", "ML_{k}", 1, "CREATE MATERIALIZED VIEW LOG"), at=((V, "LOG", 1),)),
    _t("CREATE OR REPLACE CONTEXT cx_{k} USING p;", ("context_object", "CX_{k}", 1, "CREATE CONTEXT")),
    _t("CREATE OR REPLACE PUBLIC SYNONYM sy_{k}\nFOR hr.tgt_{k};", ("public_synonym", "SY_{k}", 1, "FOR TGT_{k}")),
    _t("CREATE TYPE ot_{k} AS OBJECT (a NUMBER);", ("object_type", "OT_{k}", 1, "CREATE TYPE ... AS OBJECT")),
    _t("CREATE OR REPLACE TYPE BODY ob_{k} AS\n MEMBER FUNCTION f RETURN NUMBER IS BEGIN RETURN 1; END;\nEND;", ("object_type", "OB_{k}", 1, "CREATE TYPE BODY")),
    _t("CREATE TYPE ca_{k} AS TABLE OF NUMBER;", ("collection_type", "CA_{k}", 1, "CREATE TYPE ... TABLE OF / VARRAY OF")),
    _t("CREATE TYPE cb_{k} IS TABLE OF NUMBER;", ("collection_type", "CB_{k}", 1, "CREATE TYPE ... TABLE OF / VARRAY OF")),
    _t("CREATE TYPE cc_{k} AS VARRAY(10) OF NUMBER;", ("collection_type", "CC_{k}", 1, "CREATE TYPE ... TABLE OF / VARRAY OF")),
    _in(P, "CREATE PROCEDURE bc_{k} IS\n TYPE t IS TABLE OF NUMBER;\n v t;\nBEGIN\n SELECT a BULK COLLECT INTO v FROM x;\n FORALL i IN 1..2 INSERT INTO y VALUES (v(i));\nEND;", ("bulk_collect", None, 2, "TYPE t IS TABLE OF", 0), ("bulk_collect", None, 5, "BULK COLLECT INTO", 1), ("bulk_collect", None, 6, "FORALL", 2)),
    _in(P, "CREATE PROCEDURE dl_{k} IS\nBEGIN\n DELETE FROM t@far.example;\nEND;", ("database_link", None, 3, "t@far.example")),
    _in(V, 'CREATE VIEW dq_{k} AS SELECT "a@b" c FROM t;'),
    _in(V, "CREATE VIEW mc_{k} AS SELECT * FROM s\nMODEL DIMENSION BY (d) MEASURES (m)\nRULES (m[1] = 2);", ("model_clause", None, 2, "MODEL")),
    _in(V, "CREATE VIEW pv_{k} AS SELECT * FROM s\nPIVOT (SUM(a) FOR b IN (1));", ("pivot_clause", None, 2, "PIVOT")),
    _in(V, "CREATE VIEW uv_{k} AS SELECT * FROM s UNPIVOT INCLUDE NULLS (a FOR b IN (c));", ("pivot_clause", None, 1, "UNPIVOT")),
    _in(V, "CREATE VIEW wf_{k} AS WITH  FUNCTION f RETURN NUMBER IS BEGIN RETURN 1; END;\nSELECT f FROM dual;", ("with_function", None, 1, "WITH FUNCTION")),
    _in(V, "CREATE VIEW fq_{k} AS SELECT * FROM t AS OF\n TIMESTAMP SYSDATE;", ("flashback_query", None, 1, "AS OF TIMESTAMP")),
    _in(V, "CREATE VIEW cn_{k} AS SELECT a FROM t\nCONNECT BY NOCYCLE PRIOR a = b\nORDER SIBLINGS BY a;", ("connect_by_nocycle", None, 2, "CONNECT BY NOCYCLE"), ("connect_by_nocycle", None, 3, "ORDER SIBLINGS BY")),
    _in(P, "CREATE PROCEDURE ia_{k} IS\nBEGIN\n INSERT ALL INTO a VALUES (1) INTO b VALUES (2) SELECT 1 FROM dual;\nEND;", ("insert_all", None, 3, "INSERT ALL")),
    _in(V, "CREATE VIEW jt_{k} AS SELECT j.* FROM t,\nJSON_TABLE(t.c, '$' COLUMNS (a NUMBER PATH '$.a')) j;", ("json_table", None, 2, "JSON_TABLE(...)")),
    _in(P, "CREATE FUNCTION sm_{k} RETURN VARCHAR2 SQL_MACRO IS\nBEGIN\n RETURN 'SELECT 1';\nEND;", ("sql_macro", None, 1, "SQL_MACRO")),
    _in(V, "CREATE VIEW ap_{k} AS SELECT * FROM a\nCROSS APPLY (SELECT 1 x FROM b) z;", ("cross_apply", None, 2, "CROSS APPLY")),
    _in(P, "CREATE PROCEDURE dy_{k} IS\nBEGIN\n EXECUTE IMMEDIATE 'SELECT 1 FROM a OUTER APPLY f(x)';\nEND;", ("cross_apply", None, 3, "OUTER APPLY")),
    _in(P, "CREATE PROCEDURE dz_{k} IS\n x VARCHAR2(9);\nBEGIN\n x := 'CROSS APPLY'; /* READ ONLY\n CROSS APPLY */\nEND;"),
    _in(V, "CREATE VIEW rc_{k} AS WITH r AS (SELECT 1 n FROM d UNION ALL SELECT n + 1 FROM r)\nSELECT * FROM r;", ("recursive_with", None, 1, "WITH R AS (...)")),
    _in(V, "CREATE VIEW rx_{k} AS WITH RECURSIVE r AS (SELECT 1 n FROM d UNION ALL SELECT n + 1 FROM r) SELECT * FROM r;"),
    _in(T, "CREATE OR REPLACE TRIGGER tr_{k}\nFOR INSERT ON t\nCOMPOUND TRIGGER\n AFTER STATEMENT IS BEGIN NULL; END AFTER STATEMENT;\nEND;", ("compound_triggers", None, 3, "COMPOUND TRIGGER")),
    _in(T, "CREATE TRIGGER tp_{k} BEFORE INSERT ON t BEGIN NULL; END;"),
    _in(P, "CREATE PROCEDURE du_{k} IS\nBEGIN\n dbms_lock.sleep(1);\n DBMS_OUTPUT.PUT_LINE('x');\n utl_file.fclose_all;\nEND;", ("dbms_utl_calls", "DBMS_LOCK.SLEEP", 3, "dbms_lock.sleep"), ("dbms_utl_calls", "UTL_FILE.FCLOSE_ALL", 5, "utl_file.fclose_all")),
    _in(P, "CREATE PROCEDURE me_{k} IS\nBEGIN\n MERGE INTO t USING s ON (t.a = s.a)\n WHEN MATCHED THEN UPDATE SET b = 1\n DELETE WHERE b = 0;\nEND;", ("merge_delete_clause", None, 5, "DELETE WHERE")),
    _in(
        G,
        "CREATE PACKAGE BODY pk_{k} AS\n g_n NUMBER := 0;\n PROCEDURE lg IS\n  PRAGMA AUTONOMOUS_TRANSACTION;\n BEGIN\n  IF g_n > 0 THEN NULL; END IF;\n END;\nEND;",
        ("autonomous_tx", "PK_{k}.LG", 4, "PRAGMA AUTONOMOUS_TRANSACTION;"),
        ("package_state", "PK_{k}.G_N", 2, "g_n NUMBER :="),
        inner=(("nested_routine", "LG", 3),),
    ),
    _in(G, "CREATE PACKAGE sp_{k} AS\n c_x CONSTANT NUMBER := 1;\n PROCEDURE p;\nEND;", ("package_state", "SP_{k}.C_X", 2, "c_x CONSTANT NUMBER :="), inner=(("nested_routine", "P", 3),)),
    _in(P, "CREATE PROCEDURE ou_{k} IS\n PROCEDURE inr IS BEGIN NULL; END;\nBEGIN\n inr;\nEND;", ("nested_subprogram", "OU_{k}.INR", 2, "PROCEDURE inr"), inner=(("nested_routine", "INR", 2),)),
    _in(P, "CREATE PROCEDURE cd_{k} IS\nBEGIN\n $IF TRUE $THEN\n NULL;\n $END\nEND;", ("conditional_compilation", None, 3, "$IF"), ("conditional_compilation", None, 5, "$END")),
    _t('REM CREATE TABLE x READ ONLY;\nCREATE TABLE "Qt_{k}" (a NUMBER) "READ ONLY";'),
    _t("CREATE TABLE lt_{k} (a VARCHAR2(30) DEFAULT q'[it's READ ONLY]') READ ONLY;", ("read_only_table", "LT_{k}", 1, "READ ONLY")),
    _t("GRANT CREATE VIEW, CREATE PROCEDURE TO hr_{k};"),
    _in(V, "CREATE VIEW as_{k} AS SELECT 1 x FROM a CROSS\n APPLY b;", ("cross_apply", None, 1, "CROSS APPLY")),
)
N = len(TEMPLATES)
#: Another tool's output, for the detector that looks at generated code.
GENERATED: tuple[Template, ...] = (
    _t("CREATE OR REPLACE FUNCTION gc_{k} () RETURNS int AS $body$\nBEGIN\n WITH RECURSIVE cte AS (\n SELECT 1 UNION ALL\n SELECT (c.level+1) FROM cte c) SELECT 1;\nEND;", ("connect_by", "GC_{k}", 0, "c.level")),
    _t("CREATE FUNCTION gd_{k} () RETURNS int AS $body$\nBEGIN\n WITH RECURSIVE cte AS (SELECT 1) SELECT level FROM cte;\nEND;"),
)


def files(spark: SparkSession, sf_dir: str, templates: tuple[Template, ...] = TEMPLATES, per_file: int | None = None) -> DataFrame:
    """(source_file, source): the statements of consecutive keys, in order."""
    n = len(templates)
    per_file = per_file or n
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    text = F.replace(F.element_at(F.array(*[F.lit(t.text) for t in templates]), (F.pmod(F.col("k"), F.lit(n)) + 1).cast("int")), F.lit("{k}"), F.col("k").cast("string"))
    rows = part.select(F.floor(F.col("k") / per_file).alias("f"), "k", text.alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n")
    texts = rows.groupBy("f").agg(joined.alias("source")).select(F.concat(F.lit("f"), F.col("f"), F.lit(".sql")).alias("source_file"), "source")
    # few bytes but much work each: adaptive execution would put them all into one task
    return texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_file")


def _q(x: object) -> str:
    return str(x) if isinstance(x, int) else "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in rows)


def base_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """b(k, f, tid, source_file, before): every statement with the number of lines before it in its file."""
    n = len(templates)
    sizes = values([(i, t.text.count("\n") + 1) for i, t in enumerate(templates)])
    return f"""x(tid, size) AS (VALUES {sizes}),
b AS (SELECT k, f, tid, 'f' || f || '.sql' AS source_file, coalesce(sum(size) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT p_partkey AS k, p_partkey // {n} AS f, p_partkey % {n} AS tid FROM part) JOIN x USING (tid))"""


def findings_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """fs: the expected findings of the corpus."""
    rows = [(i, d, KNOWN[d][0], o, line, s, KNOWN[d][6][m], 1 if line else 0) for i, t in enumerate(templates) for d, o, line, s, m in t.expected]
    return f"""{base_sql(templates)},
e(tid, detector, severity, obj, rel, snip, message, counted) AS (VALUES {values(rows)}),
fs AS (SELECT detector, severity, replace(obj, '{{k}}', k::VARCHAR) AS object_name, ((before + rel) * counted)::INT AS line, replace(snip, '{{k}}', k::VARCHAR) AS snippet, message, source_file FROM b JOIN e USING (tid))"""


def containers_sql() -> str:
    rows = [(i, kind, name, line) for i, t in enumerate(TEMPLATES) for kind, name, line in t.containers]
    return f"""{base_sql()},
e(tid, kind, nm, rel) AS (VALUES {values(rows)}),
cs AS (SELECT source_file, (before + rel)::INT AS line, kind, replace(nm, '{{k}}', k::VARCHAR) AS name FROM b JOIN e USING (tid))"""


def texts_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """ft: source_file and text."""
    n = len(templates)
    rows = values([(i, t.text) for i, t in enumerate(templates)])
    return f"""tx(tid, text) AS (VALUES {rows}),
ft AS (SELECT 'f' || f || '.sql' AS source_file, string_agg(replace(text, '{{k}}', k::VARCHAR), chr(10) ORDER BY k) AS text
       FROM (SELECT p_partkey AS k, p_partkey // {n} AS f, p_partkey % {n} AS tid FROM part) JOIN tx USING (tid) GROUP BY f)"""
