import time

import pytest

from quillspark.functions.lexer import Source
from quillspark.operators import detect, scan
from quillspark.operators.specs import SPECS, Part, Spec


def found(spark, text, detector=None):
    src = spark.createDataFrame([("a.sql", text)], "source_file string, source string")
    rows = scan.scan(src, [detector] if detector else None).orderBy("detector_seq", "hit_seq").collect()
    return [(r["object_name"], r["line"], r["snippet"]) for r in rows]


CASES = [
    ("read_only_table", "CREATE TABLE u1 (a NUMBER)\nCREATE TABLE u2 (b NUMBER) READ ONLY", [("U2", 2, "READ ONLY")]),
    ("read_only_table", "CREATE TABLE t (a NUMBER) COMMENT 'READ ONLY'", []),
    ("cross_apply", "CREATE OR REPLACE PACKAGE BODY p AS\n PROCEDURE q IS BEGIN\n  FOR r IN (SELECT 1 FROM a CROSS APPLY (SELECT 1 FROM b) z) LOOP NULL; END LOOP; END;\nEND;", [("P.Q", 3, "CROSS APPLY")]),
    ("cross_apply", "x := 'OUTER APPLY';", []),
    ("cross_apply", "EXECUTE IMMEDIATE 'a' || 'SELECT 1 FROM b OUTER APPLY f'; y := 'CROSS APPLY';", [("UNKNOWN", 1, "OUTER APPLY")]),
    ("cross_apply", "EXECUTE /* c */ IMMEDIATE 'SELECT 1 FROM b OUTER APPLY f';", []),
    ("database_link", "SELECT 1 FROM a@l.dom", [("UNKNOWN", 1, "a@l.dom")]),
    ("database_link", 'SELECT "a@b" FROM t', []),
    ("nested_subprogram", "CREATE PROCEDURE o IS\n PROCEDURE x;\nBEGIN NULL; END;", []),
    ("nested_subprogram", "CREATE PACKAGE BODY p AS\nPROCEDURE o IS\n PROCEDURE a IS\n  FUNCTION b RETURN NUMBER IS BEGIN RETURN 1; END;\n BEGIN NULL; END;\nBEGIN NULL; END;\nEND;", [("P.O.B", 4, "FUNCTION b"), ("P.O.A", 3, "PROCEDURE a")]),
    ("autonomous_tx", "PROCEDURE lone IS\nPRAGMA AUTONOMOUS_TRANSACTION;\nBEGIN CASE WHEN a THEN b; END CASE; FOR i IN 1..2 LOOP NULL; END LOOP; END;", [("UNKNOWN.LONE", 2, "PRAGMA AUTONOMOUS_TRANSACTION;")]),
    ("autonomous_tx", "PACKAGE BODY q IS\nPROCEDURE o IS\n PROCEDURE i IS PRAGMA AUTONOMOUS_TRANSACTION; BEGIN NULL; END;\nBEGIN NULL; END;\nEND;", []),
    ("recursive_with", "WITH r AS (SELECT 1 n FROM d UNION ALL SELECT n+1 FROM r) SELECT * FROM r", [("UNKNOWN", 1, "WITH R AS (...)")]),
    ("recursive_with", "WITH a AS (SELECT 1 FROM d), r (n) AS (SELECT 1 FROM a UNION ALL SELECT n FROM a, r) SELECT 1 FROM r", [("UNKNOWN", 1, "WITH R AS (...)")]),
    ("recursive_with", "WITH RECURSIVE r AS (SELECT 1 n FROM d UNION ALL SELECT n FROM r) SELECT 1 FROM r", []),
    ("sequence_cycle", "CREATE SEQUENCE a\nCREATE SEQUENCE b CYCLE", [("B", 2, "CYCLE")]),
    ("table_partitioning", "CREATE TABLE a (x DATE)\nCREATE TABLE b (x DATE) PARTITION BY HASH (x) SUBPARTITIONS 2", [("B", 2, "PARTITION BY HASH")]),
    ("rowid_type", "CREATE TABLE a (x DATE\nCREATE TABLE b (r ROWID)", [("A", 2, "r ROWID"), ("B", 2, "r ROWID")]),
    ("rowid_type", "CREATE TABLE a (x DATE); -- (\nSELECT x ROWID FROM t", []),
    ("virtual_column", "CREATE TABLE a (x NUMBER GENERATED ALWAYS AS IDENTITY)", []),
    ("model_clause", "SELECT model FROM cars", []),
    ("oracle_text", "SELECT 1 FROM t WHERE CONTAINS(a, b) = :n AND MATCHES(c)", [("UNKNOWN", 1, "CONTAINS(...)")]),
    ("package_state", "CREATE PACKAGE BODY p IS\n a t.c%TYPE;\n b CONSTANT VARCHAR2(3) NOT NULL := 1;\n PROCEDURE q IS\n c NUMBER;\n BEGIN NULL; END;\nEND;", [("P.A", 2, "a t.c%TYPE;"), ("P.B", 3, "b CONSTANT VARCHAR2(3) NOT NULL :=")]),
    ("package_state", "CREATE PACKAGE body_x IS\n a DATE;\nEND;", [("BODY_X.A", 2, "a DATE;")]),
    ("dbms_utl_calls", "my_dbms_x.y; x.dbms_lob.substr(1); UTL_http.request(u)", [("UTL_HTTP.REQUEST", 1, "UTL_http.request")]),
    ("bulk_collect", "CREATE OR REPLACE TYPE t IS TABLE OF NUMBER;\nDECLARE TYPE u IS TABLE OF t;", [("UNKNOWN", 2, "TYPE u IS TABLE OF")]),
    ("merge_delete_clause", "MERGE INTO a USING b ON (1=1); DELETE WHERE x", []),
    ("invisible_index", 'CREATE INDEX i ON t (a) "INVISIBLE"', []),
    ("public_synonym", 'CREATE SYNONYM "S" FOR "H"."T"', [("S", 1, "FOR T")]),
]


@pytest.mark.parametrize("detector, text, expected", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_detector(spark, detector, text, expected):
    assert found(spark, text, detector) == expected


def test_edges(spark):
    empty = spark.createDataFrame([], "source_file string, source string")
    assert scan.scan(empty).count() == 0
    odd = spark.createDataFrame([("a", None, 1), (None, "CREATE TABLE t (a NUMBER) READ ONLY;", 2), ("a", "", 3)], "source_file string, source string, clean int")
    assert [r["object_name"] for r in scan.scan(odd).collect()] == ["T"]


def test_repeated_files_give_repeated_findings(spark):
    one = ("a.sql", "CREATE TABLE t (a NUMBER) READ ONLY;")
    assert scan.scan(spark.createDataFrame([one, one], "source_file string, source string"), ["read_only_table"]).count() == 2


def test_long_text(spark):
    text = "CREATE VIEW v AS SELECT '" + "x''" * 200_000 + "' FROM a CROSS APPLY b;\n" * 1 + "-- y\n" * 50_000 + "SELECT 1 FROM c CROSS APPLY d;"
    assert [x[1] for x in found(spark, text, "cross_apply")] == [1, 50_002]


def test_own_detector(spark):
    spec = Spec("todo", (Part("own"),), ("Left to do.",), "Do it.", severity="low")
    rows = lambda s: [(m.start(), None, m[0], 0) for m in s.visible.matches(r"\bTODO\b")]
    scan.register_detector(spec, rows)
    try:
        src = spark.createDataFrame([("a.sql", "CREATE VIEW v AS\nSELECT TODO FROM t;")], "source_file string, source string")
        got = scan.scan(src).collect()
        assert [(r["detector"], r["severity"], r["object_name"], r["line"], r["message"]) for r in got] == [("todo", "low", "V", 2, "Left to do.")]
    finally:
        scan.unregister_detector("todo")
    with pytest.raises(ValueError):
        scan.scan(src, ["todo"])


def test_plan_masks_once_and_shuffles_nothing(spark):
    src = spark.createDataFrame([("a.sql", "x")], "source_file string, source string")
    plan = scan.scan(src)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("MapInArrow") == 1
    assert len(SPECS) == 37


def test_scan_is_linear_in_its_hits():
    def seconds(n):
        text = "CREATE PACKAGE BODY p IS\n" + "".join(f"PROCEDURE q{i} IS\n TYPE t{i} IS TABLE OF NUMBER;\n PRAGMA AUTONOMOUS_TRANSACTION;\nBEGIN NULL; END;\n" for i in range(n)) + "END;"
        began = time.perf_counter()
        s = Source(text)
        assert sum(1 for spec in SPECS for _ in detect.hits(spec, s)) == 2 * n
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(4000) for _ in range(3)) < 3 * min(seconds(2000) for _ in range(3)) + 0.1
