import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import costs, registry, snapshot
from quillspark.operators import findings as O
from quillspark.sources import dictionary, files, sinks

DDL = "detector string, severity string, object_name string, line int, snippet string, message string, source_file string, file_seq int, detector_seq int, hit_seq int"


def table(spark, *rows):
    """Rows of (detector, severity, object, line)."""
    return spark.createDataFrame([(d, s, o, n, "s", f"m {d}", "f.sql", 0, 0, i) for i, (d, s, o, n) in enumerate(rows)], DDL)


def test_effort(spark):
    e = lambda *r: tuple(O.effort(table(spark, *r)).first())[:2]
    assert e(*[("a", "high", "o", 1)] * 8) == (3.75, 15.0)
    assert e(*[("a", "high", "o", 1)] * 2, *[("b", "medium", "o", 1)] * 3) == (3.75, 15.0)
    assert e() == (0.0, 0.0)
    assert e(("a", "odd", "o", 1)) == (1.0, 4.0)


def test_counts_and_gate(spark):
    t = table(spark, ("a", "high", "o", 1), ("a", "odd", "p", 2))
    assert {r["severity"]: r["n"] for r in O.severity_counts(t).collect()} == {"high": 1, "medium": 0, "low": 0, "other": 1}
    assert [r["severity"] for r in O.ordered_counts(t).collect()] == ["high", "other"]
    assert O.gate(t, "high").first()[0] and not O.gate(t.filter("severity = 'odd'"), "low").first()[0]
    assert not O.gate(t.limit(0), "low").first()[0]


def test_top_objects(spark):
    one = table(spark, ("a", "high", "o", 1))
    assert O.top_objects(one).count() == 0
    t = table(spark, ("a", "medium", "b", 1), ("a", "high", "c", 1), ("a", "medium", "a", 1))
    assert [(r["object_name"], r["left_out"]) for r in O.top_objects(t, 2).collect()] == [("c", 1), ("a", 1)]


def test_order_is_stable(spark):
    t = table(spark, ("b", "medium", "o", 1), ("a", "high", "p", 2), ("c", "high", "o", 2), ("d", "high", "o", 2))
    assert [r["detector"] for r in O.ordered(t).collect()] == ["c", "d", "a", "b"]
    assert [r["detector"] for r in O.numbered(t).orderBy("seq").collect()] == ["c", "d", "a", "b"]


def test_bag_diff(spark):
    def bag(*keys):
        return spark.createDataFrame([(k,) for k in keys], "group_key string")

    got = lambda b, c: {(r["status"], r["group_key"]): r["n"] for r in snapshot.diff(b, c).collect()}
    assert got(bag("k", "k"), bag("k")) == {("resolved", "k"): 1, ("unchanged", "k"): 1}
    assert got(bag("k"), bag("k", "k")) == {("new", "k"): 1, ("unchanged", "k"): 1}
    assert got(bag(), bag()) == {}


def test_group_key_is_known(spark):
    t = table(spark, ("bulk_collect", "high", "BULK_TEST_PKG.ARCHIVE_OLD_ORDERS", 3)).withColumn("source_file", F.lit("oracle/bulk_test_pkg.sql")).withColumn("snippet", F.lit("TYPE t_id_tab IS TABLE OF"))
    assert snapshot.keyed(t).first()["group_key"] == "1e9bb10a8896"


def test_verify(spark):
    before = table(spark, ("bulk_collect", "high", "o", 1), ("sql_macro", "high", "o", 1), ("mine", "high", "o", 1), ("json_table", "high", "o", 1))
    after = table(spark, ("bulk_collect", "high", "o", 1), ("sql_macro", "high", "o", 1), ("pivot_clause", "high", "o", 1))
    rows = {r["detector"]: (r["status"], r["post_migration_count"], r["gap_number"]) for r in snapshot.verify(before, after).collect()}
    assert rows == {"bulk_collect": ("still_present", 1, "003"), "sql_macro": ("not_verifiable", 1, "019"), "mine": ("not_verifiable", 0, None), "json_table": ("not_detected", 0, "017")}


def test_snapshot_files(spark, tmp_path):
    t = table(spark, ("bulk_collect", "high", "o", 1))
    assert not snapshot.save(t, str(tmp_path / "x"), had_error=True) and not (tmp_path / "x").exists()
    assert snapshot.save(t, str(tmp_path / "x"))
    assert snapshot.diff(snapshot.load(spark, str(tmp_path / "x")), snapshot.keyed(t)).collect()[0]["status"] == "unchanged"
    assert snapshot.save_document(t, str(tmp_path / "d.json")) and not snapshot.save_document(t, str(tmp_path / "e.json"), had_error=True)
    written = json.loads((tmp_path / "d.json").read_text())
    assert written["schema_version"] == 1 and set(written["findings"][0]) == {*snapshot.COLUMNS, "group_key"}
    assert [tuple(r) for r in snapshot.load(spark, str(tmp_path / "d.json")).collect()] == [tuple(r) for r in snapshot.load(spark, str(tmp_path / "x")).collect()]
    with pytest.raises(snapshot.SnapshotError):
        snapshot.save(t, str(tmp_path / "x"), baseline=str(tmp_path / "." / "x"))
    good = {"schema_version": 1, "findings": [{"group_key": "k", "detector": "d"}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert snapshot.load(spark, str(tmp_path / "good.json")).first()["gap_number"] is None
    bad = [b"\xff", b"{", b"[]", b'{"schema_version": 2, "findings": []}', b'{"schema_version": true, "findings": []}', b'{"schema_version": 1, "findings": [{"detector": "d"}]}']
    for i, raw in enumerate(bad):
        (tmp_path / f"{i}.json").write_bytes(raw)
        with pytest.raises(snapshot.SnapshotError):
            snapshot.load(spark, str(tmp_path / f"{i}.json"))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, str(tmp_path / "none.json"))


@pytest.mark.parametrize("reference, number", [("GAP-023", "023"), ("gap23", "023"), ("023", "023"), (" 23 ", "023"), ("x", None), ("2345", None)])
def test_gap_numbers(spark, reference, number):
    assert spark.range(1).select(registry.gap_number(F.lit(reference))).first()[0] == number


def test_explain(spark):
    assert registry.explain(spark, "gap6").first()["detector"] == "database_link"
    assert registry.explain(spark, "cross_apply").first()["number"] == "022"


def test_registry_is_whole(spark):
    gaps = registry.gaps(spark)
    assert gaps.count() == gaps.select("number").distinct().count() == 37
    assert {r["failure_stage"]: r["count"] for r in gaps.groupBy("failure_stage").count().collect()} == {"deployment": 5, "runtime": 19, "semantic": 11, None: 2}
    assert {r["mode"]: r["count"] for r in registry.modes(spark).groupBy("mode").count().collect()} == {"verbatim": 15, "not_verifiable": 22, "generated_only": 1}


def test_costs(spark):
    text = "-- Total estimated cost for package p: 225.1 units, 3 person-day(s).\n\t-- Function p.a total estimated cost: 3.4\n\t\t-- CONCAT => 4 (cost: 0.1)\n\t\t-- Test => 1\n\t\t-- TEST => 2\n-- Function b estimated cost: 6.2\nx\n-- Total estimated cost: 6.2 units, 1 person-day(s)."
    t = spark.createDataFrame([("r", text), ("n", None)], "source_file string, source string")
    assert {r["name"]: (r["total_cost"], r["breakdown"]) for r in costs.function_costs(t).collect()} == {"p.a": (3.4, {"CONCAT": 4, "TEST": 2}), "b": (6.2, {})}
    assert [tuple(r)[1:] for r in costs.totals(t).collect()] == [("p", 225.1, 3.0), (None, 6.2, 1.0)]


def test_sinks(spark):
    t = table(spark, ("bulk_collect", "high", "=o|<é>", 0), ("mine", "low", "p", 2))
    docs = {k: f(t) for k, f in sinks.DOCUMENTS.items()}
    assert [r["line"] for r in json.loads(docs["json"])] == [0, 2] and "é" in docs["json"]
    assert docs["csv"].splitlines()[1].split(",")[2] == "'=o|<é>" and "\r" not in docs["csv"]
    assert r"=o\|<é>" in docs["markdown"] and "&lt;é&gt;" in docs["html"]
    sarif = json.loads(docs["sarif"])["runs"][0]
    assert "region" not in sarif["results"][0]["locations"][0]["physicalLocation"]
    assert [r["level"] for r in sarif["results"]] == ["error", "note"]
    rules = {r["id"].split("/")[0]: r for r in sarif["tool"]["driver"]["rules"]}
    assert "helpUri" not in rules["mine"] and rules["bulk_collect"]["properties"]["gapNumber"] == "003"
    assert rules["bulk_collect"]["shortDescription"]["text"] == "Bulk collect"
    assert sinks.markdown_document(t.limit(0)) == "No findings.\n"
    uri = spark.range(1).select(sinks.sarif_uri(F.lit("a b\\c~*+é/ü"))).first()[0]
    assert uri == "a%20b/c~%2A%2B%C3%A9/%C3%BC"


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "d" / "b.SQL").write_bytes(b"a\r\nb\xff")
    (tmp_path / "d" / "e" / "a.pkb").write_text("x")
    (tmp_path / "d" / "n.txt").write_text("x")
    paths, empty = files.expand([str(tmp_path / "d"), str(tmp_path / "d" / "." / "b.SQL"), str(tmp_path / "d" / "n.txt"), str(tmp_path / "empty"), str(tmp_path / "gone.sql")])
    assert [p.rpartition("/")[2] for p in paths] == ["b.SQL", "a.pkb", "n.txt", "gone.sql"] and len(empty) == 1
    rows, missing = files.read_files(spark, paths)
    assert missing == [str(tmp_path / "gone.sql")]
    assert {r["file_seq"]: r["source"] for r in rows.collect()} == {0: "a\nb�", 1: "x", 2: "x"}
    assert files.read_tree(spark, str(tmp_path)).count() == 2


def test_statements(spark):
    t = spark.createDataFrame([("a", "CREATE x;\n/\n-- ;\n/\nBEGIN '\n/\n'; END;\n/"), ("b", "a; 'b';c"), ("c", None)], "source_file string, source string")
    got = [(r["source_file"], r["statement"]) for r in files.split_statements(t).orderBy("source_file", "n").collect()]
    assert got == [("a", "CREATE x;"), ("a", "BEGIN '\n/\n'; END;"), ("b", "a"), ("b", "c")]


def test_dictionary(spark, tmp_path):
    rows = [("TRIGGER", "a b", "x"), ("TRIGGER", "A_B", "y"), ("TRIGGER", "gone", None), ("PACKAGE_BODY", "_P_", "z"), ("PACKAGE_BODY", "é", "w")]
    t = spark.createDataFrame(rows, "kind string, object_name string, ddl string")
    assert [p.rpartition("/")[2] for p in dictionary.export(t, str(tmp_path))] == ["object.pkb.sql", "p.pkb.sql", "a_b.trg.sql", "a_b_2.trg.sql"]
    assert "O''X" in dictionary.triggers_query("o'x")
    with pytest.raises(dictionary.DriverMissing):
        dictionary.read(spark, "jdbc:none", "select 1")
