import json

import pytest

from quillspark import cli
from quillspark.operators import checks
from quillspark.streaming import watch


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("ddl")
    (at / "a.sql").write_text("CREATE TABLE t (a NUMBER) READ ONLY;\nCREATE CONTEXT c USING p;\n")
    (at / "b.pkb").write_text("CREATE VIEW v AS SELECT 1 FROM a CROSS APPLY b;\n")
    return at


def test_scan_save_compare_gate(spark, folder, tmp_path, capsys):
    run = lambda *x: cli.main([*map(str, x)], spark)
    assert run(folder, "--format", "json", "--save", tmp_path / "base", "--fail-on", "high") == 1
    assert [r["detector"] for r in json.loads(capsys.readouterr().out)] == ["read_only_table", "cross_apply", "context_object"]
    assert run(folder / "b.pkb", "--format", "csv", "--baseline", tmp_path / "base", "--output", tmp_path / "o.csv", "--severity", "low", "--fail-on", "low") == 1
    assert "new 0, resolved 2, unchanged 1" in capsys.readouterr().err and len((tmp_path / "o.csv").read_text().splitlines()) == 1
    assert run(folder / "b.pkb", "--verify", "--baseline", tmp_path / "base", "--format", "json") == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["total"], got["still_present"], got["not_verifiable"]) == (3, 1, 2)
    assert run(folder, "--format", "terminal", "--object", "v") == 0
    assert "lateral join" in capsys.readouterr().out


def test_errors(spark, folder, tmp_path, capsys):
    run = lambda *x: cli.main([*map(str, x)], spark)
    assert run() == 2
    assert run(folder, "--verify") == 2
    assert run(folder, "--verify", "--baseline", "x", "--save", "y") == 2
    assert run(folder, "--baseline", tmp_path / "none") == 2
    assert run(folder, tmp_path / "gone.sql", "--save", tmp_path / "s", "--fail-on", "high") == 2
    assert not (tmp_path / "s").exists()
    assert run("--explain", "GAP-22") == 0 and "cross_apply" in capsys.readouterr().out
    assert run("--explain", "x") == 2


def test_registry_is_sound(spark):
    for rows in (checks.scanned(spark), checks.moded(spark), checks.translated(spark), checks.staged(spark)):
        assert rows.isEmpty()
    assert checks.translated(spark, "xx").count() == 78
    docs = spark.createDataFrame([("d/gap-001-autonomous-transaction.md",), ("d/other.md",)], "path string")
    sides = [r["side"] for r in checks.documented(docs, spark).collect()]
    assert (sides.count("left"), sides.count("right")) == (36, 1)
    rows = spark.createDataFrame([("001", "confirmed", "24", "16"), ("002", "open", "1", "1"), ("003", "confirmed", "25.0", "16")], "number string, status string, converter_version string, postgresql_version string")
    assert [r[0] for r in checks.versioned(rows, spark).collect()] == ["001"]
    tests = spark.createDataFrame([("test_sql_macro.py", "def test_a():\n  assert x == []\ndef test_b():\n  pass\n")], "file string, source string")
    assert [tuple(r) for r in checks.tested(tests, spark).filter("tests > 0").collect()] == [("019", 2, 1)]


def test_stream_gives_the_batch_findings(spark, folder, tmp_path):
    seen = []
    watch.run(watch.read(spark, str(folder)), str(tmp_path / "c"), lambda df, n: seen.extend(r["detector"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == ["context_object", "cross_apply", "read_only_table"]
