"""The command line: scan files, compare with a snapshot, verify generated code, explain a gap.

Exit codes: 0 done, 1 the gate failed, 2 an error (which outweighs the gate).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import findings as O
from quillspark.operators import registry, scan, snapshot
from quillspark.sources import sinks
from quillspark.sources.files import expand, read_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("paths", nargs="*", help="files, or folders with .sql, .pks and .pkb files")
    p.add_argument("--format", choices=[*sinks.DOCUMENTS, "terminal"])
    p.add_argument("--output", help="write the report here")
    p.add_argument("--severity", choices=list(registry.RANKS), help="show findings of this severity only")
    p.add_argument("--object", help="show findings of objects whose name holds this")
    p.add_argument("--save", help="write a snapshot here: one document if it ends in .json, else a folder")
    p.add_argument("--baseline", help="a snapshot to compare with")
    p.add_argument("--verify", action="store_true", help="paths are generated code to be checked against the snapshot")
    p.add_argument("--fail-on", choices=list(registry.RANKS), help="exit with 1 on findings of this severity or worse")
    p.add_argument("--check-generated", metavar="FOLDER", help="a folder of generated code to lint besides")
    p.add_argument("--explain", metavar="GAP", help="show a gap, by number or detector, and stop")
    return p


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _terminal(shown: DataFrame, objects: int) -> str:
    lines = [f"{objects} objects; {sinks.summary(shown)}", ""]
    lines += [f"{r['severity']:<8}{r['object_name']}  {r['source_file']}:{r['line']}  {r['detector']}  {r['snippet']}" for r in O.ordered(shown).toLocalIterator()]
    lines += ["", *(f"{r['object_name']}: {r['n']}" for r in O.top_objects(shown).collect())]
    lines += ["", *(f"{r['n']} x {r['detector']}: {r['hint']}" for r in O.recommendations(shown).collect())]
    return "\n".join(lines) + "\n"


def _emit(text: str, output: str | None) -> None:
    if output:
        Path(output).write_text(text, encoding="utf-8")
    else:
        print(text)


def _conflict(a: argparse.Namespace) -> str | None:
    if a.verify and (a.save or a.fail_on or a.check_generated or a.severity or a.object):
        return "--verify goes with --baseline, --format and --output only"
    if a.verify and (not a.baseline or not a.paths):
        return "--verify needs --baseline and paths"
    if a.verify and a.format not in (None, "json", "terminal"):
        return "--verify reports as json or terminal"
    if not a.explain and not a.paths:
        return "no paths"
    if a.save and a.baseline and Path(a.save).resolve() == Path(a.baseline).resolve():
        return "--save can't replace the snapshot of --baseline"
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    wrong = _conflict(a)
    if wrong:
        _say(wrong)
        return 2
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    if a.explain:
        rows = registry.explain(spark, a.explain).collect()
        print("\n".join(str(r.asDict()) for r in rows) or "no such gap")
        return 0 if rows else 2
    files, empty = expand(a.paths)
    sources, missing = read_files(spark, files)
    for path in empty:
        _say(f"no source files in {path}")
    for path in missing:
        _say(f"not found: {path}")
    error = bool(missing or empty)
    found = scan.scan(sources)
    if a.check_generated:
        found = found.unionByName(scan.lint_generated(read_files(spark, expand([a.check_generated])[0])[0]))
    found = found.persist()
    try:
        baseline = snapshot.load(spark, a.baseline) if a.baseline else None
        if a.verify:
            rows = snapshot.verify(baseline, found)
            text = sinks.verification_json(rows).first()[0] if a.format == "json" else "\n".join(f"{r['detector']}: {r['baseline_count']} -> {'-' if r['status'] == 'not_verifiable' else r['post_migration_count']} {r['status']}" for r in rows.orderBy("detector").collect())
            _emit(text, a.output)
            return 2 if error else 0
        if a.save and not (snapshot.save_document if a.save.endswith(".json") else snapshot.save)(found, a.save, error):
            _say("snapshot not written, as the scan had errors")
        if baseline is not None:
            counts = {r["status"]: r["n"] for r in snapshot.diff(baseline, snapshot.keyed(found)).groupBy("status").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
            for r in O.ordered(snapshot.diff_rows(baseline, snapshot.keyed(found)).filter("status = 'new'").withColumns({k: F.lit(0) for k in O.KEYS if k != "source_file"})).toLocalIterator():
                _say(f"new: {r['severity']} {r['object_name']} {r['source_file']}:{r['line']} {r['detector']}")
            _say("against the snapshot: " + ", ".join(f"{s} {counts.get(s, 0)}" for s in ("new", "resolved", "unchanged")))
        shown = O.select(found, a.severity, a.object)
        kind = a.format or ("terminal" if not a.output and sys.stdout.isatty() else "markdown")
        if kind == "terminal":
            objects = scan.total_objects(scan.with_views(sources)).agg({"objects": "sum"}).first()[0] or 0
            _emit(_terminal(shown, objects), a.output)
        else:
            _emit(sinks.DOCUMENTS[kind](shown), a.output)
        if error:
            return 2
        return int(bool(a.fail_on and O.gate(found, a.fail_on).first()[0]))
    except snapshot.SnapshotError as e:
        _say(str(e))
        return 2
    finally:
        found.unpersist()


if __name__ == "__main__":
    sys.exit(main())
