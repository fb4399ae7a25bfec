"""The scan: sources to findings.

One pass over Arrow batches: a file's masked views, lines and object index are made once, as
far as a detector asks for them, and all detectors run on them, each in time linear in the
text and its hits.  Nothing is shuffled.  Where only some detectors are asked for, a native
filter leaves out the files that hold none of the words these begin with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexer as L

from . import detect
from .specs import BY_NAME, GENERATED, SPECS, Spec

FINDING = ["detector", "severity", "object_name", "line", "snippet", "message", "source_file"]
ORDER = ["file_seq", "detector_seq", "hit_seq"]
SCHEMA = "detector string, severity string, object_name string, line int, snippet string, message string, source_file string, file_seq int, detector_seq int, hit_seq int"
VIEWS = f"source_file string, file_seq int, clean string, visible string, idx {L.INDEX}"
_FOUND = pa.schema([(c, pa.int32() if c in ("line", *ORDER) else pa.string()) for c in FINDING + ORDER])
_ENTRY = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("name", pa.string())])
_VIEWS = pa.schema([("source_file", pa.string()), ("file_seq", pa.int32()), ("clean", pa.string()), ("visible", pa.string()), ("idx", pa.list_(_ENTRY))])
BATCH_FINDINGS, BATCH_FILES = 20_000, 64
Rows = Callable[[L.Source], Iterable[tuple[int, "str | None", str, int]]]
_plugins: dict[str, tuple[Spec, Rows]] = {}


def register_detector(spec: Spec, rows: Rows) -> None:
    """Add a detector of one's own: rows(source) gives (offset, object or None for the one around it, snippet, number of the message); it runs on the executors."""
    _plugins[spec.name] = (spec, rows)


def unregister_detector(name: str) -> None:
    _plugins.pop(name, None)


def _sources(sources: DataFrame) -> DataFrame:
    seq = F.col("file_seq").cast("int") if "file_seq" in sources.columns else F.lit(0)
    return sources.select(F.col("source_file").cast("string").alias("source_file"), seq.alias("file_seq"), F.col("source").cast("string").alias("source"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, L.Source]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), L.Source(batch.column(2)[i].as_py())


def with_views(sources: DataFrame) -> DataFrame:
    """source_file, file_seq, clean, visible and idx of sources (source_file, source, and file_seq if there is one).

    A null source is an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, seq, s in _texts(batch):
                rows.append((file, seq, s.clean.text, s.visible.text, [dict(zip(("pos", "kind", "name"), e)) for e in s.index]))
                if len(rows) == BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _VIEWS)], schema=_VIEWS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _VIEWS)], schema=_VIEWS)

    return _sources(sources).mapInArrow(run, VIEWS)


def _run(specs: list[tuple[int, Spec, Rows | None]], at_line_0: bool = False):
    """Findings of the given detectors, in batches."""

    def hits(spec: Spec, own: Rows | None, s: L.Source) -> Iterator[detect.Hit]:
        if own is None:
            yield from detect.hits(spec, s)
        else:
            for pos, name, snippet, message in own(s):
                yield pos, s.line(pos), s.enclosing(pos) if name is None else name, snippet, message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

        for batch in batches:
            for file, seq, s in _texts(batch):
                for number, spec, own in specs:
                    for k, (_, line, name, snippet, message) in enumerate(hits(spec, own, s)):
                        rows.append((spec.name, spec.severity, name, 0 if at_line_0 else line, snippet, spec.messages[message], file, seq, number, k))
                        if len(rows) == BATCH_FINDINGS:
                            yield packed()
                            rows.clear()
        if rows:
            yield packed()

    return run


def _may_hold(specs: list[Spec]) -> Column | None:
    """Whether a text has one of the words that the detectors' hits begin with; None where a detector has none."""
    needed = [detect.begins(s) for s in specs]
    if not all(needed):
        return None
    up, out = F.upper(F.lower(F.col("source"))), F.lit(False)
    for word in sorted({w for ws in needed for w in ws}):
        out = out | up.contains(word)
    return out


def scan(sources: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """Findings of sources: one row for each construct that a detector finds.

    Columns: detector, severity, object_name, line, snippet, message, source_file, and the
    order of emission, file_seq, detector_seq and hit_seq.  A null or empty text and an empty
    table give none; repeated files give repeated findings; other columns are ignored.
    """
    specs = [(i, s, None) for i, s in enumerate(SPECS) if detectors is None or s.name in detectors]
    specs += [(len(SPECS) + i, s, rows) for i, (s, rows) in enumerate(_plugins.values()) if detectors is None or s.name in detectors]
    unknown = set(detectors or []) - {s.name for _, s, _ in specs}
    if unknown:
        raise ValueError(f"no such detector: {sorted(unknown)}")
    texts = _sources(sources).filter("source <> ''")
    test = _may_hold([s for _, s, _ in specs]) if detectors is not None and not any(own for _, _, own in specs) else None
    return (texts if test is None else texts.filter(test)).mapInArrow(_run(specs), SCHEMA)


def lint_generated(generated: DataFrame) -> DataFrame:
    """Findings in generated code, of the detector that isn't part of the scan; line 0, as the place is not one of the source."""
    return _sources(generated).mapInArrow(_run([(len(SPECS), GENERATED, None)], at_line_0=True), SCHEMA)


def total_objects(views: DataFrame) -> DataFrame:
    """source_file and the number of its objects, routines inside others left out."""
    return views.select("source_file", L.object_count(F.col("idx")).cast("long").alias("objects"))


__all__ = ["BY_NAME", "FINDING", "ORDER", "lint_generated", "register_detector", "scan", "total_objects", "unregister_detector", "with_views"]
