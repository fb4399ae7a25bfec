"""The detectors' shapes: each takes a Source and a part of a detector and gives its hits, in order.

A hit is (offset, line, object, snippet, number of the message).  All walk the matches of a
few patterns once; scopes and objects are found by bisection.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from quillspark.functions.lexer import PACKAGE, Source, View, first, matches, starting
from quillspark.functions.phrases import ID

from . import blocks
from .specs import CALLS_CONVERTED, STATE, Part, Spec

NEAR = 2000
Hit = tuple[int, int, str, str, int]
_SPACE = re.compile(r"\s+")
_HEAD = r"\b(?:IS|AS)\b"
_MEMBER = r"\b(?:PROCEDURE|FUNCTION)\b"
_BODY = re.compile(r"PACKAGE\s+BODY\s")
_SCORED = re.compile(r"\s*(?:[<>!]=|<>|[<>=])\s*[\d:]")
_LEVEL = r"(?<![A-Z0-9_$#])(?:\w+\.)?LEVEL\b"
_GAP = re.compile(r"[ \t\r\n]*")


def _one_space(text: str) -> str:
    return _SPACE.sub(" ", text.strip())


def _snippet(part: Part, text: str, m: re.Match, at: int = 0) -> str:
    """What is shown of a match in upper case; text is what it stands for, from `at` on."""
    if part.snippet == "match":
        return text[at + m.start() : at + m.end()].strip(" ")
    if part.snippet == "collapse":
        return _one_space(text[at + m.start() : at + m.end()])
    before, slot, after = part.snippet.partition("{}")
    return before + _SPACE.sub(" ", "".join(filter(None, m.groups()))) + after if slot else part.snippet


def scan(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """Anywhere, named by the object around it; near: what must follow within NEAR characters."""
    for m in view.matches(part.pattern):
        if all(first(view.up[m.end() : m.end() + NEAR], near) for near in part.near):
            yield m.start(), s.line(m.start()), s.enclosing(m.start()), _snippet(part, view.text, m), part.message


def declare(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """A declaration, named by itself."""
    for m in view.matches(part.pattern):
        yield m.start(), s.line(m.start()), m[1], _snippet(part, view.text, m), part.message


def _inside(part: Part, s: Source, view: View, outer: re.Match, start: int, end: int) -> Iterator[Hit]:
    """Hits of the probe between two offsets behind a declaration's match."""
    text = view.up[start:end]
    if part.take == "none":
        if not first(text, part.probe):
            yield outer.start(), s.line(outer.start()), outer[1], part.snippet, part.message
        return
    found = matches(text, part.probe) if part.take == "all" else filter(None, [first(text, part.probe)])
    for m in found:
        at = {"hit": start + m.start(), "start": outer.start(), "name": outer.end()}[part.at]
        yield at, s.line(at), outer[1], _snippet(part, view.text, m, start), part.message


def statement(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """Probes in a declaration's statement: up to its semicolon, if it ends there, or the next declaration of the kind."""
    found = view.matches(part.pattern)
    for m, after in zip(found, [*found[1:], None]):
        end = after.start() if after else len(view.text)
        if part.ends:
            stop = view.text.find(";", m.end(), end)
            end = end if stop < 0 else stop
        yield from _inside(part, s, view, m, m.end(), end)


def columns(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """Probes in a table's column list."""
    for m in view.matches(part.pattern):
        at = _GAP.match(view.text, m.end()).end()
        if view.text[at : at + 1] == "(":
            yield from _inside(part, s, view, m, at + 1, view.closing(at) - 1)


def calls(part: Part, s: Source, view: View) -> Iterator[Hit]:
    for m in view.matches(part.pattern):
        if m[0] not in CALLS_CONVERTED:
            yield m.start(), s.line(m.start()), m[0], view.text[m.start() : m.end()], part.message


def merge(part: Part, s: Source, view: View) -> Iterator[Hit]:
    for outer in view.matches(part.pattern):
        m = first(view.up[outer.start() : view.statement_end(outer.start())], part.probe)
        if m:
            at = outer.start() + m.start()
            yield at, s.line(at), s.enclosing(outer.start()), _snippet(part, view.text, m, outer.start()), part.message


def local_type(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """Types that aren't made by a CREATE, which the probe matches up to TYPE."""
    made = {m.end() for m in view.matches(rf"{part.probe}(?=TYPE\b)")}
    for m in view.matches(part.pattern):
        if m.start() not in made:
            yield m.start(), s.line(m.start()), s.enclosing(m.start()), _snippet(part, view.text, m), part.message


def text_call(part: Part, s: Source, view: View) -> Iterator[Hit]:
    for m in view.matches(part.pattern):
        behind = view.closing(m.end() - 1)
        if _SCORED.match(view.text, behind, min(behind + NEAR, len(view.text))):
            yield m.start(), s.line(m.start()), s.enclosing(m.start()), _snippet(part, view.text, m), part.message


def package_state(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """Declarations between a package's IS and its first routine; bodies first, then specifications."""
    found, heads = view.matches(PACKAGE), view.matches(_HEAD)
    head_at, members, routines = [h.start() for h in heads], [m.start() for m in view.matches(_MEMBER)], [r[0] for r in s.routines]
    for body in (True, False):
        for m, after in zip(found, [*found[1:], None]):
            end = after.start() if after else len(view.text)
            k = bisect_left(head_at, m.end())
            if bool(_BODY.search(m[0])) != body or k == len(heads) or heads[k].end() > end:
                continue
            start, stops = heads[k].end(), routines if body else members
            k = bisect_left(stops, start)
            end = min(end, stops[k]) if k < len(stops) else end
            for x in matches(view.up[start:end], STATE):
                at = start + x.start()
                yield at, s.line(at), f"{m[1]}.{x[1]}", _one_space(view.text[at : start + x.end()]), part.message


def generated(part: Part, s: Source, view: View) -> Iterator[Hit]:
    """LEVEL in the body of a recursive expression, named by the routine that it stands in."""
    made = matches(view.up, rf"CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+({ID})")
    made_at = [m.start() for m in made]
    for w in matches(view.up, rf"\bWITH\s+RECURSIVE\s+({ID})\s+AS\s*\("):
        start, k = w.end() - 1, bisect_right(made_at, w.start())
        m = first(view.up[start : view.closing(start)], _LEVEL)
        if m:
            at = start + m.start()
            yield at, s.line(at), (made[k - 1] if k else w)[1], view.text[at : start + m.end()].strip(" "), part.message


SHAPES: dict[str, Callable[[Part, Source, View], Iterator[Hit]]] = {f.__name__: f for f in (scan, declare, statement, columns, calls, merge, local_type, text_call, package_state, generated)}


def _structured(spec: Spec, s: Source) -> Iterator[Hit]:
    found = {"autonomous_tx": blocks.autonomous, "nested_subprogram": blocks.nested, "recursive_with": blocks.recursive}[spec.name]
    for at, name, snippet in found(s):
        yield at, s.line(at), name or s.enclosing(at), snippet, 0


def hits(spec: Spec, s: Source) -> Iterator[Hit]:
    """The hits of a detector in a source, part by part."""
    for part in spec.parts:
        if part.shape in ("blocks", "chains"):
            yield from _structured(spec, s)
        else:
            yield from SHAPES[part.shape](part, s, getattr(s, part.view))


_NEEDS = {"autonomous_tx": ("AUTONOMOUS_TRANSACTION",), "nested_subprogram": ("BEGIN",), "recursive_with": ("UNION",), "package_state": ("PACKAGE",), "database_link": ("@",)}


def begins(spec: Spec) -> tuple[str, ...]:
    """Words one of which is in every text with a hit, or none where there is no such list."""
    words = [starting(p.pattern) for p in spec.parts]
    return _NEEDS.get(spec.name) or (tuple(w for ws in words for w in ws) if all(words) else ())
