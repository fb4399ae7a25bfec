"""Lexical operators on source texts.

Source is one text with its masked views, its lines and the index of its objects, each made
at most once and in time linear in the text; it runs inside Arrow batches.  Patterns are
matched on an upper-cased view of the same length, so keywords are found by plain substring
search and only their places are looked at by a regular expression.

Offsets count characters from 0, lines from 1.  Masked views have the length and the line
ends of the source, so an offset means the same place in all of them.  The columns at the end
are native.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import ID, named, phrase, words

_QUOTED = "|".join(rf"{a}.*?{b}'" for a, b in ((r"\[", r"\]"), (r"\{", r"\}"), (r"\(", r"\)"), ("<", ">")))
_REMARK = "[rR][eE][mM](?:[aA][rR][kK])?"
_ATOM = re.compile(rf"(?s)--[^\n]*|(?m:^)[ \t]*{_REMARK}(?=[ \t\r\n]|\Z)[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>(?<!\w)[nN]?[qQ]'(?:{_QUOTED}|([^\[{{(<]).*?\2')|'[^']*+'?)")
_MAY_HOLD_ATOM = ("--", "/*", "'")
_DYNAMIC = re.compile(r"\bEXECUTE\s+IMMEDIATE\b")
_NAME_QUOTED = re.compile('"[^"]*"')
_INK = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()]")
_GRANT = re.compile(r"\s*(?:GRANT|REVOKE)\b")
_ROUTINE = re.compile(rf"(?:FUNCTION|PROCEDURE)\s+({ID})")
_MAKE, _EDITION = "CREATE [OR REPLACE]", "[EDITIONABLE|NONEDITIONABLE]"
PACKAGE = named(f"{_MAKE} {_EDITION} PACKAGE [BODY]")
PACKAGE_BODY = named(f"{_MAKE} {_EDITION} PACKAGE BODY")
PACKAGE_SPEC = phrase(f"{_MAKE} {_EDITION}") + named(r"PACKAGE(?!\s+BODY\b)")
STANDALONE = phrase(f"{_MAKE} {{FUNCTION|PROCEDURE}}").replace("(FUNCTION", "(?:FUNCTION") + rf"\s+({ID})"
TRIGGER = named(f"{_MAKE} {_EDITION} TRIGGER")
VIEW = named(f"{_MAKE} [FORCE|NOFORCE] {_EDITION} [MATERIALIZED] VIEW")
KINDS = ((PACKAGE_BODY, "package"), (PACKAGE_SPEC, "package"), (None, "nested_routine"), (STANDALONE, "standalone_routine"), (TRIGGER, "trigger"), (VIEW, "view"))
INDEX = "array<struct<pos:int,kind:string,name:string>>"
UNKNOWN = "UNKNOWN"


def fold(text: str) -> str:
    """The text in upper case, character for character."""
    up = text.upper() if text.isascii() else text.lower().upper()
    if len(up) == len(text):
        return up
    table = {ord(c): u for c in set(text) if len(u := c.lower().upper()) == 1 and u != c}
    return text.translate(table)


def blanked(text: str) -> str:
    return _INK.sub(" ", text) if "\n" in text else " " * len(text)


def without(text: str, spans: Iterator[tuple[int, int]] | list[tuple[int, int]]) -> str:
    """The text with rising spans blanked, line ends kept."""
    out, at = [], 0
    for s, e in spans:
        out += (text[at:s], blanked(text[s:e]))
        at = e
    return "".join((*out, text[at:])) if out else text


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> tuple[re.Pattern, tuple[str, ...]]:
    """A pattern and the plain words one of which its matches begin with; () where there are none."""
    lead = re.match(r"(?:\\b|\(\?<!(?:\[[^\]]*\]|[^)\[])*\))*", pattern).end()
    some = re.match(r"\((?:\?:)?([A-Z_|]+)\)(?![?*])", pattern[lead:])
    plain = re.match(r"(\\\$)?([A-Z_]*)(?![A-Z_?*{])", pattern[lead:])
    if some:
        found = tuple(some[1].split("|"))
    else:
        found = tuple(filter(None, [("$" if plain[1] else "") + plain[2]])) if plain else ()
    return re.compile(pattern), found


def starting(pattern: str) -> tuple[str, ...]:
    """The plain words one of which every match of a pattern begins with; () where there are none."""
    return _compiled(pattern)[1]


def places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def matches(folded: str, pattern: str) -> list[re.Match]:
    """All matches, left to right without overlap."""
    compiled, begins = _compiled(pattern)
    if not begins:
        return list(compiled.finditer(folded)) if "@" not in pattern or "@" in folded else []
    starts = list(places(folded, begins[0])) if len(begins) == 1 else sorted(p for w in begins for p in places(folded, w))
    out, end = [], 0
    for at in starts:
        if at >= end and (m := compiled.match(folded, at)):
            out.append(m)
            end = max(m.end(), at + 1)
    return out


def first(folded: str, pattern: str) -> re.Match | None:
    """The first match in a short text."""
    return _compiled(pattern)[0].search(folded)


class View:
    """A view of a source, and the same in upper case."""

    def __init__(self, text: str):
        self.text = text
        self._found: dict[str, list[re.Match]] = {}

    @cached_property
    def up(self) -> str:
        return fold(self.text)

    def matches(self, pattern: str) -> list[re.Match]:
        """All matches in upper case, left to right without overlap; kept, as detectors share patterns."""
        have = self._found.get(pattern)
        if have is None:
            have = self._found[pattern] = matches(self.up, pattern)
        return have

    @cached_property
    def _closes(self) -> dict[int, int]:
        open_, out = [], {}
        for m in _BRACKET.finditer(self.text):
            if m[0] == "(":
                open_.append(m.start())
            elif open_:
                out[open_.pop()] = m.end()
        return out

    def closing(self, at: int) -> int:
        """The offset behind the parenthesis that closes the one at `at`, or the text's end."""
        return self._closes.get(at, len(self.text))

    def statement_end(self, at: int) -> int:
        """The offset of the next semicolon, or the text's end."""
        end = self.text.find(";", at)
        return len(self.text) if end < 0 else end


class Source:
    """One text: line ends become \\n; null is empty."""

    def __init__(self, text: str | None):
        self.text = (text or "").replace("\r\n", "\n").replace("\r", "\n")

    @cached_property
    def _atoms(self) -> list[re.Match]:
        some = any(x in self.text for x in _MAY_HOLD_ATOM) or "REM" in fold(self.text)
        return list(_ATOM.finditer(self.text)) if some else []

    @cached_property
    def clean(self) -> View:
        """Without comments and literals."""
        return View(without(self.text, [m.span() for m in self._atoms])) if self._atoms else View(self.text)

    @cached_property
    def visible(self) -> View:
        """Without comments, and without literals but those of EXECUTE IMMEDIATE statements, up to the next semicolon outside literals."""
        clean = self.clean.text
        if not self._atoms or "IMMEDIATE" not in self.clean.up:
            return self.clean
        up, spans, end = self.clean.up, [], 0
        atoms = [m.start() for m in self._atoms]
        for m in _DYNAMIC.finditer(up):
            between = bisect_left(atoms, m.start())
            if m.start() >= end and not (between < len(atoms) and atoms[between] < m.end()):
                end = self.clean.statement_end(m.end())
                spans.append((m.end(), end))
        if not spans:
            return self.clean
        out, at = [], 0
        for s, e in spans:
            out.append(clean[at:s])
            at = s
            for k in range(bisect_left(atoms, s), bisect_left(atoms, e)):
                a = self._atoms[k]
                if a["text"] is not None:
                    stop = min(a.end(), e)
                    out += (clean[at : a.start()], self.text[a.start() : stop])
                    at = stop
        return View("".join((*out, clean[at:])))

    @cached_property
    def unquoted(self) -> View:
        """The visible view with double-quoted names blanked."""
        text = self.visible.text
        return View(without(text, [m.span() for m in _NAME_QUOTED.finditer(text)])) if '"' in text else self.visible

    @cached_property
    def _breaks(self) -> list[int]:
        return list(places(self.text, "\n"))

    def line(self, pos: int) -> int:
        return bisect_left(self._breaks, pos) + 1

    def granted(self, pos: int) -> bool:
        """Whether the statement around an offset, back to the last ; or /, begins with GRANT or REVOKE."""
        text = self.clean.text
        start = max(text.rfind(";", 0, pos), text.rfind("/", 0, pos)) + 1
        return _GRANT.match(self.clean.up, start, pos) is not None

    @cached_property
    def routines(self) -> list[tuple[int, int, str]]:
        """(start, end of the name, name) of FUNCTION and PROCEDURE at the beginning of a line; start is the first line's of the blank lines before."""
        up, out, end = self.clean.up, [], 0
        for at in sorted((*places(up, "FUNCTION"), *places(up, "PROCEDURE"))):
            if at < end or not (m := _ROUTINE.match(up, at)):
                continue
            ink = at
            while ink > end and up[ink - 1].isspace():
                ink -= 1
            start = 0 if not ink else up.find("\n", ink, at) + 1
            if start or not ink:
                end = m.end()
                out.append((start, end, m[1]))
        return out

    @cached_property
    def index(self) -> list[tuple[int, str, str]]:
        """(offset, kind, name) of packages, routines, triggers and views, by place."""
        found, careful = [], "GRANT" in self.clean.up or "REVOKE" in self.clean.up
        for order, (pattern, kind) in enumerate(KINDS):
            if pattern is None:
                found += [(start, order, kind, name) for start, _, name in self.routines]
            else:
                found += [(m.start(), order, kind, m[1]) for m in self.clean.matches(pattern) if not (careful and self.granted(m.start()))]
        return [(pos, kind, name) for pos, _, kind, name in sorted(found)]

    @cached_property
    def _owners(self) -> tuple[list[int], list[str]]:
        at, names, package = [], [UNKNOWN], None
        for pos, kind, name in self.index:
            if kind == "package":
                package = name
            elif kind != "nested_routine":
                package = None
            at.append(pos)
            names.append(f"{package}.{name}" if package and kind == "nested_routine" else name)
        return at, names

    def enclosing(self, pos: int) -> str:
        """As-of lookup: the name of the object that holds an offset, or UNKNOWN."""
        at, names = self._owners
        return names[bisect_right(at, pos)]


# --- native columns --------------------------------------------------------------------------------


def normalise(source: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(source, "\r\n?", "\n")


def breaks(text: Column) -> Column:
    """The number of line ends in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(text: Column, pos: Column) -> Column:
    return breaks(F.substr(text, F.lit(1), pos)) + 1


def object_count(index: Column) -> Column:
    return F.size(F.filter(index, lambda x: x["kind"] != "nested_routine"))


def has_connect_by(view: Column) -> Column:
    return view.rlike("(?i)" + words("CONNECT BY"))


def object_type(view: Column) -> Column:
    """The kind of object a file most likely holds."""
    tests = [("PACKAGE", words("PACKAGE BODY"))] + [(k, words(f"CREATE [OR REPLACE] {k}")) for k in ("TRIGGER", "PROCEDURE", "FUNCTION", "VIEW")]
    out = F.when(view.rlike("(?i)" + tests[0][1]), tests[0][0])
    for kind, pattern in tests[1:]:
        out = out.when(view.rlike("(?i)" + pattern), kind)
    return out.otherwise("PACKAGE")
