import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.phrases import named, phrase
from quillspark.operators import scan


def views(spark, *texts):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    got = scan.with_views(spark.createDataFrame(rows, "source_file string, source string")).collect()
    return [(r["clean"], r["visible"], r["idx"]) for r in sorted(got, key=lambda r: int(r["source_file"]))]


def _mask(text: str) -> str:
    """The same masking, one character after another."""
    out, i, n = [], 0, len(text)
    pairs = {"[": "]", "{": "}", "(": ")", "<": ">"}
    while i < n:
        j = None
        if text.startswith("--", i) or (re.match(r"(?i)rem(ark)?(?=[ \t\r\n]|\Z)", text[i:]) and not text[text.rfind("\n", 0, i) + 1 : i].strip(" \t")):
            j = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2) + 2 or n
            j = n if j == 1 else j
        elif (m := re.match(r"(?is)n?q'(.)", text[i:])) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            end = text.find(pairs.get(m[1], m[1]) + "'", i + m.end())
            j = end + 2 if end >= 0 else None
        if j is None and text[i] == "'":
            j = text.find("'", i + 1) + 1 or n
        if j is None:
            out.append(text[i])
            i += 1
        else:
            out.append(re.sub(r"[^\n]", " ", text[i:j]))
            i = j
    return "".join(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "''", "q'[", "]'", "nq'!", "!'", "--", "\n", "/*", "*/", "REM", "REMARK", " ", "a", "_q'(", ")'", ";", "é", '"']), max_size=14).map("".join), min_size=40, max_size=40))
def test_mask_against_a_walk(spark, texts):
    for text, (clean, visible, _) in zip(texts, views(spark, *texts)):
        assert clean == _mask(text)
        assert visible == clean


@pytest.mark.parametrize("text, clean", [("q'[it's READ ONLY]'x", "                   x"), ("'a''b'c", "      c"), ("remx := 1", "remx := 1"), (" REM x\ny", "      \ny"), ("/* a\nb", "    \n "), ("q'x", "q  "), ("a--b\r\nc", "a   \nc")])
def test_mask(spark, text, clean):
    assert views(spark, text)[0][0] == clean


def test_dynamic_sql(spark):
    text = "x := 'a'; EXECUTE IMMEDIATE 'SELECT ''b;'' /* c */' -- d\n || q'[e;]'; y := 'f';"
    assert views(spark, text)[0][1] == "x :=    ; EXECUTE IMMEDIATE 'SELECT ''b;'' /* c */'     \n || q'[e;]'; y :=    ;"


def test_index_and_grants(spark):
    idx = views(spark, "GRANT CREATE VIEW TO u;\nCREATE OR REPLACE FORCE VIEW s.v AS SELECT 1/2 FROM d;\nCREATE PACKAGE p IS\nFUNCTION f RETURN NUMBER;\nEND;\n/\nCREATE TRIGGER \"T\" x")[0][2]
    assert [(x["kind"], x["name"]) for x in idx] == [("view", "V"), ("package", "P"), ("nested_routine", "F"), ("trigger", "T")]


def test_phrases():
    assert phrase("A [B|C D] {E|F} G") == r"A\s+(?:(?:B|C\s+D)\s+)?(E|F)\s+G"
    assert re.search(named("PACKAGE [BODY]"), "PACKAGE BODY X.Y")[1] == "Y"
