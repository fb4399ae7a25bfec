"""Keyword phrases as regular expressions on text in upper case.

A phrase is a run of words between which any white space may stand.  "[A|B C]" may be left
out, "{A|B C}" must be there and is captured.
"""

from __future__ import annotations

import re

ID = r"[A-Z_][A-Z0-9_$#]*"
_Q = '"?'
_GAP = r"\s+"


def _words(text: str) -> str:
    return "|".join(_GAP.join(option.split()) for option in text.split("|"))


def phrase(text: str) -> str:
    """The phrase without word borders or white space at its ends."""
    out, gap = "", False
    for part in re.findall(r"\[[^\]]*\]|\{[^}]*\}|\S+", text):
        if gap:
            out += _GAP
        if part[0] == "[":
            out, gap = out + f"(?:(?:{_words(part[1:-1])}){_GAP})?", False
        else:
            out, gap = out + (f"({_words(part[1:-1])})" if part[0] == "{" else part), True
    return out


def words(text: str) -> str:
    """The phrase as whole words."""
    return rf"\b{phrase(text)}\b"


def named(text: str) -> str:
    """The phrase and a name, with or without schema and quotes; the name's last part is captured."""
    lead = phrase(f"{text} @")[:-1]
    return lead + rf"(?:{_Q}{ID}{_Q}\.)?{_Q}({ID}){_Q}"
