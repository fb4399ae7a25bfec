"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A conversation is a transcript: the lines of its rows, in turn order.  Each line is in one of
six states: the first line, or a later one, of a turn by system, user or assistant.  A line is
seen through its features: whether it opens a row, its length class, whether it ends in a
question mark or opens a list or code, and its speaker marker.  A plain marker is a name and a
colon ("User:", "A:", "**Bot:**"), which ordinary text has too: how often later lines of a turn
have one is counted, so where that is usual a marker inside a text stays text.  A tagged marker
("<|assistant|>", "### Bot", "[User]"), or the row's own role column, under any of the usual
names, is right with 1 - MARKER_WRONG.  Transition, feature and marker probabilities are counts
over all rows of known role in the whole table, mixed with even ones by EVEN and MOVES_EVEN; how
turns begin inside a text, which such rows don't show, is set by OPENS and MARKED.  Viterbi gives the states; a run of
lines from one first line to the next is a turn, rendered as <|role|>, a line end, its text and
<|end|>.  A marker goes only where Viterbi begins a turn of its role, and blank lines inside a
turn stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import cut
from .tables import load, pick

ROLES = ["system", "user", "assistant"]
_NAMES = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "prompter": 1, "customer": 1, "q": 1, "question": 1, "assistant": 2, "bot": 2, "ai": 2, "gpt": 2, "model": 2, "chatbot": 2, "agent": 2, "a": 2, "answer": 2}
_MARK = regex.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*(?P<a>\p{L}+)(?:\|>)?|\#{1,4}\s*(?P<b>\p{L}+)\s*:?\s*$|\[(?P<c>\p{L}+)\]:?|(?:\*\*)?(?P<d>\p{L}+)(?:\*\*)?\s*:(?:\*\*)?)\s*", regex.I)
_END = regex.compile(r"\s*<\|(?:im_end|end|eot_id|endoftext)\|>\s*$", regex.I)
MARKER_WRONG, EVEN, MOVES_EVEN = 1e-9, 1e-3, 2e-2
#: The probability that a first line opens a row, that a later one does, and that a first line has its role's plain marker.
OPENS, LATER_OPENS, MARKED = 0.95, 0.02, 0.5
#: Plain markers of later lines: so many are supposed in so many lines before counting.
PLAIN_BEFORE, LINES_BEFORE = 0.001, 1000
BLOCK_LINES = 200_000
SHAPES = 9
SCHEMA = "conv_id long, n_turns long, roles array<string>, text string"
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("roles", pa.list_(pa.string())), ("text", pa.string())])


def role_number(name: str | None) -> int:
    return _NAMES.get((name or "").strip().lower(), -1)


@dataclass
class Line:
    """tag and plain: the role of a tagged or plain marker, or -1; raw: the line; bare: without its marker; gap: blank lines before it in its row; opens: it is its row's first."""

    tag: int
    plain: int
    raw: str
    bare: str
    gap: int
    opens: bool


def lines_of(text: str) -> list[Line]:
    """The lines of a text that aren't blank; a marker alone on its line belongs to the next one, unless that has its own."""
    out: list[Line] = []
    gap, header = 0, False
    for line in regex.split(r"\r\n?|\n", text):
        if not line.strip():
            gap += 1
            continue
        m, tag, plain = _MARK.match(line), -1, -1
        if m:
            role = role_number(m["a"] or m["b"] or m["c"] or m["d"])
            tag, plain = (-1, role) if m["d"] else (role, -1)
        raw = _END.sub("", line).rstrip()
        marked = tag >= 0 or plain >= 0
        bare = _END.sub("", line[m.end() :]).rstrip() if marked else raw
        if header and not marked:
            out[-1].raw, out[-1].bare = out[-1].raw + "\n" * (gap + 1) + raw, raw
        else:
            out.append(Line(tag, plain, raw, bare, gap if out else 0, not out))
        gap, header = 0, marked and not bare
    return out


def shape(line: str) -> int:
    """Number of a line's shape: length class, and end or opening, below SHAPES."""
    size = min(2, len(line) // 120)
    kind = 2 if line.lstrip()[:3] in ("```", "1. ") or line.lstrip()[:2] in ("- ", "* ") else int(line.rstrip()[-1:] == "?")
    return size * 3 + kind


@dataclass
class Model:
    """Log probabilities of the first state, of state pairs, and of shapes by state, and the share of later lines with a plain marker; states 2r and 2r + 1 start and go on with a turn of role r."""

    start: np.ndarray
    move: np.ndarray
    shapes: np.ndarray
    plain: float = PLAIN_BEFORE / LINES_BEFORE

    def emissions(self, lines: list[Line], roles: list[int]) -> np.ndarray:
        """roles: each line's role by its row or -1; a tagged marker overrules it."""
        e = self.shapes[:, [shape(x.bare) for x in lines]].T.copy()
        opens = np.array([x.opens for x in lines])
        e[:, ::2] += np.log(np.where(opens, OPENS, 1 - OPENS))[:, None]
        e[:, 1::2] += np.log(np.where(opens, LATER_OPENS, 1 - LATER_OPENS))[:, None]
        plain = np.array([x.plain for x in lines])
        e[:, ::2] += np.log(np.where(plain[:, None] < 0, 1 - MARKED, np.where(plain[:, None] == np.arange(3), MARKED, MARKED * self.plain / 3)))
        e[:, 1::2] += np.log(np.where(plain < 0, 1 - self.plain, self.plain / 3))[:, None]
        told = np.array([x.tag if x.tag >= 0 else r for x, r in zip(lines, roles)])
        for r in range(3):
            m = told == r
            e[m] += np.log(MARKER_WRONG / 5)
            e[m, 2 * r] += np.log1p(-MARKER_WRONG) - np.log(MARKER_WRONG / 5)
        return e


def viterbi(e: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Best states of the chains e[off[i]:off[i + 1]], all chains at once; ties go to the lower state."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    first, length = off[:-1][order], n[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    back, score, state = np.zeros(e.shape, dtype=np.int8), np.zeros((len(first), 6)), np.zeros(len(e), dtype=np.int8)
    for i, m in enumerate(active):
        at = first[:m] + i
        if i:
            both = score[:m, :, None] + model.move
            back[at] = both.argmax(axis=1)
            score[:m] = both.max(axis=1) + e[at]
        else:
            score[:m] = model.start + e[at]
    last = score.argmax(axis=1)
    for i in range(longest - 1, -1, -1):
        m = active[i]
        at = first[:m] + i
        ends = length[:m] == i + 1
        state[at] = np.where(ends, last[:m], 0)
        if (~ends).any():
            going = at[~ends]
            state[going] = back[going + 1, state[going + 1]]
    return state


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start, move, shapes, later = np.zeros(6), np.zeros((6, 6)), np.zeros((6, SHAPES)), np.zeros(2)
    for b in batches:
        for turns in b.column("turns").to_pylist():
            before = -1
            for t in turns:
                r = role_number(t["role"])
                for x in lines_of(t["text"] or ""):
                    if r < 0:
                        before = -1
                        continue
                    s = 2 * r + (not x.opens)
                    shapes[s, shape(x.bare)] += 1
                    if not x.opens:
                        later += (1, x.plain >= 0)
                    if before >= 0:
                        move[before, s] += 1
                    elif t is turns[0] and x.opens:
                        start[s] += 1
                    before = s
    flat = np.concatenate([start, move.ravel(), shapes.ravel(), later]).astype(np.int64)
    some = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some])], names=["k", "n"])


def _conversations(rows: DataFrame) -> DataFrame:
    rows = pick(rows, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text"))).alias("turns"))


def fit(rows: DataFrame) -> Model:
    """The model of a table, from counts over all its rows of known role; the usual one where it has none."""
    return _fit(_conversations(rows))


def _fit(conversations: DataFrame) -> Model:
    got = conversations.mapInArrow(_counts, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(6 + 36 + 6 * SHAPES + 2)
    for r in got:
        flat[r["k"]] = r["n"]

    start, move, shapes, later = flat[:6], flat[6:42].reshape(6, 6), flat[42:-2].reshape(6, SHAPES), flat[-2:]
    # one count of what is usual in each distribution, which decides where the table has none
    start += np.array([0.3, 0, 0.6, 0, 0.1, 0])
    for r in range(3):
        for state in (2 * r, 2 * r + 1):
            move[state, 2 * r + 1] += 0.6
            move[state, 2 if r != 1 else 4] += 0.4
            shapes[state] += 1 / SHAPES

    def log(x: np.ndarray, even: float = EVEN) -> np.ndarray:
        return np.log((1 - even) * x / x.sum(axis=-1, keepdims=True) + even / x.shape[-1])

    return Model(log(start), log(move, MOVES_EVEN), log(shapes), float((later[1] + PLAIN_BEFORE) / (later[0] + LINES_BEFORE)))


def turns_of(lines: list[Line], states: np.ndarray) -> list[tuple[int, str]]:
    """(role, text) of each turn: a state of a first line, or of another role, begins one."""
    out: list[tuple[int, list[str]]] = []
    for s, x in zip(states.tolist(), lines):
        r, new = s // 2, s % 2 == 0 or not out or out[-1][0] != s // 2
        if new:
            out.append((r, []))
        else:
            out[-1][1].extend([""] * x.gap)
        out[-1][1].append(x.bare if new and r == (x.tag if x.tag >= 0 else x.plain) else x.raw)
    return [(r, "\n".join(t).strip("\n")) for r, t in out]


def _render(model: Model):
    def solve(group: list[tuple[int, list[Line], list[int]]]) -> pa.RecordBatch:
        off = np.cumsum([0, *(len(g[1]) for g in group)])
        flat = [x for g in group for x in g[1]]
        states = viterbi(model.emissions(flat, [r for g in group for r in g[2]]), off, model) if flat else np.zeros(0, np.int8)
        turns = [turns_of(g[1], states[off[i] : off[i + 1]]) for i, g in enumerate(group)]
        texts = ["\n".join(f"<|{ROLES[r]}|>\n{t}\n<|end|>" for r, t in c) for c in turns]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([len(c) for c in turns], pa.int64()), pa.array([[ROLES[r] for r, _ in c] for c in turns], pa.list_(pa.string())), pa.array(texts, pa.string())], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for b in batches:
            for cid, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                lines, roles = [], []
                for t in turns:
                    own = lines_of(t["text"] or "")
                    lines += own
                    roles += [role_number(t["role"]) if x.opens else -1 for x in own]
                group.append((cid, lines, roles))
                size += len(lines)
                if size >= BLOCK_LINES:
                    yield solve(group)
                    group, size = [], 0
        if group:
            yield solve(group)

    return run


def format_chats(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, the recovered roles, and the canonical text.

    rows has conv_id, turn, role and text; other columns are ignored.  Rows are taken in order
    of turn (null last), role and text; a repeated row is a repeated turn.  A null or unknown
    role is recovered from the lines; markers inside a text that begin a turn split it and are
    taken out.  A tagged marker overrules its row's role, and a row's role a plain marker.
    Blank lines inside a turn stay, those around it go; null or empty texts add no turn, and a
    conversation without any line has no turn and an empty text.  Rows without a conv_id are
    left out, and an empty table gives no rows.  A conversation is one row of the result, so
    it has to fit into a task.
    """
    conversations = _conversations(rows)
    if model is None:
        conversations = cut(conversations)
        model = _fit(conversations)
    return conversations.mapInArrow(_render(model), SCHEMA)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))


QUERIES = {"op8_chat_format": (op8_chat_format, None)}
