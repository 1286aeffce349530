"""Chat formatting: turns of a transcript by a hidden Markov model over its lines, then canonical rendering.

A transcript is a conversation's text as plain lines, where a turn may or may not begin with a speaker marker ("User:", "###
Assistant", "Q:"). States are a role's first line and a role's further lines; an observation is a line's marker and other line
features. Only a first line can change the role, so the decoded states cut the transcript into turns. Counts over labelled
lines give the model. Viterbi runs over range-sorted partitions, so a conversation of any length is spread out: each task sums
up the conversation pieces at its two ends as matrices of best scores, the driver chains these (two a task), and each task then
decodes its rows with the known scores before and after them.

Null texts are empty: one empty line. Null turns come first, equal turns are ordered by text; lines of a message that is
repeated as a whole alternate. Rows with a null conv_id form one conversation. An empty table gives no rows. Roles other than
the three of ROLES aren't learnt and can't be found. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: its first line; 2 * role + 1: its further lines
#: Words that mark a speaker.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "q", "question"), "assistant": ("assistant", "ai", "bot", "a", "answer")}
_WORD = "|".join(sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:(?:#+\s*|<\|?|\[)?({_WORD})\s*(?:\|?>|\]|:|-)|#+\s*({_WORD})\s*$)\s*", re.I)
KIND = {w: k + 1 for k, ws in enumerate(MARKERS.values()) for w in ws}
SIZES = (4, 3, 6, 2)  # values of each feature
CHUNK = 4096
END = "<|end|>\n"


def split_marker(text: str) -> tuple[int, str]:
    """Kind of the leading marker (0: none, else 1 + role) and the text behind it."""
    m = MARKER.match(text)
    return (KIND[(m[1] or m[2]).lower()], text[m.end() :]) if m else (0, text)


def observe(text: str) -> tuple[int, ...]:
    """Marker kind, last mark (. ? other), length class, begins with a capital letter."""
    kind, body = split_marker(text)
    last = body.rstrip()[-1:]
    return kind, 0 if last == "." else 1 if last == "?" else 2, min(5, (len(body).bit_length() + 1) // 2), int(body[:1].isupper())


class Model:
    """Log probabilities: first (STATES), step (STATES, STATES), and one table per feature."""

    def __init__(self, first: np.ndarray, step: np.ndarray, tables: list[np.ndarray]) -> None:
        log = lambda c: np.log((c + 0.5) / (c + 0.5).sum(-1, keepdims=True))
        self.first, self.step, self.tables = log(first), log(step), [log(t) for t in tables]
        state = np.arange(STATES)
        self.first[state % 2 == 1] = -np.inf
        self.step[(state[None] % 2 == 1) & (state[:, None] // 2 != state[None] // 2)] = -np.inf

    def emission(self, texts: list[str]) -> np.ndarray:
        seen = np.array([observe(t) for t in texts], np.int64).reshape(-1, len(SIZES))
        return sum(t[:, seen[:, k]].T for k, t in enumerate(self.tables))


def lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """conv_id, turn, line, text and ``columns``, one row per line in the transcript's order, dealt by ranges and fixed in the
    checkpoint folder. turn and line only give the order; decode() doesn't look at them."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)
    rows = rows.select("conv_id", "turn", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line", "text"), *columns)
    key = ["conv_id", "turn", "h", "line"]
    return cut(rows.repartitionByRange(shuffle_partitions(df.sparkSession), *key).sortWithinPartitions(*key).select("conv_id", "turn", "line", "text", *columns))


def fit(ordered: DataFrame) -> Model:
    """Counts from lines(df, ["role"]) of known roles: one small row per task. The driver joins the tasks' ends, so the model
    doesn't depend on how the lines are dealt."""
    ends = np.cumsum([STATES, STATES * STATES] + [STATES * n for n in SIZES])

    def count(batches):
        first, step, tables = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, n)) for n in SIZES]
        lead = before = None
        for b in batches:
            for conv, line, text, role in zip(*(b.column(c).to_pylist() for c in ("conv_id", "line", "text", "role"))):
                state = 2 * ROLES.index(role) + (line > 0) if role in ROLES else -1
                if state >= 0:
                    for t, v in zip(tables, observe(text)):
                        t[state, v] += 1
                if before is None:
                    lead = (conv, state)
                else:
                    pair(first, step, before, (conv, state))
                before = (conv, state)
        if before is not None:
            flat = np.concatenate([first, step.ravel(), *[t.ravel() for t in tables]])
            columns = [[TaskContext.get().partitionId()], [flat.tolist()], *([x] for x in (*lead, *before))]
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pid", "n", "c0", "s0", "c1", "s1"])

    def pair(first, step, before, now):
        if before is None or before[0] != now[0]:
            first[now[1]] += now[1] >= 0
        elif before[1] >= 0 and now[1] >= 0:
            step[before[1], now[1]] += 1

    rows = sorted(ordered.mapInArrow(count, "pid int, n array<double>, c0 long, s0 int, c1 long, s1 int").collect(), key=lambda r: r["pid"])
    flat = np.sum([np.zeros(ends[-1]), *[r["n"] for r in rows]], axis=0)
    first, step = flat[:STATES], flat[STATES : ends[1]].reshape(STATES, STATES)
    before = None
    for r in rows:
        pair(first, step, before, (r["c0"], r["s0"]))
        before = (r["c1"], r["s1"])
    return Model(first, step, [flat[a:z].reshape(STATES, -1) for a, z in zip(ends[1:], ends[2:])])


def _chunks(batches):
    """Lists (new, rows) of one conversation's rows, cut at CHUNK rows; new: it didn't begin in an earlier chunk."""
    rows, new = [], True
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if rows and (row[0] != rows[-1][0] or len(rows) == CHUNK):
                yield new, rows
                new, rows = row[0] != rows[-1][0], []
            rows.append(row)
    if rows:
        yield new, rows


class Piece:
    """What a task holds of a conversation: the best scores from each state before it to each at its end, and, if the
    conversation begins here, to each at its end. The latest rows wait, as most pieces are never asked for."""

    def __init__(self, model: Model, conv: int | None) -> None:
        self.model, self.conv, self.rows = model, conv, []
        self.matrix = self.scores = None

    def add(self, rows: list[tuple]) -> None:
        self.fold()
        self.rows = rows

    def fold(self) -> None:
        for e in self.model.emission([r[3] for r in self.rows]) if self.rows else ():
            step = self.model.step + e
            if self.matrix is None:
                self.matrix, self.scores = step, self.model.first + e
            else:
                self.matrix = (self.matrix[:, :, None] + step[None]).max(1)
                self.scores = (self.scores[:, None] + step).max(0)
        self.rows = []


def decode(ordered: DataFrame, model: Model, carried: str) -> DataFrame:
    """conv_id, turn, line, ``carried``, role, begins (a turn), marked, body, rendered, for rows of lines(df, [carried]).

    The ``rendered`` values of a conversation, one after the other, are its canonical transcript.
    """
    spark = ordered.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def ends(batches):
        """One row for each of the task's first and last conversation piece."""
        held: list[Piece] = []
        for new, rows in _chunks(batches):
            if new:
                del held[1:]
                held.append(Piece(shared.value, rows[0][0]))
            held[-1].add(rows)
        for k, p in enumerate(held):
            p.fold()
            columns = ([TaskContext.get().partitionId()], [k], [p.conv], [p.matrix.ravel().tolist()], [p.scores.tolist()])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pid", "k", "conv", "m", "scores"])

    schema = "pid int, k long, conv long, m array<double>, scores array<double>"
    pieces = sorted(ordered.select("conv_id", "turn", "line", "text").mapInArrow(ends, schema).collect(), key=lambda r: (r["pid"], r["k"]))
    before: dict[tuple[int, int], np.ndarray] = {}  # scores of the states before a piece that goes on from an earlier task
    after: dict[tuple[int, int], np.ndarray] = {}  # best score of what follows a piece in later tasks, by its last state
    matrix = lambda r: np.array(r["m"]).reshape(STATES, STATES)
    for p, r in zip(pieces, pieces[1:]):
        if p["conv"] == r["conv"] and p["pid"] != r["pid"]:
            at = (p["pid"], p["k"])
            before[r["pid"], r["k"]] = (before[at][:, None] + matrix(p)).max(0) if at in before else np.array(p["scores"])
    for p, r in reversed(list(zip(pieces, pieces[1:]))):
        if (r["pid"], r["k"]) in before:
            after[p["pid"], p["k"]] = (matrix(r) + after.get((r["pid"], r["k"]), np.zeros(STATES))).max(1)
    plan = spark.sparkContext.broadcast((before, after))

    def run(batches):
        before, after = plan.value
        model, pid = shared.value, TaskContext.get().partitionId()
        for k, (last, rows) in enumerate(_whole(_chunks(batches))):
            lead, tail = before.get((pid, 0)) if k == 0 else None, after.get((pid, min(k, 1))) if last else None
            state = viterbi(model, model.emission([r[3] for r in rows]), lead, tail)
            split = [split_marker(r[3]) for r in rows]
            begins, body = state % 2 == 0, [b.strip() for _, b in split]
            shown = []
            for i, (s, (kind, _), text) in enumerate(zip(state.tolist(), split, body)):
                close = END if begins[i] and (i or lead is not None) else ""
                head = f"<|{ROLES[s // 2]}|>\n" if begins[i] else ""
                shown.append(close + head + (text + "\n" if text or not kind else ""))
            if tail is None:
                shown[-1] += END
            columns = [[r[i] for r in rows] for i in (0, 1, 2, 4)] + [[ROLES[s // 2] for s in state], begins.tolist(), [kind > 0 for kind, _ in split], body, shown]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
            names = ["conv_id", "turn", "line", carried, "role", "begins", "marked", "body", "rendered"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    out = f"conv_id long, turn long, line int, {carried} string, role string, begins boolean, marked boolean, body string, rendered string"
    return ordered.select("conv_id", "turn", "line", "text", carried).mapInArrow(run, out)


def _whole(chunks):
    """(is the task's last, rows) per conversation piece of a task."""
    held = None
    for new, rows in chunks:
        if held is not None and not new:
            held.extend(rows)
            continue
        if held is not None:
            yield False, held
        held = list(rows)
    if held is not None:
        yield True, held


def viterbi(model: Model, emission: np.ndarray, lead: np.ndarray | None = None, tail: np.ndarray | None = None) -> np.ndarray:
    """Best states. lead: scores of the states before the rows (none: they begin a conversation); tail: by state, of what follows."""
    n = len(emission)
    back = np.zeros((n, STATES), np.int8)
    score = model.first + emission[0] if lead is None else (lead[:, None] + model.step).max(0) + emission[0]
    for k in range(1, n):
        path = score[:, None] + model.step
        back[k] = path.argmax(0)
        score = path.max(0) + emission[k]
    out = np.zeros(n, np.int64)
    out[-1] = int((score + (0 if tail is None else tail)).argmax())
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out
