"""Transcripts to chat turns with a hidden Markov model.

Each line of a transcript has a speaker marker or none, and line features (a blank line before it, a question mark at
its end, its length). The states are a role's first line and a role's further lines; the Viterbi path gives every line
its role, and runs of lines become turns, rendered in one canonical form. Probabilities are counts over a bounded sample
of labelled segments on top of prior counts.

A conversation is stored in segments of SEGMENT_TURNS turns, each a row, so that no conversation meets in one task. The
path is the best one of the whole conversation all the same: every segment is summed up by a matrix (best score from any
state before it to any state at its end), a tree of products of FAN matrices gives the scores that reach each segment
from both sides, and each segment is then decoded on its own.

Null and empty transcripts have no turns; lines before any marker go to the likeliest role; markers of unknown names
start a turn of the role that fits best; ties go to the earlier role of ROLES; repeated rows each get theirs; a turn
without number counts as number 0. Blank lines inside a turn stay, white space around it goes. Very long lines and
transcripts are read whole. An empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cleaned, tune, written

SEGMENT_TURNS, FAN = 512, 64
#: Turns of the segments that the model is counted on, about; and what the prior below is worth, in lines of each state.
FIT_TURNS, PRIOR = 50_000, 20.0
ROLES = ("system", "user", "assistant")
#: Names of speakers in transcripts.
NAMES = {
    "system": ("system", "sys", "instructions", "instruction", "context"),
    "user": ("user", "human", "q", "question", "customer", "me", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "chatbot", "agent"),
}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|__|\[|<\|?|>\s*)?(?P<name>[A-Za-z][A-Za-z0-9_ .-]{0,24}?)\s*(?:\*\*|__|\]|\|?>)?\s*(?P<sign>:|：|>>|\|>|\])(?:\*\*|__)?(?:\s+|$)")
MARKS = ("system", "user", "assistant", "other", "none")
LENGTHS = (40, 120, 300)
#: Prior: how likely each mark is in a role's first line, by role, and in further lines; then features and changes.
_FIRST = np.array([[0.80, 0.01, 0.01, 0.03, 0.15], [0.005, 0.82, 0.015, 0.06, 0.10], [0.005, 0.015, 0.82, 0.06, 0.10]])
_INSIDE = np.array([0.001, 0.001, 0.001, 0.02, 0.977])
_ASKS = {"system": 0.02, "user": 0.35, "assistant": 0.08}
_BLANK_FIRST, _BLANK_INSIDE = 0.5, 0.25
_STAY = 0.75
_START = {"system": 0.25, "user": 0.65, "assistant": 0.10}
_NEXT = {"system": (0.02, 0.88, 0.10), "user": (0.02, 0.13, 0.85), "assistant": (0.02, 0.86, 0.12)}
N, BEGIN = 2 * len(ROLES), 2 * len(ROLES)  # states: first lines by role, further lines by role; and what stands before all
_NEVER = -1e18
Model = tuple[np.ndarray, np.ndarray]


def marker(line: str) -> tuple[str, str]:
    """(kind of the marker, line without it). Unknown names count only where they are short and capital."""
    m = _MARKER.match(line)
    if not m:
        return "none", line
    name = m["name"].strip().lower()
    role = _ROLE_OF.get(name)
    if role:
        return role, line[m.end() :]
    if m["name"][:1].isupper() and len(name.split()) <= 2 and m["sign"] == ":":
        return "other", line
    return "none", line


def _prior() -> Model:
    """Probabilities: change (N + 1 x N, the last row for the first line), emission by mark, question, blank, length."""
    n = len(ROLES)
    change = np.full((N + 1, N), 1e-9)
    change[BEGIN, :n] = [_START[r] for r in ROLES]
    emit = np.zeros((N, len(MARKS), 2, 2, len(LENGTHS) + 1))
    for i, r in enumerate(ROLES):
        for row in (i, n + i):
            change[row, n + i] = _STAY
            change[row, :n] = (1 - _STAY) * np.array(_NEXT[r])
        for part, marks, blank in ((i, _FIRST[i], _BLANK_FIRST), (n + i, _INSIDE, _BLANK_INSIDE)):
            for q in (0, 1):
                for b in (0, 1):
                    emit[part, :, q, b, :] = (marks * (_ASKS[r] if q else 1 - _ASKS[r]) * (blank if b else 1 - blank) / emit.shape[-1])[:, None]
    return change / change.sum(1, keepdims=True), emit


def model_of(change: np.ndarray | None = None, emit: np.ndarray | None = None) -> Model:
    """Log probabilities of counts on top of the prior's."""
    c, e = _prior()
    c, e = PRIOR * c + (0 if change is None else change), PRIOR * e + (0 if emit is None else emit)
    return np.log(c / c.sum(1, keepdims=True)), np.log(e / e.sum((1, 2, 3, 4), keepdims=True))


PRIOR_MODEL = model_of()


def observed(lines: list[str]) -> tuple[list[tuple[int, int, int, int]], list[str | None]]:
    """Features of each line that is not blank, and all lines, without their markers; None for blank ones."""
    seen, bare, blank = [], [], 0
    for line in lines:
        if not line.strip():
            blank = 1
            bare.append(None)
            continue
        kind, rest = marker(line)
        seen.append((MARKS.index(kind), int(rest.rstrip().endswith("?")), blank, sum(len(rest) > x for x in LENGTHS)))
        bare.append(rest)
        blank = 0
    return seen, bare


def _emitted(seen: list[tuple[int, int, int, int]], model: Model) -> np.ndarray:
    return model[1][(slice(None), *np.array(seen).T)].T if seen else np.zeros((0, N))


def viterbi(seen: list[tuple[int, int, int, int]], model: Model = PRIOR_MODEL, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> list[int]:
    """The best states of the lines, given the scores of what comes before (N + 1 states) and after them (N states)."""
    change, obs, back = model[0], _emitted(seen, model), []
    best = np.full(N + 1, _NEVER)
    best[BEGIN] = 0.0
    best = best if entry is None else entry
    for o in obs:
        scores = best[: len(best), None] + change[: len(best)]
        came = scores.argmax(0)
        back.append(came)
        best = scores[came, np.arange(N)] + o
    if not back:
        return []
    path = [int((best if leave is None else best + leave[:N]).argmax())]
    for came in reversed(back[1:]):
        path.append(int(came[path[-1]]))
    return path[::-1]


def summed(seen: list[tuple[int, int, int, int]], model: Model) -> np.ndarray:
    """The best score from each state before the lines to each state at their end (N + 1 x N + 1)."""
    out = np.full((N + 1, N + 1), _NEVER)
    np.fill_diagonal(out, 0.0)
    full = np.concatenate([model[0], np.full((N + 1, 1), _NEVER)], 1)
    for o in _emitted(seen, model):
        out = joined(out, full) + np.append(o, 0.0)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product in which scores add up and the best one counts."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), _NEVER)


def parse(transcript: str | None, model: Model = PRIOR_MODEL, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    seen, bare = observed((transcript or "").split("\n"))
    states, turns = iter(viterbi(seen, model, entry, leave)), []
    for line in bare:
        if line is None:
            if turns:
                turns[-1][1].append("")
            continue
        s = next(states)
        if s < len(ROLES) or not turns:
            turns.append([ROLES[s % len(ROLES)], [line]])
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(x).strip()) for r, x in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


#: Turns that have markers in the style that leaves them out later.
MARKED_TURNS = 6


def style_of(conv_id) -> int:
    return zlib.crc32(str(conv_id).encode()) % 4


def marked_turns(turns: list[tuple[int, str, str]], style: int) -> list[str]:
    """The texts of turns (number, role, text) as they stand in a transcript of one of four styles."""
    names = (("System", "User", "Assistant"), ("### Instructions", "### Human", "### Assistant"), ("**System**", "**Q**", "**A**"), ("[system]", "Human", "AI"))[style]
    out = []
    for number, role, text in turns:
        name = names[ROLES.index(role)] if role in ROLES else role.title()
        out.append(text if style == 3 and number >= MARKED_TURNS else f"{name}{'' if name.startswith('[') else ':'} {text}")
    return out


def transcript(turns: list[tuple[int, str, str]], style: int, first: bool = True) -> str:
    """A raw transcript of known turns; that of a later segment begins where the one before it ends."""
    return ("" if first or style % 2 == 0 else "\n") + ("\n\n" if style % 2 else "\n").join(marked_turns(turns, style))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def parse_transcripts(rows: DataFrame, key: list[str], text: str, model: Model = PRIOR_MODEL, entry: str | None = None, leave: str | None = None) -> DataFrame:
    """key..., turns (role, text), rendered of each transcript; entry and leave: columns with the scores around it."""
    tune(rows.sparkSession)
    kinds, k = dict(rows.dtypes), len(key)
    around = lambda c: F.col(c) if c else F.lit(None).cast("array<double>")

    def run(batches):
        for b in batches:
            found = [parse(t, model, None if e is None else np.array(e), None if x is None else np.array(x)) for t, e, x in zip(*(b.column(k + i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([[{"role": r, "text": x} for r, x in f] for f in found], _TURNS), pa.array([render(f) for f in found], pa.string())], [*(f"k{i}" for i in range(k)), "turns", "rendered"])

    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(key)), "turns array<struct<role: string, text: string>>, rendered string"])
    return rows.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)), F.col(f"`{text}`").cast("string").alias("t"), around(entry).alias("e"), around(leave).alias("x")).mapInArrow(run, schema).toDF(*key, "turns", "rendered")


def _segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment, t: the turns (turn, role, text) of each segment, by number."""
    one = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    number = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(0)) / SEGMENT_TURNS).cast("long")
    return turns.groupBy("conv_id", number.alias("segment")).agg(F.array_sort(F.collect_list(one)).alias("t"))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, segment, given (roles of the turns), raw: conversation tables as raw transcripts in a style by conv_id."""
    tune(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches):
        for b in batches:
            given, raw = [], []
            for name, segment, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                given.append([x["role"] for x in t])
                raw.append(transcript([(x["turn"], x["role"], x["text"]) for x in t], style_of(name), segment <= 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(given, pa.list_(pa.string())), pa.array(raw, pa.string())], ["conv_id", "segment", "given", "raw"])

    return _segments(turns).select("conv_id", "segment", "t").mapInArrow(run, f"conv_id {kind}, segment long, given array<string>, raw string")


def counted(turns: list[tuple[int, str, str]], style: int, change: np.ndarray, emit: np.ndarray) -> None:
    """Add the states and features of the lines of known turns to the counts. Other roles are left out."""
    blank, before = style % 2, BEGIN if turns and turns[0][0] == 0 else None
    for k, ((_, role, _), text) in enumerate(zip(turns, marked_turns(turns, style), strict=True)):
        if role not in ROLES:
            before = None
            continue
        first = ROLES.index(role)
        seen, _ = observed([*[""] * int(blank and k > 0), *text.split("\n")])
        for i, x in enumerate(seen):
            state = first if i == 0 else len(ROLES) + first
            if before is not None:
                change[before, state] += 1
            emit[(state, *x)] += 1
            before = state


def fit(turns: DataFrame, fit_turns: int = FIT_TURNS) -> Model:
    """The model of a table of known turns, counted on segments chosen by a hash, about fit_turns turns."""
    tune(turns.sparkSession)
    share = min(1.0, fit_turns / max(1, turns.count()))
    number = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(0)) / SEGMENT_TURNS)
    some = turns if share == 1 else turns.where(F.pmod(F.xxhash64("conv_id", number, F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))
    shapes = [x.shape for x in _prior()]

    def run(batches):
        change, emit = map(np.zeros, shapes)
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counted([(x["turn"], x["role"], x["text"]) for x in t], style_of(name), change, emit)
        both = np.concatenate([change.ravel(), emit.ravel()])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both[at], pa.float64())], ["i", "n"])

    both, cut = np.zeros(sum(int(np.prod(s)) for s in shapes)), int(np.prod(shapes[0]))
    for r in _segments(some).select("conv_id", "t").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each parameter
        both[r.i] = r.n
    return model_of(both[:cut].reshape(shapes[0]), both[cut:].reshape(shapes[1]))


def _spread(nodes: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one parent in order, with the scores around the parent -> the scores around each of them."""
    nodes = nodes.sort_values("at")
    m = [np.array(x).reshape(N + 1, N + 1) for x in nodes["m"]]
    first, last = np.array(nodes["entry"].iloc[0])[None, :], np.array(nodes["leave"].iloc[0])[:, None]
    entries, leaves = [], []
    for x in m:
        entries.append(first[0] - first.max())
        first = joined(first, x)
    for x in reversed(m):
        leaves.append(last[:, 0] - last.max())
        last = joined(x, last)
    return pd.DataFrame({"conv_id": nodes["conv_id"], "at": nodes["at"], "entry": entries, "leave": leaves[::-1]})


def boundaries(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, at, entry, leave: for the matrix (conv_id, at, m) of each segment, the scores that reach it from before and
    after it. No task holds more than fan matrices of a conversation at once."""
    with cleaned(matrices.sparkSession) as keep:
        around, path = _boundaries(matrices, fan)
        keep.append(path)
    return around


def _boundaries(matrices: DataFrame, fan: int) -> tuple[DataFrame, str]:
    kind = dict(matrices.dtypes)["conv_id"]

    def product(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        m = functools.reduce(joined, [np.array(x).reshape(N + 1, N + 1) for x in nodes["m"]])
        return pd.DataFrame({"conv_id": nodes["conv_id"].iloc[:1], "at": nodes["at"].iloc[:1] // fan, "m": [m.ravel()]})

    levels = [matrices]
    top = matrices.agg(F.max("at")).first()[0] or 0
    while top > 0:
        up = levels[-1].groupBy("conv_id", F.floor(F.col("at") / fan)).applyInPandas(product, f"conv_id {kind}, at long, m array<double>")
        levels.append(written(up, "matrices")[0])
        top //= fan
    begin = [_NEVER] * N + [0.0]
    path = ""
    around = levels.pop().select("conv_id", F.col("at").alias("up"), F.array(*map(F.lit, begin)).alias("entry"), F.array(*([F.lit(0.0)] * (N + 1))).alias("leave"))
    while levels:
        nodes = levels.pop().withColumn("up", F.floor(F.col("at") / fan).cast("long"))
        spread = nodes.join(around, ["conv_id", "up"]).groupBy("conv_id", "up").applyInPandas(_spread, f"conv_id {kind}, at long, entry array<double>, leave array<double>")
        around, path = written(spread.withColumnRenamed("at", "up"), "around")
    return around.withColumnRenamed("up", "at"), path


def recovered(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """Per conversation segment: turns found, their roles, whether they are those given, and the canonical text."""
    model = model or fit(turns)
    raw = as_transcripts(turns).select("conv_id", "segment", F.array_join("given", ",").alias("given"), "raw")
    last = turns.agg(F.max(F.col("turn").cast("long"))).first()[0] or 0
    if last >= SEGMENT_TURNS:
        raw, _ = written(raw, "transcripts")
        more = raw.where("segment > 0").select("conv_id").distinct()
        long = raw.join(more, "conv_id", "left_semi")
        kind = dict(turns.dtypes)["conv_id"]

        def run(batches):
            for b in batches:
                m = [summed(observed(t.split("\n"))[0], model).ravel() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.float64()))], ["conv_id", "at", "m"])

        matrices, _ = written(long.select("conv_id", "segment", "raw").mapInArrow(run, f"conv_id {kind}, at long, m array<double>"), "matrices")
        raw = raw.join(boundaries(matrices).withColumnRenamed("at", "segment"), ["conv_id", "segment"], "left")
        found = parse_transcripts(raw, ["conv_id", "segment", "given"], "raw", model, "entry", "leave")
    else:
        found = parse_transcripts(raw, ["conv_id", "segment", "given"], "raw", model)
    roles = F.array_join(F.transform("turns", lambda t: t.role), ",")
    return found.select("conv_id", "segment", F.size("turns").cast("long").alias("n_turns"), roles.alias("roles"), (roles == F.col("given")).alias("agrees"), "rendered")
