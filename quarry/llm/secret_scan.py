"""Secret scans with DataFrame functions only.

Base spans come from three patterns. Candidate strings of base64 letters get the Shannon entropy of a sliding window,
kept by counts that change by one letter in and one letter out at each step; the threshold depends on the narrowest
character class that holds the candidate, or the window where that holds both letters and digits (a key behind a name
and a separator). Base spans and parts that the allow-list knows are cut out of a candidate; what remains on each side
of them is scored, from WINDOW letters on.

Positions are code points, ends exclusive. Null and empty texts have no spans; an empty table gives an empty result;
repeated rows each get theirs; spans that tie on their start go in the order of BASE, then entropy; scan() adds its
column under a name the caller chooses and keeps all others, whatever they are called. Very long texts are read whole:
a window costs the same at every place of a candidate, and lists are folded in pieces of _PIECE, so that the time grows
with the length of a text and, for spans, with the power 1.5 of their number at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same texts, where a look at the first letters decides that nothing can match.
_LIKELY = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]{16}"}
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character class, pattern of a whole candidate, least bits a letter. The first class that holds it counts. Strings
#: without both letters and digits are words or numbers.
CLASSES = (
    ("hex", "^[0-9a-fA-F]+$", 2.9),
    ("alnum", "^[A-Za-z0-9]+$", 3.6),
    ("base64", "^[A-Za-z0-9+/_=-]+$", 3.75),
)
#: What is known not to be secret: whole strings (^...$), or words that make the part between separators known.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|dummy",
    "(?i)abcdefgh|01234567|12345678",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]+$",
)
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
_PIECE, _BLOCK = 256, 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _each(state: Column, kind: str, items: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """struct(state, out): step(state, item) gives the next state and an array of this kind; out holds all arrays joined.

    Folded in pieces, so that joining costs the power 1.5 of the items rather than their square.
    """

    def inner(a: Column, x: Column) -> Column:
        new, out = step(a.state, x)
        return F.struct(new.alias("state"), F.concat(a.out, out).alias("out"))

    def outer(a: Column, piece: Column) -> Column:
        zero = F.struct(a.state.alias("state"), F.array().cast(kind).alias("out"))
        return _let(F.aggregate(piece, zero, inner), lambda r: F.struct(r.state.alias("state"), F.concat(a.out, F.array(r.out)).alias("out")))

    def pieces(all_items: Column) -> Column:
        starts = F.when(F.size(all_items) > 0, F.sequence(F.lit(1), F.size(all_items), F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(all_items, i, _PIECE))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(_let(items, pieces), zero, outer, lambda a: F.struct(a.state.alias("state"), F.flatten(a.out).alias("out")))


def _found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, with places: the pieces between the matches, and the matches, in turn."""
    plain = f"({pattern})" if group == 0 else pattern.replace("(?i)", "(?i)(", 1) + ")"
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(plain), F.lit(1)).alias("all"), F.regexp_extract_all(text, F.lit(plain), F.lit(group + 1)).alias("part"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["all"].alias("value"))).cast(_SPAN)
        return end, F.when(F.length(x["part"]) >= least, one).otherwise(F.array().cast(_SPAN))

    return _each(F.lit(0).cast("bigint"), _SPAN, pieces, step).out


def _entropy(value: Column) -> Column:
    """struct(bits, first, end): the greatest entropy of a window and the span of all windows that reach the threshold.

    The accumulator carries the window's letters and a string of counts, one letter for each letter of ALPHABET.
    """
    weight = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    gains = F.array(*(F.lit(b - a) for a, b in zip(weight, weight[1:], strict=False)))
    zero_count = 48  # the code of "0"
    # places in ALPHABET from 1: letters up to 52, digits up to 62, then symbols; hex letters begin both cases
    kinds = {"sym": lambda c: c > 62, "dig": lambda c: c.between(53, 62), "oth": lambda c: c.between(7, 26) | c.between(33, 52)}
    count = lambda counts, c: F.ascii(F.substr(counts, c, F.lit(1))) - zero_count
    put = lambda counts, c, n: F.overlay(counts, F.char((n + zero_count).cast("bigint")), c, F.lit(1))

    def step(a: Column, x: Column) -> Column:
        come, go = F.instr(F.lit(ALPHABET), x), F.when(a.i >= WINDOW, F.instr(F.lit(ALPHABET), F.substr(a.window, F.lit(1), F.lit(1)))).otherwise(0)
        return _let(F.struct(come.alias("come"), go.alias("go")), lambda s: left(a, x, s))

    def left(a: Column, x: Column, s: Column) -> Column:
        n = count(a.counts, s.go)
        gone = F.struct(put(a.counts, s.go, n - 1).alias("counts"), (a.total - F.get(gains, n - 1)).alias("total"))
        same = F.struct(a.counts.alias("counts"), a.total.alias("total"))
        return _let(F.when(s.go > 0, gone).otherwise(same), lambda g: _let(count(g.counts, s.come), lambda m: entered(a, x, s, g, m)))

    def entered(a: Column, x: Column, s: Column, g: Column, m: Column) -> Column:
        total = g.total + F.get(gains, m)
        held = [(a[k] + f(s.come).cast("int") - (f(s.go) & (s.go > 0)).cast("int")).alias(k) for k, f in kinds.items()]
        window = F.when(s.go > 0, F.concat(F.substr(a.window, F.lit(2)), x)).otherwise(F.concat(a.window, x))
        bits = F.when(a.i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
        now = F.struct(put(g.counts, s.come, m + 1).alias("counts"), window.alias("window"), total.alias("total"), bits.alias("bits"), *held)
        return _let(now, lambda n: judged(a, n))

    def judged(a: Column, n: Column) -> Column:
        mixed = (n.dig > 0) & (n.dig + n.sym < WINDOW)
        own = F.when(n.sym > 0, F.lit(CLASSES[2][2])).when(n.oth > 0, F.lit(CLASSES[1][2])).otherwise(F.lit(CLASSES[0][2]))
        high = (a.i >= WINDOW - 1) & (n.bits >= F.when(mixed, F.least(a.least, own)).otherwise(a.least))
        return F.struct(
            (a.i + 1).alias("i"),
            n.counts.alias("counts"),
            n.window.alias("window"),
            n.total.alias("total"),
            F.greatest(a.bits, n.bits).alias("bits"),
            a.least.alias("least"),
            F.when(high & (a.first < 0), a.i - (WINDOW - 1)).otherwise(a.first).alias("first"),
            F.when(high, a.i + 1).otherwise(a.end).alias("end"),
            *(n[k].alias(k) for k in kinds),
        )

    least = F.coalesce(*(F.when(value.rlike(p), F.lit(t)) for _, p, t in CLASSES), F.lit(99.0))
    zero = F.struct(F.lit(0).alias("i"), F.lit(chr(zero_count) * len(ALPHABET)).alias("counts"), F.lit("").alias("window"), F.lit(0.0).alias("total"), F.lit(0.0).alias("bits"), least.alias("least"), F.lit(-1).alias("first"), F.lit(-1).alias("end"), *(F.lit(0).alias(k) for k in kinds))
    return F.aggregate(F.split(value, ""), zero, step, lambda a: F.struct(a.bits.alias("bits"), a["first"].alias("first"), a.end.alias("end")))


def _blocks(text: Column) -> Column:
    """The text in pieces of _BLOCK code points, from which _between() reads without walking from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _between(blocks: Column, at: Column, end: Column) -> Column:
    """Code points at (from 0) up to end of a text in blocks."""

    def piece(p: Column) -> Column:
        whole = F.array_join(F.slice(blocks, p.first + 1, F.greatest(p.last - p.first + 1, F.lit(0))), "")
        return F.substring(whole, (at - p.first * _BLOCK + 1).cast("int"), (end - at).cast("int"))

    place = F.struct(F.floor(at / _BLOCK).cast("int").alias("first"), F.floor((end - 1) / _BLOCK).cast("int").alias("last"))
    return F.when(end > at, _let(place, piece)).otherwise(F.lit(""))


def _remains(blocks: Column, cand: Column, cuts: Column) -> Column:
    """The pieces of the candidates outside of the cuts, with WINDOW letters or more: one walk over both, by place."""
    none = F.array().cast(_SPAN)

    def piece(at: Column, end: Column) -> Column:
        one = F.struct(at.alias("start"), F.lit(len(BASE)).alias("rank"), end.alias("end"), F.lit("entropy").alias("kind"), _between(blocks, at, end).alias("value"))
        return F.when(end - at >= WINDOW, F.array(one).cast(_SPAN)).otherwise(none)

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        # a: at (what is not cut yet begins here) and end of the open candidate; a cut may begin before it and end behind it
        opened = F.struct(F.greatest(x.start, a.cut).alias("at"), x.end.alias("end"), a.cut.alias("cut"))
        cut = F.struct(F.greatest(a.at, F.least(x.end, a.end)).alias("at"), a.end.alias("end"), F.greatest(a.cut, x.end).alias("cut"))
        out = F.when(x.is_cut, piece(a.at, F.least(x.start, a.end))).otherwise(piece(a.at, a.end))
        return F.when(x.is_cut, cut).otherwise(opened), out

    event = lambda cut: lambda s: F.struct(s.start.alias("start"), F.lit(cut).alias("is_cut"), s.end.alias("end"))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(k) for k in ("at", "end", "cut")))
    # behind all others, an empty candidate that closes the last one
    last = F.array(F.struct(F.lit(1 << 62).alias("start"), F.lit(False).alias("is_cut"), F.lit(1 << 62).alias("end")))
    events = F.array_sort(F.concat(F.transform(cand, event(False)), F.transform(cuts, event(True)), last))
    return _each(zero, _SPAN, events, step).out


def _unlike(pattern: str):
    return lambda c: ~c.value.rlike(pattern)


def _fresh(names: list[str], *wanted: str) -> list[str]:
    """These names with as many signs behind them as keep them apart from a table's columns."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w in taken:
            w += "_"
        out.append(w)
        taken.add(w)
    return out


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with an array of spans (start, rank, end, kind, value), by start, then kind as listed, then entropy."""
    none = F.array().cast(_SPAN)
    names = _fresh([*docs.columns, spans], "base", "cand", "cuts", "fit")
    base, cand, cuts, fit = map(F.col, names)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    likely = t.rlike(CANDIDATE)
    found = [F.when(t.rlike(_LIKELY[k]), _found(t, k, r, p, g, n)).otherwise(none) for r, (k, p, g, n) in enumerate(BASE)]
    out = docs.withColumn(names[0], F.concat(*found)).withColumn(names[1], F.when(likely, _found(t, "entropy", len(BASE), CANDIDATE, 0, WINDOW)).otherwise(none))
    whole = [p for p in allowed if p.startswith("^")]
    words = "|".join(f"(?:{p})" for p in allowed if not p.startswith("^"))
    known = F.when(likely & t.rlike(words), _found(t, "allowed", len(BASE), f"(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?:{words})[A-Za-z0-9+]*", 0, 1)).otherwise(none) if words else none
    out = out.withColumn(names[2], F.concat(base, known))
    left = F.when(F.size(cand) == 0, none).when(F.size(cuts) == 0, cand).otherwise(_let(_blocks(t), lambda b: _remains(b, cand, cuts)))
    left = F.filter(left, lambda c: c.value.rlike("[0-9]") & c.value.rlike("[A-Za-z]"))
    for pattern in whole:
        left = F.filter(left, _unlike(pattern))
    out = out.withColumn(names[3], left)
    scored = F.transform(fit, lambda c: F.struct(c.alias("c"), _entropy(c.value).alias("e")))
    kept = F.transform(F.filter(scored, lambda s: s.e["first"] >= 0), lambda s: F.struct((s.c.start + s.e["first"]).alias("start"), s.c.rank.alias("rank"), (s.c.start + s.e.end).alias("end"), s.c.kind.alias("kind"), F.substring(s.c.value, s.e["first"] + 1, s.e.end - s.e["first"]).alias("value")))
    return out.withColumn(spans, F.array_sort(F.concat(base, F.when(F.size(fit) > 0, kept).otherwise(none).cast(_SPAN)))).drop(*names)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of each document."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t")
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r).alias(f"n_{k}") for r, (k, *_) in enumerate(BASE)), F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "<secret>") -> DataFrame:
    """The documents with a mark in place of each secret; columns as before, n_chars follows. Null texts stay null.

    Spans that overlap get one mark for each that begins where the ones before it have ended.
    """
    (spans,) = _fresh(docs.columns, "spans")
    found = scan(docs, text, spans)
    t, some = F.col(f"`{text}`").cast("string"), F.size(spans) > 0

    def marked(blocks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            return F.greatest(at, s.end), F.when(s.start >= at, F.array(_between(blocks, at, s.start), F.lit(mark))).otherwise(F.array().cast("array<string>"))

        walk = _each(F.lit(0).cast("bigint"), "array<string>", F.col(spans), step)
        return _let(walk, lambda w: F.concat(F.array_join(w.out, ""), _between(blocks, w.state, F.length(t).cast("bigint"))))

    new = F.when(some, _let(_blocks(t), marked)).otherwise(t)
    if n_chars in docs.columns:
        (clean,) = _fresh([*docs.columns, spans], "clean")
        found = found.withColumn(clean, new)
        count = F.when(some, F.length(clean).cast(dict(docs.dtypes)[n_chars])).otherwise(F.col(f"`{n_chars}`"))
        return found.select(*(F.col(clean).alias(text) if c == text else count.alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns))
    return found.select(*(new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))
