"""Benchmark decontamination with a generalised suffix automaton over words.

The words of the normalised test items are inserted into one automaton. A document streams through it: after each word
the automaton holds the longest run of words, ending there, that some item contains. Where that run reaches the window
(10 words, or the whole of a shorter item), the words of the window are hit and the items that hold it are known.

decontaminate() cuts hit spans that exceed a limit: every span longer than MAX_SPAN words, and all spans of a document
where they cover more than MAX_COVERAGE of its words. Spans of windows exceed the first limit always; what remains under
both are a few places where a short item (a name, a number) occurs in a long text.

Null and empty texts have no words and no hits; null or empty items have no windows; items without an id count for hits
and cuts and are missing from the lists of items alone; repeated item_ids count once; items with equal texts all count;
repeated documents each get a row; empty tables give empty results or no hits; columns of other names are kept by
decontaminate() and left out by matches(). Very long texts are read whole, in time that grows with their length,
whatever repeats in the items.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, text_of, tune, written

WINDOW = 10
#: Characters of items in one automaton. An automaton takes about 100 times this in a worker; more items make more
#: automata, each applied to all documents.
ITEM_CHARS = 1_500_000
#: A hit span longer than MAX_SPAN words is cut out; so are all spans of a document where they cover more than
#: MAX_COVERAGE of its words. Above DROP_COVERAGE the document goes.
MAX_SPAN, MAX_COVERAGE, DROP_COVERAGE = 5, 0.05, 0.8
#: What the words of a text are, and the letters that are lower-cased.
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.names = [n for n, _ in items]
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.whole: list[list[int]] = [[]]  # short items whose last state this is
        sequences = [s for _, s in items]
        for k, sequence in enumerate(sequences):
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        self.holders: dict[int, list[int]] = {}  # state of a window -> items that hold it
        self.short: dict[int, list[int]] = {}
        for k, sequence in enumerate(sequences):
            if 0 < len(sequence) < window:
                v = 0
                for w in sequence:
                    v = self.next[v][w]
                self.short.setdefault(v, []).append(k)
                continue
            v = n = 0
            for w in sequence:
                v, n = self.next[v][w], n + 1
                while self.size[self.link[v]] >= window:
                    v = self.link[v]
                n = min(n, self.size[v])
                if n >= window:
                    held = self.holders.setdefault(v, [])
                    if not held or held[-1] != k:
                        held.append(k)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.up = [-1] * len(self.size)  # nearest state above that ends a short item
        self.window_of = [0] * len(self.size)  # for states of a window and more: the state of their last window
        for v in order:
            p = self.link[v]
            self.up[v] = p if p in self.short else self.up[p] if p >= 0 else -1
            self.window_of[v] = self.window_of[p] if self.size[p] >= window else v

    def _extend(self, last: int, w: str) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        new = len(self.size)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: str, q: int) -> int:
        c = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, found: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, end) in ascending order without overlaps, and the items with windows in the text."""
        nxt, link, size, window, holders, short, up, window_of = self.next, self.link, self.size, self.window, self.holders, self.short, self.up, self.window_of
        root, v, n = nxt[0], 0, 0
        spans: list[list[int]] = []
        items: set[int] = set()
        for i, w in enumerate(found):
            if v == 0:
                v = root.get(w, 0)
                n = 1 if v else 0
                if not v:
                    continue
            else:
                at = nxt[v].get(w)
                while at is None and v:
                    v = link[v]
                    n = size[v]
                    at = nxt[v].get(w)
                if at is None:
                    v = n = 0
                    continue
                v, n = at, n + 1
            reach = 0
            if n >= window:
                items.update(holders.get(window_of[v], ()))
                reach = window
            if short:
                u = v if v in short and n >= size[v] else up[v]
                while u > 0:
                    k = size[u]  # a short item is the longest string of its state: insertion makes one for each prefix of an item
                    if n >= k:
                        items.update(short[u])
                        reach = max(reach, k)
                    u = up[u]
            if reach:
                begin = i + 1 - reach
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i + 1
                else:
                    spans.append([begin, i + 1])
        return [tuple(s) for s in spans], items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(s) for s in out]


def automata(items: DataFrame, item_id: str, text: str, window: int, item_chars: int):
    """Automata of blocks of items, one at a time; the driver holds one block, whose size item_chars bounds. Items with a
    null id count for hits and cuts like others; only their id is missing from the lists of items."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), text_of(text).alias("t")).distinct().orderBy("i", "t")
    block, size = [], 0
    for i, t in rows.toLocalIterator():
        if size and size + len(t) > item_chars:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((i, words(t)))
        size += len(t)
    if block or not size:
        yield Automaton(block, window)


def _scanned(docs: DataFrame, automaton: Automaton, keep: list[str], text_at: str) -> DataFrame:
    """keep..., n_words, spans, items of one automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        a = shared.value
        for b in batches:
            n, spans, items = [], [], []
            for t in b.column(text_at):
                found = words(t.as_py())
                s, k = a.scan(found)
                n.append(len(found))
                spans.append([x for p in s for x in p])
                items.append(sorted(a.names[i] for i in k if a.names[i] is not None))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, spans array<long>, items array<string>"])
    return docs.mapInArrow(lean(run, __name__), schema)


def _scan_many(docs: DataFrame, scans: Iterator[Automaton], keep: list[str]) -> DataFrame:
    """keep..., n_words, spans, items: docs (keep..., t) through several automata; the results of each row meet again under a
    row number."""
    rows, _ = written(docs.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    found = None
    for k, automaton in enumerate(scans):
        part, _ = written(_scanned(rows, automaton, ["row"], "t"), f"decontam-{k}")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_spans(batches):
        for b in batches:
            joined = [[x for p in _merged([p for s in many for p in zip(s[::2], s[1::2], strict=True)]) for x in p] for many in b.column("many").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_words"), pa.array(joined, pa.list_(pa.int64())), b.column("items")], ["row", "n_words", "spans", "items"])

    merged = merged.mapInArrow(lean(join_spans, __name__), "row long, n_words long, spans array<long>, items array<string>")
    return rows.join(merged, "row").select(*keep, "n_words", "spans", "items")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, item_chars: int = ITEM_CHARS) -> DataFrame:
    """doc_id, n_words, spans (begin, end, begin, end ... of hit words), items (sorted ids) for each document."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    scans = automata(items, item_id, item_text, window, item_chars)
    first = next(scans)
    second = next(scans, None)
    if second is None:
        return _scanned(rows, first, ["doc_id"], "t")
    return _scan_many(rows, itertools.chain([first, second], scans), ["doc_id"])


def digests(found: DataFrame) -> DataFrame:
    """Counts of hits of each document, from matches()."""
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("spans")), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 0, F.get("spans", i - 1)).otherwise(-F.get("spans", i - 1)))
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut(text: str, spans: list[int], max_span: int, max_coverage: float) -> str:
    """The text without the spans of words that exceed a limit."""
    at = [m.span() for m in WORDS.finditer(text.translate(LOWER))]
    pairs = [*zip(spans[::2], spans[1::2], strict=True)]
    covered = sum(e - b for b, e in pairs) / max(1, len(at))
    out, last = [], 0
    for b, e in pairs:
        if e - b > max_span or covered > max_coverage:
            out.append(text[last : at[b][0]])
            last = at[e - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, item_chars: int = ITEM_CHARS, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE, drop_coverage: float = DROP_COVERAGE) -> DataFrame:
    """The documents without their spans of items; columns as before. A document covered beyond drop_coverage goes.

    A column n_chars follows the shortened text. Texts without such spans, nulls included, stay as they are.
    """
    tune(docs.sparkSession)
    names, kinds = docs.columns, dict(docs.dtypes)
    inner = [f"c{i}" for i in range(len(names))]
    flat = docs.select(*(F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)), text_of(f"`{text}`").alias("t"))
    at_text = inner[names.index(text)]
    at_chars = inner[names.index(n_chars)] if n_chars in names else None

    def shortened(b: pa.RecordBatch, spans: list[list[int]], n: list[int]) -> pa.RecordBatch:
        """The columns of a batch, changed in the rows that have spans only."""
        hit = [i for i, x in enumerate(spans) if x]
        out = b.select(inner)
        if not hit:
            return out
        texts, gone = b.column(at_text).to_pylist(), set()
        for i in hit:
            if sum(spans[i][1::2]) - sum(spans[i][::2]) > drop_coverage * n[i]:
                gone.add(i)
            else:
                texts[i] = cut(texts[i], spans[i], max_span, max_coverage)
        out = out.set_column(inner.index(at_text), at_text, pa.array(texts, out.schema.field(at_text).type))
        if at_chars:
            sizes = b.column(at_chars).to_pylist()
            for i in hit:
                sizes[i] = len(texts[i])
            out = out.set_column(inner.index(at_chars), at_chars, pa.array(sizes, out.schema.field(at_chars).type))
        return out.filter(pa.array([i not in gone for i in range(out.num_rows)], pa.bool_()))

    schema = ", ".join(f"{i} {kinds[n]}" for n, i in zip(names, inner, strict=True))
    scans = automata(items, item_id, item_text, window, item_chars)
    first = next(scans)
    second = next(scans, None)
    if second is None:  # one automaton: a single pass scans and cuts
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for b in batches:
                found = [words(t) for t in b.column("t").to_pylist()]
                spans = [[x for p in shared.value.scan(f)[0] for x in p] for f in found]
                yield shortened(b, spans, [len(f) for f in found])

        return flat.mapInArrow(lean(run, __name__), schema).toDF(*names)

    def cut_found(batches):
        for b in batches:
            yield shortened(b, b.column("spans").to_pylist(), b.column("n_words").to_pylist())

    found = _scan_many(flat, itertools.chain([first, second], scans), inner)
    return found.mapInArrow(lean(cut_found, __name__), schema).toDF(*names)


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """n_words, n_hit, item ids by comparing every window with every place; for tests."""
    found, hit, ids = words(text), set(), set()
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            for i in range(len(found) - k + 1):
                if found[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    ids.add(name)
    return len(found), len(hit), sorted(ids)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
