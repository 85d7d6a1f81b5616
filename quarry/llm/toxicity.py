"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: log-odds of words and word beginnings between toxic and other labelled documents, with an informative
Dirichlet prior whose weights are the pooled counts. A word scores its own log-odds where they are significant, else
those of its beginning, else a small negative constant. Scoring: a linear scan finds all maximal scoring segments
(stack of cumulative sums); extreme-value statistics of clean documents (lambda from the token scores, K from the
maxima) turn segment scores into bits above what the document's length yields by chance; the strongest and the sum of
the significant ones go through a logistic curve fitted on the same labelled rows.

Only texts and labels.toxic of the training rows are read. The training sample is bounded by SAMPLE_ROWS labelled
documents, chosen by a hash of doc_id, and with it the model, all of whose features occur some dozens of times there;
scoring covers every document. The sample and the sums over it do not depend on how the rows are dealt to tasks.

Null and empty texts have no segments and score the base curve; labels without documents, null labels and repeated
labels of a document (the greatest counts) are defined; repeated documents each get a row; with no labels, or labels
of one kind only, the score is the smoothed base rate; other columns are ignored; an empty table gives no rows. Very
long texts are read whole, in time that grows with their length. Segments that tie in score are all kept; of sample
rows that look like copies the one with the smallest doc_id, then the smallest text, stays.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cleaned, lean, text_of, tune, written
from quarry.llm.near_dup import shingles

SAMPLE_ROWS, MIN_DOCS, MIN_Z, MIN_ODDS = 40_000, 2, 7.5, 2.0
#: Tokens that the prior is worth, score of a word that says nothing, greatest score of a word.
PRIOR, NEUTRAL, MOST = 2000.0, -0.15, 8.0
PREFIXES = (8, 7, 6, 5, 4)
#: Features that a task counts before it hands the counts on.
COUNTED = 100_000
#: A segment counts as significant below this probability.
SIGNIFICANT, THRESHOLD = 0.05, 0.3
_WORD = re.compile(r"\w+")
_WORD_CACHE = 150_000


def features(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked by its length."""
    return [word, *(f"{k}:{word[:k]}" for k in PREFIXES if len(word) >= k)]


class _Scores(dict):
    """Scores by word; one that is missing is looked up in a model's weights."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get, got = self.weights.get, NEUTRAL
        for f in features(word):
            s = get(f)
            if s is not None:
                got = max(-MOST, min(MOST, s))
                break
        self[word] = got
        return got


class Model:
    def __init__(self, weights: dict[str, float], scale: float = 1.0, k: float = 0.1, curve: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.weights, self.scale, self.k, self.curve = weights, scale, k, curve
        self.cache = _Scores(weights)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cache = _Scores(self.weights)

    def scores(self, text: str) -> np.ndarray:
        if len(self.cache) > _WORD_CACHE:
            self.cache.clear()
        found = _WORD.findall(text.lower())
        return np.fromiter(map(self.cache.__getitem__, found), float, len(found))

    def bits(self, score: float, n: int) -> float:
        """Score above chance: the expected number of such segments in n words is exp(-bits)."""
        return self.scale * score - math.log(max(self.k * n, 1e-9))

    def found(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Maximal segments (first word, end, score, bits) and the number of words."""
        s = self.scores(text) if text else np.zeros(0)
        return [(b, e, x, self.bits(x, len(s))) for b, e, x in segments(s)], len(s)

    @staticmethod
    def summary(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Strength of the best segment and of all significant ones."""
        strong = [x[3] for x in found if -math.expm1(-math.exp(-x[3])) < SIGNIFICANT]
        return (max(0.0, max((x[3] for x in found), default=0.0)) ** 0.5, math.log1p(sum(strong)))

    def judged(self, text: str | None) -> tuple[float, list[dict]]:
        """The score, and the significant segments: begin, end (code points), score, p."""
        found, n = self.found(text)
        a, b = self.summary(found)
        out, at = [], None
        for begin, end, x, bits in found:
            p = -math.expm1(-math.exp(-bits))
            if p < SIGNIFICANT:
                at = at or [m.span() for m in _WORD.finditer(text)]
                if len(at) == n:  # a text whose lower case has other words keeps its score but no place
                    out.append({"begin": at[begin][0], "end": at[end - 1][1], "score": float(x), "p": float(p)})
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b)))), out

    def score(self, text: str | None) -> float:
        a, b = self.summary(self.found(text)[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]])))
    stack: list[list] = []  # begin, end, sum before, sum after, place on the stack of the last one with a lesser sum before
    for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right = float(total[b]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([b, e, left, right, j])
                break
            b, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - x) for b, e, x, r, _ in stack]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _keyed(batches):
    """Smallest hashes of the runs of 3 and of 4 words: near copies nearly always share one of them."""
    for b in batches:
        keys = []
        for k in (3, 4):
            firsts = [s[:1].view(np.int64) for s in (shingles(t.as_py(), k) for t in b.column("t"))]
            keys.append(pa.array([int(f[0]) if len(f) else 0 for f in firsts], pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns, *keys], ["d", "t", "y", "h3", "h4"])


def _counted(batches):
    """Occurrences of each feature in toxic and other documents, and documents that have it."""
    fields = ["f", "n1", "n0", "d"]
    n, d = (Counter(), Counter()), Counter()

    def rows():
        names = [*d]
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (n[1], n[0], d))], fields)
        for c in (*n, d):
            c.clear()
        return out

    for b in batches:
        for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
            own = Counter()
            for w, k in Counter(_WORD.findall(t.lower())).items():
                for f in features(w):
                    own[f] += k
            n[y].update(own)
            d.update(own.keys())
        if len(d) > COUNTED:
            yield rows()
    yield rows()


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic curve by Newton's method, with a weak pull to zero."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.05 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows that are not held out."""
    tune(docs.sparkSession)
    with cleaned(docs.sparkSession):
        return _trained(docs, labels, doc_id, text, toxic, sample_rows)


def _trained(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample_rows: int) -> Model:
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("d")).agg(F.max((F.col(toxic) > 0).cast("int")).alias("y"))
    n = known.count()
    keep = min(1.0, sample_rows / max(1, n))
    known = known.where(F.pmod(F.xxhash64("d", F.lit("sample")), F.lit(1_000_000)) < int(keep * 1_000_000)) if keep < 1 else known
    rows = docs.select(F.col(doc_id).alias("d"), text_of(text).alias("t")).join(F.broadcast(known), "d")  # at most about sample_rows ids
    keyed = rows.select("d", "t", "y").mapInArrow(lean(_keyed, __name__), f"d {dict(rows.dtypes)['d']}, t string, y int, h3 long, h4 long")
    # near copies would make a text's rare words look toxic
    once = keyed.groupBy("h3", "y").agg(F.min(F.struct("d", "t", "h4")).alias("m")).groupBy("m.h4", "y").agg(F.min(F.struct("m.d", "m.t")).alias("m"))
    sample, _ = written(once.select("m.d", "m.t", "y"), "toxicity-sample")
    sizes = dict(sample.groupBy("y").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        rate = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1 + 9 * (not sizes))
        return Model({}, curve=(math.log(rate / (1 - rate)), 0.0, 0.0))
    counts = sample.mapInArrow(lean(_counted, __name__), "f string, n1 long, n0 long, d long").groupBy("f").agg(*(F.sum(c).cast("double").alias(c) for c in ("n1", "n0", "d")))
    counts, _ = written(counts.where(F.col("d") >= MIN_DOCS), "toxicity-counts")
    c1, c0 = (max(1.0, x or 0.0) for x in counts.where("f not like '%:%'").agg(F.sum("n1"), F.sum("n0")).collect()[0])
    both = F.col("n1") + F.col("n0")
    alpha = PRIOR * both / (c1 + c0)
    odds = F.log((F.col("n1") + alpha) / (c1 + PRIOR)) - F.log((F.col("n0") + alpha) / (c0 + PRIOR))
    part = lambda n, c: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (c1 + c0) / (both * c))).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("n1", c1) + part("n0", c0))))  # root of the likelihood ratio
    best = counts.select("f", odds.alias("s"), z.alias("z")).where((F.col("z") >= MIN_Z) & (F.abs("s") >= MIN_ODDS))
    model = Model({r.f: r.s for r in best.collect()})

    def seen(batches):
        for b in batches:
            hist, top, length = [], [], []
            for t in b.column("t").to_pylist():
                s = model.scores(t)
                v, k = np.unique(np.round(s, 2), return_counts=True)
                hist.append([x for p in zip(v.tolist(), k.tolist(), strict=True) for x in p])
                top.append(max((x for _, _, x in segments(s)), default=0.0))
                length.append(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(hist, pa.list_(pa.float64())), pa.array(top, pa.float64()), pa.array(length, pa.int64())], ["hist", "top", "n"])

    clean = sample.where("y = 0").mapInArrow(lean(seen, __name__), "hist array<double>, top double, n long")
    pairs = clean.select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("hist")), lambda i: (i % 2 == 0) & (i < F.size("hist"))), lambda i: F.struct(F.get("hist", i).alias("v"), F.get("hist", i + 1).alias("k")))).alias("p"))
    hist = {r.v: r.k for r in pairs.groupBy("p.v").agg(F.sum("p.k").alias("k")).collect()}
    tops = clean.where("n > 0").select("top", "n").toPandas()  # sample_rows at most
    values, share = np.array([*sorted(hist), 1.0]), np.array([*(hist[v] for v in sorted(hist)), 1.0])
    share = share / share.sum()
    low, high = 1e-3, 20.0
    if (values * share).sum() < 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if (share * np.exp(np.minimum(mid * values, 600))).sum() > 1 else (mid, high)
        model.scale = low
    if len(tops):
        top, length = (math.fsum(x) / len(tops) for x in (tops["top"], np.log(tops["n"])))
        model.k = min(1.0, max(1e-4, math.exp(min(0.0, model.scale * top - 0.5772 - length))))

    def summed(batches):
        for b in batches:
            s = [model.summary(model.found(t)[0]) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in s], pa.float64()), pa.array([x for _, x in s], pa.float64()), b.column("y")], ["a", "b", "y"])

    table = sample.select("t", "y").mapInArrow(lean(summed, __name__), "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    model.curve = _fit(table[["a", "b"]].to_numpy(), table["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", passages: bool = True) -> DataFrame:
    """doc_id, score and, if wanted, passages (begin, end, score, p) of each document."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[doc_id]
    passage = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if passages:
                found = [m.judged(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], passage)], ["doc_id", "score", "passages"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id), text_of(text)).mapInArrow(lean(run, __name__), f"doc_id {kind}, score double" + (", passages array<struct<begin: long, end: long, score: double, p: double>>" if passages else ""))


def digests(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold; columns as before."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run, __name__), docs.schema)
