"""Learning from what users do after a search.

Signals come from ordered calls of a user; weights are folded in the order of the signals, for each key on its own, with
a rate that falls with the key's count. A hot key never meets in one task: rows are numbered by ranges, and a run of
steps, each held between two limits, is one shift held between two limits, so that runs of CHUNK steps are folded apart
and their few numbers joined.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize_terms
from quarry.session import checkpointed

BASE_LR, MOST, GLOBAL_SHARE, TERM_SHARE, NEGATIVE = 0.05, 0.15, 0.3, 0.5, 0.1
CHUNK = 1024
#: Follow-up tool, signal, feature.
FOLLOWS = (
    ("find_plugin", "refinement_to_plugin", "is_plugin"),
    ("find_class", "refinement_to_class", "class_match"),
    ("find_config", "refinement_to_config", "config_match"),
    ("find_observer", "refinement_to_observer", "is_observer"),
    ("find_controller", "refinement_to_controller", "is_controller"),
    ("find_block", "refinement_to_block", "is_block"),
    ("trace_flow", "trace_after_search", "is_controller"),
)
FEATURES = ("is_plugin", "is_observer", "is_controller", "is_block", "class_match", "config_match")


def signals(calls: DataFrame, follow: str = "30 seconds", refine: str = "60 seconds") -> DataFrame:
    """user_id, event_id, ts, signal, search_id: follow-ups of the last search, and searches that refine another.

    calls: user_id, event_id, ts, tool, k (what a search asked for). One sort per user; the time between is shorter than the
    interval.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    search = F.when(F.col("tool") == "search", F.struct("ts", "event_id", "k"))
    prior = calls.withColumn("p", F.last(search, ignorenulls=True).over(own))
    kind = F.lit(None).cast("string")
    for tool, signal, _ in reversed(FOLLOWS):
        kind = F.when((F.col("tool") == tool) & (F.col("ts") < F.col("p.ts") + F.expr(f"interval {follow}")), signal).otherwise(kind)
    again = (F.col("tool") == "search") & ~F.col("k").eqNullSafe(F.col("p.k")) & (F.col("ts") < F.col("p.ts") + F.expr(f"interval {refine}"))
    kind = F.when(again, "query_refinement").otherwise(kind)
    return prior.select("user_id", "event_id", "ts", kind.alias("signal"), F.col("p.event_id").alias("search_id"), F.col("p.k").alias("k")).where(F.col("signal").isNotNull())


def feature(signal: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, name, f in FOLLOWS:
        out = F.when(signal == name, f).otherwise(out)
    return out


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with n, the place (from 1) among the rows of their key. Rows are dealt by ranges of key and order, numbered inside
    a part, and moved on by the counts of the parts before: a row for each key and part."""
    ranged = checkpointed(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "part_").agg(F.count("*").alias("size_")).withColumn("before_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    own = Window.partitionBy(key, "part_").orderBy(*order)
    inside = ranged.withColumn("n", F.row_number().over(own))
    moved = counts.select(F.col(key).alias("key_"), F.col("part_").alias("of_"), "before_")
    return inside.join(moved, F.col(key).eqNullSafe(F.col("key_")) & (F.col("part_") == F.col("of_"))).withColumn("n", (F.col("n") + F.col("before_")).cast("long")).drop("part_", "before_", "key_", "of_")


def _spread(counted: DataFrame, key: str, lr: Column) -> DataFrame:
    """key, feature, n, delta: what each signal adds to each feature of its key."""
    plus = F.array(F.struct(F.col("feature").alias("f"), lr.alias("d")))
    config = F.when(F.col("signal") == "refinement_to_config", F.array(F.struct(F.lit("config_xml_dir").alias("f"), (lr * 0.5).alias("d")))).otherwise(F.array().cast("array<struct<f:string,d:double>>"))
    minus = F.transform(F.filter(F.array(*map(F.lit, FEATURES)), lambda f: f != F.col("feature")), lambda f: F.struct(f.alias("f"), (-lr * NEGATIVE).alias("d")))
    return counted.select(key, "n", F.explode(F.concat(plus, config, minus)).alias("o")).select(key, "n", F.col("o.f").alias("feature"), F.col("o.d").alias("delta"))


def _folded(observations: DataFrame, key: str) -> DataFrame:
    """key, feature, weight, n: sums in order, held between -MOST (when falling) and MOST (when rising).

    What a run of steps does to a weight w is max(low, min(high, w + shift)); such runs join to one of the same form.
    """
    held = lambda x, d: F.when(d >= 0, F.least(x + d, F.lit(MOST))).otherwise(F.greatest(x + d, F.lit(-MOST)))
    run = lambda shift, low, high: F.struct(shift.alias("shift"), low.alias("low"), high.alias("high"))
    zero = run(F.lit(0.0), F.lit(-math.inf), F.lit(math.inf))
    steps = F.array_sort(F.collect_list(F.struct("n", "delta")))
    chunk = F.aggregate(steps, zero, lambda a, s: run(a.shift + s.delta, held(a.low, s.delta), held(a.high, s.delta)))
    chunks = observations.groupBy(key, "feature", F.floor((F.col("n") - 1) / CHUNK).alias("chunk")).agg(chunk.alias("run"), F.count("*").alias("n"))
    within = lambda x, r: F.greatest(r.low, F.least(r.high, x + r.shift))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "run"))), zero, lambda a, s: run(a.shift + s.run.shift, within(a.low, s.run), within(a.high, s.run)), lambda a: within(F.lit(0.0), a))
    return chunks.groupBy(key, "feature").agg(whole.alias("weight"), F.sum("n").alias("n"))


def learned(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights by query pattern, by term, and overall: (key, feature, weight, n) each.

    rows: ts, event_id, signal, query. The rate of all three follows the pattern's count. Rows that repeat an event_id are
    signals of their own.
    """
    known = rows.withColumn("feature", feature(F.col("signal"))).where(F.col("feature").isNotNull())
    terms = normalize_terms(F.col("query"))
    keyed = known.select("ts", "event_id", "signal", "feature", terms.alias("terms"), F.xxhash64(F.array_join(terms, "ÿ")).alias("pattern"))
    rated = numbered(keyed, "pattern", ["ts", "event_id"]).withColumn("lr", F.lit(BASE_LR) / (1 + F.col("n") * 0.1))
    rated = checkpointed(rated)
    patterns = _folded(_spread(rated, "pattern", F.col("lr")), "pattern")
    each = rated.drop("n").withColumn("term", F.explode("terms"))
    by_term = _spread(numbered(each, "term", ["ts", "event_id", "pattern"]), "term", F.col("lr") * TERM_SHARE).where("feature <> 'config_xml_dir'")
    every = numbered(rated.drop("n").withColumn("all", F.lit("all")), "all", ["ts", "event_id", "pattern"])
    overall = _spread(every, "all", F.col("lr") * GLOBAL_SHARE).where("feature <> 'config_xml_dir'")
    return patterns, _folded(by_term, "term"), _folded(overall, "all")


def weights_for(query: str, patterns: DataFrame, terms: DataFrame, overall: DataFrame) -> tuple[dict[str, float], list[dict[str, float]], dict[str, float]]:
    """The learned weights that bear on a query: its pattern's, those of its terms that have some, and the overall ones. A
    key has a handful of features, and a query its terms."""
    words = sorted({t for t in query.lower().split() if len(t.encode()) >= 3})
    own = patterns.where(F.col("pattern") == F.xxhash64(F.lit("ÿ".join(words))))
    by_term: dict[str, dict[str, float]] = {}
    for r in terms.where(F.col("term").isin(words)).collect() if words else ():
        by_term.setdefault(r["term"], {})[r["feature"]] = r["weight"]
    return {r["feature"]: r["weight"] for r in own.collect()}, [by_term[w] for w in words if w in by_term], {r["feature"]: r["weight"] for r in overall.collect()}


def query_adjustments(queries: DataFrame, results: DataFrame, patterns: DataFrame, terms: DataFrame, overall: DataFrame) -> DataFrame:
    """query_id, id, adjustment for many queries (query_id, query) and their results (query_id, id and what features test):
    the three tiers as joins on pattern, term and feature."""
    keyed = queries.select("query_id", normalize_terms(F.col("query")).alias("terms"))
    none = keyed.select("query_id", F.xxhash64(F.array_join("terms", "ÿ")).alias("pattern"))
    tier1 = none.join(patterns, "pattern").select("query_id", "feature", "weight")
    found = keyed.select("query_id", F.explode("terms").alias("term")).join(terms, "term")
    share = found.groupBy("query_id").agg(F.countDistinct("term").alias("known"))
    tier2 = found.join(share, "query_id").groupBy("query_id", "feature").agg((F.sum("weight") / F.max("known") * 0.7).alias("weight"))
    known = [F.struct(F.lit(r["feature"]).alias("feature"), F.lit(r["weight"] * 0.3).alias("weight")) for r in overall.collect()]  # a row for each feature
    each = tier1.unionByName(tier2)
    if known:
        each = each.unionByName(queries.select("query_id", F.explode(F.array(*known)).alias("o")).select("query_id", "o.feature", "o.weight"))
    each = each.groupBy("query_id", "feature").agg(F.sum("weight").alias("weight"))
    has = F.array_compact(F.array(*(F.when(t, F.lit(f)) for f, t in feature_tests(results).items())))
    rows = results.select("query_id", "id", F.explode_outer(has).alias("feature"))
    total = rows.join(each, ["query_id", "feature"], "left").groupBy("query_id", "id").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    return total.select("query_id", "id", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), "total")).alias("adjustment"))


def status(patterns: DataFrame, terms: DataFrame, overall: DataFrame) -> DataFrame:
    """name, n: how many patterns, terms and updates the tables hold."""
    n = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(patterns, "patterns", F.countDistinct("pattern")).unionByName(n(terms, "terms", F.countDistinct("term"))).unionByName(n(overall, "updates", F.max("n")))


def feature_tests(df: DataFrame) -> dict[str, Column]:
    """Whether a row has each feature."""
    col = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    path = F.lower("path")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    kind = (text("type") == "xml") if "type" in df.columns else path.endswith(".xml")
    return {f: col(f) for f in FEATURES[:4]} | {
        "class_match": F.col("class_name").isNotNull() if "class_name" in df.columns else F.lit(False),
        "config_match": (text("component_type") == "di_config") | kind,
        "config_xml_dir": path.contains("/etc/") & path.endswith(".xml"),
    }


def applied(df: DataFrame, weights: dict[str, float]) -> Column:
    """The sum of the weights of the features that a row has."""
    out = F.lit(0.0)
    for f, test in feature_tests(df).items():
        if f in weights:
            out = out + F.when(test, weights[f]).otherwise(0.0)
    return out


def adjustment(df: DataFrame, pattern: dict[str, float], terms: list[dict[str, float]], overall: dict[str, float]) -> Column:
    """Three tiers: the query's own weights, 0.7 of the mean of its terms', 0.3 of the overall ones; held to MOST."""
    out = applied(df, pattern)
    if terms:
        total = F.lit(0.0)
        for t in terms:
            total = total + applied(df, t)
        out = out + total / len(terms) * 0.7
    out = out + applied(df, overall) * 0.3
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), out))


class Adapter:
    """Low-rank change of a query vector, e + B(A e), that starts as the identity and is held near what mattered."""

    RATE, DECAY = 0.001, 0.005

    def __init__(self, dim: int, rank: int = 2, seed: int = 0, ewc: float = 2000.0):
        r = np.random.default_rng(seed)
        self.a, self.b = r.normal(0, 0.02, (rank, dim)), np.zeros((dim, rank))
        self.fisher, self.star, self.ewc = np.zeros(2 * rank * dim), np.zeros(2 * rank * dim), ewc
        self.n = self.kept = 0  # updates, and those that the regularizer has seen

    def _flat(self) -> np.ndarray:
        return np.concatenate([self.a.ravel(), self.b.ravel()])

    def forward(self, e: np.ndarray) -> np.ndarray:
        return e + self.b @ (self.a @ e)

    def adjust(self, e: np.ndarray, least: float = 0.90) -> np.ndarray:
        """The changed vector of unit length, or the old one where the change would turn it too far."""
        out = self.forward(e)
        n = np.linalg.norm(out) * np.linalg.norm(e)
        return out / np.linalg.norm(out) if n > 0 and float(out @ e) / n >= least else e

    def penalty(self) -> float:
        return float(0.5 * self.ewc * (self.fisher * (self._flat() - self.star) ** 2).sum()) if self.kept else 0.0

    def update(self, query: np.ndarray, target: np.ndarray) -> None:
        """One step from the query towards the target (the mean of what was followed): B first, then A by the new B; then the
        pull to the weights before, and the running mean of squared moves."""
        self.n += 1
        lr = self.RATE / (1 + self.DECAY * self.n)
        delta = target - query
        self.b += lr * np.outer(delta, self.a @ query)
        self.a += lr * np.outer(self.b.T @ delta, query)
        if self.kept:
            pull = self.RATE * self.ewc * self.fisher * (self._flat() - self.star)
            self.a -= pull[: self.a.size].reshape(self.a.shape)
            self.b -= pull[self.a.size :].reshape(self.b.shape)
            share = 1 / (self.kept + 1)
            self.fisher = (1 - share) * self.fisher + share * (self._flat() - self.star) ** 2
        self.star = self._flat()
        self.kept += 1

    def state(self) -> dict[str, list[float]]:
        return {"a": self.a.ravel().tolist(), "b": self.b.ravel().tolist(), "fisher": self.fisher.tolist(), "star": self.star.tolist(), "n": [float(self.n), float(self.kept)]}

    @classmethod
    def load(cls, dim: int, rank: int, state: dict[str, list[float]]) -> Adapter:
        """From a state; a state of other sizes gives a new adapter."""
        out = cls(dim, rank)
        if {k: len(state.get(k) or ()) for k in ("a", "b", "fisher", "star")} == {"a": dim * rank, "b": dim * rank, "fisher": 2 * dim * rank, "star": 2 * dim * rank}:
            out.a, out.b = np.array(state["a"]).reshape(rank, dim), np.array(state["b"]).reshape(dim, rank)
            out.fisher, out.star = np.array(state["fisher"]), np.array(state["star"])
            out.n, out.kept = (int(x) for x in (*(state.get("n") or ()), 0, 0)[:2])
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of arrays."""
        spark.createDataFrame([self.state()], "a array<double>, b array<double>, fisher array<double>, star array<double>, n array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int, rank: int = 2) -> Adapter:
        """What save() wrote; a table that cannot be read, or of other sizes, gives a new adapter."""
        try:
            row = spark.read.parquet(path).first()
        except Exception:  # noqa: BLE001  a missing or damaged state starts anew
            return cls(dim, rank)
        return cls.load(dim, rank, row.asDict()) if row else cls(dim, rank)
