"""Quality of ranked results: rows (query_id, rank, relevant)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters by least points.
GRADES = ((95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (60, "D"))


def per_query(results: DataFrame, expected: Column | int = 1, k: int = 10) -> DataFrame:
    """precision, recall, f1, reciprocal rank and NDCG@k of each query. The ideal order holds what was returned."""
    rel = F.col("relevant").cast("int")
    hits, n = F.sum(rel), F.count("*")
    want = expected if isinstance(expected, Column) else F.lit(expected)
    gain = F.sum(F.when(F.col("rank") <= k, rel / F.log2(F.col("rank") + 1)).otherwise(0.0))
    out = results.groupBy("query_id").agg(n.alias("n"), hits.alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), gain.alias("dcg"), F.max(want).alias("want"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("hits").cast("int")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    precision = F.col("hits") / F.col("n")
    recall = F.when(F.col("want") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.nullif(F.col("want"), F.lit(0))))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    mrr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    ndcg = F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0)
    return out.select("query_id", "n", "hits", *(F.round(c, 6).alias(a) for c, a in ((F.col("precision"), "precision"), (F.col("recall"), "recall"), (f1, "f1"), (mrr, "mrr"), (ndcg, "ndcg"))))


def summary(per: DataFrame, category: str) -> DataFrame:
    """Means by category and, with category "all", over all, in one pass; grade of F1 and the share that passes."""
    score = 100 * (0.6 * F.avg("f1") + 0.4 * F.avg((F.col("f1") > 0).cast("double")))
    grouped = per.rollup(category).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "mrr", "ndcg")), F.round(score, 4).alias("points"))
    return grouped.withColumn(category, F.coalesce(F.col(category).cast("string"), F.lit("all"))).withColumn("grade", grade(F.col("points")))


def grade(points: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(points >= least, letter).otherwise(out)
    return out


def latency(rows: DataFrame, value: str) -> DataFrame:
    """Count, least, greatest, mean, the values at the places floor(n p) of the sorted ones, and how many fit in 1,000."""
    n = rows.where(F.col(value).isNotNull()).count()
    place = lambda p: (math.floor(n * p) + 0.5) / max(1, n)  # noqa: E731  the share below which exactly so many values lie
    at = lambda p: F.expr(f"percentile_disc({place(p)}D) within group (order by {value})")
    mean = F.avg(value)
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(mean, 6).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.round(1000 / mean, 6).alias("throughput"))


#: Role flags by the pattern that they show.
PATTERN_FLAGS = {"plugin": "is_plugin", "controller": "is_controller", "observer": "is_observer", "repository": "is_repository", "graphql_resolver": "is_resolver", "model": "is_model", "block": "is_block"}


def _of(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _any(values: list[str], test: Callable[[str], Column]) -> Column:
    return reduce(lambda a, v: a | F.coalesce(test(v), F.lit(False)), values, F.lit(False))


def relevant(df: DataFrame, conditions: dict) -> Column:
    """Whether a result fits any of the conditions: types, patterns, classes, methods, file_types, content (all words of it)
    and module. Columns that the results lack fit nothing."""
    path, cls, content = _of(df, "path"), _of(df, "class_name"), _of(df, "content")
    tests = [
        _any(conditions.get("types", []), lambda t: (_of(df, "component_type") == t) | F.coalesce(_of(df, "type") == t.lower(), F.lit(False)) | path.contains(f"/{t}/")),
        _any(conditions.get("patterns", []), lambda p: _of(df, PATTERN_FLAGS.get(p, p), "boolean")),
        _any(conditions.get("classes", []), lambda c: F.coalesce(cls.contains(c), F.lit(False)) | content.contains(f"class {c}")),
        _any(conditions.get("methods", []), lambda m: F.coalesce(_of(df, "method") == m, F.lit(False)) | content.contains(f"function {m}")),
        _any(conditions.get("file_types", []), lambda t: _of(df, "type") == t),
    ]
    if conditions.get("content"):
        low = F.lower(F.coalesce(content, F.lit("")))
        tests.append(reduce(lambda a, c: a & low.contains(c.lower()), conditions["content"], F.lit(True)))
    if m := conditions.get("module"):
        tests.append(F.coalesce(_of(df, "module") == m, F.lit(False)) | F.coalesce(path.contains(m.replace("_", "/", 1)), F.lit(False)))
    return reduce(lambda a, t: a | t, tests, F.lit(False))


def relevance(df: DataFrame, conditions: dict) -> Column:
    """How well a result fits, from 0 to 1: the mean over the conditions that are given."""
    path, cls = _of(df, "path"), _of(df, "class_name")
    parts = []
    if "types" in conditions:
        whole, part = (_any(conditions["types"], f) for f in (lambda t: _of(df, "component_type") == t, lambda t: path.contains(f"/{t}/")))
        parts.append(F.when(whole, 1.0).when(part, 0.7).otherwise(0.0))
    if "patterns" in conditions:
        parts.append(sum((F.coalesce(_of(df, PATTERN_FLAGS.get(p, p), "boolean"), F.lit(False)).cast("int") for p in conditions["patterns"]), F.lit(0)) / len(conditions["patterns"]))
    if "classes" in conditions:
        whole, part = (_any(conditions["classes"], f) for f in (lambda c: cls == c, lambda c: cls.contains(c)))
        parts.append(F.when(whole, 1.0).when(part, 0.5).otherwise(0.0))
    if "content" in conditions:
        low = F.lower(F.coalesce(_of(df, "content"), F.lit("")))
        parts.append(sum((low.contains(c.lower()).cast("int") for c in conditions["content"]), F.lit(0)) / len(conditions["content"]))
    if conditions.get("module"):
        parts.append(F.when(_of(df, "module") == conditions["module"], 1.0).otherwise(0.0))
    return sum(parts, F.lit(0.0)) / len(parts) if parts else F.lit(0.0)


def missed_patterns(results: DataFrame, more_than: int = 2, most: int = 5) -> DataFrame:
    """pattern, n: what failed cases (passed, missed) lack most often."""
    rows = results.where(~F.col("passed")).select(F.explode("missed").alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), "pattern").limit(most)


def pattern_pass(results: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, expected_hits, unexpected_hits, top_score, passed, missed (expected texts that were not found).

    results: case_id, rank, text, score; cases: case_id, expected, unexpected (arrays), min_score. Half of the expected
    texts in the first ten, none of the unexpected in the first five, and the top score reached.
    """
    rows = results.join(cases, "case_id")
    has = lambda p: F.lower("text").contains(F.lower(p))
    hit = F.when(F.col("rank") <= 10, F.filter("expected", has)).otherwise(F.array().cast("array<string>"))
    bad = F.when(F.col("rank") <= 5, F.size(F.filter("unexpected", has))).otherwise(0)
    got = rows.select("case_id", "expected", hit.alias("hit"), bad.alias("bad"), "score", F.size("expected").alias("want"), "min_score")
    agg = got.groupBy("case_id", "want", "min_score").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("found"), F.max("expected").alias("expected"), F.sum("bad").alias("unexpected_hits"), F.max("score").alias("top_score"))
    agg = agg.withColumn("expected_hits", F.size("found"))
    missed = F.array_sort(F.array_except("expected", "found"))
    return agg.select("case_id", missed.alias("missed"), F.col("expected_hits").cast("long"), "unexpected_hits", "top_score", ((2 * F.col("expected_hits") >= F.col("want")) & (F.col("unexpected_hits") == 0) & (F.col("top_score") >= F.col("min_score"))).alias("passed"))
