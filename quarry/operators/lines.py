"""Texts as ordered lines: search with context, enclosing definitions, guards, ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import component_type
from quarry.functions.text import glob_regex

MAX_RESULTS, MAX_CONTEXT = 200, 10
#: A setter called with null among its arguments; a call on a call's result; signs of a null check.
NULL_CALL = r"->(set[A-Z][A-Za-z0-9_]*)\(\s*(?:[^()]*,\s*)?null\s*(?:,[^()]*)?\)"
CHAIN = r"\$(\w+)\s*->\s*(\w+)\s*\([^)]{0,60}\)\s*->\s*(\w+)\s*\("
SAFE_ARROW, COALESCE = "?->", r"\?\?|\?:"
RECEIVER_TESTS = r"(?i)(?:is_null\s*\(\s*{0}|{0}\s*(?:===|!==)\s*null|!\s*{0}\s*[,)]|isset\s*\(\s*{0})"
UNCHECKED_CHAIN = r"\$this->(\w+)->(\w+)\("


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long")


def located(files: DataFrame, pattern: str, groups: dict[str, int], content: str = "content") -> DataFrame:
    """files with a row for each match of a pattern in the whole content: line (from 1) where it begins, and groups."""
    c = F.coalesce(F.col(content), F.lit(""))
    parts = {"m": 0} | groups
    pieces = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), *(F.regexp_extract_all(c, F.lit(pattern), F.lit(k)).alias(n) for n, k in parts.items()))

    def step(a: Column, x: Column) -> Column:
        line = a.line + newlines(x.gap)
        one = F.struct(line.alias("line"), *(x[n].alias(n) for n in parts))
        return F.struct((line + newlines(F.coalesce(x.m, F.lit("")))).alias("line"), F.concat(a.out, F.when(x.m.isNotNull(), F.array(one)).otherwise(F.array().cast(kind))).alias("out"))

    kind = "array<struct<line:bigint," + ",".join(f"{n}:string" for n in parts) + ">>"
    zero = F.struct(F.lit(1).cast("long").alias("line"), F.array().cast(kind).alias("out"))
    found = files.where(c.rlike(pattern)).select("*", F.explode(F.aggregate(pieces, zero, step, lambda a: a.out)).alias("found_"))
    return found.select(*files.columns, "found_.line", *(F.col(f"found_.{n}").alias(n) for n in groups))


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line (from 1), text."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(content, F.lit("")), "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def read_range(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Numbered lines of one file."""
    return lines(files.where(F.col("path") == path)).where(F.col("line").between(start, end))


def include_condition(path: Column, include: str) -> Column:
    """Whether a glob (with braces, or several by commas) fits the name of a file, the last part of its path, as a whole."""
    return F.element_at(F.split(path, "/"), -1).rlike(glob_regex(include))


def under(path: Column, scope: str) -> Column:
    """Whether a path is, or lies below, a scope; "." is everything."""
    clean = scope.strip("/")
    return F.lit(True) if clean in ("", ".") else (path == clean) | path.startswith(clean + "/")


#: Patterns with these may fit a line without fitting the content that holds it.
_LOCAL = re.compile(r"\\[AzZG]|\(\?")


def grep(files: DataFrame, pattern: str, include: str | None = None, ignore_case: bool = False, scope: str | None = None) -> DataFrame:
    """path, line, text of every matching line. A content that cannot match as a whole is not split."""
    regex = f"(?i){pattern}" if ignore_case else pattern
    some = files.where(include_condition(F.col("path"), include)) if include else files
    some = some.where(under(F.col("path"), scope)) if scope else some
    if not _LOCAL.search(pattern):
        some = some.where(F.col("content").rlike("(?m)" + regex))
    return lines(some).where(F.col("text").rlike(regex))


def with_context(files: DataFrame, matches: DataFrame, context: int = 4) -> DataFrame:
    """path, first, last, n_matches, text: the lines around matches, ranges that touch joined to one."""
    ranges = merged_ranges(matches, max(0, min(context, MAX_CONTEXT)))
    parts = F.split(F.coalesce("content", F.lit("")), "\n")
    own = files.select("path", parts.alias("parts_")).join(ranges, "path")
    last = F.least(F.col("last"), F.size("parts_"))
    text = F.array_join(F.slice("parts_", F.col("first").cast("int"), (last - F.col("first") + 1).cast("int")), "\n")
    return own.select("path", "first", last.cast("long").alias("last"), "n_matches", text.alias("text"))


def top_matches(matches: DataFrame, limit: int = 50) -> DataFrame:
    return matches.orderBy("path", "line").limit(min(limit, MAX_RESULTS))


def matching_files(files: DataFrame, pattern: str) -> DataFrame:
    """path and matching lines of each file that has some."""
    return grep(files, pattern).groupBy("path").agg(F.count("*").alias("n_matches"))


def merged_ranges(matches: DataFrame, context: int) -> DataFrame:
    """path, first, last, n_matches: context ranges, joined where they touch. Gaps and islands in one sort per path."""
    own = Window.partitionBy("path").orderBy("line")
    spans = matches.select("path", "line", F.greatest(F.col("line") - context, F.lit(1)).alias("b"), (F.col("line") + context).alias("e"))
    fresh = spans.withColumn("new", F.when(F.col("b") > F.lag("e").over(own) + 1, 1).otherwise(0))
    islands = fresh.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("path", "island").agg(F.min("b").alias("first"), F.max("e").alias("last"), F.count("*").alias("n_matches")).drop("island")


def context_text(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Each line with the text of its neighbours."""
    frame = Window.partitionBy("path").orderBy("line").rowsBetween(-before, after)
    return rows.withColumn("context", F.array_join(F.collect_list("text").over(frame), "\n"))


def enclosing(rows: DataFrame, pattern: str = r"function\s+([A-Za-z0-9_]+)", reach: int = 30) -> DataFrame:
    """Each line with the nearest definition at most so many lines above it."""
    name = F.regexp_extract("text", pattern, 1)
    frame = Window.partitionBy("path").orderBy("line").rowsBetween(-reach, 0)
    return rows.withColumn("method", F.last(F.when(name != "", name), ignorenulls=True).over(frame))


def capped(rows: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most).drop("__n")


def method_chains(files: DataFrame, scope: str | None = None, reach: int = 6) -> DataFrame:
    """path, line, receiver, first_method, second_method, has_null_guard of calls on a call's result, over lines too.

    A guard is a safe arrow on the line where the chain begins, or a coalescing sign or a test of the receiver against
    null within so many lines of it.
    """
    php = files.where(F.col("path").endswith(".php") & F.col("content").contains("->"))
    php = php.where(under(F.col("path"), scope)) if scope else php
    found = located(php.select("path", "content"), CHAIN, {"receiver": 1, "first_method": 2, "second_method": 3})
    parts = F.split("content", "\r?\n")
    begin = F.greatest(F.col("line") - reach, F.lit(1)).cast("int")
    near = F.array_join(F.slice(parts, begin, (F.col("line") + reach + 1).cast("int") - begin), "\n")
    own = F.element_at(parts, F.col("line").cast("int"))
    before, *rest = RECEIVER_TESTS.split("{0}")
    named = F.concat(F.lit(r"\$"), F.col("receiver"))
    tests = F.concat(F.lit(before), *(x for r in rest for x in (named, F.lit(r))))
    seen = found.withColumn("near", near).withColumn("tests", tests)
    guard = own.contains(SAFE_ARROW) | F.col("near").rlike(COALESCE) | F.regexp_like("near", F.col("tests"))
    return seen.select("path", "line", "receiver", "first_method", "second_method", guard.alias("has_null_guard"))


def method_snippet(content: Column, method: Column | str, most: int = 15) -> Column:
    """The first line that defines a method, and those behind it; null without one."""
    return _from_definition(content, method, lambda parts, at: F.slice(parts, at, most))


def method_body(content: Column, method: Column | str, most: int = 60) -> Column:
    """A method from its definition to the line that closes its braces, so many lines at most; null without one."""

    def whole(parts: Column, at: Column) -> Column:
        some = F.slice(parts, at, most)
        braces = lambda x: F.length(x) - F.length(F.translate(x, "{", ""))
        closed = lambda x: F.length(x) - F.length(F.translate(x, "}", ""))

        def step(a: Column, x: Column) -> Column:
            depth, started = a.depth + braces(x) - closed(x), a.started | x.contains("{")
            return F.struct(depth.alias("depth"), started.alias("started"), F.when(a.done, a.n).otherwise(a.n + 1).alias("n"), (a.done | (started & (depth <= 0))).alias("done"))

        zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("started"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        return F.slice(some, 1, F.aggregate(some, zero, step, lambda a: a.n))

    return _from_definition(content, method, whole)


def _from_definition(content: Column, method: Column | str, cut) -> Column:
    name = F.lit(method) if isinstance(method, str) else method
    head = F.concat(F.lit("function "), name, F.lit("("))
    parts = F.split(F.coalesce(content, F.lit("")), "\n")
    at = F.array_position(F.transform(parts, lambda x: x.contains(head)), True).cast("int")
    return F.when(at > 0, F.array_join(cut(parts, F.greatest(at, F.lit(1))), "\n"))


def null_risks(chains: DataFrame, first_method: str | None = None, most: int = 20) -> DataFrame:
    """Unguarded chains by their methods with the number of sites and the first of them."""
    some = chains.where(~F.col("has_null_guard"))
    some = some.where(F.col("first_method") == first_method) if first_method else some
    site = F.concat_ws(":", "path", F.col("line").cast("string"))
    return some.groupBy("first_method", "second_method").agg(F.count("*").alias("n_sites"), F.array_join(F.slice(F.array_sort(F.collect_set(site)), 1, most), ",").alias("sites"))


def complexity(files: DataFrame, threshold: int = 0) -> DataFrame:
    """path, complexity (1 + branching words and signs), rating."""
    branches = F.regexp_count("content", F.lit(r"\b(if|elseif|for|foreach|while|case|catch)\b|&&|\|\||\?\?"))
    out = files.select("path", (F.lit(1) + branches).cast("long").alias("complexity"))
    rating = F.when(F.col("complexity") <= 5, "low").when(F.col("complexity") <= 10, "moderate").when(F.col("complexity") <= 20, "high").otherwise("very high")
    return out.withColumn("rating", rating).where(F.col("complexity") >= threshold)


#: What a change of a kind of file adds to its risk, and changed lines that make it certain.
RISKY, RISKY_KINDS, SURE_LINES = 0.3, ("di_config", "db_schema", "plugin"), 200


def diff_risk(diffs: DataFrame) -> DataFrame:
    """path, added, removed, risk of unified diffs (path, diff): lines changed by SURE_LINES, more for risky kinds, 1 at most."""
    count = lambda sign: F.size(F.filter(F.split("diff", "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    rows = diffs.select("path", count("+").alias("added"), count("-").alias("removed"))
    kind = F.when(component_type(F.col("path")).isin(*RISKY_KINDS), RISKY).otherwise(0.0)
    return rows.withColumn("risk", F.least(F.lit(1.0), (F.col("added") + F.col("removed")) / SURE_LINES + kind))
