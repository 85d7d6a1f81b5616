"""Filters over search results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precise(text: Column, query: str) -> Column:
    """At least one query term of more than two letters is in the text."""
    out = F.lit(False)
    for t in (t for t in query.lower().split() if len(t) > 2):
        out = out | F.lower(text).contains(t)
    return out


def _module_matches(pattern: str) -> Column:
    mod, path = F.coalesce("module", F.lit("")), F.coalesce("path", F.lit(""))
    low_mod, low_path = F.lower(mod), F.lower(path)
    if "*" in pattern:
        regex = "".join("[/_]" if c in "/_" else ".*" if c == "*" else re.escape(c) for c in pattern)
        out = mod.rlike(f"(?i)^{regex}$") | path.rlike(f"(?i)^{regex}$")
        prefix = re.split(r"[/*_]", pattern)[0].lower()
        if prefix:
            out = out | low_mod.startswith(prefix) | low_path.contains("vendor/" + prefix) | low_path.contains("app/code/" + prefix)
        return out
    low = pattern.lower()
    out = low_mod.contains(low) | low_path.contains(low)
    parts = re.split(r"[/_]", low)
    if len(parts) >= 2:
        pieces = F.split(low_mod, "[/_]")
        vendor = F.get(pieces, F.lit(0))
        rest = F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), "-")
        wanted = "-".join(parts[1:])
        same = vendor.startswith(parts[0]) | F.lit(parts[0]).startswith(vendor)
        out = out | ((F.size(pieces) >= 2) & same & rest.contains(wanted))
    return out


def module_matches(patterns: str | list[str]) -> Column:
    """Any of the patterns fits module or path; "/" and "_" are alike, "*" is free, a vendor may be a prefix."""
    out = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        out = out | _module_matches(p)
    return F.coalesce(out, F.lit(False))


def in_module(name: str) -> Column:
    """Whether module or path belong to a module as a whole, in both forms of a tree (Vendor/Module, vendor/module-name)."""
    parts = name.split("_")
    out = F.lower(F.coalesce("module", F.lit(""))) == name.lower()
    if len(parts) == 2:
        kebab = re.sub("([a-z])([A-Z])", r"\1-\2", parts[1]).lower()
        out = out | F.col("path").startswith(f"app/code/{parts[0]}/{parts[1]}/") | F.col("path").startswith(f"vendor/{parts[0].lower()}/module-{kebab}/")
    return out


def include_modules(df: DataFrame, patterns: str | list[str]) -> DataFrame:
    return df.where(module_matches(patterns))


def exclude_modules(df: DataFrame, patterns: str | list[str]) -> DataFrame:
    """Rows whose path no matching row has."""
    return df.join(include_modules(df, patterns).select("path").distinct(), "path", "left_anti")


def soft_filter(df: DataFrame, condition: Column, group: list[str], least: int = 1) -> DataFrame:
    """Rows of a group that fit, or all of its rows where fewer than least fit."""
    fits = F.coalesce(condition, F.lit(False))
    counts = df.groupBy(*group).agg(F.count_if(fits).alias("__n"))
    return df.join(counts, group).where(fits | (F.col("__n") < least)).drop("__n")


def fallback(df: DataFrame, first: Column, second: Column, group: list[str], least: int) -> DataFrame:
    """Rows of the first tier; where a group has fewer than least, also those of the second. tier: 1 or 2."""
    tier = F.when(first, 1).when(second, 2)
    tiered = df.withColumn("tier", tier).where(F.col("tier").isNotNull())
    counts = tiered.groupBy(*group).agg(F.count_if(F.col("tier") == 1).alias("__n"))
    return tiered.join(counts, group).where((F.col("tier") == 1) | (F.col("__n") < least)).drop("__n")


def role(df_flag: str, *parts: str) -> Column:
    """A role by its flag or by parts of the path."""
    out = F.coalesce(F.col(df_flag), F.lit(False))
    for p in parts:
        out = out | F.col("path").contains(p)
    return out


def class_matches(name: Column, target: str) -> Column:
    """Full names match whole or at the end; short ones anywhere in the last segment, without case."""
    bare = F.regexp_replace(name, r"^\\+", "")
    if "\\" in target:
        t = target.lstrip("\\")
        return (bare == t) | bare.endswith("\\" + t)
    return F.lower(F.element_at(F.split(bare, r"\\"), -1)).contains(target.lower())


def segment_matches(name: Column, target: str) -> Column:
    return F.array_contains(F.split(F.lower(name), r"\\"), target.lower())


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
