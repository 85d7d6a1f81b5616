"""Code trees as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import excluded
from quarry.functions.text import brace_expand

EXTENSIONS = ("php", "xml", "phtml", "js", "graphqls")
MAX_BYTES = 100_000
#: Folders and prefixes that are not scanned.
EXCLUDED_NAMES = ("node_modules", ".git", "var", "generated", "Test", "Tests", "test", "tests", "_files", "fixtures", "performance-toolkit")
EXCLUDED_PREFIXES = ("vendor/bin", "pub/static", "dev/tests", "dev/tools")


def ignore_patterns(lines: list[str]) -> list[str]:
    """Patterns of an ignore file: no comments, no blank lines, no slash at the end."""
    return [x.strip().rstrip("/") for x in lines if x.strip() and not x.strip().startswith("#")]


def ignored(path, patterns: list[str]):
    """A pattern with a slash is a prefix; one without is a folder or file of that name anywhere."""
    out = F.lit(False)
    for p in patterns:
        out = out | ((path == p) | path.startswith(p + "/") if "/" in p else F.array_contains(F.split(path, "/"), p))
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] = [], names: tuple[str, ...] = EXCLUDED_NAMES, prefixes: tuple[str, ...] = EXCLUDED_PREFIXES, max_bytes: int = MAX_BYTES) -> DataFrame:  # noqa: B006
    """path (below the root), content, size, mtime of the tree's source files; the size filter reaches the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = re.sub("^/+", "/", root.split(":", 1)[-1]).rstrip("/") + "/"
    path = F.regexp_replace(F.element_at(F.split("path", F.lit(_quoted(base)), 2), 2), "^/+", "")
    rows = raw.where(F.col("length") <= max_bytes).select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where(~excluded(F.col("path"), list(names), list(prefixes)) & ~ignored(F.col("path"), ignore))


def globbed(files: DataFrame, *globs: str) -> DataFrame:
    """Files of a tree whose path fits one of some globs: "**/" is any number of folders, "*" and "?" stay inside a name."""

    def regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            else:
                out, i = out + ("[^/]" if glob[i] == "?" else re.escape(glob[i])), i + 1
        return out

    every = [x for g in globs for x in brace_expand(g)]
    return files.where(F.col("path").rlike("^(?:" + "|".join(map(regex, every)) + ")$"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def config_values(spark: SparkSession, root: str) -> DataFrame:
    """env, scope, scope_id, config_path, value out of one JSON array file per environment; malformed files give none."""
    schema = "scope string, scope_id long, path string, value string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(root)
    env = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.where(F.col("path").isNotNull()).select(env.alias("env"), "scope", "scope_id", F.col("path").alias("config_path"), "value")
