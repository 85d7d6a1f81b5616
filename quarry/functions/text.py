"""Column functions over texts and queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a query is expanded with, by head term.
SYNONYMS = {
    "plugin": ("interceptor", "around method", "before after"),
    "preference": ("di override", "rewrite", "di.xml for type"),
    "observer": ("event listener", "event handler", "events.xml"),
    "model": ("entity", "resource model"),
    "block": ("view block", "template block"),
    "controller": ("action class", "execute method", "route handler"),
    "cron": ("scheduled task", "crontab.xml"),
    "api": ("rest endpoint", "webapi", "service contract"),
    "layout": ("xml layout", "handle", "container", "reference block"),
    "checkout": ("cart", "quote", "totals collection"),
    "order": ("sales order", "order placement", "order submit"),
    "product": ("catalog product", "product entity"),
    "customer": ("customer entity", "customer account"),
    "indexer": ("reindex", "flat table", "price index"),
    "payment": ("payment method", "payment gateway", "payment information"),
    "shipping": ("carrier", "shipping method", "delivery"),
    "stock": ("inventory", "salable quantity", "source item"),
}
#: Fixed values of the term weight.
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 200


def normalize_terms(query: Column) -> Column:
    """Distinct lower-case terms of 3 bytes or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.octet_length(t) >= 3)))


def pattern_hash(query: Column) -> Column:
    """A hash that neither order nor repetition of terms changes."""
    return F.xxhash64(F.array_join(normalize_terms(query), "ÿ"))


def split_camel(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=.)(\p{Lu})", " $1"))


def expand_query(query: Column) -> Column:
    """The query followed by the synonyms of its terms, in the order of the terms."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(" ".join(v)))))
    found = F.filter(F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.try_element_at(table, t)), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, F.concat_ws(" ", query, F.array_join(found, " "))).otherwise(query)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """Terms that the term weight uses: longer than 2, cut at white space, underscores and backslashes."""
    return [t for t in re.split(r"[\s_\\]+", query.lower()) if len(t) > 2]


def _is(word: str):
    return lambda x: x == word


def bm25(text: Column, terms: list[str]) -> Column:
    """Sum of saturated term frequencies, without document frequencies, against a fixed average length."""

    def weight(w: Column) -> Column:
        norm = F.lit(K1) * (1 - B + B * F.size(w) / AVERAGE_LENGTH)
        out = F.lit(0.0)
        for t in terms:
            tf = F.size(F.filter(w, _is(t))).cast("double")
            out = out + tf * (K1 + 1) / (tf + norm)
        return out

    # only words that count are kept apart; the array is made once, however many terms there are
    return F.get(F.transform(F.array(words(text)), weight), 0)


def brace_expand(pattern: str) -> list[str]:
    """All patterns that the brace groups of one pattern stand for."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for part in m[1].split(",") for x in brace_expand(pattern[: m.start()] + part.strip() + pattern[m.end() :])]


def last_json(output: str):
    """The last line of a program's output that is JSON; else what is left without log lines. ValueError without any."""
    rows = output.split("\n")
    for row in reversed(rows):
        try:
            if row.strip():
                return json.loads(row)
        except ValueError:
            continue
    log = re.compile(r"^\s*(?:\x1b\[|\[[\d\-T:.Z]+)")
    first = next((i for i, r in enumerate(rows) if r.strip() and not log.match(r) and re.match(r'\s*[\[{"\-0-9tfn]', r)), 0)
    return json.loads("\n".join(r for r in rows[first:] if r.strip() and not log.match(r)))


def pascal(name: Column) -> Column:
    """snake_case to PascalCase; letters behind the first of each part stay as they are."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def glob_regex(include: str) -> str:
    """An anchored, case-insensitive regex for a glob of names with braces; commas outside of braces separate globs."""
    parts = re.split(r",(?![^{}]*\})", include)
    globs = [g.strip() for p in parts for g in brace_expand(p) if g.strip()]
    one = lambda g: "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g)
    return "(?i)^(?:" + "|".join(map(one, globs)) + ")$"
