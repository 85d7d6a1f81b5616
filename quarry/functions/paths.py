"""Column functions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Component types in the order in which they are tried; the first rule that holds decides.
#: (type, kind of test, text): "end" tests the path's end, "has" a part of it.
COMPONENT_RULES = (
    ("di_config", "end", "di.xml"),
    ("events_config", "end", "events.xml"),
    ("webapi_config", "end", "webapi.xml"),
    ("system_config", "end", "system.xml"),
    ("acl_config", "end", "acl.xml"),
    ("crontab_config", "end", "crontab.xml"),
    ("db_schema", "end", "db_schema.xml"),
    ("layout_config", "layout", ".xml"),
    ("controller", "has", "/controller/"),
    ("plugin", "has", "/plugin/"),
    ("observer", "has", "/observer/"),
    ("block", "has", "/block/"),
    ("helper", "has", "/helper/"),
    ("api", "has", "/api/"),
    ("setup", "has", "/setup/"),
    ("console", "has", "/console/"),
    ("cron", "has", "/cron/"),
    ("graphql_resolver", "resolver", ""),
    ("repository", "repository", ""),
    ("model", "has", "/model/"),
    ("template", "end", ".phtml"),
    ("javascript", "end", ".js"),
    ("graphql_schema", "end", ".graphqls"),
)
#: Areas by a part of the path, first match first.
AREAS = (("frontend", "/frontend/"), ("adminhtml", "/adminhtml/"), ("base", "/base/"), ("webapi", "/webapi_rest/"), ("webapi", "/webapi_soap/"), ("graphql", "/graphql/"), ("crontab", "/crontab/"))
DI_AREAS = ("adminhtml", "frontend", "graphql", "webapi_rest", "webapi_soap", "crontab")
FILE_TYPES = {"php": "php", "xml": "xml", "phtml": "template", "js": "javascript", "graphqls": "graphql"}


def _first(pairs: list[tuple[Column, str]], other: str | None) -> Column:
    out = F.lit(other)
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def component_type(path: Column) -> Column:
    p = F.lower(path)
    tests = {
        "end": lambda x: p.endswith(x),
        "has": lambda x: p.contains(x),
        "layout": lambda x: p.contains("/layout/") & p.endswith(x),
        "resolver": lambda x: p.contains("resolver") & (p.contains("graph-ql") | p.contains("graphql")),
        "repository": lambda x: p.contains("/model/") & p.contains("repository"),
    }
    return _first([(tests[kind](text), name) for name, kind, text in COMPONENT_RULES], "other")


def module(path: Column) -> Column:
    """Vendor_Module of a path in app/code, vendor or lib/internal; null elsewhere."""
    code = F.regexp_extract(path, r"app/code/(\w+)/(\w+)", 1), F.regexp_extract(path, r"app/code/(\w+)/(\w+)", 2)
    vendor = F.regexp_extract(path, r"vendor/([\w-]+)/([\w-]+)", 1), F.regexp_extract(path, r"vendor/([\w-]+)/([\w-]+)", 2)
    lib = F.regexp_extract(path, r"lib/internal/(\w+)/(\w+)", 1), F.regexp_extract(path, r"lib/internal/(\w+)/(\w+)", 2)
    return F.coalesce(*(F.when(a != "", F.concat(a, F.lit("_"), b)) for a, b in (code, vendor, lib)))


def area(path: Column) -> Column:
    return _first([(path.contains(text), name) for name, text in AREAS], None)


def di_area(path: Column) -> Column:
    return _first([(path.contains(f"/etc/{a}/"), a) for a in DI_AREAS], "global")


def file_type(path: Column) -> Column:
    return _first([(F.lower(path).endswith("." + e), t) for e, t in FILE_TYPES.items()], "other")


def entry_type(entry: Column) -> Column:
    """api, event, graphql or route, by the form of an entry point."""
    flat = ~entry.contains("/")
    return _first([(entry.rlike(r"^/?V[0-9]"), "api"), (flat & entry.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "event"), (flat & entry.rlike("^[a-z]") & entry.rlike("[A-Z]"), "graphql")], "route")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\\"), -1)


def excluded(path: Column, names: list[str], prefixes: list[str]) -> Column:
    """Whether the path lies in a folder of these names or below one of these prefixes."""
    folders = F.split(path, "/")
    out = F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, names))) if names else F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p.rstrip("/") + "/")
    return out


def class_candidates(fqcn: str) -> list[str]:
    """Paths where a class of three segments or more is looked for first; the vendor's part of a module is in kebab case."""
    parts = fqcn.replace("\\\\", "\\").split("\\")
    if len(parts) < 3:
        return []
    vendor, module = parts[0].lower(), re.sub("^-", "", re.sub("([A-Z])", r"-\1", parts[1]).lower())
    return [f"vendor/{vendor}/{'/'.join(parts[1:])}.php", f"vendor/{vendor}/{module}/{'/'.join(parts[2:])}.php", f"app/code/{'/'.join(parts)}.php"]


def is_version(text: Column) -> Column:
    """Three numbers with points, and a suffix of letters, digits, points and dashes or none."""
    return text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?$")
