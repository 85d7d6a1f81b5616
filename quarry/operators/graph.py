"""Traversals over relations. Depth is bounded; walks with a memory of seen nodes checkpoint each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import short_name
from quarry.operators import extract
from quarry.operators.lines import UNCHECKED_CHAIN, enclosing, lines, method_body
from quarry.session import checkpointed


def resolved(names: DataFrame, preferences: DataFrame, name: str = "iface") -> DataFrame:
    """name, impl: the preference of each name; a whole name goes before a short one, preferences of all areas before those of
    one, then the first path decides."""
    order = F.concat((F.col("area") != "global").cast("int").cast("string"), F.lit(" "), "path")
    p = preferences.select(F.col("iface").alias("p_iface"), "impl", order.alias("p_path"), short_name(F.col("iface")).alias("p_short"))
    n = names.select(F.col(name).alias("n")).distinct()
    exact = n.join(p, F.col("n") == F.col("p_iface")).select("n", "impl", "p_path", F.lit(0).alias("tier"))
    short = n.join(p, short_name(F.col("n")) == F.col("p_short")).select("n", "impl", "p_path", F.lit(1).alias("tier"))
    own = Window.partitionBy("n").orderBy("tier", "p_path", "impl")
    best = exact.unionByName(short).withColumn("r", F.row_number().over(own)).where("r = 1")
    return n.join(best.select("n", "impl"), "n", "left").select(F.col("n").alias(name), "impl")


def reach(edges: DataFrame, start: DataFrame, depth: int, source: str = "source", target: str = "target") -> DataFrame:
    """start, node, depth: nodes within so many steps, each with its least depth. Seen nodes are not walked again."""
    e = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).distinct()
    e = checkpointed(e) if depth > 1 else e
    level = checkpointed(start.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).distinct())
    seen = level
    for d in range(1, depth + 1):
        level = level.join(e, F.col("node") == F.col("__s")).select("start", F.col("__t").alias("node"), F.lit(d).cast("long").alias("depth")).distinct()
        level = checkpointed(level.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def call_chain(calls: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """depth, caller, callee, trail: calls below a start, with the path that leads there; a method may come again."""
    c = calls.select(F.col("caller").alias("__c"), "callee")
    level = start.select("method", F.col("method").alias("trail"))
    out = []
    for d in range(1, depth + 1):
        level = level.join(c, F.col("method") == F.col("__c")).select(F.lit(d).cast("long").alias("depth"), F.col("method").alias("caller"), "callee", F.concat_ws(" > ", "trail", "callee").alias("trail"))
        out.append(level)
        level = level.select(F.col("callee").alias("method"), "trail")
    return reduce(DataFrame.unionByName, out).distinct()


def ancestors(parents: DataFrame, depth: int = 10) -> DataFrame:
    """fqcn, ancestor, depth along whole names of parents (fqcn, parent); nobody is its own ancestor."""
    edges = parents.select(F.col("fqcn").alias("source"), F.col("parent").alias("target"))
    found = reach(edges, parents.select(F.col("fqcn").alias("node")).distinct(), depth)
    return found.where("depth > 0").select(F.col("start").alias("fqcn"), F.col("node").alias("ancestor"), "depth")


def class_paths(names: DataFrame, classes: DataFrame, name: str = "name") -> DataFrame:
    """name, fqcn, path: the class of each name: the whole name goes before the short one, then the first path decides."""
    c = classes.select("fqcn", "path", short_name(F.col("fqcn")).alias("c_short"))
    n = names.select(F.col(name).alias("n")).distinct().withColumn("bare", F.regexp_replace("n", r"^\\+", ""))
    exact = n.join(c, F.col("bare") == F.col("fqcn")).select("n", "fqcn", "path", F.lit(0).alias("tier"))
    short = n.join(c, short_name(F.col("bare")) == F.col("c_short")).select("n", "fqcn", "path", F.lit(1).alias("tier"))
    own = Window.partitionBy("n").orderBy("tier", "path", "fqcn")
    best = exact.unionByName(short).withColumn("r", F.row_number().over(own)).where("r = 1")
    return best.select(F.col("n").alias(name), "fqcn", "path")


def defining_classes(asked: DataFrame, up: DataFrame, methods: DataFrame) -> DataFrame:
    """fqcn, method, defined_in, path: where a method of a class (fqcn, method) is defined: in itself or its nearest ancestor.

    up: what ancestors() gives; methods: fqcn, method, path.
    """
    a = asked.select("fqcn", "method").distinct()
    where = a.select("fqcn", "method", F.col("fqcn").alias("defined_in"), F.lit(0).cast("long").alias("depth")).unionByName(a.join(up, "fqcn").select("fqcn", "method", F.col("ancestor").alias("defined_in"), "depth"))
    m = methods.select(F.col("fqcn").alias("defined_in"), "method", "path").distinct()
    own = Window.partitionBy("fqcn", "method").orderBy("depth", "defined_in", "path")
    return where.join(m, ["defined_in", "method"]).withColumn("r", F.row_number().over(own)).where("r = 1").select("fqcn", "method", "defined_in", "path")


def calls(files: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """path, method, kind (self or dependency), property, callee, type_hint: calls on the object itself and on its
    properties inside methods; a property's type is that of the constructor's parameter of its name, in the class or else
    in its nearest ancestor that has one. up: what ancestors() gives, where it is known."""
    src = files.where(F.col("path").endswith(".php"))
    inside = enclosing(lines(src), reach=200).where(F.col("method").isNotNull() & F.col("text").contains("$this->")).select("path", "line", "method", "text")
    all_of = lambda p, k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
    own = inside.select("path", "method", F.explode(all_of(r"\$this->(\w+)\s*\(", 1)).alias("callee"))
    own = own.where((F.col("callee") != F.col("method")) & (F.col("callee") != "__construct"))
    pair = F.explode(F.arrays_zip(all_of(UNCHECKED_CHAIN, 1).alias("p"), all_of(UNCHECKED_CHAIN, 2).alias("m")))
    other = inside.select("path", "method", pair.alias("c")).select("path", "method", F.col("c.p").alias("property"), F.col("c.m").alias("callee"))
    c = extract.classes(src).select("path", "fqcn")
    given = extract.ctor_params(src).select("path", F.col("variable").alias("property"), "type_hint")
    up = ancestors(extract.resolved_parents(src)) if up is None else up
    above = c.join(up, "fqcn").select("path", F.col("ancestor").alias("fqcn"), "depth").join(c.withColumnRenamed("path", "from"), "fqcn").join(given.withColumnRenamed("path", "from"), "from")
    typed = given.withColumn("depth", F.lit(0).cast("long")).unionByName(above.select("path", "property", "type_hint", "depth"))
    best = Window.partitionBy("path", "property").orderBy("depth", "type_hint")
    typed = typed.withColumn("r", F.row_number().over(best)).where("r = 1").select("path", "property", "type_hint")
    dependency = other.join(typed, ["path", "property"], "left").select("path", "method", F.lit("dependency").alias("kind"), "property", "callee", "type_hint")
    none = F.lit(None).cast("string")
    return own.select("path", "method", F.lit("self").alias("kind"), none.alias("property"), "callee", none.alias("type_hint")).unionByName(dependency).distinct()


def traced_calls(files: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """depth, class, method, status, defined_in, trail: what methods (class, method) call, step by step.

    Calls on the object itself are followed to the last level, calls on properties, by their type or its preference, one
    level less far. A method that an ancestor defines is found there. status: found, unresolved or method_not_found. The
    same method may come again on another trail.
    """
    src = files.where(F.col("path").endswith(".php"))
    c = checkpointed(extract.classes(src))
    m = checkpointed(extract.methods(src).select("path", "method").distinct().join(c.select("path", "fqcn"), "path").select("fqcn", "method", "path"))
    up = checkpointed(ancestors(extract.resolved_parents(src)))
    every = checkpointed(calls(files, up))
    bound = checkpointed(extract.preferences(files))
    level = start.select("class", "method", F.concat_ws("::", "class", "method").alias("trail"))
    out = []
    for d in range(depth + 1):
        level = checkpointed(level.distinct())
        known = class_paths(level, c, "class").select("class", "fqcn")
        named = level.join(known, "class", "left")
        where = defining_classes(named.where(F.col("fqcn").isNotNull()), up, m)
        rows = checkpointed(named.join(where, ["fqcn", "method"], "left"))
        status = F.when(F.col("fqcn").isNull(), "unresolved").when(F.col("defined_in").isNull(), "method_not_found").otherwise("found")
        out.append(rows.select(F.lit(d).cast("long").alias("depth"), "class", "method", status.alias("status"), "defined_in", "trail"))
        if d == depth:
            break
        below = rows.where(F.col("path").isNotNull()).join(every, ["path", "method"])
        step = below.where("kind = 'self'").select("class", F.col("callee").alias("method"), "trail")
        if d < depth - 1:
            named = below.where((F.col("kind") == "dependency") & F.col("type_hint").isNotNull())
            impl = resolved(named.select(F.col("type_hint").alias("iface")), bound).withColumnRenamed("iface", "type_hint")
            step = step.unionByName(named.join(impl, "type_hint", "left").select(F.coalesce("impl", "type_hint").alias("class"), F.col("callee").alias("method"), "trail"))
        level = step.select("class", "method", F.concat_ws(" > ", "trail", F.concat_ws("::", "class", "method")).alias("trail"))
    return reduce(DataFrame.unionByName, out)


def implementors(classes: DataFrame, preferences: DataFrame, interface: str) -> DataFrame:
    """name, match_type: classes that name the interface, and types that a preference gives it."""
    short = interface.rsplit("\\", 1)[-1]
    listed = classes.where(F.array_contains(F.transform(F.split("interfaces", r"\s*,\s*"), lambda x: short_name(x)), short)).select(F.col("fqcn").alias("name"), F.lit("implements").alias("match_type"))
    given = preferences.where(short_name(F.col("iface")) == short).select(F.col("impl").alias("name"), F.lit("preference").alias("match_type"))
    return listed.unionByName(given).distinct()


def impact(target: str, preferences: DataFrame, plugins: DataFrame, ctor_params: DataFrame, observers: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, n: how many references of each kind a class has, and of all kinds (total)."""
    short = target.rsplit("\\", 1)[-1]
    parts = [
        ("preference", preferences.where((short_name(F.col("impl")) == short) | (short_name(F.col("iface")) == short))),
        ("plugin", plugins.where(short_name(F.col("target")) == short)),
        ("constructor", ctor_params.where(short_name(F.col("type_hint")) == short)),
        ("observer", observers.where(short_name(F.col("instance")) == short)),
        ("subclass", classes.where(short_name(F.col("parent")) == short)),
    ]
    every = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "path") for k, df in parts])
    return every.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def event_flow(dispatches: DataFrame, observers: DataFrame) -> DataFrame:
    """event, dispatched_in, observer, instance, method: who raises and who hears; either may be absent."""
    d = dispatches.select("event", F.col("path").alias("dispatched_in")).distinct()
    return d.join(observers.select("event", F.col("name").alias("observer"), "instance", "method"), "event", "full_outer")


def api_trace(routes: DataFrame, preferences: DataFrame, plugins: DataFrame) -> DataFrame:
    """url, http_method, service_class, service_method, impl, plugins of each route."""
    impl = resolved(routes.select(F.col("service_class").alias("iface")), preferences)
    hooks = plugins.where(~F.col("disabled")).groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("plugins"))
    return routes.join(impl.withColumnRenamed("iface", "service_class"), "service_class", "left").join(hooks.withColumnRenamed("target", "service_class"), "service_class", "left").select("url", "http_method", "service_class", "service_method", "impl", "plugins")


def api_bodies(files: DataFrame, most: int = 60) -> DataFrame:
    """url, http_method, impl, path, body: the method that answers each route, where its class is in the tree."""
    r = extract.routes(files)
    traced = api_trace(r, extract.preferences(files), extract.plugins(files))
    named = traced.withColumn("class", F.coalesce("impl", "service_class"))
    where = class_paths(named, extract.classes(files), "class").select("class", F.col("path").alias("at"))
    rows = named.join(where, "class").join(files.select(F.col("path").alias("at"), "content"), "at")
    return rows.select("url", "http_method", "impl", F.col("at").alias("path"), method_body(F.col("content"), F.col("service_method"), most).alias("body"))


def config_consumers(files: DataFrame, fields: DataFrame) -> DataFrame:
    """config_path, path, class, constant: PHP files that write a configuration path as a string."""
    src = files.where(F.col("path").endswith(".php"))
    strings = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"['\"](\w+/\w+/\w+)['\"]"), F.lit(1))))
    used = src.select("path", "content", strings.alias("config_path")).join(fields.select("config_path").distinct(), "config_path")
    first = extract.classes(src).groupBy("path").agg(F.min("fqcn").alias("class"))
    used = used.withColumn("pattern", F.concat(F.lit(r"(\w+)\s*=\s*['\"]"), F.col("config_path"), F.lit(r"['\"]")))
    constant = F.expr("regexp_extract(content, pattern, 1)")
    return used.select("config_path", "path", F.nullif(constant, F.lit("")).alias("constant")).join(first, "path", "left").select("config_path", "path", "class", "constant")


def config_trace(fields: DataFrame, values: DataFrame) -> DataFrame:
    """config_path, label, env, scope, value: fields with the values of each environment, and values without a field."""
    return fields.select("config_path", "label").join(values, "config_path", "full_outer")


def trace_summary(trail: str = "trail"):
    """Steps of a trail in one line."""
    return F.regexp_replace(trail, " > ", " -> ")
