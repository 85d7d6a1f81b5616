"""The catalogue of 47 tools over one code tree: every tool gives a DataFrame composed of the operators.

Engine(files) takes path and content; relations are extracted once. Search tools
rank an index of the same files by the embedder's similarity, keyword bonus and term weights.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.functions.embed import HashingEmbedder, embedded
from quarry.operators import extract, filters, graph, indexing, learning, lines, maintenance, retrieval
from quarry.session import checkpointed
from quarry.sources import store

TOOLS: dict[str, str] = {}
#: Roles of a subsystem in a profile.
SUBSYSTEMS = {"checkout": "cart quote totals", "catalog": "product category listing", "search": "search index query", "order": "order sales invoice", "customer": "customer account session", "cache": "cache storage page"}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = (f.__doc__ or "").strip()
    return f


class Engine:
    """files: path, content. Relations and the index are computed once and kept as reliable checkpoints; with a root the
    index is kept there as a versioned table and read again by later engines.

    descriptions: path, description (and hash, ts); diffs: path, diff (and commit, staged); config: env, scope, config_path,
    value; feedback: the three tables of learned weights; adapter: the learned change of query vectors.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, embedder=None, descriptions: DataFrame | None = None, diffs: DataFrame | None = None, config: DataFrame | None = None, feedback: tuple[DataFrame, DataFrame, DataFrame] | None = None, adapter=None, root: str | None = None):
        self.spark, self.files, self.embedder = spark, files, embedder or HashingEmbedder()
        self.descriptions, self.diffs, self.config, self.feedback, self.adapter, self.root = descriptions, diffs, config, feedback, adapter, root
        self._index: DataFrame | None = None
        self._cache: dict[tuple, DataFrame] = {}
        self._relations: dict[str, DataFrame] = {}

    def relation(self, name: str) -> DataFrame:
        """A relation of quarry.operators.extract over the files."""
        if name not in self._relations:
            self._relations[name] = checkpointed(getattr(extract, name)(self.files))
        return self._relations[name]

    # The index

    def _built(self) -> DataFrame:
        known = self.descriptions if self.descriptions is not None and "description" in self.descriptions.columns else None
        rows = embedded(indexing.index_rows(self.files, known), "embed_text", self.embedder).drop("embed_text")
        return maintenance.inserted(None, rows, len(self.embedder([""])[0]))

    @tool
    def index(self, path: str | None = None) -> DataFrame:
        """Rows of the index: path, types, module, names, search text, role flags, vector; of all files or of those below a path."""
        if self._index is None and self.root:
            if not store.versions(self.spark, self.root):
                store.save(self._built(), self.root)
            self._index = store.load(self.spark, self.root)
        elif self._index is None:
            self._index = checkpointed(self._built())
        return self._index.where(lines.under(F.col("path"), path)) if path else self._index

    @tool
    def search(self, query: str, limit: int = 10, modules=None, without=None, expand: bool = True, precise: bool = False) -> DataFrame:
        """Ranked files for a query with their descriptions, module filters, expansion and a precise mode."""
        key = ("search", query, limit, str(modules), str(without), expand, precise)
        if key not in self._cache:
            asked = query if precise or not expand else self._expanded(query)
            rows = self._ranked(asked, max(limit, 200 if modules else 60 if precise else 30))
            rows = retrieval.bm25_rerank(rows, query)
            if precise:
                rows = rows.where(filters.precise(F.concat_ws(" ", "search_text", "class_name", "path", "methods"), query))
            rows = filters.include_modules(rows, modules) if modules else rows
            rows = filters.exclude_modules(rows, without) if without else rows
            top = rows.orderBy(F.desc("score"), "path").limit(limit)
            if len(self._cache) >= 200:
                self._cache.pop(next(iter(self._cache)))
            self._cache[key] = retrieval.ranked(top, [F.desc("score"), F.col("path")])
        return self._cache[key]

    def _expanded(self, query: str) -> str:
        return " ".join([query, *(s for t in query.lower().split() for s in text.SYNONYMS.get(t, ()))])

    def _ranked(self, query: str, fetch: int) -> DataFrame:
        """The best rows by similarity, bonus and what was learned, out of three times as many by similarity alone."""
        vector = np.asarray(self.embedder([query])[0], float)
        vector = self.adapter.adjust(vector) if self.adapter is not None else vector
        learned = None
        if self.feedback is not None:
            known = learning.weights_for(query, *self.feedback)
            learned = lambda df: learning.adjustment(df, *known)
        near = retrieval.reranked(self.index(), [float(x) for x in vector], query, 3 * fetch, learned)
        return near.orderBy(F.desc("score"), "path").limit(fetch)

    def _found(self, query: str, role: Column | None = None, least: int = 1, limit: int = 10, fetch: int = 30, **boosts) -> DataFrame:
        rows = retrieval.metadata_boost(self._ranked(query, fetch), **boosts)
        if role is not None:
            rows = filters.soft_filter(rows.withColumn("__all", F.lit(1)), role, ["__all"], least).drop("__all")
        return retrieval.ranked(rows.orderBy(F.desc("score"), "path").limit(limit), [F.desc("score"), F.col("path")])

    def _with_body(self, rows: DataFrame, method: Column | str) -> DataFrame:
        """rows (path) with the body of a method in their file."""
        return rows.join(self.files.select("path", F.col("content").alias("content_")), "path", "left").withColumn("body", lines.method_body(F.col("content_"), method)).drop("content_")

    @tool
    def find_class(self, class_name: str, namespace: str | None = None) -> DataFrame:
        """Classes by whole, partial or short name, in a namespace or any."""
        rows = self.relation("classes").where(filters.class_matches(F.col("fqcn"), class_name))
        if namespace:
            rows = rows.where(F.lower("fqcn").contains(namespace.lower().strip("\\")))
        return rows.orderBy(F.lower("fqcn") != class_name.lower(), "fqcn", "path")

    @tool
    def find_method(self, method: str, class_name: str | None = None, limit: int = 5) -> DataFrame:
        """Files that define a method, whole names before partial ones and those of the class first, with its body."""
        rows = self.relation("methods").where(F.lower("method").contains(method.lower())).select("path", "method", "visibility").distinct()
        exact = F.lower("method") == method.lower()
        order = [~exact, *([~F.col("path").endswith(f"/{class_name.rsplit(chr(92), 1)[-1]}.php")] if class_name else []), "path", "method"]
        return self._with_body(rows.orderBy(*order).limit(limit), F.col("method")).orderBy(*order)

    @tool
    def find_config(self, query: str, config_type: str | None = None) -> DataFrame:
        """Configuration files for a query."""
        role = F.col("type") == "xml" if not config_type else F.col("component_type").startswith(config_type)
        return self._found(query, role, file_type="xml")

    @tool
    def find_template(self, query: str, area: str | None = None) -> DataFrame:
        """Templates for a query."""
        return self._found(query, (F.col("type") == "template") & (F.lit(area is None) | (F.col("area") == (area or ""))), file_type="template")

    @tool
    def stats(self) -> DataFrame:
        """Live rows and files of the index."""
        return store.stats(self.index())

    @tool
    def find_plugin(self, target: str | None = None, method: str | None = None) -> DataFrame:
        """Declared interceptors of a class, or of classes in a namespace of that name, with their methods and bodies."""
        rows = self.relation("plugins")
        if target:
            rows = rows.where(filters.class_matches(F.col("target"), target) | filters.segment_matches(F.col("target"), target))
        own = self.relation("plugin_methods").select(F.col("path").alias("class_path"), F.regexp_extract("path", r"([^/]+)\.php$", 1).alias("short"), F.col("type"), "target_method")
        out = rows.withColumn("short", paths.short_name(F.col("plugin_class"))).join(own, "short", "left").drop("short")
        out = out.where(F.col("target_method") == method) if method else out
        name = F.concat("type", F.upper(F.substring("target_method", 1, 1)), F.substring("target_method", 2, 1000))
        bodies = self.files.select(F.col("path").alias("class_path"), F.col("content").alias("content_"))
        return out.join(bodies, "class_path", "left").withColumn("body", lines.method_body(F.col("content_"), name)).drop("content_", "class_path")

    @tool
    def find_observer(self, event: str) -> DataFrame:
        """Observers of an event; where none is declared, the files that a search finds for it, with a null name."""
        rows = self.relation("observers").where(F.col("event") == event)
        if not rows.isEmpty():
            return rows
        found = self._found(f"observer {event}", F.col("is_observer") | F.col("path").endswith("events.xml"))
        none = F.lit(None).cast("string")
        return found.select(F.lit(event).alias("event"), none.alias("name"), F.col("class_name").alias("instance"), none.alias("method"), "path")

    @tool
    def find_preference(self, interface: str) -> DataFrame:
        """What an interface is bound to."""
        return self.relation("preferences").where(filters.class_matches(F.col("iface"), interface))

    @tool
    def find_api(self, query: str, method: str | None = None) -> DataFrame:
        """Web routes whose url or service holds the query."""
        rows = self.relation("routes").where(F.lower(F.concat_ws(" ", "url", "service_class", "service_method")).contains(query.lower()))
        return rows.where(F.col("http_method") == method.upper()) if method else rows

    @tool
    def find_controller(self, route: str, area: str | None = None) -> DataFrame:
        """Controllers, those that share most segments with a route first, with the body of execute()."""
        hits = F.lit(0)
        for s in route.strip("/").lower().split("/"):
            hits = hits + F.lower("path").contains(s).cast("int")
        rows = self.index().where(F.col("is_controller") & (F.lit(area is None) | (F.col("area") == (area or ""))))
        top = rows.withColumn("hits", hits).orderBy(F.desc("hits"), "path").limit(20)
        return self._with_body(top.drop("content"), "execute").orderBy(F.desc("hits"), "path")

    @tool
    def find_block(self, query: str) -> DataFrame:
        """View classes for a query."""
        return self._found(query, filters.role("is_block", "/Block/"), flags=("is_block",))

    @tool
    def find_cron(self, job: str) -> DataFrame:
        """Scheduled jobs for a name."""
        return self._found(f"cron {job}", F.col("component_type").isin("crontab_config", "cron"), path_contains=("cron",))

    @tool
    def find_graphql(self, query: str, schema_type: str | None = None) -> DataFrame:
        """Schema operations and their resolvers; of a type (type, input, interface, enum, query, mutation) or all."""
        rows = self.relation("graphql_ops").where(F.lower("op").contains(query.lower()) | F.lower("resolver_class").contains(query.lower()))
        if not schema_type:
            return rows
        name = schema_type.lower()
        head = rf"(?i)\b(?:type\s+{name}|{name}\s+\w+)\b" if name in ("query", "mutation") else rf"(?i)\b{name}\s+\w+"
        return rows.join(self.files.where(F.col("content").rlike(head)).select("path"), "path", "left_semi")

    @tool
    def find_db_schema(self, table: str) -> DataFrame:
        """Files that declare or create a table: declarations first."""
        named = self.index().where(F.col("content").contains(table) & F.col("component_type").isin("db_schema", "setup"))
        return named.select("path", "component_type").orderBy(F.col("component_type") != "db_schema", "path")

    @tool
    def find_trigger(self, name: str | None = None, table: str | None = None) -> DataFrame:
        """Database triggers by name or table."""
        rows = self.relation("db_triggers")
        rows = rows.where(F.col("name") == name) if name else rows
        return rows.where(F.col("table") == table) if table else rows

    @tool
    def find_table_usage(self, table: str) -> DataFrame:
        """Files that use a table, in one of four categories: declarative schema, setup scripts, code, configuration."""
        declared = extract.tags(self.files.where(F.col("path").endswith(".xml")), "table").select("path", extract.attribute(F.col("tag"), "name").alias("table"))
        every = self.relation("sql_tables").unionByName(self.relation("setup_tables").select("path", "table")).unionByName(declared)
        rows = every.where(F.lower("table") == table.lower()).select("path", F.lower("table").alias("table")).distinct()
        p = F.concat(F.lit("/"), F.col("path"))
        setup = p.contains("/Setup/") | p.contains("InstallSchema") | p.contains("UpgradeSchema") | p.contains("/Patch/")
        kind = F.when(p.contains("db_schema.xml"), "schema").when(setup, "setup").when(p.endswith(".php"), "code").when(p.endswith(".xml"), "config").otherwise("other")
        return rows.select("path", "table", kind.alias("usage"))

    @tool
    def module_structure(self, module: str) -> DataFrame:
        """Files of a module by overlapping categories: controllers, models, blocks, plugins, observers, apis, configs, other."""
        rows = self.index().where(filters.in_module(module))
        p = F.concat(F.lit("/"), F.col("path"))
        has = lambda part: p.contains(part)
        known = {
            "controllers": F.col("is_controller") | has("/Controller/"),
            "models": (F.col("is_model") | has("/Model/")) & ~has("ResourceModel"),
            "blocks": F.col("is_block") | has("/Block/"),
            "plugins": F.col("is_plugin") | has("/Plugin/"),
            "observers": F.col("is_observer") | has("/Observer/"),
            "apis": has("/Api/"),
            "configs": F.col("type") == "xml",
        }
        some = known["controllers"] | has("/Model/") | known["blocks"] | known["plugins"] | known["observers"] | known["apis"] | known["configs"]
        flags = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in known.items()), F.when(~some, F.lit("other"))))
        return rows.select(F.explode(flags).alias("category")).groupBy("category").agg(F.count("*").alias("n"))

    @tool
    def analyze_diff(self, commit: str | None = None, staged: bool | None = None) -> DataFrame:
        """Added and removed lines of each file of the given diffs, a risk by size and kind, and all of them together (path
        null): the sums and the greatest risk."""
        if self.diffs is None:
            raise ValueError("the engine has no diffs")
        rows = self.diffs
        rows = rows.where(F.col("commit") == commit) if commit else rows
        rows = rows.where(F.col("staged") == staged) if staged is not None else rows
        each = lines.diff_risk(rows)
        total = each.agg(F.lit(None).cast("string").alias("path"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("risk").alias("risk"))
        return each.unionByName(total)

    @tool
    def complexity(self, threshold: int = 0, top: int = 50, module: str | None = None, path: str | None = None) -> DataFrame:
        """The most complex files, of a module, below a path or of all."""
        rows = self.files.where(lines.under(F.col("path"), path)) if path else self.files
        if module:
            rows = rows.withColumn("module", paths.module(F.col("path"))).where(filters.in_module(module))
        return lines.complexity(rows, threshold).orderBy(F.desc("complexity"), "path").limit(top)

    @tool
    def describe(self, force: bool = False, describer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Files whose description is missing or out of date, or all by force; with a describer, all descriptions after it
        wrote the stale ones."""
        known = self.descriptions if self.descriptions is not None else self.spark.createDataFrame([], "path string, hash string, description string, ts timestamp")
        if describer is None:
            return maintenance.described(self.files, known, force).where("stale")
        return maintenance.redescribed(self.files, known, describer, F.current_timestamp(), force)

    @tool
    def find_fieldset(self, fieldset: str | None = None, aspect: str | None = None) -> DataFrame:
        """Fields of fieldsets by aspect."""
        rows = self.relation("fieldsets")
        rows = rows.where(F.col("fieldset") == fieldset) if fieldset else rows
        rows = rows.where(F.col("aspect") == aspect) if aspect else rows
        return rows.groupBy("fieldset", "aspect").agg(F.array_sort(F.collect_list("field")).alias("fields"))

    @tool
    def trace_shipping_chain(self, carrier: str | None = None) -> DataFrame:
        """part, name, path, detail: carriers, interceptors of what carriers extend or implement with their methods, rate
        modifiers, totals collectors, and the fields that orders take over."""
        rows = self.index().select("path", F.coalesce("class_name", F.lit("")).alias("name"), F.array_join("methods", ",").alias("detail"))
        p = F.concat(F.lit("/"), F.col("path"))
        named = F.lit(True) if not carrier else F.lower(F.concat_ws(" ", "path", "name")).contains(carrier.lower())
        carriers = rows.where((p.contains("/Carrier/") | p.contains("/Model/Carrier")) & named).withColumn("part", F.lit("carrier"))
        hooks = self.relation("plugins").where(paths.short_name(F.col("target")).rlike("AbstractCarrier|CarrierInterface"))
        own = self.relation("plugin_methods").select(F.regexp_extract("path", r"([^/]+)\.php$", 1).alias("short"), F.concat_ws(":", "type", "target_method").alias("m")).groupBy("short").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("detail"))
        hooks = hooks.withColumn("short", paths.short_name(F.col("plugin_class"))).join(own, "short", "left").select(F.lit("plugin").alias("part"), "name", "path", "detail")
        modifiers = rows.where(F.lower("path").contains("modifier")).withColumn("part", F.lit("modifier"))
        totals = rows.where(p.contains("/Total/") | (F.col("name").contains("Shipping") & ~F.lower("path").contains("modifier"))).withColumn("part", F.lit("total"))
        fields = self.relation("fieldsets").where(F.lower(F.concat_ws(" ", "fieldset", "scope")).contains("sales_convert")).select(F.lit("fieldset").alias("part"), F.concat_ws("/", "fieldset", "field").alias("name"), "path", F.col("aspect").alias("detail"))
        out = carriers
        for part in (hooks, modifiers, totals, fields):
            out = out.unionByName(part)
        return out.select("part", "name", "path", "detail")

    @tool
    def trace_flow(self, entry: str, entry_type: str | None = None, depth: str = "shallow") -> DataFrame:
        """What answers an entry point: a web route, event, schema operation, scheduled job or controller. A deep trace of a
        route or controller gives the calls below its method."""
        kind = entry_type if entry_type and entry_type != "auto" else self.spark.range(1).select(paths.entry_type(F.lit(entry)).alias("k")).first()[0]
        if kind == "cron":
            return self.find_cron(entry)
        if kind == "event":
            return self.find_event_flow(entry)
        if kind == "graphql":
            return self.find_graphql(entry)
        rows = self.trace_api(url=entry) if kind == "api" else self.find_controller(entry)
        if depth != "deep":
            return rows
        start = rows.select(F.coalesce("impl", "service_class").alias("class"), F.col("service_method").alias("method")) if kind == "api" else rows.where(F.col("hits") > 0).limit(3).select(F.concat_ws("\\", "namespace", "class_name").alias("class"), F.lit("execute").alias("method"))
        return graph.traced_calls(self.files, start, 2)

    @tool
    def trace_dependency(self, class_name: str, direction: str = "both") -> DataFrame:
        """Bindings, interceptors and constructor uses of a class: what it resolves to, and what depends on it."""
        p, c = self.relation("preferences"), self.relation("ctor_params")
        down = p.where(filters.class_matches(F.col("iface"), class_name)).select(F.lit("resolves_to").alias("kind"), F.col("impl").alias("name"), "path")
        up = c.where(filters.class_matches(F.col("type_hint"), class_name)).select(F.lit("used_by").alias("kind"), F.col("variable").alias("name"), "path")
        up = up.unionByName(self.relation("plugins").where(filters.class_matches(F.col("target"), class_name)).select(F.lit("plugin").alias("kind"), F.col("name"), "path"))
        return down if direction == "resolve" else up if direction == "dependents" else down.unionByName(up)

    @tool
    def error_parser(self, error: str) -> DataFrame:
        """Type, subject and stack frames of an error text."""
        return extract.errors(self.spark.createDataFrame([(error,)], "error string"))

    @tool
    def performance_profile(self, subsystem: str, threshold: int = 0) -> DataFrame:
        """The most complex files of a subsystem."""
        rows = self._found(SUBSYSTEMS.get(subsystem, subsystem), limit=30)
        return rows.join(lines.complexity(self.files), "path", "left").select("path", "score", F.coalesce("complexity", F.lit(0)).alias("complexity"), F.coalesce("rating", F.lit("unknown")).alias("rating")).where(F.col("complexity") >= threshold).orderBy(F.desc("complexity"), "path")

    @tool
    def find_layout(self, query: str | None = None, handle: str | None = None) -> DataFrame:
        """Layout nodes by name or handle."""
        if not query and not handle:
            raise ValueError("query or handle is needed")
        rows = self.relation("layout_nodes")
        rows = rows.where(F.lower("name").contains(query.lower())) if query else rows
        return rows.where(F.col("handle") == handle) if handle else rows

    @tool
    def impact_analysis(self, class_name: str) -> DataFrame:
        """References to a class by kind."""
        return graph.impact(class_name, *map(self.relation, ("preferences", "plugins", "ctor_params", "observers", "classes")))

    @tool
    def find_event_flow(self, event: str) -> DataFrame:
        """Who dispatches an event and who observes it."""
        return graph.event_flow(self.relation("dispatches"), self.relation("observers")).where(F.col("event") == event)

    @tool
    def find_test(self, class_name: str, method: str | None = None) -> DataFrame:
        """Tests of a class by the name of their file or by what they say they cover."""
        short = class_name.rsplit("\\", 1)[-1]
        rows = self.relation("test_methods").where(F.col("path").contains(f"/{short}Test") | F.concat(F.lit(","), "covers", F.lit(",")).rlike(rf"[,\\]\Q{short}\E[,:]"))
        return rows.where(F.lower("test_method").contains(method.lower())) if method else rows

    @tool
    def find_implementors(self, interface: str) -> DataFrame:
        """Classes and bindings of an interface."""
        return graph.implementors(self.relation("classes"), self.relation("preferences"), interface)

    @tool
    def find_callers(self, method: str, class_name: str | None = None) -> DataFrame:
        """Call sites of a method in code and configuration, five a file at most; files that name the class first."""
        short = class_name.rsplit("\\", 1)[-1] if class_name else ""
        src = self.files.where(F.col("content").contains(method)).withColumn("names_class", F.lit(not short) | F.col("content").contains(short))
        sites = lines.enclosing(lines.lines(src)).where(F.col("text").rlike(rf"(->|::)\Q{method}\E\s*\(") | F.col("text").contains(f'method="{method}"'))
        top = lines.capped(sites, ["path"], 5, [F.col("line")]).join(src.select("path", "names_class"), "path")
        return top.select("path", "line", "method", F.trim("text").alias("text"), "names_class").orderBy(~F.col("names_class"), "path", "line")

    @tool
    def find_di_wiring(self, class_name: str) -> DataFrame:
        """All declarations that name a class, by kind."""
        r = self.relation
        parts = [
            r("preferences").select(F.lit("preference").alias("kind"), F.col("iface").alias("subject"), F.col("impl").alias("value"), "path"),
            r("plugins").select(F.lit("plugin").alias("kind"), F.col("target").alias("subject"), F.col("plugin_class").alias("value"), "path"),
            r("virtual_types").select(F.lit("virtual_type").alias("kind"), F.col("name").alias("subject"), F.col("type").alias("value"), "path"),
            r("di_arguments").select(F.lit("argument").alias("kind"), F.col("target").alias("subject"), F.concat_ws("=", F.concat_ws("/", "arg", "item"), F.substring("value", 1, 200)).alias("value"), "path"),
            r("ctor_params").select(F.lit("constructor").alias("kind"), F.col("type_hint").alias("subject"), F.col("variable").alias("value"), "path"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(filters.class_matches(F.col("subject"), class_name) | filters.class_matches(F.col("value"), class_name))

    @tool
    def trace_call_chain(self, class_name: str, method: str, depth: int = 3) -> DataFrame:
        """Calls below a method, through inheritance and bindings, with their trails."""
        return graph.traced_calls(self.files, self.spark.createDataFrame([(class_name, method)], "class string, method string"), depth)

    @tool
    def trace_data_flow(self, attribute: str, model_class: str | None = None) -> DataFrame:
        """The first line of each file and kind that sets, reads or declares an attribute, with its method; files that name
        the model first."""
        pascal = "".join(p[:1].upper() + p[1:] for p in attribute.split("_"))
        short = model_class.rsplit("\\", 1)[-1] if model_class else ""
        src = self.files.where(F.col("content").contains(attribute) | F.col("content").contains(pascal)).withColumn("names_model", F.lit(not short) | F.col("content").contains(short))
        rows = lines.enclosing(lines.lines(src))
        t = F.col("text")
        kind = F.when(t.contains(f"set{pascal}(") | t.rlike(rf"setData\(\s*['\"]{attribute}['\"]"), "setter").when(t.contains(f"get{pascal}(") | t.rlike(rf"getData\(\s*['\"]{attribute}['\"]"), "getter").when(t.rlike(rf"const\s+\w+\s*=\s*['\"]{attribute}['\"]"), "constant").when(F.col("path").endswith(".xml") & t.contains(f'"{attribute}"'), "xml")
        found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
        first = filters.best_per(found, ["path", "kind"], [F.col("line")]).join(src.select("path", "names_model"), "path")
        return first.select("path", "line", "kind", "method", "names_model").orderBy(~F.col("names_model"), "path", "line", "kind")

    @tool
    def find_event_dispatchers(self, event: str) -> DataFrame:
        """Lines that dispatch an event, their method and context, and its number of observers."""
        rows = lines.context_text(lines.enclosing(lines.lines(self.files.where(F.col("content").contains(event)))), 2, 2).where(F.col("text").rlike(rf"dispatch\(\s*['\"]{event}['\"]"))
        heard = self.relation("observers").where(F.col("event") == event).count()
        return rows.select("path", "line", "method", "context", F.lit(heard).cast("long").alias("n_observers"))

    @tool
    def batch(self, queries: list, limit: int = 5) -> dict[str, DataFrame] | DataFrame:
        """Up to ten requests: texts are searched by their vectors in one plan; {"tool", "args"} run that tool, and give a
        frame for each place and name."""
        if len(queries) > 10:
            raise ValueError("at most 10 queries")
        if any(isinstance(q, dict) for q in queries):
            out = {}
            for i, q in enumerate(queries):
                if q["tool"] not in TOOLS or q["tool"] == "batch":
                    raise ValueError(f"no tool {q['tool']} in a batch")
                out[f"{i}:{q['tool']}"] = getattr(self, q["tool"])(**q.get("args", {}))
            return out
        vectors = [(i, [float(x) for x in v]) for i, v in enumerate(self.embedder(queries))]
        asked = self.spark.createDataFrame(vectors, "query_id int, vector array<float>")
        top = retrieval.batch_nearest(self.index().where(~F.col("is_deleted")).select("id", "embedding"), asked, limit)
        return self.index().select("id", "path").join(F.broadcast(top), "id")  # limit rows for each of ten queries

    @tool
    def grep(self, pattern: str, include: str | None = None, ignore_case: bool = False, limit: int = 50, files_only: bool = False, path: str | None = None, context: int | None = None) -> DataFrame:
        """Matching lines, files with their number of matches, or with a context the ranges of lines around matches."""
        found = lines.grep(self.files, pattern, include, ignore_case, path)
        if files_only:
            return found.groupBy("path").agg(F.count("*").alias("n_matches")).orderBy("path").limit(min(limit, lines.MAX_RESULTS))
        if context is None:
            return lines.top_matches(found, limit)
        return lines.with_context(self.files, lines.top_matches(found, limit), context).orderBy("path", "first")

    @tool
    def ast_search(self, pattern: str, limit: int = 50, path: str | None = None) -> DataFrame:
        """Named structural patterns (set-null, unchecked-chain), over lines too: path, line, and what was called."""
        regex = {"set-null": lines.NULL_CALL, "unchecked-chain": lines.UNCHECKED_CHAIN}[pattern]
        src = self.files.where(F.col("path").endswith(".php"))
        src = src.where(lines.under(F.col("path"), path)) if path else src
        return lines.located(src.select("path", "content"), regex, {"text": 1}).drop("content").orderBy("path", "line").limit(min(limit, lines.MAX_RESULTS))

    @tool
    def find_dataobject_issues(self, limit: int = 100, path: str | None = None) -> DataFrame:
        """Setters called with null."""
        return self.ast_search("set-null", limit, path)

    @tool
    def enrich(self, path: str | None = None) -> DataFrame:
        """Chains of method calls with their guards."""
        return lines.method_chains(self.files, path)

    @tool
    def find_null_risks(self, first_method: str | None = None, limit: int = 100) -> DataFrame:
        """Unguarded chains, most sites first."""
        return lines.null_risks(self.enrich(), first_method).orderBy(F.desc("n_sites"), "first_method", "second_method").limit(min(limit, 500))

    @tool
    def trace_api(self, url: str | None = None, interface: str | None = None, method: str | None = None) -> DataFrame:
        """Routes with binding, interceptors and the body that answers them."""
        rows = graph.api_trace(self.relation("routes"), self.relation("preferences"), self.relation("plugins"))
        bodies = graph.api_bodies(self.files).select("url", "http_method", "body")
        rows = rows.join(bodies, ["url", "http_method"], "left")
        rows = rows.where(F.col("url").contains(url)) if url else rows
        rows = rows.where(filters.class_matches(F.col("service_class"), interface)) if interface else rows
        return rows.where(F.col("http_method") == method.upper()) if method else rows

    @tool
    def trace_config(self, config_path: str | None = None, keyword: str | None = None) -> DataFrame:
        """Fields and values of configuration paths in each environment, and the classes that read them (comma-joined)."""
        values = self.config if self.config is not None else self.spark.createDataFrame([], "env string, scope string, config_path string, value string")
        fields = self.relation("system_fields")
        readers = graph.config_consumers(self.files, fields).groupBy("config_path").agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("consumers"))
        rows = graph.config_trace(fields, values).join(readers, "config_path", "left")
        rows = rows.where(F.col("config_path") == config_path) if config_path else rows
        return rows.where(F.lower(F.concat_ws(" ", "config_path", "value")).contains(keyword.lower())) if keyword else rows

    @tool
    def read(self, path: str, start: int = 1, end: int | None = None, method: str | None = None) -> DataFrame:
        """Numbered lines of a file, or those of one method. A path that leaves the tree is refused."""
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"{path} is not below the root")
        one = self.files.where(F.col("path") == path)
        if method:
            parts = F.split("content", "\n")
            first = F.array_position(F.transform(parts, lambda x: x.contains(f"function {method}(")), True)
            body = F.split(lines.method_body(F.col("content"), method), "\n")
            rows = one.where(first > 0).select(first.alias("first"), F.posexplode(body).alias("at", "text"))
            return rows.select((F.col("first") + F.col("at")).cast("long").alias("line"), "text")
        rows = lines.lines(one).where(F.col("line") >= start).select("line", "text")
        return rows.where(F.col("line") <= end) if end is not None else rows


def respond(engine: Engine, line: str, limit: int = 200) -> str:
    """One request as a line of JSON, {"tool": ..., "args": {...}}, to one line: rows, or the error. A request that fails
    does not end the engine."""
    try:
        request = json.loads(line)
        if request["tool"] not in TOOLS:
            raise ValueError(f"no tool {request['tool']}")
        got = getattr(engine, request["tool"])(**request.get("args", {}))
        frames = got if isinstance(got, dict) else {"": got}
        shown = {k: [r.asDict(recursive=True) for r in df.drop("embedding", "content").limit(limit).collect()] for k, df in frames.items()}
        return json.dumps({"ok": True, "data": shown[""] if "" in shown else shown}, default=str)
    except Exception as e:  # noqa: BLE001  whatever it is, the caller hears of it
        return json.dumps({"ok": False, "error": str(e).split("\n")[0]})
