"""The registered queries: each operator over whole driver tables, or over the inline code tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.functions.embed import HashingEmbedder
from quarry.functions.vectors import is_valid
from quarry.operators import extract, filters, graph, indexing, learning, lines, maintenance, metrics, retrieval
from quarry.plans import fixtures as X
from quarry.sources.files import globbed
from quarry.sources.store import stats
from quarry.sources.tables import corpus, metadata, query_vector, read, searches, vectors
from quarry.streaming.signals import windowed_counts as windowed
from quarry.tools import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TEXT_QUERY = "the and label_2"
BM25_QUERY = "the ation der que"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*X.FILES.items()], "path string, content string")


def results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.RESULTS, "qid long, id long, path string, type string, component_type string, module string, score double, is_plugin boolean, is_controller boolean")


# Retrieval


@query
def vector_topk(spark, sf_dir):
    top = retrieval.nearest(read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), query_vector(spark, sf_dir), 10)
    return retrieval.ranked(top.select("id", "similarity"), [F.desc("similarity"), F.col("id")])


@query
def vector_topk_batch(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.batch_nearest(rows.select(F.col("vec_id").alias("id"), "embedding"), asked, 5)


@query
def vector_validity(spark, sf_dir):
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("label", is_valid(v, 64).alias("ok")).groupBy("label").agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"))


@query
def hybrid_search(spark, sf_dir):
    return retrieval.hybrid_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), TEXT_QUERY, 10, metadata=metadata(spark, sf_dir))


@query
def keyword_bonus(spark, sf_dir):
    rows = metadata(spark, sf_dir).join(vectors(spark, sf_dir).drop("embedding"), "id")
    return rows.select("id", F.round(retrieval.keyword_bonus(rows, TEXT_QUERY), 6).alias("bonus"))


@query
def type_bonus(spark, sf_dir):
    """Every rule of the bonus over rows that fit it and rows that nearly do."""
    names = "id long, path string, search_text string, class_name string, component_type string, is_plugin boolean, is_repository boolean, is_observer boolean, is_resolver boolean"
    rows = spark.createDataFrame(X.INDEX, names)
    out = None
    for q in X.BONUS_QUERIES:
        one = rows.select(F.lit(q).alias("q"), "id", F.round(retrieval.keyword_bonus(rows, q), 6).alias("bonus"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def vector_insert(spark, sf_dir):
    """New rows behind an index: ids go on by path, invalid vectors are dead."""
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("path"), F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("embedding"), (F.col("vec_id") % 2).alias("half"))
    first = maintenance.inserted(None, rows.where("half = 0").drop("half"), 64)
    return maintenance.inserted(first, rows.where("half = 1").drop("half"), 64).select("id", "path", "is_deleted")


@query
def bm25_score(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.round(text.bm25(F.col("content"), text.query_terms(BM25_QUERY)), 6).alias("bm25"))


@query
def bm25_rerank(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", F.col("content").alias("search_text"), (1 / (1 + F.col("doc_id"))).alias("score"))
    scored = retrieval.bm25_rerank(rows, BM25_QUERY).select("id", F.round("score", 6).alias("score"))
    return retrieval.ranked(scored.orderBy(F.desc("score"), "id").limit(20), [F.desc("score"), F.col("id")])


@query
def metadata_boost(spark, sf_dir):
    return retrieval.metadata_boost(results(spark), file_type="php", path_contains=("/Plugin/",), flags=("is_plugin",), component_type="controller").select("qid", "id", "path", F.round("score", 6).alias("score"))


@query
def rank_badges(spark, sf_dir):
    rows = results(spark).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("long"))
    rows = rows.withColumn("search_text", F.col("path"))
    return retrieval.formatted(rows, snippet=12, verbose=1)


# Scalars


@query
def component_type(spark, sf_dir):
    urls = read(spark, sf_dir, "pages").select(F.concat(F.lit("x"), F.coalesce("url", F.lit(""))).alias("path"))
    every = code(spark).select("path").unionByName(urls)
    return every.select("path", paths.component_type(F.col("path")).alias("component_type"), paths.file_type(F.col("path")).alias("file_type"))


@query
def module_name(spark, sf_dir):
    return code(spark).select("path", paths.module(F.col("path")).alias("module"))


@query
def area(spark, sf_dir):
    return code(spark).select("path", paths.area(F.col("path")).alias("area"), paths.di_area(F.col("path")).alias("di_area"))


@query
def entry_type(spark, sf_dir):
    return spark.createDataFrame(X.ENTRIES, "id long, entry string").select("id", paths.entry_type(F.col("entry")).alias("kind"))


@query
def camel_split(spark, sf_dir):
    return spark.createDataFrame(X.NAMES, "id long, name string").select("id", text.split_camel(F.col("name")).alias("words"))


@query
def normalize_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.normalize_terms(F.col("text")), " ").alias("terms"))


@query
def query_expansion(spark, sf_dir):
    return spark.createDataFrame(X.QUERIES, "id long, q string").select("id", text.expand_query(F.col("q")).alias("expanded"))


@query
def content_hash(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("hash"))


# Filters and set operations


@query
def precise_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.precise(F.col("content"), "idiot ab secret")).select("doc_id")


@query
def module_include(spark, sf_dir):
    rows = results(spark).select("qid", "id", "path", "module")
    return filters.include_modules(rows, ["acme/*", "Other_Cart"]).select("qid", "id")


@query
def module_exclude(spark, sf_dir):
    return filters.exclude_modules(results(spark), "acme/*").select("qid", "id")


@query
def soft_filter(spark, sf_dir):
    return filters.soft_filter(results(spark), F.col("is_plugin"), ["qid"]).select("qid", "id", "score")


@query
def fallback_concat(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return filters.fallback(rows, F.col("lang") == "es", F.col("lang") == "de", ["source"], 3).select("doc_id", "source", F.col("tier").cast("long").alias("tier"))


@query
def dedup_max_score(spark, sf_dir):
    return results(spark).groupBy("path").agg(F.max("score").alias("score"))


@query
def dedup_first(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return filters.best_per(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query
def union_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tiers = docs.where("lang = 'en'").select("doc_id", F.lit(1).alias("src")).unionByName(docs.where("n_chars > 1000").select("doc_id", F.lit(2).alias("src")))
    return tiers.groupBy("doc_id").agg(F.min("src").cast("long").alias("src"))


@query
def category_counts(spark, sf_dir):
    c = F.coalesce("text", F.lit(""))
    kinds = {"secret": c.contains("password") | c.contains("token"), "long": F.length(c) > 3000, "digits": c.rlike("[0-9]"), "lines": c.contains("\n")}
    flags = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in kinds.items())))
    return read(spark, sf_dir, "documents").select("source", F.explode(flags).alias("category")).groupBy("source", "category").agg(F.count("*").alias("n"))


@query
def class_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.sum("n_chars").alias("chars"))


@query
def grouped_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))


@query
def caller_sets(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


# Lines and windows


@query
def grep_lines(spark, sf_dir):
    return lines.grep(corpus(spark, sf_dir), "(password|token|AKIA)[ =A-Z0-9]").select("path", "line")


@query
def grep_files_only(spark, sf_dir):
    return lines.matching_files(corpus(spark, sf_dir), "idiot|[0-9]{9}")


@query
def grep_include(spark, sf_dir):
    return lines.grep(code(spark), "PUBLIC function", include="[!a-z]*, C*.{php, phtml}, ?ase.php", ignore_case=True).select("path", "line")


@query
def grep_context(spark, sf_dir):
    """Ranges of lines around matches below a folder."""
    return lines.with_context(code(spark), lines.grep(code(spark), "getCustomer|function (count|save)", scope="app/code/Acme"), 2)


@query
def context_merge(spark, sf_dir):
    return lines.merged_ranges(lines.grep(corpus(spark, sf_dir), "the"), 2)


@query
def context_window(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), "text")
    return lines.context_text(rows, 1, 1).select(F.col("path").alias("conv_id"), F.col("line").alias("turn"), F.length("context").cast("long").alias("context_chars"))


@query
def enclosing_method(spark, sf_dir):
    return lines.enclosing(lines.lines(code(spark)).where(F.col("path").endswith(".php"))).where(F.col("text").contains("->")).select("path", "line", "method")


@query
def cap_per_file(spark, sf_dir):
    return lines.capped(lines.grep(corpus(spark, sf_dir), "and"), ["path"], 5, [F.col("line")]).select("path", "line")


@query
def read_range(spark, sf_dir):
    return lines.read_range(code(spark), "app/code/Acme/Shop/Model/Cart.php", 9, 20).select("line", "text")


@query
def method_chains(spark, sf_dir):
    return lines.method_chains(code(spark))


@query
def null_risks(spark, sf_dir):
    return lines.null_risks(lines.method_chains(code(spark)))


@query
def set_null_calls(spark, sf_dir):
    return lines.located(code(spark), lines.NULL_CALL, {"setter": 1}).select("path", "line", "setter")


@query
def unchecked_chains(spark, sf_dir):
    return lines.located(code(spark), lines.UNCHECKED_CHAIN, {"property": 1, "callee": 2}).select("path", "line", "property", "callee")


@query
def method_body(spark, sf_dir):
    """Whole methods and the first lines of methods."""
    rows = code(spark).where(F.col("path").endswith("Cart.php") | F.col("path").endswith("Many.php"))
    return rows.select("path", F.explode(F.array(*map(F.lit, ("load", "save", "make", "later", "none")))).alias("method"), "content").select("path", "method", lines.method_body(F.col("content"), F.col("method")).alias("body"), lines.method_body(F.col("content"), F.col("method"), 3).alias("cut"), lines.method_snippet(F.col("content"), F.col("method"), 2).alias("snippet"))


@query
def complexity(spark, sf_dir):
    return lines.complexity(code(spark), 2)


# Extractors


def _extract(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(code(spark))

    run.__name__ = name
    query(run)


for _name, _f in {
    "di_preferences": extract.preferences,
    "di_plugins": extract.plugins,
    "virtual_types": extract.virtual_types,
    "di_arguments": extract.di_arguments,
    "event_observers": extract.observers,
    "webapi_routes": extract.routes,
    "layout_nodes": extract.layout_nodes,
    "fieldsets": extract.fieldsets,
    "system_fields": extract.system_fields,
    "graphql_ops": extract.graphql_ops,
    "php_classes": extract.classes,
    "php_imports": extract.imports,
    "php_parents": extract.resolved_parents,
    "php_methods": extract.methods,
    "php_params": extract.method_params,
    "php_properties": extract.properties,
    "class_roles": extract.class_roles,
    "plugin_methods": extract.plugin_methods,
    "ctor_params": extract.ctor_params,
    "event_dispatches": extract.dispatches,
    "sql_tables": extract.sql_tables,
    "setup_tables": extract.setup_tables,
    "db_triggers": extract.db_triggers,
    "test_methods": extract.test_methods,
    "js_modules": extract.js_modules,
    "js_exports": extract.js_exports,
}.items():
    _extract(_name, _f)


@query
def error_classify(spark, sf_dir):
    return extract.errors(spark.createDataFrame(X.ERRORS, "id long, error string")).select("id", "error_type", "subject", "frames")


@query
def html_attr_extract(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("href").alias("first_href"))


@query
def url_routes(spark, sf_dir):
    part = lambda k: F.regexp_extract("url", r"^(https?)://([^/?#]+)/?([^/?#]*)", k)
    return read(spark, sf_dir, "pages").groupBy(part(1).alias("scheme"), part(3).alias("first")).agg(F.count("*").alias("n"))


# Graphs


@query
def preference_resolve(spark, sf_dir):
    c = code(spark)
    return graph.resolved(extract.routes(c).select(F.col("service_class").alias("iface")), extract.preferences(c))


@query
def inheritance_resolve(spark, sf_dir):
    return graph.ancestors(extract.resolved_parents(code(spark)))


@query
def class_lookup(spark, sf_dir):
    """Names to classes: whole names, short names, unknown ones."""
    names = spark.createDataFrame([("Acme\\Shop\\Model\\Base",), ("\\Acme\\Other\\Base",), ("Base",), ("Elsewhere\\Cart",), ("Nothing",)], "name string")
    return graph.class_paths(names, extract.classes(code(spark)))


@query
def inherited_methods(spark, sf_dir):
    c = code(spark)
    classes = extract.classes(c)
    own = extract.methods(c).select("path", "method").join(classes.select("path", "fqcn"), "path").select("fqcn", "method", "path")
    asked = spark.createDataFrame([("Acme\\Shop\\Model\\Leaf", m) for m in ("start", "shared", "top", "missing")], "fqcn string, method string")
    return graph.defining_classes(asked, graph.ancestors(extract.resolved_parents(c)), own)


@query
def typed_calls(spark, sf_dir):
    return graph.calls(code(spark))


@query
def traced_calls(spark, sf_dir):
    return graph.traced_calls(code(spark), spark.createDataFrame([("Leaf", "start"), ("Gone", "x")], "class string, method string"), 3)


@query
def chain_depth(spark, sf_dir):
    """How deep the calls below each start go."""
    traced = graph.traced_calls(code(spark), spark.createDataFrame([("Leaf", "start"), ("Cart", "save")], "class string, method string"), 2)
    return traced.groupBy(F.element_at(F.split("trail", " > "), 1).alias("start")).agg(F.max("depth").alias("depth"))


@query
def first_per_file(spark, sf_dir):
    """The first line of each document that holds a digit."""
    return filters.best_per(lines.grep(corpus(spark, sf_dir), "[0-9]"), ["path"], [F.col("line")]).select("path", "line")


@query
def api_bodies(spark, sf_dir):
    return graph.api_bodies(code(spark))


@query
def config_consumers(spark, sf_dir):
    c = code(spark)
    return graph.config_consumers(c, extract.system_fields(c))


@query
def search_rows(spark, sf_dir):
    """What an index knows of each file, with descriptions of some."""
    known = spark.createDataFrame([("app/code/Acme/Shop/Helper/Text.php", "Cuts texts.")], "path string, description string")
    rows = indexing.index_rows(code(spark), known)
    flags = F.array_join(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c[3:])) for c in sorted(x for x in rows.columns if x.startswith("is_"))))), ",")
    return rows.select("path", "type", "component_type", "class_name", "class_type", "namespace", "extends", F.array_join("implements", ",").alias("implements"), F.array_join("methods", ",").alias("methods"), "method_name", flags.alias("flags"))


@query
def search_texts(spark, sf_dir):
    """The search text and embedded text of files of each kind."""
    known = spark.createDataFrame([("app/code/Acme/Shop/Helper/Text.php", "Cuts texts.")], "path string, description string")
    rows = indexing.index_rows(code(spark), known)
    some = rows.where(F.col("path").endswith("Helper/Text.php") | F.col("path").endswith("frontend/di.xml") | F.col("path").endswith("node.js"))
    return some.select("path", "search_text", "embed_text")


@query
def call_chain(spark, sf_dir):
    calls = spark.createDataFrame(X.CALLS, "caller string, callee string")
    return graph.call_chain(calls, spark.createDataFrame([("Cart::save",)], "method string"), 3)


@query
def region_reach(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    edges = read(spark, sf_dir, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    for name, key, up in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        edges = edges.unionByName(read(spark, sf_dir, name).select(F.concat(F.lit("n"), up).alias("source"), F.concat(F.lit(name[0]), key).alias("target")))
    edges = edges.unionByName(read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target")))
    found = graph.reach(edges, read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 3)
    return found.groupBy("start", "depth").agg(F.count("*").alias("n"))


@query
def implementors(spark, sf_dir):
    c = code(spark)
    return graph.implementors(extract.classes(c), extract.preferences(c), "Acme\\Shop\\Api\\CartInterface")


@query
def impact_counts(spark, sf_dir):
    c = code(spark)
    parts = extract.preferences(c), extract.plugins(c), extract.ctor_params(c), extract.observers(c), extract.classes(c)
    return graph.impact("Acme\\Shop\\Api\\ItemRepositoryInterface", *parts)


@query
def event_flow(spark, sf_dir):
    c = code(spark)
    return graph.event_flow(extract.dispatches(c), extract.observers(c))


@query
def api_trace(spark, sf_dir):
    c = code(spark)
    return graph.api_trace(extract.routes(c), extract.preferences(c), extract.plugins(c))


@query
def config_trace(spark, sf_dir):
    values = spark.createDataFrame(X.CONFIG, "env string, scope string, config_path string, value string")
    return graph.config_trace(extract.system_fields(code(spark)), values)


# Maintenance


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = corpus(spark, sf_dir)
    size = F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return rows.where("doc_id % 10 <> 3").select("path", "size", F.lit(0).alias("mtime")), rows.where("doc_id % 10 <> 7").select("path", size.alias("size"), F.lit(0).alias("mtime"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus(spark, sf_dir).select("doc_id", "path", F.lit(False).alias("is_deleted"))
    return maintenance.tombstoned(index, maintenance.change_set(*_snapshots(spark, sf_dir)))


@query
def change_set(spark, sf_dir):
    return maintenance.change_set(*_snapshots(spark, sf_dir))


@query
def tombstone_ratio(spark, sf_dir):
    return maintenance.tombstone_ratio(_marked(spark, sf_dir))


@query
def compaction(spark, sf_dir):
    return maintenance.compacted(_marked(spark, sf_dir)).select("doc_id")


@query
def index_counters(spark, sf_dir):
    """Documents by language, and what became of them in an index that lacks some."""
    files = corpus(spark, sf_dir)
    kept = _marked(spark, sf_dir).where("doc_id % 4 <> 1")
    return maintenance.index_counters(files, kept, F.element_at(F.split("path", "/"), 2))


@query
def windowed_counts(spark, sf_dir):
    """Calls in event-time windows of an hour."""
    return windowed(searches(spark, sf_dir).where("tool is not null")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool", "n")


@query
def index_stats(spark, sf_dir):
    return stats(_marked(spark, sf_dir))


@query
def resume_pending(spark, sf_dir):
    old, _ = _snapshots(spark, sf_dir)
    return maintenance.pending(corpus(spark, sf_dir).select("doc_id", "path"), old).select("doc_id")


@query
def latest_description(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return maintenance.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query
def stale_descriptions(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    known = docs.select("path", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.sha2("content", 256)).alias("hash"))
    return maintenance.described(docs, known).groupBy("stale").agg(F.count("*").alias("n"))


# Learning


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.signals(searches(spark, sf_dir), "6 hours", "6 hours")


@query
def signal_gates(spark, sf_dir):
    """The gates as they are used, 30 and 60 seconds: a call on the second of the gate is too late."""
    calls = spark.createDataFrame(X.GATE_CALLS, "user_id long, event_id long, ts string, tool string, k long").withColumn("ts", F.col("ts").cast("timestamp"))
    return learning.signals(calls).select("user_id", "event_id", "signal", "search_id")


@query
def session_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("user_id", "event_id", "signal", "search_id")


@query
def signal_features(spark, sf_dir):
    return _signals(spark, sf_dir).withColumn("feature", learning.feature(F.col("signal"))).groupBy("signal", "feature").agg(F.count("*").alias("n"))


def _learned(spark: SparkSession, sf_dir: str):
    return learning.learned(_signals(spark, sf_dir).withColumn("query", F.concat_ws(" ", F.lit("query"), F.lit("Term"), F.concat(F.lit("kind"), (F.col("k") % 7).cast("string")))))


@query
def pattern_weights(spark, sf_dir):
    """Weights of each pattern, told by its size, since engines hash patterns each in its way."""
    return _learned(spark, sf_dir)[0].groupBy("feature").agg(F.count("*").alias("n_patterns"), F.sum("n").alias("n_updates"), F.round(F.max("weight"), 6).alias("most"), F.round(F.min("weight"), 6).alias("least"), F.round(F.sum(F.col("weight") * F.col("n")), 4).alias("weighted"))


@query
def term_weights(spark, sf_dir):
    return _learned(spark, sf_dir)[1].select("term", "feature", F.round("weight", 6).alias("weight"), "n")


@query
def global_weights(spark, sf_dir):
    return _learned(spark, sf_dir)[2].select("feature", F.round("weight", 6).alias("weight"), "n")


@query
def learned_adjustment(spark, sf_dir):
    """Results of several queries moved by what was learned: the tables of weights joined by pattern, term and feature."""
    queries = spark.createDataFrame([(1, "kind3 term query"), (2, "TERM kind5 other"), (3, "unknown words")], "query_id long, query string")
    rows = results(spark).select(F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("query_id"), (F.col("qid") * 100 + F.col("id")).alias("id"), "path", "type", "component_type", "is_plugin", "is_controller").dropDuplicates(["query_id", "id"])
    return learning.query_adjustments(queries, rows, *_learned(spark, sf_dir)).select("query_id", "id", F.round("adjustment", 6).alias("adjustment"))


@query
def learning_status(spark, sf_dir):
    return learning.status(*_learned(spark, sf_dir))


@query
def score_adjustment(spark, sf_dir):
    rows = results(spark)
    adj = learning.adjustment(rows, {"is_plugin": 0.10, "config_match": 0.06}, [{"is_plugin": 0.05}, {"is_controller": -0.04, "config_xml_dir": 0.02}], {"is_controller": 0.03, "config_match": -0.01})
    return rows.select("qid", "id", F.round(adj, 6).alias("adjustment"))


# Metrics


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    ranked = docs.select(F.concat_ws("/", "source", "lang").alias("query_id"), "n_chars", "doc_id", "lang", (F.col("quality") == 1).alias("relevant"))
    return ranked.withColumn("rank", F.row_number().over(own)).where("rank <= 10")


@query
def precision_recall(spark, sf_dir):
    return metrics.per_query(_judged(spark, sf_dir), 5).select("query_id", "n", "hits", "precision", "recall", "f1")


@query
def mrr(spark, sf_dir):
    return metrics.per_query(_judged(spark, sf_dir)).select("query_id", "mrr")


@query
def ndcg10(spark, sf_dir):
    return metrics.per_query(_judged(spark, sf_dir)).select("query_id", "ndcg")


@query
def quality_by_category(spark, sf_dir):
    per = metrics.per_query(_judged(spark, sf_dir), 5).withColumn("category", F.element_at(F.split("query_id", "/"), 2))
    return metrics.summary(per, "category").select("category", "n_queries", "precision", "mrr", "grade")


@query
def percentile_latency(spark, sf_dir):
    return metrics.latency(read(spark, sf_dir, "events"), "value")


@query
def relevance(spark, sf_dir):
    """Which results fit the conditions of a query, and how well."""
    rows = results(spark).withColumn("class_name", F.regexp_extract("path", r"([A-Z]\w*)\.php$", 1)).withColumn("content", F.concat(F.lit("class "), "class_name", F.lit(" has a cart")))
    out = None
    for i, conditions in enumerate(X.CONDITIONS):
        one = rows.select(F.lit(i).cast("long").alias("case_id"), "qid", "id", metrics.relevant(rows, conditions).alias("fits"), F.round(metrics.relevance(rows, conditions), 6).alias("grade"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def pattern_pass(spark, sf_dir):
    return _passed(spark).select("case_id", F.array_join("missed", ",").alias("missed"), "expected_hits", "unexpected_hits", "top_score", "passed")


def _passed(spark: SparkSession) -> DataFrame:
    found = spark.createDataFrame(X.CASE_RESULTS, "case_id long, rank long, text string, score double")
    cases = spark.createDataFrame(X.CASES, "case_id long, expected array<string>, unexpected array<string>, min_score double")
    return metrics.pattern_pass(found, cases)


@query
def missed_patterns(spark, sf_dir):
    return metrics.missed_patterns(_passed(spark))


@query
def diff_risk(spark, sf_dir):
    return lines.diff_risk(spark.createDataFrame(X.DIFFS, "path string, diff string"))


@query
def glob_scan(spark, sf_dir):
    return globbed(code(spark), "**/etc/**/di.xml", "app/code/*/Shop/{Helper,Observer}/*.php", "vendor/**/?iew.php").select("path")


@query
def class_candidates(spark, sf_dir):
    names = ["Acme\\ShopCart\\Model\\Item", "Acme\\Shop", "A\\\\B\\\\C"]
    return spark.createDataFrame([(n, i, p) for n in names for i, p in enumerate(paths.class_candidates(n))], "name string, place long, path string")


@query
def pascal_names(spark, sf_dir):
    return spark.createDataFrame([(1, "price_list"), (2, "sku"), (3, "isoCode_a"), (4, "")], "id long, name string").select("id", text.pascal(F.col("name")).alias("pascal"))


@query
def safe_versions(spark, sf_dir):
    return spark.createDataFrame([(1, "1.2.3"), (2, "1.2.3-beta.1"), (3, "1.2"), (4, "1.2.3; rm"), (5, "v1.2.3")], "id long, v string").select("id", paths.is_version(F.col("v")).alias("ok"))


# Tools over the inline code tree


def _engine(spark: SparkSession) -> Engine:
    config = spark.createDataFrame(X.CONFIG, "env string, scope string, config_path string, value string")
    return Engine(spark, code(spark), HashingEmbedder(64), config=config, diffs=spark.createDataFrame(X.DIFFS, "path string, diff string"))


def _tool(name: str, call: Callable[[Engine], DataFrame], *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = call(_engine(spark))
        return df.select(*columns) if columns else df

    run.__name__ = f"tool_{name}"
    query(run)


_tool("find_class", lambda e: e.find_class("Base"), "fqcn", "path")
_tool("find_method", lambda e: e.find_method("load", "Cart"), "path", "method", "visibility", "body")
_tool("find_plugin", lambda e: e.find_plugin("Acme\\Shop\\Model\\Cart"), "target", "name", "plugin_class", "type", "target_method", "body")
_tool("find_observer", lambda e: e.find_observer("cart_saved"), "name", "instance", "method")
_tool("find_api", lambda e: e.find_api("cart"), "url", "service_method")
_tool("find_graphql", lambda e: e.find_graphql("items"), "op", "resolver_class")
_tool("find_db_schema", lambda e: e.find_db_schema("shop_cart"), "path", "component_type")
_tool("find_trigger", lambda e: e.find_trigger(table="shop_cart"), "name", "event", "timing")
_tool("find_table_usage", lambda e: e.find_table_usage("shop_item"), "path", "usage")
_tool("module_structure", lambda e: e.module_structure("Acme_Shop"), "category", "n")
_tool("analyze_diff", lambda e: e.analyze_diff(), "path", "added", "removed", "risk")
_tool("complexity", lambda e: e.complexity(threshold=3), "path", "complexity", "rating")
_tool("find_fieldset", lambda e: e.find_fieldset(aspect="to_order").select("fieldset", "aspect", F.array_join("fields", ",").alias("fields")))
_tool("trace_shipping_chain", lambda e: e.trace_shipping_chain(), "part", "name", "path", "detail")
_tool("trace_dependency", lambda e: e.trace_dependency("CartInterface"), "kind", "name", "path")
_tool("error_parser", lambda e: e.error_parser("Class A\\B does not exist at x/y.php(7)"), "error_type", "subject", "frames")
_tool("find_layout", lambda e: e.find_layout("cart"), "handle", "kind", "name")
_tool("find_test", lambda e: e.find_test("Acme\\Shop\\Model\\Many"), "path", "test_method")
_tool("find_callers", lambda e: e.find_callers("load", "Leaf"), "path", "line", "method", "names_class")
_tool("find_di_wiring", lambda e: e.find_di_wiring("Cart"), "kind", "subject", "value", "path")
_tool("trace_data_flow", lambda e: e.trace_data_flow("price"), "path", "line", "kind", "method")
_tool("find_event_dispatchers", lambda e: e.find_event_dispatchers("cart_saved"), "path", "line", "method", "n_observers")
_tool("grep", lambda e: e.grep("extends", "*.php", path="app/code/Acme/Shop/Model", files_only=True), "path", "n_matches")
_tool("ast_search", lambda e: e.ast_search("unchecked-chain", path="app/code/Acme/Shop/Model"), "path", "line")
_tool("find_null_risks", lambda e: e.find_null_risks("nine"), "second_method", "n_sites")
_tool("trace_config", lambda e: e.trace_config(keyword="limit"), "config_path", "label", "env", "scope", "value", "consumers")
_tool("read", lambda e: e.read("app/code/Acme/Shop/Model/Cart.php", method="save"), "line", "text")
_tool("stats", lambda e: e.stats(), "n_live", "n_deleted", "n_files")
