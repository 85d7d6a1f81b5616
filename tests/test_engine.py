from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.functions.embed import HashingEmbedder, unit
from quarry.operators import learning, lines, maintenance, metrics
from quarry.plans import fixtures as X
from quarry.sources import files, store
from quarry.streaming import watch
from quarry.tools import TOOLS, Engine


@pytest.fixture(scope="module")
def engine(spark):
    rows = spark.createDataFrame([*X.FILES.items()], "path string, content string")
    config = spark.createDataFrame(X.CONFIG, "env string, scope string, config_path string, value string")
    diffs = spark.createDataFrame([("a/etc/di.xml", "--- a\n+++ b\n+x\n+y\n-z", "c1", True), ("a/X.php", "+1", "c2", False)], "path string, diff string, commit string, staged boolean")
    return Engine(spark, rows, HashingEmbedder(64), config=config, diffs=diffs)


def test_catalogue_is_whole():
    assert len(TOOLS) == 47


CALLS = [
    ("search", ("cart plugin",), "path"), ("find_class", ("Cart",), "fqcn"), ("find_method", ("load", "Cart"), "method"), ("find_config", ("cart events",), "path"), ("stats", (), "n_live"),
    ("find_plugin", ("Cart",), "name"), ("find_observer", ("cart_saved",), "instance"), ("find_preference", ("CartInterface",), "impl"), ("find_api", ("carts",), "url"), ("find_controller", ("index/view",), "path"),
    ("find_block", ("cart",), "path"), ("find_cron", ("clean",), "path"), ("find_graphql", ("cart",), "op"), ("find_db_schema", ("shop_cart",), "path"), ("find_trigger", ("trg_cart",), "table"), ("find_table_usage", ("shop_cart",), "usage"),
    ("module_structure", ("Acme_Shop",), "n"), ("analyze_diff", (), "risk"), ("complexity", (), "rating"), ("describe", (), "content_hash"), ("find_fieldset", ("convert_cart",), "fields"), ("trace_flow", ("/V1/carts/:id",), "impl"),
    ("trace_flow", ("cart_saved",), "observer"), ("trace_dependency", ("CartInterface",), "kind"), ("error_parser", ("Area code is not set",), "error_type"), ("performance_profile", ("checkout",), "rating"), ("find_layout", ("cart",), "handle"),
    ("impact_analysis", ("Cart",), "n"), ("find_event_flow", ("cart_saved",), "observer"), ("find_test", ("Cart",), "test_method"), ("find_implementors", ("CartInterface",), "match_type"), ("find_callers", ("getCustomer",), "line"),
    ("find_di_wiring", ("Cart",), "kind"), ("trace_call_chain", ("Cart", "load"), "trail"), ("find_event_dispatchers", ("cart_saved",), "n_observers"), ("batch", (["cart", "logger"],), "path"), ("grep", ("namespace",), "line"), ("ast_search", ("set-null",), "line"),
    ("find_dataobject_issues", (), "line"), ("enrich", (), "has_null_guard"), ("find_null_risks", (), "n_sites"), ("trace_api", (), "plugins"), ("trace_config", ("shop/cart/limit",), "value"), ("read", ("app/code/Acme/Shop/Model/Cart.php", 1, 3), "text"), ("trace_data_flow", ("price",), "kind"),
]


@pytest.mark.parametrize("name,args,column", CALLS)
def test_tools(engine, name, args, column):
    rows = getattr(engine, name)(*args).collect()
    assert rows and column in rows[0].asDict()


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_tools_take_all_their_arguments(engine):
    e = engine
    assert rows_of(e.find_class("Base", "Other"), "fqcn") == [("Acme\\Other\\Base",)]
    found = e.find_method("load", "Cart").collect()
    assert (found[0].path, found[0].method) == ("app/code/Acme/Shop/Model/Cart.php", "load") and found[0].body.strip().startswith("public function load") and found[0].body.endswith("}")
    assert {r.target_method for r in e.find_plugin("Cart", "save").collect()} == {"save"}
    assert e.find_plugin("Model").count() and "around" in {r.type for r in e.find_plugin("Cart").collect()}  # a namespace of that name
    assert rows_of(e.find_observer("nothing_hears"), "event", "name")[0] == ("nothing_hears", None)
    assert e.find_graphql("cart", "query").count() == 1 and e.find_graphql("cart", "enum").count() == 0
    total = {r.path: (r.added, r.removed) for r in e.analyze_diff().collect()}
    assert total[None] == (3, 1) and e.analyze_diff("c2").count() == 2 and e.analyze_diff(staged=True).where("path is null").first().added == 2
    assert {r.path.split("/")[0] for r in e.complexity(path="vendor").collect()} == {"vendor"} and all("Acme/Shop" in r.path for r in e.complexity(module="Acme_Shop").collect())
    assert e.describe(force=True).count() == len(X.FILES)
    assert rows_of(e.trace_flow("cart_saved", "event"), "observer") == rows_of(e.find_event_flow("cart_saved"), "observer")
    deep = e.trace_flow("/V1/carts/:id", depth="deep").collect()
    assert ("Acme\\Shop\\Model\\Cart", "load", "found") in {(r["class"], r.method, r.status) for r in deep}
    assert all(r.complexity >= 2 for r in e.performance_profile("checkout", threshold=2).collect())
    callers = e.find_callers("getCustomer", "Cart").collect()
    assert callers and callers[0].names_class and callers[0].method == "load"
    flow = e.trace_data_flow("price", "Cart").collect()
    assert flow[0].path.endswith("Model/Cart.php") and flow[0].names_model and len({(r.path, r.kind) for r in flow}) == len(flow)
    both = e.batch([{"tool": "find_class", "args": {"class_name": "Leaf"}}, {"tool": "grep", "args": {"pattern": "interface", "path": "lib"}}])
    assert both["0:find_class"].count() == 1 and rows_of(both["1:grep"], "path") == [("lib/internal/Acme/Framework/Base.php",)]
    with pytest.raises(ValueError):
        e.batch(["a"] * 11)
    with pytest.raises(ValueError):
        e.batch([{"tool": "batch", "args": {}}])
    ranges = e.grep("getCustomer", "Cart.php", context=1).collect()
    assert [(r.first, r.last) for r in ranges] == [(16, 18)] and "getCustomer" in ranges[0].text
    assert {p for (p,) in rows_of(e.grep("class", "b*.php"), "path")} == {p for p in X.FILES if p.split("/")[-1].startswith("B") and "class" in X.FILES[p]}
    assert rows_of(e.grep("namespace", "Cart.php"), "path") == [("app/code/Acme/Shop/Model/Cart.php",)]
    assert e.ast_search("set-null", path="vendor").count() == 3 and e.find_dataobject_issues(path="app").count() == 1
    body = rows_of(e.read("app/code/Acme/Shop/Model/Cart.php", method="load"), "line", "text")
    assert body[0] == (13, "    public function load($id)") and body[-1][1] == "    }"
    assert rows_of(e.read("app/code/Acme/Shop/Model/Cart.php", 2, 2), "line", "text") == [(2, "namespace Acme\\Shop\\Model;")]
    assert {r.consumers for r in e.trace_config("shop/cart/limit").collect()} == {"Acme\\Shop\\Model\\Sql"}
    assert "load($id)" in e.trace_api(url="carts").first().body
    wired = rows_of(e.find_di_wiring("Acme\\Shop\\Model\\Pool"), "kind", "value")
    assert sorted(wired) == [("argument", "label=Pool"), ("argument", "modifiers/first=Acme\\Shop\\First"), ("argument", "modifiers/second=two")]


def test_requests_as_lines(engine):
    import json

    from quarry.tools import respond

    got = json.loads(respond(engine, '{"tool": "find_class", "args": {"class_name": "Leaf"}}'))
    assert got["ok"] and [r["fqcn"] for r in got["data"]] == ["Acme\\Shop\\Model\\Leaf"]
    for bad in ("{nope", '{"tool": "none"}', '{"tool": "read", "args": {"path": "../x"}}'):
        assert json.loads(respond(engine, bad))["ok"] is False
    assert json.loads(respond(engine, '{"tool": "stats"}'))["data"][0]["n_files"] == len(X.FILES)


def test_module_structure(engine):
    got = dict(rows_of(engine.module_structure("Acme_Shop"), "category", "n"))
    paths = [p for p in X.FILES if p.startswith("app/code/Acme/Shop/")]
    assert got["configs"] == sum(p.endswith(".xml") for p in paths) and got["observers"] == 2 and got["plugins"] == 1
    assert got["models"] == sum("/Model/" in p for p in paths) and "apis" not in got


def test_search_uses_descriptions_weights_and_adapter(spark):
    files_ = spark.createDataFrame([*X.FILES.items()], "path string, content string")
    told = spark.createDataFrame([("app/code/Acme/Shop/Model/Sql.php", "zebra stripes everywhere")], "path string, description string")
    plain = Engine(spark, files_, HashingEmbedder(64))
    known = Engine(spark, files_, HashingEmbedder(64), descriptions=told)
    rank = lambda e: {r.path: r["rank"] for r in e.search("zebra stripes", limit=30).collect()}.get("app/code/Acme/Shop/Model/Sql.php", 99)
    assert rank(known) < rank(plain)
    signals = spark.createDataFrame([(i, i, "refinement_to_plugin", "cart thing") for i in range(9)], "ts long, event_id long, signal string, query string")
    taught = Engine(spark, files_, HashingEmbedder(64), feedback=learning.learned(signals))
    place = lambda e: {r.path: r.score for r in e.search("cart thing", limit=30).collect()}
    a, b = place(plain), place(taught)
    assert b["app/code/Acme/Shop/Plugin/LogCart.php"] > a["app/code/Acme/Shop/Plugin/LogCart.php"]
    turned = Engine(spark, files_, HashingEmbedder(64), adapter=learning.Adapter(64))
    assert place(turned) == a  # a new adapter changes nothing


def test_index_is_kept(spark, tmp_path):
    files_ = spark.createDataFrame([*X.FILES.items()], "path string, content string")
    root = f"file://{tmp_path}/index"
    first = Engine(spark, files_, HashingEmbedder(64), root=root).index()
    again = Engine(spark, files_.limit(0), HashingEmbedder(64), root=root).index()
    assert first.count() == again.count() == len(X.FILES) and sorted(r.id for r in again.collect()) == list(range(len(X.FILES)))


def test_search_filters(engine):
    found = engine.search("cart", modules="Acme_Shop").collect()
    assert found and all("Acme/Shop" in r.path for r in found)
    assert all("Acme/Shop" not in r.path for r in engine.search("cart", without="Acme_Shop").collect())
    with pytest.raises(ValueError):
        engine.read("../x")


def test_observer_method_is_read(engine):
    got = {r.name: r.method for r in engine.find_observer("cart_saved").collect()}
    assert got == {"notify": "send", "count": "execute"}


@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "de"]), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None)
def test_pattern_hash_ignores_order(spark, words):
    a, b = " ".join(words), " ".join(reversed(words + words))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.pattern_hash(F.col("a")).alias("x"), text.pattern_hash(F.col("b")).alias("y")).first()
    assert row.x == row.y


def test_globs():
    assert sorted(text.brace_expand("*.{a,b}")) == ["*.a", "*.b"]
    import re

    assert re.match(text.glob_regex("*.{php,phtml},*.xml"), "X/Y.PHTML") and not re.match(text.glob_regex("*.php"), "a.phps")


def test_learning_folds_in_order(spark):
    rows = [(i, i, "refinement_to_plugin", "cart plugin") for i in range(6)] + [(9, 9, "query_refinement", "x")]
    df = spark.createDataFrame(rows, "ts long, event_id long, signal string, query string")
    pattern, term, overall = learning.learned(df)
    w = 0.0
    for n in range(1, 7):
        w = min(0.15, w + 0.05 / (1 + 0.1 * n))
    got = {r.feature: r.weight for r in pattern.collect()}
    assert abs(got["is_plugin"] - w) < 1e-9 and got["is_block"] < 0
    assert {r.term for r in term.collect()} == {"cart", "plugin"}
    assert all(abs(r.weight) <= 0.15 for df in (pattern, term, overall) for r in df.collect())


def test_repeated_event_ids_count_once_each(spark):
    rows = [(1, 7, "refinement_to_plugin", "cart"), (2, 7, "refinement_to_plugin", "cart")]
    _, term, overall = learning.learned(spark.createDataFrame(rows, "ts long, event_id long, signal string, query string"))
    assert {r.n for r in term.collect()} == {2} == {r.n for r in overall.collect()}


def test_folds_in_chunks_equal_folds_in_one(spark, monkeypatch):
    r = np.random.default_rng(3)
    names = [s for _, s, _ in learning.FOLLOWS]
    rows = [(int(i), int(i), names[r.integers(len(names))], f"term{r.integers(2)} cart") for i in range(400)]
    df = spark.createDataFrame(rows, "ts long, event_id long, signal string, query string")
    whole = [{tuple(x)[:2]: x.weight for x in t.collect()} for t in learning.learned(df)]
    monkeypatch.setattr(learning, "CHUNK", 7)
    cut = [{tuple(x)[:2]: x.weight for x in t.collect()} for t in learning.learned(df)]
    assert all(a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) for a, b in zip(whole, cut, strict=True))
    w, counts = {}, {}
    features = {s: f for _, s, f in learning.FOLLOWS}
    for _, _, signal, query in rows:
        counts[query] = counts.get(query, 0) + 1
        lr = 0.05 / (1 + 0.1 * counts[query]) * 0.3
        for f in learning.FEATURES:
            w[f] = min(0.15, w.get(f, 0) + lr) if f == features[signal] else max(-0.15, w.get(f, 0) - 0.1 * lr)
    assert all(abs(whole[2]["all", f] - x) < 1e-9 for f, x in w.items())


def test_numbers_go_on_over_parts(spark):
    df = spark.createDataFrame([(i % 3 // 2, i) for i in range(300)], "k long, t long")
    got = learning.numbered(df, "k", ["t"]).collect()
    for k in (0, 1):
        own = sorted((x.t, x.n) for x in got if x.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_weights_of_a_query(spark):
    rows = [(i, i, "refinement_to_plugin", "cart plugin") for i in range(4)]
    tables = learning.learned(spark.createDataFrame(rows, "ts long, event_id long, signal string, query string"))
    own, terms, overall = learning.weights_for("Plugin CART", *tables)
    assert own["is_plugin"] > terms[0]["is_plugin"] > overall["is_plugin"] > 0 and len(terms) == 2
    assert learning.weights_for("other", *tables)[:2] == ({}, [])


def test_adapter_starts_as_identity_and_learns(spark, tmp_path):
    r = np.random.default_rng(1)
    a, q, t = learning.Adapter(16), unit(r.normal(size=16)), unit(r.normal(size=16))
    assert np.allclose(a.forward(q), q) and a.penalty() == 0
    before = float(np.linalg.norm(a.forward(q) - t))
    first = learning.Adapter(16)
    low, delta, lr = first.a @ q, t - q, 0.001 / 1.005
    b = lr * np.outer(delta, low)
    want = first.a + lr * np.outer(b.T @ delta, q)
    first.update(q, t)
    assert np.allclose(first.b, b) and np.allclose(first.a, want) and not first.fisher.any() and np.allclose(first.star, first._flat())
    star = first._flat()
    first.update(q, t)
    assert np.allclose(first.fisher, 0.5 * (first._flat() - star) ** 2) and first.n == first.kept == 2
    for _ in range(200):
        a.update(q, t)
    assert float(np.linalg.norm(a.forward(q) - t)) < before and a.penalty() >= 0
    a.save(spark, f"file://{tmp_path}/a")
    assert np.allclose(learning.Adapter.open(spark, f"file://{tmp_path}/a", 16).forward(q), a.forward(q))
    assert np.allclose(learning.Adapter.open(spark, f"file://{tmp_path}/a", 8).forward(q[:8]), q[:8])
    assert np.allclose(learning.Adapter.open(spark, f"file://{tmp_path}/none", 16).forward(q), q)


def test_store_versions_and_watch(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    first = spark.createDataFrame([("a", "1", 1, 0), ("b", "2", 2, 0), ("c", "3", 3, 0), ("d", "4", 4, 0), ("e", "5", 5, 0), ("f", "6", 6, 0)], "path string, content string, size long, mtime long")
    build = lambda f: f.select("path", F.length("content").alias("n"))
    assert watch.apply_changes(spark, first, root, build) == {"added": 6}
    assert watch.apply_changes(spark, first, root, build) == {}
    second = first.where("path <> 'a'").union(spark.createDataFrame([("g", "7", 7, 0)], first.schema))
    assert watch.apply_changes(spark, second, root, build) == {"added": 1, "deleted": 1}
    index = store.load(spark, root, name="index")
    assert index.count() == 7 and index.where("is_deleted").count() == 1
    third = second.withColumn("size", F.when(F.col("path") == "b", 9).otherwise(F.col("size")))
    assert watch.apply_changes(spark, third, root, build) == {"modified": 1}
    assert store.load(spark, root, name="index").where("is_deleted").count() == 0  # compacted: 2 of 8 were dead
    with pytest.raises(ValueError):
        store.load(spark, root, name="index", schema=first.schema)
    assert watch.apply_changes(spark, third, root, build, force=True, parts=3) == {"added": 6}
    assert store.load(spark, root, name="index").count() == 6 == store.load(spark, root, name="manifest").count()
    last = store.versions(spark, root)[-1]
    assert store.prune(spark, root) == list(range(1, last - 1)) and store.versions(spark, root) == [last - 1, last]


def test_store_tables(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert [store._claimed(spark, root), store._claimed(spark, root)] == [1, 2] and store.versions(spark, root) == []  # two writers
    assert store.save(one, root) == 3
    put = store.upsert(store.load(spark, root), spark.createDataFrame([(2, "c"), (3, "d")], one.schema), ["k"])
    assert sorted(map(tuple, put.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, store.remove(put, spark.createDataFrame([(1,)], "k long")).collect())) == [(2, "c"), (3, "d")]
    wider = one.withColumn("w", F.lit(1))
    assert store.load_or_rebuild(spark, root, wider.schema, lambda: wider).columns == ["k", "v", "w"] and len(store.versions(spark, root)) == 2


def test_descriptions_are_renewed(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    old = spark.createDataFrame([("a", "x", "old a", 1), ("b", "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35", "old b", 1)], "path string, hash string, description string, ts long")
    tell = lambda df: df.select("path", F.concat(F.lit("new "), "path").alias("description"))
    got = {r.path: r.description for r in maintenance.redescribed(rows, old, tell, F.lit(2)).collect()}
    assert got == {"a": "new a", "b": "old b"}
    assert {r.description for r in maintenance.redescribed(rows, old, tell, F.lit(2), force=True).collect()} == {"new a", "new b"}


def test_change_set_is_a_partition(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 0)], "path string, size long, mtime long")
    new = spark.createDataFrame([("b", 1, 0), ("c", 2, 0), ("d", 1, 0)], "path string, size long, mtime long")
    assert {(r.path, r.change) for r in maintenance.change_set(old, new).collect()} == {("a", "deleted"), ("c", "modified"), ("d", "added")}


def test_scan_and_config(spark, tmp_path):
    (tmp_path / "t/app/node_modules").mkdir(parents=True)
    for kept in ("pub", "setup", "lib/web", "dev/x"):
        (tmp_path / "t" / kept).mkdir(parents=True)
        (tmp_path / "t" / kept / "k.php").write_text("kept")
    for gone in ("Tests", "_files", "fixtures", "performance-toolkit", "pub/static", "dev/tests", "dev/tools", "vendor/bin"):
        (tmp_path / "t" / gone).mkdir(parents=True)
        (tmp_path / "t" / gone / "g.php").write_text("gone")
    (tmp_path / "t/app/a.php").write_text("<?php")
    (tmp_path / "t/app/node_modules/b.php").write_text("x")
    (tmp_path / "t/app/c.php").write_text("skip")
    (tmp_path / "t/app/big.xml").write_text("y" * 200_000)
    got = files.scan(spark, f"file://{tmp_path}/t", files.ignore_patterns(["# c", "", "app/c.php/"])).collect()
    assert sorted(r.path for r in got) == ["app/a.php", "dev/x/k.php", "lib/web/k.php", "pub/k.php", "setup/k.php"]
    (tmp_path / "env").mkdir()
    (tmp_path / "env/live.json").write_text('[{"scope": "default", "scope_id": 0, "path": "a/b", "value": "1"}]')
    (tmp_path / "env/bad.json").write_text("{nope")
    assert [(r.env, r.config_path) for r in files.config_values(spark, f"file://{tmp_path}/env").collect()] == [("live", "a/b")]


def test_metrics_bounds(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id long, rank long, relevant boolean")
    got = {r.query_id: r for r in metrics.per_query(rows, 2).collect()}
    assert got[1].mrr == 0.5 and got[1].precision == 0.5 and got[1].recall == 0.5 and 0 < got[1].ndcg < 1 and got[2].ndcg == 0


def test_component_order(spark):
    rows = [("a/Model/Resolver/X.php",), ("a/graphql/Model/Resolver/X.php",), ("a/Model/XRepository.php",), ("a/etc/db_schema.xml",)]
    got = [r[0] for r in spark.createDataFrame([(("/" + p),) for (p,) in rows], "p string").select(paths.component_type(F.col("p"))).collect()]
    assert got == ["model", "graphql_resolver", "repository", "db_schema"]


def test_stream_signals_match_batch(spark, tmp_path):
    from quarry.streaming.signals import stream_signals

    rows = [(1, 1, "2024-01-01 00:00:00", "search", 5), (1, 2, "2024-01-01 00:00:10", "find_plugin", None), (1, 3, "2024-01-01 00:00:20", "search", 6), (2, 4, "2024-01-01 00:00:00", "find_class", None)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, tool string, k long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = stream_signals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("signals_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_id, r.signal) for r in spark.table("signals_out").collect()}
    assert got == {(2, "refinement_to_plugin"), (3, "query_refinement")} == {(r.event_id, r.signal) for r in learning.signals(df).collect()}


def test_stream_weights_match_batch(spark, tmp_path):
    from quarry.streaming.signals import stream_weights

    rows = [(f"2024-01-01 00:00:{i:02d}", i, s, 1) for i, s in enumerate(["refinement_to_plugin", "refinement_to_config", "query_refinement", "trace_after_search"])]
    df = spark.createDataFrame(rows, "ts string, event_id long, signal string, pattern long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = stream_weights(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("weights_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {r.feature: r.weight for r in spark.table("weights_out").collect()}
    want = {r.feature: r.weight for r in learning.learned(df.withColumn("query", F.lit("abc")))[0].collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in got)


def test_last_json_and_versions():
    assert text.last_json('[2024-01-01] log\n{"a": 1}\nbye') == {"a": 1}
    assert text.last_json("setting up 5\n[\n1,\n2\n]") in ([1, 2], 2)
    with pytest.raises(ValueError):
        text.last_json("nothing here")


def test_a_cluster_needs_a_shared_folder():
    from quarry import session

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(*_):
                    return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpointed(Frame())


def test_the_library_stands_without_the_llm_folders(tmp_path):
    """Both folders and the pipeline deleted: the entry module imports and offers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and 'hybrid_search' in q and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
