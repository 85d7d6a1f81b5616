"""Relations out of code and configuration texts (path, content), by regular expressions that both Java and RE2 take.

Every extractor is a narrow plan: a cheap test of the whole content, regexp_extract_all, explode. Attributes may come in
any order inside a tag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import di_area, short_name

#: Strings that hold SQL, the table names in them, names given to getTable(), and words that are no tables.
SQL_TEXTS = (r"(?s)Zend_Db_Expr\s*\(\s*'(.*?)'", r"(?s)->query\s*\(\s*['\"](.+?)['\"]")
SQL_NAME = r"(?i)\b(?:from|into|update|join|table)\s+`?(\w+)`?"
GET_TABLE = r"getTable(?:Name)?\s*\(\s*['\"](\w+)['\"]"
SQL_STOP = tuple("as set where and or not null true false select insert update delete from into values group order having limit offset on inner left right outer cross join if then else end when case new old main_table related".split())
#: Tables and triggers of set-up scripts.
NEW_TABLE = r"newTable\s*\(\s*(?:\$\w+->getTable\s*\(\s*)?['\"](\w+)['\"]"
SETUP_TABLE = r"getTable\s*\(\s*['\"](\w+)['\"]"
STATEMENT, STATEMENT_STOP = r"(?s)addStatement\s*\(\s*'(.*?)'", ("as", "set", "where")
TRIGGER_START = r"riggerFactory[^\n]*create\(\)"
TRIGGER_NAME, TRIGGER_TABLE = r"setName\s*\(\s*['\"]([^'\"]+)['\"]", r"setTable\s*\(\s*(?:\$(\w+)|['\"]([^'\"]+)['\"])"
TRIGGER_EVENT, TRIGGER_TIME = r"setEvent\s*\([^)]*EVENT_(\w+)", r"setTime\s*\([^)]*TIME_(\w+)"
DROP_TRIGGER = r"dropTrigger\s*\(\s*['\"]([^'\"]+)['\"]"
#: Error types in the order in which they are tried, with the words that show them.
ERRORS = (
    ("missing_preference", r"(?i)cannot instantiate interface\s+([\w\\]+)"),
    ("missing_class", r"(?i)class\s+([\w\\]+)\s+does not exist"),
    ("missing_plugin", r"(?i)plugin class\s+([\w\\]+)\s+doesn't exist"),
    ("area_code_not_set", r"(?i)area code is not set()"),
    ("circular_dependency", r"(?i)circular dependency:\s*([\w\\,\s]+)"),
    ("plugin_sort_conflict", r"(?i)(\d+)\s+plugins\s+.*sortOrder.*conflict"),
    ("template_undefined_index", r"(?i)undefined index:\s+(\w+)\s+in\s+[\w/.-]+\.phtml"),
    ("missing_table", r"(?i)SQLSTATE\[\w+\].*table '[\w.]*\.(\w+)' doesn't exist"),
    ("missing_cli_command", r'(?i)there are no commands defined in the "(\w+(?::\w+)*)" namespace'),
    ("invalid_plugin_method", r"(?i)invalid method\s+([\w\\]+)::(?:before|after|around)\w+"),
    ("rule_not_matching", r"(?i)()(?:rule\s+(?:did\s+)?not\s+(?:match|apply|work)|(?:sales|cart|price)\s*rule.*(?:not\s+applied|didn'?t\s+match|failed))"),
    ("free_shipping_not_applied", r"(?i)()(?:free\s*shipping.*(?:not|didn'?t|did\s+not)\s+(?:apply|work|match)|(?:not|didn'?t)\s+(?:get|receive)\s+free\s*shipping)"),
    ("custom_condition_issue", r"(?i)()(?:condition|rule|promotion|discount).*(?:custom|type).*(?:not|fail|wrong|weird|unexpected)"),
)


def _all(content: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def tags(files: DataFrame, name: str, content: str = "content") -> DataFrame:
    """path, tag: every opening tag of a name."""
    return files.where(F.col(content).contains(f"<{name}")).select("*", F.explode(_all(F.col(content), rf"<{name}\s[^>]*>", 0)).alias("tag"))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, null where it is absent."""
    value = F.regexp_extract(tag, rf"[\s]{name}\s*=\s*\"([^\"]*)\"", 1)
    return F.when(tag.rlike(rf"[\s]{name}\s*=\s*\""), value)


def elements(files: DataFrame, name: str) -> DataFrame:
    """path, tag, body of every element of a name that has a body (no element of the name inside another)."""
    pattern = rf"(?s)(<{name}\s[^>]*[^/]>)(.*?)</{name}>"
    pairs = F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("tag"), _all(F.col("content"), pattern, 2).alias("body")))
    return files.where(F.col("content").contains(f"<{name}")).select("path", pairs.alias("e")).select("path", F.col("e.tag").alias("tag"), F.col("e.body").alias("body"))


def preferences(files: DataFrame) -> DataFrame:
    t = tags(files.where(F.col("path").endswith("di.xml")), "preference")
    return t.select(attribute(F.col("tag"), "for").alias("iface"), attribute(F.col("tag"), "type").alias("impl"), "path", di_area(F.concat(F.lit("/"), F.col("path"))).alias("area"))


def plugins(files: DataFrame) -> DataFrame:
    t = elements(files.where(F.col("path").endswith("di.xml")), "type")
    inner = t.select("path", attribute(F.col("tag"), "name").alias("target"), F.explode(_all(F.col("body"), r"<plugin\s[^>]*>", 0)).alias("p"))
    a = lambda n: attribute(F.col("p"), n)
    return inner.select("target", a("name").alias("name"), a("type").alias("plugin_class"), F.coalesce(a("disabled") == "true", F.lit(False)).alias("disabled"), a("sortOrder").cast("long").alias("sort_order"), "path", di_area(F.concat(F.lit("/"), F.col("path"))).alias("area"))


def virtual_types(files: DataFrame) -> DataFrame:
    t = tags(files.where(F.col("path").endswith("di.xml")), "virtualType")
    return t.select(attribute(F.col("tag"), "name").alias("name"), attribute(F.col("tag"), "type").alias("type"), "path")


def di_arguments(files: DataFrame) -> DataFrame:
    """target, arg, xsi_type, value, item, path: arguments of types and virtual types; the items of an array, one row each,
    have their own type and value. Attributes may come in any order."""
    src = files.where(F.col("path").endswith("di.xml"))
    both = elements(src, "type").unionByName(elements(src, "virtualType"))
    one = r"(?s)(<argument\s[^>]*>)(.*?)</argument>"
    parts = F.explode(F.arrays_zip(_all(F.col("body"), one, 1).alias("t"), _all(F.col("body"), one, 2).alias("b")))
    args = both.select(attribute(F.col("tag"), "name").alias("target"), "path", parts.alias("a"))
    args = args.select("target", attribute(F.col("a.t"), "name").alias("arg"), attribute(F.col("a.t"), "xsi:type").alias("xsi_type"), F.col("a.b").alias("body"), "path")
    plain = args.where("xsi_type <> 'array'").select("target", "arg", "xsi_type", F.trim(F.regexp_extract("body", "^([^<]*)", 1)).alias("value"), F.lit(None).cast("string").alias("item"), "path")
    item = r"(<item\s[^>]*[^/]>)([^<]*)</item>"
    items = args.where("xsi_type = 'array'").select("target", "arg", "path", F.explode(F.arrays_zip(_all(F.col("body"), item, 1).alias("t"), _all(F.col("body"), item, 2).alias("v"))).alias("i"))
    return plain.unionByName(items.select("target", "arg", attribute(F.col("i.t"), "xsi:type").alias("xsi_type"), F.trim("i.v").alias("value"), attribute(F.col("i.t"), "name").alias("item"), "path"))


def observers(files: DataFrame) -> DataFrame:
    t = elements(files.where(F.col("path").endswith("events.xml")), "event")
    inner = t.select("path", attribute(F.col("tag"), "name").alias("event"), F.explode(_all(F.col("body"), r"<observer\s[^>]*>", 0)).alias("o"))
    a = lambda n: attribute(F.col("o"), n)
    return inner.select("event", a("name").alias("name"), a("instance").alias("instance"), F.coalesce(a("method"), F.lit("execute")).alias("method"), "path")


def routes(files: DataFrame) -> DataFrame:
    t = elements(files.where(F.col("path").endswith("webapi.xml")), "route")
    service = F.regexp_extract("body", r"<service\s[^>]*>", 0)
    acl = F.array_join(_all(F.col("body"), r"<resource\s+ref=\"([^\"]*)\"", 1), ",")
    return t.select(attribute(F.col("tag"), "url").alias("url"), F.upper(attribute(F.col("tag"), "method")).alias("http_method"), attribute(service, "class").alias("service_class"), attribute(service, "method").alias("service_method"), acl.alias("acl"), "path")


def layout_nodes(files: DataFrame) -> DataFrame:
    src = files.where(F.col("path").contains("/layout/") & F.col("path").endswith(".xml"))
    handle = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    kinds = [tags(src, k).select("path", handle.alias("handle"), F.lit(k).alias("kind"), attribute(F.col("tag"), "name").alias("name")) for k in ("block", "container", "referenceBlock", "referenceContainer")]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.where(F.col("name").isNotNull()).distinct()


def fieldsets(files: DataFrame) -> DataFrame:
    """path, scope, fieldset, field, aspect: fieldsets inside a scope with its id, and those that stand in none."""
    src = files.where(F.col("path").endswith("fieldset.xml"))
    outer = r"(?s)(<scope\s[^>]*>)(.*?)</scope>"
    scoped = src.select("path", F.explode(F.arrays_zip(_all(F.col("content"), outer, 1).alias("t"), _all(F.col("content"), outer, 2).alias("b"))).alias("s"))
    scoped = scoped.select("path", attribute(F.col("s.t"), "id").alias("scope"), F.col("s.b").alias("content"))
    bare = src.select("path", F.lit(None).cast("string").alias("scope"), F.regexp_replace("content", outer, "").alias("content"))
    sets = elements_in(scoped.unionByName(bare), ["scope"], "fieldset")
    pattern = r"(?s)(<field\s[^>]*>)(.*?)</field>"
    f = sets.select("path", "scope", "fieldset", F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("t"), _all(F.col("content"), pattern, 2).alias("b"))).alias("f"))
    return f.select("path", "scope", "fieldset", attribute(F.col("f.t"), "name").alias("field"), F.explode(_all(F.col("f.b"), r"<aspect\s+name=\"([^\"]*)\"", 1)).alias("aspect"))


def system_fields(files: DataFrame) -> DataFrame:
    """config_path section/group/field, label and source model."""
    s = elements(files.where(F.col("path").endswith("system.xml")), "section").select("path", attribute(F.col("tag"), "id").alias("section"), F.col("body").alias("content"))
    g = elements_in(s, ["section"], "group")
    f = elements_in(g, ["section", "group"], "field")
    text = lambda n: F.nullif(F.regexp_extract("content", rf"<{n}>([^<]*)</{n}>", 1), F.lit(""))
    return f.select("path", F.concat_ws("/", "section", "group", "field").alias("config_path"), text("label").alias("label"), text("source_model").alias("source_model"))


def elements_in(parents: DataFrame, keep: list[str], name: str) -> DataFrame:
    """Child elements (id as a column of their name, content) of parents (path, keep..., content)."""
    pattern = rf"(?s)(<{name}\s[^>]*>)(.*?)</{name}>"
    pairs = F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("t"), _all(F.col("content"), pattern, 2).alias("b")))
    return parents.select("path", *keep, pairs.alias("e")).select("path", *keep, attribute(F.col("e.t"), "id").alias(name), F.col("e.b").alias("content"))


def graphql_ops(files: DataFrame) -> DataFrame:
    """op, resolver_class of every field with a resolver."""
    pattern = r"(?s)(\w+)\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+\s*(?:@doc\([^)]*\)\s*)?@resolver\(\s*class:\s*\"([^\"]*)\""
    pairs = F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("op"), _all(F.col("content"), pattern, 2).alias("cls")))
    cls = F.regexp_replace(F.replace("p.cls", F.lit("\\\\"), F.lit("\\")), r"^\\", "")
    return files.where(F.col("path").endswith(".graphqls")).select("path", pairs.alias("p")).select("path", F.col("p.op").alias("op"), cls.alias("resolver_class"))


#: The head of a class, with what it extends and implements over lines, and its namespace and imports.
CLASS_HEAD = r"(?m)^[ \t]*((?:abstract\s+|final\s+|readonly\s+)*)(class|interface|trait|enum)\s+(\w+)(?:\s*:\s*\w+)?(?:\s+extends\s+([\w\\]+(?:\s*,\s*[\w\\]+)*))?(?:\s+implements\s+([\w\\]+(?:\s*,\s*[\w\\]+)*))?"
NAMESPACE = r"(?m)^\s*namespace\s+([\w\\]+)\s*;"
USE = r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;"


def _zipped(content: Column, pattern: str, groups: dict[str, int]) -> Column:
    return F.explode(F.arrays_zip(*(_all(content, pattern, k).alias(n) for n, k in groups.items())))


def classes(files: DataFrame) -> DataFrame:
    """fqcn, kind, is_abstract, parent and interfaces as written (comma-joined), path: every class, interface, trait and
    enumeration of a file."""
    src = files.where(F.col("path").endswith(".php"))
    ns = F.nullif(F.regexp_extract("content", NAMESPACE, 1), F.lit(""))
    c = src.select("path", ns.alias("ns"), _zipped(F.col("content"), CLASS_HEAD, {"marks": 1, "kind": 2, "name": 3, "parent": 4, "listed": 5}).alias("c"))
    names = F.nullif(F.array_join(F.transform(F.split("c.listed", ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", ""))), ", "), F.lit(""))
    parent = F.nullif(F.regexp_replace("c.parent", r"\s+", ""), F.lit(""))
    return c.select(F.concat_ws("\\", "ns", "c.name").alias("fqcn"), "c.kind", F.col("c.marks").contains("abstract").alias("is_abstract"), parent.alias("parent"), names.alias("interfaces"), "path")


def imports(files: DataFrame) -> DataFrame:
    """path, fqcn, alias of the use statements of PHP files."""
    src = files.where(F.col("path").endswith(".php"))
    u = src.select("path", _zipped(F.col("content"), USE, {"name": 1, "as": 2}).alias("u"))
    name = F.regexp_replace("u.name", r"^\\", "")
    return u.select("path", name.alias("fqcn"), F.coalesce(F.nullif(F.col("u.as"), F.lit("")), short_name(name)).alias("alias"))


def resolved_parents(files: DataFrame) -> DataFrame:
    """fqcn, parent of each class: the whole name of what it extends, by its own use statements, else its namespace."""
    c = classes(files).where(F.col("parent").isNotNull()).select("path", "fqcn", F.explode(F.split("parent", ",")).alias("written"))
    u = imports(files).select("path", F.col("alias").alias("first"), F.col("fqcn").alias("used")).dropDuplicates(["path", "first"])
    named = c.withColumn("first", F.element_at(F.split("written", r"\\"), 1)).join(u, ["path", "first"], "left")
    rest = F.expr(r"substring(written, length(first) + 1)")
    ns = F.regexp_extract("fqcn", r"^(.*)\\\w+$", 1)
    relative = F.when(ns == "", F.col("written")).otherwise(F.concat_ws("\\", ns, "written"))
    whole = F.when(F.col("written").startswith("\\"), F.regexp_replace("written", r"^\\", "")).when(F.col("used").isNotNull(), F.concat("used", rest)).when(F.col("written").contains("\\"), F.col("written")).otherwise(relative)
    return named.select("fqcn", whole.alias("parent"), "path")


#: A function with its marks, parameters and type of return; a parameter; a property.
METHOD = r"(?:(abstract)\s+)?(?:(final)\s+)?(public|protected|private)\s+(?:(static)\s+)?(?:(abstract)\s+)?function\s+&?(\w+)\s*\(([^)]*)\)(?:\s*:\s*(\??[\w\\|]+))?"
PARAMETER = r"(?:(\??[\w\\|]+)\s+)?&?(?:\.\.\.)?\$(\w+)(\s*=)?"
PROPERTY = r"(?m)^\s*(public|protected|private)\s+(static\s+)?(?:readonly\s+)?(?:(\??[\w\\|]+)\s+)?\$(\w+)"


def methods(files: DataFrame) -> DataFrame:
    """path, visibility, method, is_static, is_abstract, return_type, params (as written) of PHP functions."""
    groups = {"a1": 1, "v": 3, "s": 4, "a2": 5, "m": 6, "p": 7, "r": 8}
    m = files.where(F.col("path").endswith(".php")).select("path", _zipped(F.col("content"), METHOD, groups).alias("x"))
    blank = lambda n: F.nullif(F.col(f"x.{n}"), F.lit(""))
    return m.select("path", F.col("x.v").alias("visibility"), F.col("x.m").alias("method"), (F.col("x.s") != "").alias("is_static"), (F.concat("x.a1", "x.a2") != "").alias("is_abstract"), blank("r").alias("return_type"), F.trim(F.regexp_replace("x.p", r"\s+", " ")).alias("params"))


def method_params(files: DataFrame) -> DataFrame:
    """path, method, position (from 1), type_hint, variable, is_optional of the parameters of PHP functions."""
    m = methods(files).select("path", "method", F.posexplode(F.arrays_zip(*(_all(F.col("params"), PARAMETER, k).alias(n) for n, k in (("t", 1), ("v", 2), ("d", 3))))).alias("at", "p"))
    return m.select("path", "method", (F.col("at") + 1).cast("long").alias("position"), F.nullif(F.col("p.t"), F.lit("")).alias("type_hint"), F.col("p.v").alias("variable"), (F.col("p.d") != "").alias("is_optional"))


def properties(files: DataFrame) -> DataFrame:
    """path, visibility, is_static, type_hint, property of PHP classes."""
    p = files.where(F.col("path").endswith(".php")).select("path", _zipped(F.col("content"), PROPERTY, {"v": 1, "s": 2, "t": 3, "n": 4}).alias("x"))
    return p.select("path", F.col("x.v").alias("visibility"), (F.col("x.s") != "").alias("is_static"), F.nullif(F.col("x.t"), F.lit("")).alias("type_hint"), F.col("x.n").alias("property"))


#: What shows a class's role: words in its interfaces, in its parent, in its name, in its namespace.
ROLES = {
    "is_controller": (("ActionInterface",), ("Action",), (), ()),
    "is_repository": (("RepositoryInterface",), (), ("Repository",), ("Repository",)),
    "is_plugin": ((), (), ("Plugin",), ("\\Plugin\\",)),
    "is_observer": (("ObserverInterface",), (), (), ()),
    "is_model": ((), ("AbstractModel", "AbstractDb"), (), ()),
    "is_block": ((), ("Template", "AbstractBlock"), (), ()),
    "is_helper": ((), ("AbstractHelper", "AbstractData"), ("Helper",), ("\\Helper\\",)),
    "is_setup": (("PatchInterface", "InstallSchemaInterface", "InstallDataInterface", "UpgradeSchemaInterface", "UpgradeDataInterface"), (), ("InstallSchema", "InstallData", "UpgradeSchema", "UpgradeData", "Patch"), ("\\Setup\\",)),
    "is_resolver": (("ResolverInterface", "BatchResolverInterface"), (), (), ()),
}


def class_roles(files: DataFrame) -> DataFrame:
    """path, fqcn, a flag for each role and is_api_interface: of the first class of each PHP file, by what it extends,
    implements, is called and defines."""
    src = files.where(F.col("path").endswith(".php"))
    head = lambda k: F.regexp_extract("content", CLASS_HEAD, k)
    rows = src.select("path", "content", F.regexp_extract("content", NAMESPACE, 1).alias("ns"), head(2).alias("kind"), head(3).alias("name"), head(4).alias("parent"), head(5).alias("listed")).where("name <> ''")
    has = lambda c, words: reduce(lambda a, w: a | F.col(c).contains(w), words, F.lit(False))
    tests = {}
    for role, (listed, parent, name, ns) in ROLES.items():
        within = reduce(lambda a, w: a | F.concat("ns", F.lit("\\")).contains(w) if role in ("is_helper", "is_setup") else a | F.col("ns").contains(w), ns, F.lit(False))
        tests[role] = has("listed", listed) | has("parent", parent) | has("name", name) | within
    tests["is_controller"] = tests["is_controller"] | F.col("content").rlike(r"function\s+execute\s*\(")
    tests["is_plugin"] = tests["is_plugin"] | F.col("content").rlike(PLUGIN_METHOD)
    tests["is_api_interface"] = (F.col("kind") == "interface") & F.col("ns").contains("Api")
    return rows.select("path", F.concat_ws("\\", F.nullif(F.col("ns"), F.lit("")), "name").alias("fqcn"), *(t.alias(n) for n, t in tests.items()))


PLUGIN_METHOD = r"public\s+function\s+(before|after|around)([A-Z]\w*)"


def plugin_methods(files: DataFrame) -> DataFrame:
    """path, type (before, after, around), target_method of interceptors."""
    pattern = PLUGIN_METHOD
    pairs = F.explode(F.arrays_zip(_all(F.col("content"), pattern, 1).alias("t"), _all(F.col("content"), pattern, 2).alias("m")))
    name = F.concat(F.lower(F.substring("p.m", 1, 1)), F.substring("p.m", 2, 1000))
    return files.where(F.col("path").endswith(".php")).select("path", pairs.alias("p")).select("path", F.col("p.t").alias("type"), name.alias("target_method"))


def ctor_params(files: DataFrame) -> DataFrame:
    """path, type_hint, variable of constructors."""
    args = F.regexp_extract("content", r"(?s)function\s+__construct\s*\((.*?)\)\s*[{:]", 1)
    pairs = F.explode(F.arrays_zip(_all(args, r"([\w\\]+)\s+\$(\w+)", 1).alias("t"), _all(args, r"([\w\\]+)\s+\$(\w+)", 2).alias("v")))
    return files.where(F.col("content").contains("__construct")).select("path", pairs.alias("p")).select("path", F.col("p.t").alias("type_hint"), F.col("p.v").alias("variable"))


def dispatches(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").contains("dispatch(")).select("path", F.explode(_all(F.col("content"), r"dispatch\(\s*['\"]([a-z0-9_]+)['\"]", 1)).alias("event"))


def sql_tables(files: DataFrame) -> DataFrame:
    """path, table: names in SQL strings that are no words of SQL, and names given to getTable(), in small letters."""
    src = files.where(F.col("content").rlike(r"Zend_Db_Expr|->query|getTable"))
    texts = F.concat(*(_all(F.col("content"), p, 1) for p in SQL_TEXTS))
    inside = F.flatten(F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit(SQL_NAME), F.lit(1)), F.lower)))
    named = F.transform(_all(F.col("content"), GET_TABLE, 1), F.lower)
    names = F.array_distinct(F.concat(F.array_except(inside, F.array(*map(F.lit, SQL_STOP))), named))
    return src.select("path", F.explode(names).alias("table"))


def setup_tables(files: DataFrame) -> DataFrame:
    """path, table, is_created: tables that set-up scripts create, name, or use in the statements of triggers."""
    src = files.where(F.col("content").rlike("getTable|newTable|addStatement"))
    made = _all(F.col("content"), NEW_TABLE, 1)
    triggers = F.col("content").rlike("TriggerFactory|createTrigger")
    statements = F.when(triggers, _all(F.col("content"), STATEMENT, 1)).otherwise(F.array().cast("array<string>"))
    used = F.array_except(F.flatten(F.transform(statements, lambda t: F.regexp_extract_all(t, F.lit(SQL_NAME), F.lit(1)))), F.array(*map(F.lit, STATEMENT_STOP)))
    names = F.array_distinct(F.concat(_all(F.col("content"), SETUP_TABLE, 1), made, used))
    rows = src.select("path", made.alias("made"), F.explode(names).alias("table"))
    return rows.select("path", "table", F.array_contains("made", F.col("table")).alias("is_created"))


def db_triggers(files: DataFrame) -> DataFrame:
    """path, name, table, event, timing, statement of triggers that set-up scripts create, and those that they drop.

    A script is cut where a factory makes a trigger; the first name, table, event and time of each part count.
    """
    src = files.where(F.col("content").rlike("TriggerFactory|triggerFactory|createTrigger|dropTrigger"))
    parts = F.split("content", TRIGGER_START)
    first = lambda p, k=1: F.nullif(F.regexp_extract("part", p, k), F.lit(""))
    each = src.select("path", F.explode(F.slice(parts, 2, F.size(parts))).alias("part"))
    made = each.select("path", first(TRIGGER_NAME).alias("name"), F.coalesce(first(TRIGGER_TABLE, 1), first(TRIGGER_TABLE, 2)).alias("table"), F.lower(first(TRIGGER_EVENT)).alias("event"), F.lower(first(TRIGGER_TIME)).alias("timing"), first(STATEMENT).alias("statement")).where(F.col("name").isNotNull())
    gone = src.select("path", F.explode(F.array_distinct(_all(F.col("content"), DROP_TRIGGER, 1))).alias("name")).join(made.select("path", "name"), ["path", "name"], "left_anti")
    none = F.lit(None).cast("string")
    return made.unionByName(gone.select("path", "name", none.alias("table"), F.lit("dropped").alias("event"), none.alias("timing"), none.alias("statement")))


def test_methods(files: DataFrame) -> DataFrame:
    """path, test_method, covers (comma-joined), has_mock of test classes."""
    src = files.where(F.col("path").endswith("Test.php"))
    covers = F.array_join(F.array_sort(F.array_distinct(_all(F.col("content"), r"@covers\s+([\w\\:]+)", 1))), ",")
    return src.select("path", F.explode(_all(F.col("content"), r"function\s+(test\w+)", 1)).alias("test_method"), covers.alias("covers"), F.col("content").rlike("createMock|getMockBuilder").alias("has_mock"))


def js_modules(files: DataFrame) -> DataFrame:
    """path, module_type, dependencies, classes, functions (comma-joined) and role flags of scripts, with a mixin's target
    and a component's name."""
    c = F.col("content")
    kind = F.when(c.contains("define("), "amd").when(c.contains("import ") | c.contains("export "), "esm").when(c.contains("module.exports") | c.contains("require("), "commonjs").when(c.contains("(function(") & c.contains("})("), "iife")
    deps = F.when(kind == "amd", _all(F.regexp_extract("content", r"(?s)define\([^\[]*\[([^\]]*)\]", 1), r"['\"]([^'\"]+)['\"]", 1)).otherwise(F.array().cast("array<string>"))
    used = F.concat(deps, _all(c, r"(?m)^\s*import\s[^;\n]*?['\"]([^'\"]+)['\"]", 1), _all(c, r"\brequire\(\s*['\"]([^'\"]+)['\"]", 1))
    names = _all(c, r"\bclass\s+(\w+)", 1)
    functions = _all(c, r"\bfunction\s+(\w+)\s*\(", 1)
    any_dep = lambda *words: F.exists(used, lambda d: reduce(lambda a, w: a | d.contains(w), words, F.lit(False)))
    mixin = c.contains("'mixins':") | c.contains("return function (target)") | c.contains("return function(target)")
    rows = files.where(F.col("path").endswith(".js"))
    return rows.select(
        "path",
        F.coalesce(kind, F.lit("unknown")).alias("module_type"),
        F.array_join(F.array_distinct(used), ",").alias("dependencies"),
        F.array_join(names, ",").alias("classes"),
        F.array_join(functions, ",").alias("functions"),
        (c.contains("uiComponent") | c.contains("_Ui/js/") | any_dep("uiComponent")).alias("is_ui_component"),
        (c.contains("$.widget(") | c.contains("jQuery.widget(") | c.contains("$.mage.") | any_dep("jquery/ui")).alias("is_widget"),
        mixin.alias("is_mixin"),
        F.nullif(F.regexp_extract("content", r"'mixins':[^'\"]*['\"]([^'\"]*)['\"]", 1), F.lit("")).alias("mixin_target"),
        (c.contains("ko.component") | c.contains("ko.bindingHandlers") | F.exists(used, lambda d: d.isin("ko", "knockout"))).alias("is_knockout"),
        F.when(c.contains("Component.extend("), F.get(names, 0)).alias("component_name"),
    )


def js_exports(files: DataFrame) -> DataFrame:
    """path, name of what modules export."""
    names = F.concat(_all(F.col("content"), r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:class|function|const|let|var)\s+(\w+)", 1), _all(F.col("content"), r"\bexports\.(\w+)\s*=", 1))
    return files.where(F.col("path").endswith(".js")).select("path", F.explode(F.array_distinct(names)).alias("name"))


def errors(texts: DataFrame, text: str = "error") -> DataFrame:
    """The columns plus error_type (first rule that fits, else unknown), subject, and frames (file:line, comma-joined)."""
    t = F.col(text)
    kind, subject = F.lit("unknown"), F.lit("")
    for name, pattern in reversed(ERRORS):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
        subject = F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).otherwise(subject)
    files = _all(t, r"([\w/.-]+\.(?:php|phtml))(?:\((\d+)\)|:(\d+))", 0)
    frames = F.transform(files, lambda f: F.regexp_replace(F.regexp_replace(f, r"\(", ":"), r"\)", ""))
    return texts.select("*", kind.alias("error_type"), subject.alias("subject"), F.array_join(frames, ",").alias("frames"))
