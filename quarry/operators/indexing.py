"""Rows of a search index out of files (path, content): metadata, search text and the text that is embedded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.functions.text import split_camel
from quarry.operators import extract

#: Words that a role adds to the search text, and to the embedded text.
ROLE_WORDS = {
    "is_controller": "controller action execute http request response controller controller controller",
    "is_repository": "repository data persistence save load get delete getList getById repository repository repository interface",
    "is_plugin": "plugin interceptor before after around plugin plugin plugin",
    "is_observer": "observer event listener dispatch",
    "is_model": "model entity data resource collection",
    "is_block": "block template view render toHtml",
    "is_resolver": "graphql resolver query mutation field",
    "is_helper": "helper utility data helper helper helper helper class data output",
    "is_setup": "setup install schema data patch upgrade setup setup setup",
}
EMBED_WORDS = {
    "is_helper": "helper helper helper utility data",
    "is_setup": "setup setup setup install schema patch upgrade",
    "is_plugin": "plugin plugin interceptor before after around",
    "is_repository": "repository repository interface persistence save load get",
}
#: Words that parts of a path in small letters add, all parts of the first list being needed.
PATH_WORDS = (
    ((("/controller/",),), "controller action execute http request controller controller controller"),
    ((("/helper/",),), "helper utility data helper helper helper helper class data output abstract"),
    ((("/plugin/",),), "plugin interceptor before after around plugin plugin plugin"),
    ((("/model/", "repository"),), "repository data persistence save load get delete getList getById repository repository repository interface"),
    ((("/setup/",), ("installschema",), ("installdata",), ("upgradeschema",), ("upgradedata",), ("/patch",)), "setup install schema data patch upgrade setup setup setup"),
    ((("inventory",),), "inventory stock qty source reservation"),
)
#: Words that the name of a configuration file adds.
XML_WORDS = {
    "di.xml": "di.xml dependency injection preference plugin type virtualType argument di.xml di.xml di.xml di.xml configuration dependency injection dependency injection plugin type configuration di.xml preference",
    "events.xml": "events.xml observer event listener dispatch",
    "routes.xml": "routes.xml routing frontend adminhtml",
    "webapi.xml": "webapi.xml rest api endpoint method",
    "db_schema.xml": "db_schema.xml declarative schema table column constraint db_schema db_schema db_schema",
    "acl.xml": "acl.xml access control permission resource",
    "menu.xml": "menu.xml admin navigation",
    "system.xml": "system.xml configuration admin settings",
    "config.xml": "config.xml default configuration values",
    "widget.xml": "widget.xml cms widget parameter",
    "crontab.xml": "crontab.xml cron job schedule",
    "email_templates.xml": "email_templates.xml email template transactional",
}
LAYOUT_WORDS = "layout xml block handle container reference layout layout layout"
SCRIPT_WORDS = {"is_ui_component": "ui component knockout observable", "is_widget": "jquery widget $.widget", "is_mixin": "mixin extend override requirejs"}
CONTENT_BYTES, EMBED_BYTES = 6000, 8000


def first_bytes(text: Column, most: int) -> Column:
    """The first so many bytes of a text, without a letter that is cut."""
    cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, most), "UTF-8"), "�+$", "")
    return F.when(F.octet_length(text) > most, cut).otherwise(text)


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def index_rows(files: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """path, content, type, component_type, module, area, class_name, class_type, namespace, extends, implements, methods,
    method_name, dependencies, role flags, description, search_text, embed_text of each file."""
    src = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    p, low = F.col("path"), F.lower(F.concat(F.lit("/"), F.col("path")))
    php, js = p.endswith(".php"), p.endswith(".js")
    none = F.array().cast("array<string>")
    listed = F.transform(F.filter(F.split(F.regexp_extract("content", extract.CLASS_HEAD, 5), r"\s*,\s*"), lambda x: x != ""), F.trim)
    blank = lambda x: F.when(php, F.nullif(x, F.lit("")))
    rows = src.select(
        "path",
        "content",
        paths.file_type(p).alias("type"),
        paths.component_type(p).alias("component_type"),
        paths.module(p).alias("module"),
        paths.area(p).alias("area"),
        blank(F.regexp_extract("content", extract.CLASS_HEAD, 3)).alias("class_name"),
        blank(F.regexp_extract("content", extract.CLASS_HEAD, 2)).alias("class_type"),
        blank(F.regexp_extract("content", extract.NAMESPACE, 1)).alias("namespace"),
        blank(F.regexp_extract("content", extract.CLASS_HEAD, 4)).alias("extends"),
        F.when(php, listed).otherwise(none).alias("implements"),
        F.when(php, _all(extract.METHOD, 6)).otherwise(none).alias("methods"),
    ).withColumn("method_name", F.get("methods", 0))
    roles = extract.class_roles(src).drop("fqcn")
    scripts = extract.js_modules(src)
    scripts = scripts.select("path", F.split("dependencies", ",").alias("dependencies"), F.split("classes", ",").alias("script_classes"), "is_ui_component", "is_widget", "is_mixin", "mixin_target", "component_name", F.split("functions", ",").alias("functions"))
    flags = [c for c in [*roles.columns, *scripts.columns] if c.startswith("is_")]
    rows = rows.join(roles, "path", "left").join(scripts, "path", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    rows = rows.withColumns({f"ast_{c}": F.col(c) for c in ROLE_WORDS})
    by_path = {"is_plugin": low.contains("/plugin/"), "is_controller": low.contains("/controller/"), "is_observer": low.contains("/observer/"), "is_block": low.contains("/block/"), "is_repository": low.contains("/model/") & low.contains("repository")}
    rows = rows.withColumns({c: F.col(c) | t for c, t in by_path.items()})
    if descriptions is not None:
        rows = rows.join(descriptions.select("path", "description"), "path", "left")
    else:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    rows = rows.withColumn("search_text", _search_text(low))
    return rows.withColumn("embed_text", _embed_text()).drop(*(f"ast_{c}" for c in ROLE_WORDS), "script_classes", "functions", "mixin_target", "component_name").withColumn("dependencies", F.coalesce("dependencies", none))


def _search_text(low: Column) -> Column:
    p = F.col("path")
    with_camel = lambda names: F.flatten(F.transform(names, lambda x: F.array(x, split_camel(x))))
    terms = [F.col("class_name"), split_camel(F.col("class_name")), F.replace("namespace", F.lit("\\"), F.lit(" ")), with_camel(F.col("methods"))]
    terms += [F.when(F.col(f"ast_{r}"), w) for r, w in ROLE_WORDS.items()]
    for ways, words in PATH_WORDS:
        test = reduce(lambda a, x: a | x, (reduce(lambda a, part: a & low.contains(part), way, F.lit(True)) for way in ways))
        terms.append(F.when(test, words))
    terms += [with_camel(F.filter("script_classes", lambda x: x != "")), F.filter("functions", lambda x: x != "")]
    terms += [F.when(F.col(r), w) for r, w in SCRIPT_WORDS.items()]
    terms += [F.col("mixin_target"), F.filter("dependencies", lambda x: x != "")]
    xml, name = p.endswith(".xml"), F.element_at(F.split(p, "/"), -1)
    named = _all(r"<(?:preference|type|virtualType|plugin|event)\s[^>]*", 0)
    values = F.flatten(F.transform(named, lambda t: F.regexp_extract_all(t, F.lit(r"\s(?:for|type|name)\s*=\s*\"([^\"]*)\""), F.lit(1))))
    words = F.lit(LAYOUT_WORDS)
    known = F.when(name.contains("layout") | low.contains("/layout/"), words)
    for file, text in XML_WORDS.items():
        known = F.when(name == file, F.lit(text)).otherwise(known)
    root = F.regexp_extract("content", r"^[^<]*<([^\s>/]*)", 1)
    terms += [F.when(xml, values), F.when(xml, F.concat_ws(" ", name, name)), F.when(xml, known), F.when(xml & (root != "") & ~root.rlike("^[?!]"), F.concat_ws(" ", F.lit("xml"), root, F.lit("configuration")))]
    parts = F.filter(F.split(p, "/"), lambda x: F.octet_length(x) > 2)
    terms.append(F.flatten(F.transform(parts, lambda x: F.when(x.rlike(r"_|\p{Lu}"), F.array(x, split_camel(x))).otherwise(F.array(x)))))
    return F.concat_ws(" ", *terms)


def _embed_text() -> Column:
    head = F.when(F.col("description").isNotNull(), F.concat(F.lit("Description: "), "description", F.lit("\n\n")))
    each = lambda word, names: F.transform(names, lambda x: F.concat_ws(" ", F.lit(word), x))
    cls = F.when(F.col("class_name").isNotNull(), F.concat_ws(" ", F.lit("class"), "class_name", "class_name", "class_name"))
    ns = F.when(F.col("namespace").isNotNull(), F.concat_ws(" ", F.lit("namespace"), F.replace("namespace", F.lit("\\"), F.lit(" "))))
    ext = F.when(F.col("extends").isNotNull(), F.concat_ws(" ", F.lit("extends"), "extends"))
    roles = [F.when(F.col(f"ast_{r}"), w) for r, w in EMBED_WORDS.items()]
    scripts = [F.transform(F.filter("script_classes", lambda x: x != ""), lambda x: F.concat_ws(" ", F.lit("class"), x, x)), each("requires", F.filter("dependencies", lambda x: x != "")), F.when(F.col("component_name").isNotNull(), F.concat_ws(" ", F.lit("component"), "component_name"))]
    parts = F.filter(F.split("path", "/"), lambda x: F.octet_length(x) > 2)
    text = F.concat_ws(" ", first_bytes(F.col("content"), CONTENT_BYTES), cls, ns, ext, each("implements", F.col("implements")), each("method", F.col("methods")), *roles, *scripts, parts, F.col("search_text"))
    return first_bytes(F.concat(F.coalesce(head, F.lit("")), text), EMBED_BYTES)
