"""Ranked retrieval: exact vector search, bonuses, reranking, batches.

All ranks end with a unique key, so that results do not depend on partitions. A top-k is TakeOrderedAndProject: each
partition keeps k rows. The inner limit of hybrid_search is part of its meaning: only the nearest rows are reranked, and
only they are joined to their metadata.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T
from quarry.functions.vectors import cosine, is_valid

#: Bonus of a query term by the field that holds it, and the caps.
PATH_BONUS, TEXT_BONUS, CLASS_BONUS, TYPE_BONUS = 0.08, 0.03, 0.06, 0.10
MANY_TERMS, MANY_BONUS, ABSTRACT_MALUS, MOST_BONUS = 3, 0.05, -0.12, 0.45
#: Query token, component types, parts of the path, flag, bonus.
TOKEN_BONUS = (
    ("helper", ("helper",), ("/helper/",), None, 0.15),
    ("plugin", ("plugin",), ("/plugin/",), "is_plugin", 0.15),
    ("repository", ("repository",), (), "is_repository", 0.15),
    ("setup", ("setup",), ("/setup/",), None, 0.15),
    ("observer", ("observer",), ("/observer/",), "is_observer", 0.15),
    ("resolver", ("graphql_resolver",), (), "is_resolver", 0.15),
    ("graphql", ("graphql_resolver", "graphql_schema"), ("graph-ql", "graphql"), None, 0.10),
)
#: Query vectors that one pass over an index compares with it.
QUERY_ROWS = 4096


def _vector(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def nearest(index: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k rows with the greatest cosine among valid rows, with their similarity."""
    live = index.where(is_valid(F.col("embedding"), len(vector)))
    if "is_deleted" in index.columns:
        live = live.where(~F.col("is_deleted"))
    return live.withColumn("similarity", F.round(cosine(F.col("embedding"), _vector(vector)), 6)).orderBy(F.desc("similarity"), "id").limit(k)


def has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def keyword_bonus(df: DataFrame, query: str) -> Column:
    """What the fields of a row add for the terms and type names of a query; capped above only."""
    path, body, cls = (F.lower(F.coalesce(has(df, c), F.lit(""))) for c in ("path", "search_text", "class_name"))
    kind = F.coalesce(has(df, "component_type"), F.lit(""))
    bonus, hits = F.lit(0.0), F.lit(0)
    low = query.lower()
    for t in (t for t in low.split() if len(t.encode()) >= 3):
        tests = ((path.contains(t), PATH_BONUS), (body.contains(t), TEXT_BONUS), (cls.contains(t), CLASS_BONUS), (kind.contains(t) | (kind == t.replace(".", "_")), TYPE_BONUS))
        for test, w in tests:
            bonus, hits = bonus + F.when(test, w).otherwise(0.0), hits + F.when(test, 1).otherwise(0)
    if "di.xml" in low:
        bonus = bonus + F.when((kind == "di_config") | path.endswith("di.xml"), 0.20).otherwise(0.0)
    if "db_schema" in low:
        bonus = bonus + F.when((kind == "db_schema") | path.endswith("db_schema.xml"), 0.20).otherwise(0.0)
    for token, names, parts, flag, w in TOKEN_BONUS:
        if token in low.split():
            test = kind.isin(*names)
            for part in parts:
                test = test | path.contains(part)
            if flag:
                test = test | F.coalesce(has(df, flag, "boolean"), F.lit(False))
            bonus = bonus + F.when(test, w).otherwise(0.0)
    bonus = bonus + F.when(hits >= MANY_TERMS, MANY_BONUS).otherwise(0.0)
    abstract = path.contains("/framework/") & (cls.endswith("interface") | cls.startswith("abstract"))
    return F.least(bonus + F.when(abstract, ABSTRACT_MALUS).otherwise(0.0), F.lit(MOST_BONUS))


def hybrid_search(index: DataFrame, vector: list[float], query: str, k: int, adjustment: Callable[[DataFrame], Column] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """rank, id, path, score: the 3k nearest rows by similarity, bonus and learned adjustment.

    metadata: what the bonus reads besides the index's own columns, by id; joined to the 3k rows only.
    """
    near = reranked(index, vector, query, 3 * k, adjustment, metadata)
    top = near.orderBy(F.desc("score"), "id").limit(k)
    return ranked(top.select("id", "path", "score"), [F.desc("score"), F.col("id")])


def reranked(index: DataFrame, vector: list[float], query: str, candidates: int, adjustment: Callable[[DataFrame], Column] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The nearest rows with similarity and score, in no order."""
    near = nearest(index, vector, candidates)
    if metadata is not None:  # the side that is broadcast has no more rows than the limit
        near = metadata.join(F.broadcast(near.drop("embedding")), "id")
    learned = F.lit(0.0) if adjustment is None else adjustment(near)
    return near.withColumn("score", F.round(F.col("similarity") + keyword_bonus(near, query) + learned, 6))


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a limited result with their rank; the window has no more rows than the limit."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def batch_nearest(index: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, id, similarity for many query vectors (query_id, vector) of one dimension.

    The query set is stated by the caller. Blocks of query_rows of them, dealt by a hash, go to all tasks; a task multiplies
    each Arrow batch of the index by a block and keeps its k best rows a query, so that k rows a query and task meet for the
    ranks. Invalid vectors and those of another dimension are no candidates; an invalid query has no results.
    """
    asked = queries.where(is_valid(F.col("vector")))
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(index.dtypes)["id"]}
    blocks = max(1, -(-asked.count() // query_rows))
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = some.select("query_id", "vector").collect()  # one block
        if not rows:
            continue
        top = index.select("id", "embedding").mapInArrow(_best_of([r[0] for r in rows], to_arrow_type(queries.schema["query_id"].dataType), np.array([r[1] for r in rows], float), k), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
        own = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        top = top.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return queries.limit(0).select("query_id", F.lit(1).cast("long").alias("rank"), F.lit(None).cast(kinds["id"]).alias("id"), F.lit(0.0).alias("similarity"))
    return out.select("query_id", "rank", "id", "similarity")


def _best_of(names: list, query_kind, vectors: np.ndarray, k: int):
    """Batches (id, embedding) -> the k best rows of a partition for each query."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, scores = [np.zeros(0, object)] * len(names), [np.zeros(0)] * len(names)
        kind = None
        for b in batches:
            kind = b.column(0).type
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            fit = b.filter(pa.array(sizes == unit.shape[1]))
            if not fit.num_rows:
                continue
            flat = fit.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(fit.num_rows, -1)
            size = np.sqrt((x * x).sum(1))
            ok = np.isfinite(size) & (size * size > 1e-12)
            own = np.array(fit.column(0).to_pylist(), object)[ok]
            near = np.round(unit @ (x[ok] / size[ok, None]).T, 6)
            for q in range(len(names)):
                s, i = np.concatenate([scores[q], near[q]]), np.concatenate([ids[q], own])
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    some = np.flatnonzero(s >= least)
                    some = some[sorted(range(len(some)), key=lambda j: (-s[some[j]], i[some[j]]))[:k]]
                    s, i = s[some], i[some]
                scores[q], ids[q] = s, i
        for q, name in enumerate(names):
            if len(ids[q]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids[q]), query_kind), pa.array(ids[q].tolist(), kind), pa.array(scores[q])], ["query_id", "id", "similarity"])

    return run


def metadata_boost(df: DataFrame, file_type: str | None = None, path_contains: tuple[str, ...] = (), flags: tuple[str, ...] = (), component_type: str | None = None, weight: float = 0.3) -> DataFrame:
    """score plus a weight for each property that holds."""
    bonus = F.lit(0.0)
    tests = [F.col("type") == file_type] if file_type else []
    tests += [F.lower("path").contains(p.lower()) for p in path_contains]
    tests += [F.col(f) for f in flags]
    tests += [F.col("component_type") == component_type] if component_type else []
    for t in tests:
        bonus = bonus + F.when(t, weight).otherwise(0.0)
    return df.withColumn("score", F.coalesce("score", F.lit(0.0)) + bonus)


def bm25_rerank(df: DataFrame, query: str, weight: float = 0.3) -> DataFrame:
    """score plus the weighted term weight of text, class name and path, which adds 1 at most."""
    terms = T.query_terms(query)
    if not terms:
        return df.withColumn("bm25", F.lit(0.0))
    text = F.concat_ws(" ", *(F.coalesce(has(df, c), F.lit("")) for c in ("search_text", "class_name", "path")))
    return df.withColumn("bm25", T.bm25(text, terms)).withColumn("score", F.coalesce("score", F.lit(0.0)) + F.least(F.col("bm25") * weight, F.lit(1.0)))


def formatted(df: DataFrame, snippet: int = 300, verbose: int = 3) -> DataFrame:
    """rank, id, path, score to 3 digits, badges, and for the first rows a snippet."""
    flags = [c for c in ("is_plugin", "is_controller", "is_observer", "is_repository", "is_resolver", "is_model", "is_block") if c in df.columns]
    badges = F.array_join(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c[3:])) for c in flags))), ",") if flags else F.lit("")
    text = F.when(F.col("rank") <= verbose, F.substring(F.coalesce(has(df, "search_text"), F.lit("")), 1, snippet))
    return df.select("rank", "id", "path", F.round("score", 3).alias("score"), badges.alias("badges"), text.alias("snippet"))
