"""Near duplicates by a chosen-path set similarity join.

Texts are sets of word shingles. Documents with equal sets form a class, whose smallest doc_id stands for it. Each
representative gets T minwise values. A tree branches the representatives by selected minwise tokens: the root sends
each to the child that one of its minwise values names; a node with more than NODE_ROWS members sends each member to
two children by values that a hash of the node selects; small nodes are compared exhaustively. Independent trees repeat
this to the wanted recall. Candidates are confirmed on full sets, and the confirmed links are joined to components.

The target is a miss of 3e-5 at most for a pair at similarity 0.8, at every size of table. Such a pair meets in a tree
with probability 0.8 at the root; with two children at each level q becomes 1 - (1 - 0.8 q)^2 and no depth brings it
under 0.75 (0.77, 0.757, 0.753 ... at levels 1, 2, 3 ...). All 8 trees miss it with 3e-6 at the root and never more than
1.53e-5. The sketch rules it out with 9e-6 (fewer than 0.8 - MAYBE_SLACK of 128 values agree). More alike pairs are
missed far more rarely.

A node that stays large at DEPTH holds near copies by the thousand, or texts around a long shared passage. So does a
large node that keeps more than KEPT_PERCENT of its parent's members: they would go down together, twice as many rows at
each level and in each tree, and end in such nodes. It is not divided further. Pairs inside it are found exactly, so that
nothing is lost by stopping early. Members of both kinds of node are dealt into random cells of NODE_ROWS members, tied together by three members of the node that join every cell. The
cells only bring most near copies into one component early. What they miss is found exactly: all documents of such
nodes, of all trees together, go through a prefix-filter join on full sets. Shingles are ranked from the rarest; two
sets at the threshold share a shingle behind which both have enough others left. Pairs inside a component are left out,
and texts that differ from a common passage or original by more than the threshold allows have no such shingle with
it, so that the work does not grow with all pairs of a node. What remains of the square: members of one posting list that
are unlinked, though each alone lies close enough to a common original.

In a cell with many candidates a spanning forest of them, the most alike first, is confirmed on full sets before the
others. With the components of the confirmed links, such cells are read again: every pair of different components is
confirmed too, whatever the forest held. No link between different components is lost by this, and no pair list of a
dense group is made.

Nulls, empty texts and texts without words have the empty set, which is linked with nothing. Repeated rows (same
doc_id) collapse to one row, whose component is the smallest of its texts'. Rows with a null doc_id are left out. Other
columns are ignored, whatever they are called. Very long texts count with all their shingles. Of documents that tie, as
copies do, the smallest doc_id stands for all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cleaned, keeps, lean, text_of, tune, written

T, TREES, NODE_ROWS, DEPTH = 128, 8, 64, 3
#: A large node that keeps more than this share of its parent's members is not divided further.
KEPT_PERCENT = 50
#: Rows of documents in candidate pairs that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Members of a posting list that one task compares at once.
POSTING_ROWS = 50_000
MAYBE_SLACK = 0.16
#: The words of a text, and the letters that are lower-cased.
WORDS = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD_CACHE = 200_000


class _Hashes(dict):
    """64-bit hashes by word; one that is missing is made."""

    def __missing__(self, word: str) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_cache = _Hashes()
keeps(__name__, _cache.clear)
_rng = np.random.default_rng(20240229)
_SALT = _rng.integers(0, 1 << 63, T, np.uint64)
#: Odd factors of 64 bits, so that products wrap: shorter ones would keep the order of the hashes.
_A = _rng.integers(1 << 62, 1 << 63, T, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, T, np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    if len(_cache) > _WORD_CACHE:
        _cache.clear()
    found = (text.lower() if text.isascii() else text.translate(_LOWER)).split() if text.isascii() and not _ODD.search(text) else WORDS.findall(text.translate(_LOWER))
    return np.fromiter(map(_cache.__getitem__, found), np.uint64, len(found))


#: Letters that str.split() takes for white space and WORDS does not.
_ODD = re.compile("[\x1c-\x1f\x85]")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of so many words; with fewer words, of the whole sequence; empty without words."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = _mixed(acc * _M1 + h[j : j + n] * _M2)
    return np.unique(acc)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """T minwise values of 32 bits, as 64-bit integers."""
    out = np.full(T, (1 << 32) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            part = (hashes[i : i + 2048, None] * _A[None, :] + _B[None, :]).min(0) >> np.uint64(32)
            out = np.minimum(out, part)
    return out


def _sketched(words: int, trees: int):
    """doc_id, n, digest of the set (d1, d2), children of the roots, sketch (low 16 bits of each minwise value)."""

    def run(batches):
        for b in batches:
            n, d1, d2, roots, sketch = [], [], [], [], []
            with np.errstate(over="ignore"):
                for t in b.column(1):
                    s = shingles(t.as_py(), words)
                    n.append(len(s))
                    if not len(s):
                        for x in (d1, d2, roots, sketch):
                            x.append(None)
                        continue
                    d1.append(int(np.bitwise_xor.reduce(_mixed(s)).view(np.int64)))
                    d2.append(int(_mixed(s + _M1).sum(dtype=np.uint64).view(np.int64)))
                    m = minwise(s)
                    roots.append(_mixed(m[:trees] + _SALT[:trees]).view(np.int64))
                    sketch.append(m.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n", "d1", "d2", "roots", "sketch"])

    return run


def _child(node, salt, sketch):
    """The child that a node's member goes to: the node's hash selects one of the member's minwise values."""
    i = F.pmod(F.xxhash64(node, salt, F.lit("select")), F.lit(T)).cast("int")
    return F.xxhash64(node, salt, i, F.substr(sketch, i * 2 + 1, F.lit(2)))


def _pairs_of_cells(least: float, forest: bool):
    """Rows sorted by cell -> candidate pairs of different labels, not dense. With forest, a cell of many candidates gives
    a spanning forest of them and a row (cell, cell, dense). Rows of a cell that a batch cuts are carried to the next."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())])

    def compare(cell, ids, n, label, sketch):
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([starts, [len(cell)]]))
        group = np.repeat(np.arange(len(starts)), size)
        left, right, like = [], [], []
        order = np.arange(len(cell))
        for s in range(1, int(size.max(initial=1))):
            i = order[:-s][group[s:] == group[:-s]] if s < len(cell) else order[:0]
            if not len(i):
                break
            j = i + s
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (lo >= least * hi - 1e-9) & (label[i] != label[j])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 20_000):
                x, y = i[k : k + 20_000], j[k : k + 20_000]
                est = (sketch[x] == sketch[y]).mean(1)
                ok = est >= least - MAYBE_SLACK
                left.append(x[ok])
                right.append(y[ok])
                like.append(est[ok])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        left, right, like = np.concatenate(left), np.concatenate(right), np.concatenate(like)
        at = np.lexsort((right, left, -like, group[left]))
        left, right, like = left[at], right[at], like[at]
        per = np.bincount(group[left], minlength=len(starts))
        dense = (per > 2 * size) & forest
        keep = ~dense[group[left]]
        top = {}

        def root(v):
            while (p := top.get(v, v)) != v:
                top[v] = top.get(p, p)
                v = top[v]
            return v

        for k in np.flatnonzero(~keep):  # by group, the surest first
            a, b = root(int(left[k])), root(int(right[k]))
            if a != b:
                keep[k] = True
                top[max(a, b)] = min(a, b)
        a, b, c = ids[left[keep]], ids[right[keep]], cell[starts[dense]]
        return np.concatenate([np.minimum(a, b), c]), np.concatenate([np.maximum(a, b), c]), np.repeat([False, True], [len(a), len(c)])

    def run(batches):
        held = None
        for b in batches:
            sketch = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(-1, T)
            now = (*(b.column(k).to_numpy() for k in range(4)), sketch)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = tuple(x[cut:] for x in now)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(*(x[:cut] for x in now))], schema=schema)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(*held)], schema=schema)

    return run


def _in_cells(cells: DataFrame, reps: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """a, b, dense of the cells (cell, doc_id, label)."""
    full = cells.join(reps.select("doc_id", "n", "sketch"), "doc_id").select("cell", "doc_id", "n", "label", "sketch")
    return full.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(lean(_pairs_of_cells(threshold, forest), __name__), "a long, b long, dense boolean")


def _cells(reps: DataFrame, node_rows: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """cell, doc_id of small nodes; of random cells of nodes that are left large; the documents of the latter. Nodes are
    joined by key and size alone."""
    members, cells, left = reps.select("doc_id", F.explode("roots").alias("node"), F.lit(None).cast("long").alias("of")), None, None
    for level in range(depth + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        sized, _ = written(members.join(sizes, "node"), "members")
        small = sized.where(F.col("size") <= node_rows).select(F.col("node").alias("cell"), "doc_id")
        cells = small if cells is None else cells.unionByName(small)
        large = sized.where(F.col("size") > node_rows)
        # of: the parent's members, null at the roots
        whole = F.lit(level == depth) | F.coalesce(100 * F.col("size") > KEPT_PERCENT * F.col("of"), F.lit(False))
        stays = large.where(whole).select("doc_id", "node")
        left = stays if left is None else left.unionByName(stays)
        large = large.where(~whole)
        if level == depth or large.isEmpty():
            break
        held = large.join(reps.select("doc_id", "sketch"), "doc_id")
        child = lambda k: _child(F.col("node"), F.lit(2 * level + k), F.col("sketch")).alias(f"child{k}")  # noqa: E731, B023
        both, _ = written(held.select("doc_id", child(0), child(1), F.col("size").alias("of")), "members")
        members = both.select("doc_id", F.col("child0").alias("node"), "of").unionByName(both.select("doc_id", F.col("child1").alias("node"), "of"))
    if left.isEmpty():
        return cells, cells.limit(0), None
    deep, _ = written(left.groupBy("doc_id").agg(F.array_distinct(F.array(F.min("node"), F.max("node"))).alias("nodes")), "deep")
    large = deep.select("doc_id", F.explode("nodes").alias("node"))
    large = large.join(large.groupBy("node").agg(F.count("*").alias("size")), "node")
    parts = F.ceil(F.col("size") / node_rows).cast("int")
    dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("doc_id", "node"), parts)).alias("cell"), "doc_id")
    by_hash = F.struct(F.xxhash64("doc_id", "node").alias("h"), "doc_id")
    leaders = large.groupBy("node", "size").agg(F.array(F.min("doc_id"), F.min(by_hash)["doc_id"], F.max(by_hash)["doc_id"]).alias("lead"))
    leaders = leaders.select("node", "lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("node", "part", F.explode("lead").alias("doc_id"))
    dealt = dealt.unionByName(leaders.select(F.xxhash64("node", F.col("part").cast("long")).alias("cell"), "doc_id")).distinct()
    return cells, dealt, deep.select("doc_id")


def _prefixes(full: DataFrame, deep: DataFrame, percent: int) -> DataFrame:
    """token, doc_id, n, rest: the rarest shingles of each set, as many as must hold one of any set at the threshold, and
    how many shingles of the set stand from that one on."""

    def tokens(batches):
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = np.frombuffer(x.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i)), pa.array(np.full(len(t), len(t))), pa.array(t)], ["doc_id", "n", "token"])

    rows = full.join(deep, "doc_id", "left_semi").mapInArrow(lean(tokens, __name__), "doc_id long, n long, token long")
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("token")))
    ranked = counted.withColumn("rest", F.col("n") + 1 - F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token")))
    return ranked.where((100 * F.col("rest") >= percent * F.col("n")) & (F.col("df") > 1)).select("token", "doc_id", "n", "rest")


def _pairs_of_postings(percent: int, one: bool):
    """Rows (cell, doc_id, n, rest, label, main, place, parts, part) sorted by cell and n -> pairs of different labels that
    the prefixes allow; with one, a single pair of each member and other label in a cell.

    Two sets meet at the threshold only if, from the first shingle that they share, both have enough shingles left. Sizes
    are sorted, so that the partners that the sizes allow are one range for each member.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(cell, ids, n, rest, label, main, place, parts, part):
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        stops = np.concatenate([starts[1:], [len(cell)]])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        most = ((100 + percent) * rest) // percent - n  # the largest partner
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            size, lab = n[s:e], label[s:e]
            low = np.searchsorted(size, -(-percent * size // 100), "left")
            high = np.searchsorted(size, np.minimum(100 * size // percent, most[s:e]), "right")
            for i in np.flatnonzero(~main[s:e] & (high > low)):
                j = np.arange(low[i], high[i])
                k = j + s
                ok = (lab[j] != lab[i]) & (rest[k] * (100 + percent) >= percent * (size[j] + size[i]))
                # two members that are not of the main label meet in one part only, once
                ok &= main[k] | ((j > i) & ((place[k] + place[s + i]) % parts[s + i] == part[s + i]))
                k = k[ok]
                if one:
                    k = k[np.unique(label[k], return_index=True)[1]]
                left.append(np.minimum(ids[k], ids[s + i]))
                right.append(np.maximum(ids[k], ids[s + i]))
        return np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)

    def run(batches):
        held = None
        for b in batches:
            now = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = tuple(x[cut:] for x in now)
            if cut:
                p = compare(*(x[:cut] for x in now))
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=schema)
        if held is not None and len(held[0]):
            p = compare(*held)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=schema)

    return run


def _of_postings(prefixes: DataFrame, found: DataFrame, reps: DataFrame, percent: int, one: bool) -> DataFrame:
    """Pairs of the prefix join between different components whose sketches do not rule them out.

    A posting list of more than POSTING_ROWS members is dealt into parts: members of its largest component go to one part,
    the others to all.
    """

    def alike(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, T) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= percent / 100 - MAYBE_SLACK, pa.bool_()))

    sizes = found.groupBy(F.col("component").alias("label")).agg(F.count("*").alias("weight"))
    labelled = prefixes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("token", "doc_id", "n", "rest", F.coalesce("component", "doc_id").alias("label")).join(sizes, "label", "left")
    own = Window.partitionBy("token")
    largest = F.max(F.struct(F.coalesce("weight", F.lit(1)).alias("weight"), "label")).over(own)
    rows = labelled.withColumns({"size": F.count("*").over(own), "least": F.min("n").over(own), "most": largest["label"], "x": F.min("label").over(own), "y": F.max("label").over(own)})
    rows = rows.where("x <> y").drop("x", "y")
    # some partner that the sizes allow
    rows = rows.where(F.expr(f"{100 + percent} * rest div {percent} - n >= greatest(least, ({percent} * n + 99) div 100)"))
    rows = rows.withColumn("main", F.col("label") == F.col("most")).withColumn("parts", F.ceil(F.col("size") / POSTING_ROWS).cast("long"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("place")), F.col("parts")))
    rows = rows.withColumn("part", F.explode(F.when(F.col("main"), F.array("place")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    rows = rows.select(F.xxhash64("token", "part").alias("cell"), "doc_id", "n", "rest", "label", "main", "place", "parts", "part")
    pairs = rows.repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(lean(_pairs_of_postings(percent, one), __name__), "a long, b long").distinct()
    sketch = lambda i, s: reps.select(F.col("doc_id").alias(i), F.col("sketch").alias(s))
    return pairs.join(sketch("a", "x"), "a").join(sketch("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(lean(alike, __name__), "a long, b long")


def _full_sets(texts: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """doc_id, s: the full sets of these documents."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "s"])

    ends, _ = written(ends.distinct(), "ends")
    if ends.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    return written(texts.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(lean(sets, __name__), "doc_id long, s binary"), "sets", "none")[0]


def _confirmed(full: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: percent of the union lie in both."""

    def test(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(test, __name__), "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links reach.

    Each round every node goes to its smallest neighbour (and that one's smallest), and the links are rewritten between
    what is left: links inside go, so that the links shrink from round to round. Each round is a written table.
    """
    links, _ = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "links")
    labels = None
    while True:
        near = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.min("v").alias("v"))
        near, _ = written(near.select(F.col("u").alias("node"), F.least("u", "v").alias("c")), "nearest")
        hop = near.join(near.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left")
        step, _ = written(hop.select("node", F.coalesce("cc", "c").alias("c")), "steps")
        to = lambda x, y: step.select(F.col("node").alias(x), F.col("c").alias(y))
        if labels is None:
            labels = step
        else:
            moved = labels.join(to("c", "next"), "c", "left")
            labels, _ = written(moved.select("node", F.coalesce("next", "c").alias("c")), "labels")
        left = links.join(to("u", "cu"), "u").join(to("v", "cv"), "v").where("cu <> cv")
        links, _ = written(left.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), "links")
        if links.isEmpty():
            return labels.select("node", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, trees: int = TREES, node_rows: int = NODE_ROWS, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document, as a table of the shared folder."""
    spark = docs.sparkSession
    tune(spark)
    with cleaned(spark) as keep:
        out, path = written(_grouped(docs, doc_id, text, words, percent, trees, node_rows, depth), "groups")
        keep.append(path)
    return out


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, trees: int, node_rows: int, depth: int) -> DataFrame:
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    sketches, _ = written(texts.mapInArrow(lean(_sketched(words, trees), __name__), "doc_id long, n long, d1 long, d2 long, roots array<long>, sketch binary"), "sketches")
    first = F.min(F.struct("doc_id", "roots", "sketch"))
    classes, _ = written(sketches.where("n > 0").groupBy("d1", "d2", "n").agg(first.alias("rep"), F.count("*").alias("copies")), "classes")
    reps = classes.select("rep.doc_id", "n", "rep.roots", "rep.sketch")
    cells, dealt, deep = _cells(reps, node_rows, depth)
    own = cells.unionByName(dealt).withColumn("label", F.col("doc_id"))
    met, _ = written(_in_cells(own, reps, percent / 100, True).distinct(), "pairs")
    pairs = met.where("not dense").select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    dense, _ = written(cells.join(met.where("dense").select(F.col("a").alias("cell")), "cell", "left_semi"), "dense")
    ends = ends.unionByName(dense.select("doc_id"))
    full = _full_sets(texts, ends if deep is None else ends.unionByName(deep), words)
    links, _ = written(_confirmed(full, pairs, percent), "confirmed")
    found = components(links)
    labelled = dense.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("cell", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    several = labelled.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cell")
    again = _in_cells(labelled.join(several, "cell", "left_semi"), reps, percent / 100, False).select("a", "b").distinct()
    # pairs of the forest that failed come again and fail again
    more, _ = written(_confirmed(full, again, percent), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    if deep is not None:
        prefixes, _ = written(_prefixes(full, deep, percent), "prefixes")
        for one in (True, False):
            more, _ = written(_confirmed(full, _of_postings(prefixes, found, reps, percent, one), percent), "confirmed")
            if not more.isEmpty():
                links = links.unionByName(more)
                found = components(links)
    thin_classes = classes.select("d1", "d2", F.col("n").alias("cn"), F.col("rep.doc_id").alias("node"), "copies")
    moved = thin_classes.join(found, "node", "left").where((F.col("copies") > 1) | (F.col("component") != F.col("node"))).select("d1", "d2", "cn", F.coalesce("component", "node").alias("c"))
    thin = sketches.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2", F.col("n").alias("cn"))
    out = thin.join(moved, ["d1", "d2", "cn"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    out = out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
