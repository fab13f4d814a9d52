"""Near-duplicate vectors by a forest of random-projection trees (operator 5).

Vectors are compared only within a label (and a dimension). Each tree splits a node of more than LEAF vectors at the
median of the projections on a random direction, one for each level; vectors within SPILL standard deviations of the projected
difference of two vectors at the threshold go to both sides. Such a pair parts at a split only if its difference projects to more than
twice SPILL of them and the median falls between with both margins, less than once in a thousand splits; all TREES trees
have to part it for a link to be missed. A node
that spilling can't divide stays a leaf. Leaves compare all their pairs by exact cosines, large ones in tiles
(links.py); every link is a verified pair.

The cuts of the trees are fitted on FIT vectors for each LEAF of a label, FIT_MOST at most (FIT_BYTES of them), chosen by their hashes; they
say only where a node is divided, and a cut beside the median makes one side larger, but loses nothing. All vectors then go down all trees at once,
in batches, and are written once, with the leaves that they came to. They are dealt out by groups, the first nodes of a tree that have GROUP_BYTES of
vectors at most (less where that gives too few groups for all cores), or all trees of a smaller label: whoever gets a group compares the leaves below. A group of over
twice as much, a leaf that wasn't divided, is cut into tiles. A label of more than about FIT_MOST / FIT_LEAST leaves
has larger ones, which are cut into tiles. The driver holds 24 bytes for each cut.

Equal vectors of a label are one node with a weight. Vectors that are null, zero or hold null or non-finite components, and
those without a label, link with nothing; so do rows without a vec_id. Rows of equal vec_ids are rows of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.llm import links
from reckoner.llm.common import forget, saved, table
from reckoner.llm.hashing import mix

COSINE, TREES, LEAF, MOST_LEVELS = 0.98, 3, 6_000, 40
SPILL = 1.5
#: Vectors that a leaf's share of the fit has, all that a label has at most, in number and bytes, and the least that are divided further where they stand for more.
FIT, FIT_MOST, FIT_BYTES, FIT_LEAST = 500, 50_000, 64 << 20, 32
#: Vectors that go to one task together for all leaves that they come to there, and groups for each core where they are fewer.
GROUP_BYTES, GROUPS = 24 << 20, 3
#: Labels or large leaves whose sizes are broadcast (about 50 bytes each).
BROADCAST_NODES = 20_000

#: Cuts of a part's trees: for each tree the paths of the nodes that are divided, in order, their cuts, and about how many vectors they have.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]
Model = dict[int, list[Tree]]


def _usable() -> Column:
    named = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(named & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and node (identity of label and embedding) of the rows that can link."""
    return vectors.select("vec_id", "label", "embedding").where(_usable()).withColumn("node", F.xxhash64("label", "embedding"))


def _vectors(rows: DataFrame, kind: type) -> DataFrame:
    """node, part (hash of label and dimension), weight, least (vec_id), vector (components as bytes, of the given kind): one row for each node."""
    nodes = rows.groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    numbers = F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>")
    nodes = nodes.select("node", F.xxhash64("label", F.size("embedding")).alias("part"), "weight", "least", numbers.alias("embedding"))
    names, size = ["node", "part", "weight", "least"], np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            lists = b.column("embedding")
            at = (np.asarray(lists.offsets) - lists.offsets[0].as_py()) * size if len(lists) else np.zeros(1)
            data = np.ascontiguousarray(np.asarray(lists.flatten()), kind)
            vectors = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), vectors], [*names, "vector"])

    return nodes.mapInArrow(run, f"node long, part long, weight long, least {rows.schema['vec_id'].dataType.simpleString()}, vector binary")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    return unit


def _projections(unit: np.ndarray, tree: int, levels: int) -> np.ndarray:
    """The rows' projections on the tree's directions, one for each level."""
    size = unit.shape[1]
    directions = np.array([np.random.default_rng([tree, level, size]).standard_normal(size) for level in range(levels)]).reshape(levels, size)
    return unit @ (directions / np.linalg.norm(directions, axis=1, keepdims=True)).T


def _margin(size: int) -> float:
    return SPILL * np.sqrt((2 - 2 * COSINE) / size)


def _grown(p: np.ndarray, margin: float, stands_for: float, leaf: int) -> list[tuple[int, float, float]]:
    """Paths, cuts and sizes of the nodes of one tree that are divided; p: projections of some vectors on the directions of all levels, stands_for: vectors that each of them stands for."""
    divided, open_nodes = [], [(1, 0, np.arange(len(p)))]
    while open_nodes:
        path, level, own = open_nodes.pop()
        if len(own) * stands_for <= leaf or level == p.shape[1] or stands_for > 1 and len(own) < FIT_LEAST:
            continue
        low, cut, high = np.quantile(x := p[own, level], (0.1, 0.5, 0.9))
        left, right = own[x <= cut + margin], own[x > cut - margin]
        if high - low < 4 * margin or len(left) + len(right) > 1.4 * len(own):  # spilling can't divide it
            continue
        divided.append((path, float(cut), len(own) * stands_for))
        open_nodes += [(2 * path, level + 1, left), (2 * path + 1, level + 1, right)]
    return divided


def forest(nodes: DataFrame, kind: type) -> tuple[Model, int, list[DataFrame]]:
    """Cuts of the trees of all parts with more vectors than a leaf, bytes of their vectors, and the written tables that they were made from; nodes: node, part, vector."""
    item, most_levels = np.dtype(kind).itemsize, MOST_LEVELS
    sizes = nodes.groupBy("part").agg(F.count("*").alias("size"), F.first(F.octet_length("vector")).alias("bytes"))
    leaf = F.least(F.lit(LEAF), F.greatest(F.lit(100), F.floor(F.lit(links.TILE_BYTES) / F.col("bytes")).cast("int")))  # fewer if they are long
    share = F.least(F.lit(1.0), F.lit(FIT) / leaf, F.lit(FIT_MOST) / F.col("size"), F.lit(FIT_BYTES) / (F.col("size") * F.col("bytes")))
    sizes = saved(sizes.where(F.col("size") > leaf).select("part", "size", "bytes", leaf.alias("leaf"), share.alias("share")), "sizes")
    chosen = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    some = nodes.join(_few(sizes), "part").where(chosen).select("part", "size", "leaf", "vector")

    def grow(group: pa.Table) -> pa.Table:
        width = len(group.column("vector")[0].as_py()) // item
        one, size, leaf = (group.column(c)[0].as_py() for c in ("part", "size", "leaf"))
        flat = [np.frombuffer(b"".join(c.to_pylist()), kind).reshape(-1, width) for c in group.column("vector").chunks if len(c)]
        out = []
        for tree in range(TREES):
            p = np.concatenate([_projections(_unit(x[k : k + 1_000]), tree, most_levels) for x in flat for k in range(0, len(x), 1_000)])
            out += [(one, tree, *x) for x in _grown(p, _margin(width), size / len(p), leaf)]
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["part", "tree", "path", "cut", "vectors"])

    cuts = saved(some.groupBy("part").applyInArrow(grow, "part long, tree int, path long, cut double, vectors double"), "cuts")
    model: Model = {}
    found = cuts.orderBy("part", "tree", "path").toArrow()
    part, tree, path, cut, vectors = (found.column(c).to_numpy() for c in found.column_names)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for s, e in itertools.pairwise(edges if len(part) else []):
        at = [slice(s + int(np.searchsorted(tree[s:e], t)), s + int(np.searchsorted(tree[s:e], t, side="right"))) for t in range(TREES)]
        if all(a.stop > a.start for a in at):  # a tree of one leaf compares all pairs of its part: the others have nothing to add
            model[int(part[s])] = [(path[a].copy(), cut[a].copy(), vectors[a].copy()) for a in at]
    return model, sizes.agg(F.sum(F.col("size") * F.col("bytes"))).first()[0] or 0, [sizes, cuts]


def _reached(unit: np.ndarray, trees: list[Tree], group: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, trees and paths of all leaves that the rows come to, and the path of the first node above each that has at most so many vectors as a group, or of the leaf."""
    margin, out = _margin(unit.shape[1]), []
    for tree, (paths, cuts, vectors) in enumerate(trees):
        p = _projections(unit, tree, int(paths[-1]).bit_length())
        row, path, above = np.arange(len(unit)), np.ones(len(unit), np.int64), np.zeros(len(unit), np.int64)
        for level in range(p.shape[1] + 1):
            at = np.minimum(np.searchsorted(paths, path), len(paths) - 1)
            inner = paths[at] == path
            above = np.where((above == 0) & (~inner | (vectors[at] <= group)), path, above)
            out.append((row[~inner], np.full(int((~inner).sum()), tree), path[~inner], above[~inner]))
            row, path, above, cut = row[inner], path[inner], above[inner], cuts[at[inner]]
            if not len(row):
                break
            left, right = p[row, level] <= cut + margin, p[row, level] > cut - margin
            row, above = np.concatenate([row[left], row[right]]), np.concatenate([above[left], above[right]])
            path = np.concatenate([2 * path[left], 2 * path[right] + 1])
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def _named(part: np.ndarray, tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Names of nodes of trees; the root has one name in all trees of a part."""
    return mix(mix(part) ^ np.where(path == 1, 1, path * TREES + tree).astype(np.uint64)).view(np.int64)


def reach(nodes: DataFrame, model: Model, kind: type, group_bytes: int) -> DataFrame:
    """node, weight, least, vector, others (all leaves that the node comes to, in order) and dealt (its groups, and which of its leaves are within each)."""
    kept, item = ["node", "weight", "least", "vector"], np.dtype(kind).itemsize
    known = np.sort(np.array(list(model), np.int64))

    def run(batches):
        for b in batches:
            part, vectors = b.column("part").to_numpy(), b.column("vector")
            offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
            data = np.frombuffer(vectors.buffers()[2] or b"", np.uint8)
            whole = np.flatnonzero(~np.isin(part, known))
            one = np.ones(len(whole), np.int64)
            found = [(whole, _named(part[whole], 0 * one, one), _named(part[whole], 0 * one, one))]
            for k in np.intersect1d(part, known):
                own = np.flatnonzero(part == k)
                size = int(offsets[own[0] + 1] - offsets[own[0]])
                raw = np.lib.stride_tricks.sliding_window_view(data, size)[offsets[own]]
                row, tree, path, above = _reached(_unit(raw.view(kind).reshape(len(own), size // item)), model[int(k)], group_bytes / size)
                found.append((own[row], _named(part[own[row]], tree, path), _named(part[own[row]], tree, above)))
            row, leaf, group = (np.concatenate([x[k] for x in found]) for k in range(3))
            order = np.lexsort((leaf, row))
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(at), pa.array(leaf[order]))
            order = np.lexsort((leaf, group, row))
            row, leaf, group = row[order], leaf[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group) != 0)])[: len(row)])
            within = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(leaf))
            groups = pa.StructArray.from_arrays([pa.array(group[first]), within], ["bucket", "within"])
            at = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(part)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), others, pa.ListArray.from_arrays(pa.array(at), groups)], [*kept, "others", "dealt"])

    least = nodes.schema["least"].dataType.simpleString()
    return nodes.select("part", *kept).mapInArrow(run, f"node long, weight long, least {least}, vector binary, others array<long>, dealt array<struct<bucket:long,within:array<long>>>")


def _few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows


def _part(unit: np.ndarray, other: bool) -> np.ndarray:
    """A fourth of the components, and two more, by which the product of a vector and another is minus half of the squared distance in these."""
    some = unit[:, ::4]
    half, one = -np.einsum("ij,ij->i", some, some)[:, None] / 2, np.ones((len(unit), 1))
    return np.hstack([some, one, half] if other else [some, half, one]).astype(np.float32)


def _judge(kind: type) -> tuple:
    """What links.linked() asks for. A fourth of the components rules most pairs out, since two vectors at the threshold are not farther apart in these than in all.
    The others are judged in double precision, or, where they are many, all pairs in single precision and in double where that could be on the wrong side."""

    def ready(right: links.Side) -> tuple[np.ndarray, np.ndarray, int]:
        unit = _unit(right.matrix("vector", kind))
        part = _part(unit, True)
        none = np.zeros((7, part.shape[1]), np.float32)
        none[:, -1] = -2  # rows by eights have no pairs beyond the tile
        return np.vstack([part, none]), unit.astype(np.float32), right.first

    def near(left: links.Side, right: links.Side, known: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        part, unit, first = known
        mine, begin, n = _unit(left.matrix("vector", kind)), right.first - first, len(right)
        error = (unit.shape[1] + 8) * 2.0**-23  # of a sum of so many products whose sizes sum up to 1
        wide = -(-n // 8) * 8
        maybe = (_part(mine, False) @ part[begin : begin + wide].T >= np.float32(COSINE - 1 - 2 * error)).view(np.uint64)
        at = np.flatnonzero(maybe)
        row, column = np.divmod(at, wide // 8)
        bit, byte = np.nonzero(maybe.reshape(-1)[at][:, None].view(bool))
        row, column = row[bit], column[bit] * 8 + byte
        row, column = row[column < n], column[column < n]
        hit = np.zeros((len(left), n), bool)
        if len(row) * 50 > hit.size:
            rough = mine.astype(np.float32) @ unit[begin : begin + n].T
            hit = rough >= np.float32(COSINE + error)
            row, column = np.nonzero((rough >= np.float32(COSINE - error)) & ~hit)
        theirs = right.matrix("vector", kind)
        for k in range(0, len(row), 10_000):
            i, j = row[k : k + 10_000], column[k : k + 10_000]
            hit[i, j] = np.einsum("ij,ij->i", mine[i], _unit(theirs[j])) >= COSINE
        return hit

    return near, ready


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id (least vec_id reachable by links, itself included), kept."""
    kind = np.float32 if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType) else np.float64
    rows = usable(vectors).select("vec_id", "label", "embedding", "node")
    nodes = saved(_vectors(rows, kind), "vectors")
    model, divided, spent = forest(nodes, kind)
    group = min(GROUP_BYTES, divided // (GROUPS * vectors.sparkSession.sparkContext.defaultParallelism))
    leaves = saved(reach(nodes, model, kind, group).withColumn("bytes", F.octet_length("vector")), "leaves")
    forget(nodes, *spent)
    one = leaves.withColumn("_d", F.explode("dealt")).select("node", "weight", "vector", "bytes", "others", "_d.bucket", "_d.within")
    large = one.groupBy("bucket").agg(links.tiles(F.count("*"), F.sum("bytes")).alias("tiles"), F.sum("bytes").alias("all"), F.max("bytes").alias("bytes"))
    leaf = F.least(LEAF * F.col("bytes"), F.lit(links.TILE_BYTES))
    large = saved(large.where(F.col("all") > 2 * F.greatest(leaf, F.lit(group))).select("bucket", "tiles"), "sizes")
    tiled = one.join(_few(large), "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    near, ready = _judge(kind)
    found = saved(links.linked(tiled, near, ["vector"], ready), "links")
    forget(large)
    linked, component = links.summary(found)
    nodes = leaves.select("node", "weight", "least").join(linked, "node", "left").join(component, "node", "left")
    nodes = nodes.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "least")
    nodes = saved(nodes, "classes")
    classes = nodes.join(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "n_links", "component_id")
    joined = rows.select("vec_id", "node").join(classes, "node").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = joined.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
