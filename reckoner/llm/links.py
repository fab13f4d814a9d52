"""Links between rows that share buckets, without rows for pairs, and the components that links make.

A node may be in several buckets. A pair is judged in its least common bucket only, so a link counts once. Buckets of more
than TILE nodes, or of more than TILE_BYTES of payload, are cut into tiles that meet two at a time, so no bucket has to
fit one task and none is capped. A task gets its tiles in order and holds the two that meet, whatever else it has to do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import forget, saved

TILE, TILE_BYTES = 8_000, 8 << 20
#: Rows of one tile that are held against rows of the other at once, and so many of these.
_STRIP, _BLOCK = 250, 16_000


def in_shared_buckets(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """rows (bucket, node, and more) of buckets with two nodes or more, with size. Of buckets (of at most `limit` nodes, if given) that hold the same nodes, only one stays."""
    small = F.col("size") <= limit if limit else F.lit(True)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("content")).where("size > 1")
    kept = sizes.where(small).groupBy("size", "content").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return rows.join(kept.unionByName(sizes.where(~small).select("bucket", "size")) if limit else kept, "bucket")


def tiles(size: Column, payload: Column | None = None) -> Column:
    """Tiles of a bucket of so many nodes with so many bytes."""
    need = F.ceil(size / TILE)
    return (need if payload is None else F.greatest(need, F.ceil(payload / TILE_BYTES))).cast("int")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list or binary column in one array, and each row's offset there."""
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets
    return np.asarray(column.values), np.asarray(column.offsets)


class Side:
    """Rows of one tile: payload columns of numbers, and bytes as one array with offsets."""

    def __init__(self, columns: dict, first: int, last: int):
        self.columns, self.first, self.last = columns, first, last

    def __len__(self) -> int:
        return self.last - self.first

    def numbers(self, name: str) -> np.ndarray:
        return self.columns[name][self.first : self.last]

    def flat(self, name: str, kind=np.uint8) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self.columns[name]
        own = offsets[self.first : self.last + 1]
        return data[own[0] : own[-1]].view(kind), (own - own[0]) * data.itemsize // np.dtype(kind).itemsize

    def matrix(self, name: str, kind=np.uint8) -> np.ndarray:
        """Bytes of one length in all rows, as rows."""
        return self.flat(name, kind)[0].reshape(len(self), -1)


def _covered(left: Side, right: Side, bucket: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which pairs of the given rows of both sides meet in a lesser bucket."""
    out, sides = np.zeros((len(rows), len(columns)), bool), []
    for s, some in ((left, rows), (right, columns)):
        own, offsets = s.flat("others", np.int64)
        count = offsets[some + 1] - offsets[some]
        own = own[np.repeat(offsets[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        keep = np.flatnonzero(own < bucket)
        order = keep[np.argsort(own[keep], kind="stable")]
        values, first = np.unique(own[order], return_index=True)
        sides.append((values, [*first.tolist(), len(order)], np.repeat(np.arange(len(some)), count)[order]))
    (a, x, i), (b, y, j) = sides
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    for p, q in zip(at.tolist(), to.tolist(), strict=True):
        out[i[x[p] : x[p + 1], None], j[y[q] : y[q + 1]]] = True
    return out


class Found:
    """Links of the nodes of one tile, or of two, as strips of them are judged: weights of the linked nodes, and for each node the least one that links lead to."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Links between the nodes at rows and those at columns, each pair once."""
        self.links[rows] += hit @ self.weight[columns]
        self.links[columns] += hit.T @ self.weight[rows]
        for k in np.flatnonzero(hit.any(1)):
            near, own = self.label[columns[hit[k]]], int(self.label[rows[k]])
            least = min(int(near.min()), own)
            if own != least or (near != least).any():
                self.label[np.isin(self.label, np.append(near, own))] = least


KEY = ("bucket", "a", "b")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ordered by KEY, in batches that don't part a group."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy() for c in KEY]
        change = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
        ends = tuple(int(k[-1]) for k in keys)
        begin = 0
        if held and tuple(int(k[0]) for k in keys) == last:
            begin = int(change[0]) if len(change) else b.num_rows
            held.append(b.slice(0, begin))
        if begin == b.num_rows:
            continue
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tail = int(change[-1]) if len(change) else 0
        if tail > begin:
            yield b.slice(begin, tail - begin)
        held, last = [b.slice(max(tail, begin))], ends
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group by the buckets that `within` lists, one batch for each of them, in the same order."""
    for b in batches:
        group = np.cumsum(np.concatenate([[False], np.logical_or.reduce([np.diff(b.column(c).to_numpy()) != 0 for c in KEY])]))
        inner, offsets = _flat(b.column("within"))
        inner = inner[offsets[0] : offsets[-1]]
        who = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        order = np.lexsort((who, inner, group[who]))
        inner, who = inner[order], who[order]
        edges = np.flatnonzero((np.diff(inner) != 0) | (np.diff(group[who]) != 0)) + 1
        names = [c for c in b.schema.names if c != "within"]
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(who)], strict=True):
            if e - s > 1:
                some = b.select(names).take(pa.array(who[s:e]))
                yield pa.RecordBatch.from_arrays([pa.array(inner[s:e]) if c == "bucket" else some.column(c) for c in names], names)


def linked(rows: DataFrame, judge: Callable[..., np.ndarray], payload: list[str], prepare: Callable[[Side], object] | None = None) -> DataFrame:
    """bucket, node, links (weight of the nodes that node is linked to, as found for one pair of tiles) and root (a node reachable by links), only where there is a link.

    rows: bucket, node, tiles (of the bucket), weight, others (all buckets of the node) and the payload columns (longs, or binary). If they have `within`, the buckets that it lists count,
    and all rows of one are to have the same bucket; so a node's payload goes once to several of its buckets.
    judge(left, right): the matrix of links between some rows of a tile and rows of another, or of the same from there on; it gets what prepare() makes of the whole tile on the right, if given.
    """
    tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("_t")).alias("a"), F.greatest(k, F.col("_t")).alias("b")))
    open_them = "within" in rows.columns
    dealt = rows.withColumn("_t", tile).withColumn("_p", F.explode(pairs)).select("bucket", "_p.a", "_p.b", "_t", "node", "weight", "others", *payload, *["within"] * open_them)
    ordered = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "_t", "node")

    def run(batches):
        whole = _whole_groups(batches)
        for b in _opened(whole) if open_them else whole:
            bucket, a, both, tile, node, weight = (b.column(c).to_numpy() for c in (*KEY, "_t", "node", "weight"))
            columns = {c: b.column(c).to_numpy() if pa.types.is_integer(b.column(c).type) else _flat(b.column(c)) for c in ("others", *payload)}
            change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(a) != 0) | (np.diff(both) != 0)) + 1
            out = []
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(bucket)], strict=True):
                square = a[s] == both[s]
                cut = e if square else s + int(np.searchsorted(tile[s:e], both[s]))
                right = Side(columns, s if square else cut, e)
                if not len(right) or cut - s < 1 + square:
                    continue
                found, keep = Found(weight[s:e]), prepare(right) if prepare else None
                for k in range(s, cut, _STRIP):
                    left = Side(columns, k, min(k + _STRIP, cut))
                    for c in range(k if square else cut, e, _BLOCK):
                        rest = Side(columns, c, min(c + _BLOCK, e))
                        hit = judge(left, rest, keep) if prepare else judge(left, rest)
                        if c == k:  # each pair once
                            hit[:, : len(left)] = np.triu(hit[:, : len(left)], 1)
                        if len(rows := np.flatnonzero(hit.any(1))):
                            across = np.flatnonzero(hit[rows].any(0))
                            hit = hit[np.ix_(rows, across)] & ~_covered(left, rest, int(bucket[s]), rows, across)
                            found.add(hit, rows + k - s, across + c - s)
                has = found.links > 0
                if has.any():
                    out.append((np.full(int(has.sum()), bucket[s]), node[s:e][has], found.links[has], node[s:e][found.label][has]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in range(4)], ["bucket", "node", "links", "root"])

    return ordered.mapInArrow(run, "bucket long, node long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that edges lead to) of all nodes of edges (node, root); edges are undirected.

    Large-star and small-star steps in turns until nothing changes; each turn is written to the shared folder, and the one before deleted.
    """
    pairs = edges.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).where("u != v").distinct()
    now, mark = saved(pairs, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        before, now = now, saved(small, "edges")
        forget(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def summary(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From linked(): node with links over all tiles, and node with component."""
    return found.groupBy("node").agg(F.sum("links").alias("links")), components(found.select("node", "root"))
