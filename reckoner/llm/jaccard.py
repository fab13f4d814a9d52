"""Jaccard join of word shingles by chosen paths (operator 7).

A text's set holds the hashes of its windows of SHINGLE words (a text of fewer words is one shingle). Sets become
sequences of POSITIONS minimum hashes, so that tokens (place, minimum) are shared with a probability of the Jaccard
similarity. A run samples tokens, each with probability 1 / (SIMILARITY * POSITIONS) by a hash of run and token, and every
sampled token is a bucket of the sets that have it: a chosen path of length one. Minima have 40 bits there, so that sets
without a common shingle don't meet however many there are. Buckets of more than LIMIT sets are split again
and again by tokens sampled anew for each bucket, BRANCH times as many, so that a pair survives any number of splits with a
fixed probability; there the minima's low bytes will do. A bucket more than DENSE of whose sets share a sampled token holds
similar sets and is compared as a whole; it goes through tiles, so none is capped.
Runs are repeated until a pair at the threshold is missed with a probability of at most 1 - RECALL. Of small buckets with
the same sets one is compared.

Equal sets are one node with a weight. In a bucket, pairs whose minimum hashes' low bytes agree in GUESS of the places or more (the
threshold less 4.5 standard deviations) mark their nodes; for these, exact sets are compared. Result: links are pairs of
similarity SIMILARITY or more; texts without words and rows without a doc_id link with nothing. Rows of equal doc_ids are
rows of their own; all rows stay.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import hashing, links
from reckoner.llm.common import flat_text, forget, saved, slices, table

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
POSITIONS, GUESS = 128, 0.64
LIMIT, BRANCH, DENSE, MOST_SPLITS = 1_000, 2.0, 0.6, 30
#: Documents whose sets are compared exactly are picked out of all texts by a broadcast of their ids, up to so many; beyond, by a shuffle.
BROADCAST_IDS = 500_000

_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = 0x8CB92BA72F3D8DD7


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has shared a final bucket with the wanted probability, however often its buckets are split. A pair at the threshold shares one sampled token on average, BRANCH in later splits."""
    found = 1.0
    for _ in range(MOST_SPLITS):
        found = 1 - math.exp(-BRANCH * found)
    return math.ceil(math.log(1 - recall) / -found)  # a run fails with probability exp(-found)


def _shingles(texts: pa.Array, width: int):
    """Yields (first text, sorted distinct hashes, offsets by text) for runs of texts."""
    data, offsets = flat_text(texts)
    for first, last in slices(offsets):
        words, start = hashing.word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        found, at = hashing.window_hashes(words, start, width)
        count = np.diff(start)
        doc = np.searchsorted(start, at, side="right") - 1
        short = np.flatnonzero((count > 0) & (count < width))
        found = np.concatenate([found, hashing._ranges(words, hashing.WORD_BASE, start[short], start[short + 1])])
        doc = np.concatenate([doc, short])
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        new = np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1]))[: len(found)]
        yield first, found[new], np.searchsorted(doc[new], np.arange(last - first + 1))


def _identity(found: np.ndarray, at: np.ndarray, full: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each non-empty set: equal for equal sets."""
    total = np.add.reduceat(hashing.mix(found ^ np.uint64(0x2545F4914F6CDD1D)), at[:-1][full])
    return hashing.mix(total ^ np.diff(at)[full].astype(np.uint64)).view(np.int64)


def sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, node (the set's identity, null without words), n (distinct shingles), sketch (the low bytes of its minimum hashes) and paths (its sampled tokens in all runs) of each row."""
    runs, limit = runs_needed(), np.uint64(int(2**64 / (SIMILARITY * POSITIONS)))

    def run(batches):
        place = (np.arange(POSITIONS, dtype=np.uint64) << np.uint64(40))[None, :]
        for b in batches:
            for first, found, at in _shingles(b.column("text"), width):
                size = np.diff(at)
                full = np.flatnonzero(size)
                node, sketch, paths = np.zeros(len(size), np.int64), np.zeros((len(full), POSITIONS), np.uint8), []
                if len(full):
                    node[full] = _identity(found, at, full)
                    least = np.stack([np.minimum.reduceat(found * f >> np.uint64(24), at[:-1][full]) for f in _FACTORS], 1)
                    sketch = (hashing.mix(least) >> np.uint64(48)).astype(np.uint8)
                    token = hashing.mix(least | place)
                    for r in range(runs):
                        h = hashing.mix(token ^ hashing.mix(np.array([_RUN * (r + 1) % (1 << 64)], np.uint64)))
                        who, what = np.nonzero(h < limit)
                        paths.append((full[who], hashing.mix(h[who, what] + np.uint64(1)).view(np.int64)))
                who, what = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in paths)]) for k in (0, 1))
                order = np.argsort(who, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who[order], np.arange(len(size) + 1)).astype(np.int32)), pa.array(what[order]))
                bytes_ = np.full(len(size), None, object)
                for k, row in zip(full.tolist(), sketch, strict=True):
                    bytes_[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(size)), pa.array(node, mask=size == 0), pa.array(size.astype(np.int64)), pa.array(bytes_, pa.binary()), lists], ["doc_id", "node", "n", "sketch", "paths"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, sketch binary, paths array<long>")


def _split(rows: DataFrame) -> DataFrame:
    """bucket, node, above (the bucket that was split) and parent (its size) for each token of rows (bucket, size, node, sketch) that is sampled anew."""
    limit = np.uint64(int(BRANCH * 2**64 / (SIMILARITY * POSITIONS)))

    def run(batches):
        place = (np.arange(POSITIONS, dtype=np.uint64) << np.uint64(8))[None, :]
        for b in batches:
            for first in range(0, b.num_rows, 2_000):
                part = b.slice(first, 2_000)
                node, size, above = (part.column(c).to_numpy() for c in ("node", "size", "bucket"))
                token = hashing.mix(np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(node), POSITIONS).astype(np.uint64) | place)
                h = hashing.mix(token ^ hashing.mix(above.view(np.uint64) + np.uint64(_RUN))[:, None])
                who, what = np.nonzero(h < limit)
                yield pa.RecordBatch.from_arrays([pa.array(hashing.mix(h[who, what] + np.uint64(1)).view(np.int64)), pa.array(node[who]), pa.array(above[who]), pa.array(size[who])], ["bucket", "node", "above", "parent"])

    return rows.select("bucket", "node", "size", "sketch").mapInArrow(run, "bucket long, node long, above long, parent long")


def chosen_paths(nodes: DataFrame) -> DataFrame:
    """bucket, node and size of all final buckets with two nodes or more; nodes: node, n, sketch, paths."""
    first = saved(links.in_shared_buckets(nodes.select(F.explode("paths").alias("bucket"), "node"), LIMIT), "paths")
    done, spent, similar = first.where(F.col("size") <= LIMIT), [first], []
    level = first.where(F.col("size") > LIMIT)
    for _ in range(MOST_SPLITS):
        if level.isEmpty():
            break
        split = saved(_split(level.join(nodes.select("node", "sketch"), "node")), "split")
        sizes = split.groupBy("bucket").agg(F.count("*").alias("size"), F.first("above").alias("above"), F.first("parent").alias("parent"))
        dense = saved(sizes.where(F.col("size") > F.greatest(F.lit(LIMIT), DENSE * F.col("parent"))).select("above").distinct(), "dense")
        similar.append(level.join(dense, F.col("bucket") == F.col("above"), "left_semi").drop("size"))
        parts = saved(links.in_shared_buckets(split.join(dense, "above", "left_anti").select("bucket", "node"), LIMIT), "paths")
        forget(split)
        spent += [dense, parts]
        done = done.unionByName(parts.where(F.col("size") <= LIMIT))
        level = parts.where(F.col("size") > LIMIT)
    else:
        done = done.unionByName(level)
    if similar:  # several paths lead to the same similar sets
        done = done.unionByName(links.in_shared_buckets(reduce(DataFrame.unionByName, similar)))
    out = saved(done, "buckets")
    forget(*spent)
    return out


def _guess(left: links.Side, right: links.Side) -> np.ndarray:
    a, b = left.matrix("sketch"), right.matrix("sketch")
    n, m = left.numbers("n"), right.numbers("n")
    out = np.zeros((len(n), len(m)), bool)
    for k in range(len(n)):
        near = np.flatnonzero((m >= SIMILARITY * n[k]) & (n[k] >= SIMILARITY * m))
        if len(near):
            out[k, near] = (b[near] == a[k]).sum(1) >= GUESS * POSITIONS
    return out


def _numbered(right: links.Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The distinct hashes of a tile, its sets as numbers of these with their offsets, and the tile's first row."""
    flat, at = right.flat("hashes", np.uint64)
    every, inverse = np.unique(flat, return_inverse=True)
    return every, inverse.astype(np.int32), at, right.first


def _exact(left: links.Side, right: links.Side, numbered: tuple) -> np.ndarray:
    """Links among the guessed pairs, by exact sets."""
    out, (every, b, bt, first) = _guess(left, right), numbered
    bt = bt[right.first - first :]
    a, at = left.flat("hashes", np.uint64)
    mark = np.zeros(len(every), bool)
    for k in np.flatnonzero(out.any(1)):
        near, own = np.flatnonzero(out[k]), a[at[k] : at[k + 1]]
        place = np.minimum(np.searchsorted(every, own), len(every) - 1)
        place = place[every[place] == own]
        mark[place] = True
        common = np.array([np.count_nonzero(mark[b[bt[j] : bt[j + 1]]]) for j in near])
        mark[place] = False
        out[k, near] = common >= SIMILARITY * (len(own) + bt[near + 1] - bt[near] - common) - 1e-9
    return out


def _hashes(docs: DataFrame, width: int) -> DataFrame:
    """node and hashes (the set itself) of each row with words."""

    def run(batches):
        for b in batches:
            for _, found, at in _shingles(b.column("text"), width):
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    yield pa.RecordBatch.from_arrays([pa.array(_identity(found, at, full)), pa.array([found[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())], ["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def join(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id (least doc_id of the rows with the same set), n_links (other rows linked directly), component_id (least doc_id reachable by links, itself included) and kept (doc_id = component_id)."""
    rows = saved(sets(docs), "sets")
    named = rows.where("node is not null and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n", "sketch", "paths")]
    nodes = saved(named.groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), *same), "nodes")
    paths = chosen_paths(nodes)
    others = paths.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("others"))
    about = nodes.select("node", "weight", "n", "sketch").join(others, "node")
    guessed = paths.select("bucket", "node", links.tiles(F.col("size")).alias("tiles")).join(about, "node")
    marked = saved(links.linked(guessed, _guess, ["n", "sketch"]).select("bucket", "node").distinct(), "marked")
    active = marked.select("node").distinct().join(nodes, "node").select(F.col("least").alias("doc_id"), F.col("node").alias("wanted"))
    active = saved(active, "active")
    chosen = docs.select("doc_id", "text").join(F.broadcast(active) if active.count() <= BROADCAST_IDS else active, "doc_id")
    held = _hashes(chosen, SHINGLE).dropDuplicates(["node"])
    weighed = marked.join(nodes.select("node", "n"), "node")
    tiled = weighed.groupBy("bucket").agg(links.tiles(F.count("*"), F.sum("n") * 8).alias("tiles"))
    again = marked.join(tiled, "bucket").join(about.join(held, "node"), "node")
    found = saved(links.linked(again, _exact, ["n", "sketch", "hashes"], _numbered), "links")
    forget(paths, marked, active)
    linked, component = links.summary(found)
    nodes = nodes.select("node", "weight", "least").join(linked, "node", "left").join(component, "node", "left")
    nodes = saved(nodes.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "least"), "classes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = nodes.join(least, "component").select(F.col("node").alias("_node"), F.col("least").alias("class_id"), "n_links", "component_id")
    out = rows.select("doc_id", "node").join(classes, (F.col("node") == F.col("_node")) & F.col("doc_id").isNotNull(), "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, n_links, component_id, kept."""
    return join(table(spark, sf_dir, "documents"))
