"""Hard negatives by threshold joins on integer vectors (operator 11).

Vectors are written once. The anchors, a stated query set, meet all rows in sets of about SET_BYTES chosen by hash; a set is
sent to the tasks whole, and its size doesn't depend on the input. A task keeps, for each window of each anchor of its set,
the best rows so far, and reads its rows in blocks, one Arrow batch each, with a threshold join in the manner of L2AP:

- Dimensions are ordered by their weight in the block. A row's tail of dimensions is left out of the inverted index where the
  norms of the tails of the row and of the anchors say that it can't lift a product to the lowest threshold asked for.
- Partial products are accumulated over the posting lists of STRIDE dimensions at a time. After each, rows go whose partial
  product with every anchor, with the norms of what remains, stays below the anchors' thresholds; the products of those
  that stay are completed with the tails that the index leaves out.
- The threshold of a window starts high and is lowered while the window isn't full; a full window's threshold is its last
  score, so that later blocks are read with that.

The first join finds each anchor's positives (the best rows of the same label); these give the windows of scores in which
the second looks for rows of other labels. Windows of the tasks meet in a window function that ranks them, with as many rows
for each anchor as tasks have found. No step is keyed by a label, so a label that a third of all rows share is dealt out.

All arithmetic is in whole numbers; norms only rule out what they rule out with a margin. Rows whose label, vec_id or vector is
null, or whose vector holds a null or non-finite component, take no part, nor do those whose products need not fit a long
(components over LARGEST). Vectors of different lengths never meet. Repeated rows and vec_ids are rows of their own, equal
scores are ordered by vec_id. An anchor without positives, or whose windows hold nothing, has no rows; an empty table gives
none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.llm.common import saved, table

#: Largest component after scaling; dimensions of a posting step; bytes of a set of anchors; anchors that are joined at once.
LARGEST, STRIDE, SET_BYTES, STRIP = 1 << 24, 16, 8 << 20, 256
#: Thresholds of a window that isn't full, as shares of the way from its upper to its lower end.
LOWERED = (0.1, 0.25, 0.5, 1.0)
#: Beyond every product, whatever the dimension.
_FAR = 1 << 62


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and vector (floor of scale times each component) of the rows of vectors (vec_id, label, embedding) that take part."""
    named = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | ~(F.abs(x.cast("double") * scale) < LARGEST))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return vectors.where(F.coalesce(named & ~odd, F.lit(False))).select("vec_id", F.col("label").cast("long").alias("label"), whole.alias("vector"))


class Block:
    """Vectors as an inverted index in steps of STRIDE dimensions."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.argsort(-np.square(vectors.astype(np.float64)).sum(0), kind="stable") if len(vectors) else np.arange(vectors.shape[1])
        self.vectors = vectors[:, self.order]
        self.tails = _tails(self.vectors)

    def join(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, rows and inner products of all pairs that reach the anchor's threshold."""
        none = np.zeros(0, np.int64)
        if not len(anchors) or not len(self.vectors):
            return none, none, none
        own = anchors[:, self.order]
        tails, steps = _tails(own), self.tails.shape[1] - 1
        # where a row's postings end: from there on its tail and the longest tail of an anchor don't reach the lowest threshold
        short = self.tails * tails.max(0) < thresholds.min()
        ends = np.where(short.any(1), short.argmax(1), steps)
        rows = np.argsort(-ends, kind="stable")
        ends = ends[rows]
        left, right = _exact(own, self.vectors)
        partial = np.zeros((len(own), len(rows)), left.dtype)
        for k in range(steps):
            listed = int(np.searchsorted(-ends, -k))  # rows whose postings reach this step; they come first
            if not listed:
                break
            dims = slice(k * STRIDE, (k + 1) * STRIDE)
            partial[:, :listed] += left[:, dims] @ right[rows[:listed], dims].T
            rest = self.tails[rows, np.minimum(ends, k + 1)]
            alive = (partial + tails[:, np.minimum(ends, k + 1)] * rest >= thresholds[:, None]).any(0)
            if alive.mean() < 0.7:
                rows, ends, partial = rows[alive], ends[alive], partial[:, alive]
        a, x = np.nonzero(partial + tails[:, ends] * self.tails[rows, ends] >= thresholds[:, None])
        score = partial[a, x].astype(np.int64)
        for e in np.unique(ends[x]).tolist():  # tails that the index leaves out
            if e < steps:
                at = np.flatnonzero(ends[x] == e)
                for s in range(0, len(at), 1 << 16):
                    part = at[s : s + (1 << 16)]
                    score[part] += np.einsum("ij,ij->i", own[a[part], e * STRIDE :], self.vectors[rows[x[part]], e * STRIDE :])
        keep = score >= thresholds[a]
        return a[keep], rows[x[keep]], score[keep]


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all sums of products are exact in these, else as whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64), b.astype(np.float64)) if most < 1 << 52 else (a, b)


def _tails(vectors: np.ndarray) -> np.ndarray:
    """Norms of what remains of each vector from each step on, a little too large; 0 after the last."""
    n, d = vectors.shape
    steps = -(-d // STRIDE)
    squares = np.zeros((n, steps * STRIDE))
    squares[:, :d] = np.square(vectors.astype(np.float64))
    sums = squares.reshape(n, steps, STRIDE).sum(2)[:, ::-1].cumsum(1)[:, ::-1]
    return np.concatenate([np.sqrt(sums) * (1 + 1e-9), np.zeros((n, 1))], 1)


class Windows:
    """For windows of scores [low, high], each of an anchor (ascending): the best `size` rows so far, by score, then vec_id."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, size: int):
        self.anchor, self.low, self.high, self.size = anchor, low, high, size
        self.last = np.full(len(anchor), -_FAR)  # score of the last row of a full window
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # window, score, vec_id, key

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(window):
            return
        w, s, v, k = (np.concatenate([a, b]) for a, b in zip(self.held, (window, score, ids, keys), strict=True))
        order = np.lexsort((k, v, -s, w))
        w, s, v, k = w[order], s[order], v[order], k[order]
        first = np.searchsorted(w, np.arange(len(self.anchor) + 1))
        keep = np.arange(len(w)) - first[w] < self.size
        full = np.diff(first) >= self.size
        self.last[full] = s[first[:-1][full] + self.size - 1]
        self.held = w[keep], s[keep], v[keep], k[keep]

    def reaching(self, threshold: np.ndarray) -> np.ndarray:
        """How many rows of each window reach its threshold."""
        return np.bincount(self.held[0][self.held[1] >= threshold[self.held[0]]], minlength=len(self.anchor))


class Strip:
    """Anchors that are joined at once, with their windows."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, labels: np.ndarray, windows: Windows):
        self.vectors, self.keys, self.labels, self.windows = vectors, keys, labels, windows

    def fill(self, block: Block, rows: dict[str, np.ndarray], asked: np.ndarray, upper: np.ndarray, lower: np.ndarray, same: bool) -> None:
        """Takes what a block has for the windows `asked`, by joins at thresholds that go from upper to lower (values for each window) until windows are full."""
        windows = self.windows
        for share in LOWERED:
            if not len(asked):
                return
            down = lower if share == 1 else np.maximum(lower, upper - (share * (upper - lower).astype(np.float64)).astype(np.int64))
            threshold = np.maximum(down, windows.last)  # of a full window only what reaches its last row
            who, number = np.unique(windows.anchor[asked], return_inverse=True)
            least = np.full(len(who), _FAR)
            np.minimum.at(least, number, threshold[asked])
            a, x, score = block.join(self.vectors[who], least)
            keep = ((rows["label"][x] == self.labels[who][a]) == same) & (rows["key"][x] != self.keys[who][a])
            a, x, score = a[keep], x[keep], score[keep]
            # each pair in all windows of its anchor; asked is ordered by anchor
            bounds = np.searchsorted(number, np.arange(len(who) + 1))
            times = np.diff(bounds)[a]
            pair = np.repeat(np.arange(len(a)), times)
            window = asked[bounds[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)]
            inside = (score[pair] >= threshold[window]) & (score[pair] <= windows.high[window])
            pair, window = pair[inside], window[inside]
            done = (windows.reaching(threshold) + np.bincount(window, minlength=len(windows.anchor)) >= windows.size) | (threshold <= lower)
            now = done[window]
            pair, window = pair[now], window[now]
            windows.add(window, score[pair], rows["vec_id"][x[pair]], rows["key"][x[pair]])
            asked = asked[~done[asked]]


def _matrices(lists: pa.Array):
    """For each length of vectors in a column: which rows have it, and their vectors."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    starts, flat = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
    dims = np.diff(starts)
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, flat[starts[rows][:, None] + np.arange(d)].astype(np.int64)


def _strips(anchors: pa.Table, size: int, same: bool):
    """Dimension and Strip of all anchors; columns: key, label, vector, and low and high (lists) where not same."""
    keys, labels = (anchors.column(c).to_numpy() for c in ("key", "label"))
    for d, rows, vectors in _matrices(anchors.column("vector")) if len(anchors) else ():
        for k in range(0, len(rows), STRIP):
            own = rows[k : k + STRIP]
            if same:
                windows = Windows(np.arange(len(own)), np.full(len(own), -_FAR), np.full(len(own), _FAR), size)
            else:
                low, high = (anchors.column(c).take(pa.array(own)).to_pylist() for c in ("low", "high"))
                windows = Windows(np.repeat(np.arange(len(own)), [len(x) for x in low]), *(np.array([y for x in c for y in x], np.int64) for c in (low, high)), size)
            yield d, Strip(vectors[k : k + STRIP], keys[own], labels[own], windows)


def joined(rows: DataFrame, anchors: pa.Table, size: int, same: bool) -> DataFrame:
    """anchor (key), window (number among the anchor's), vec_id, key, score: for each window of each anchor, the best `size` rows (of its label, or of others) of each task."""

    def run(batches):
        states = list(_strips(anchors, size, same))
        for b in batches:
            for d, at, vectors in _matrices(b.column("vector")):
                own = {c: b.column(c).to_numpy()[at] for c in ("key", "vec_id", "label")}
                mine = [s for dim, s in states if dim == d]
                if not same:
                    block = Block(vectors)
                    for s in mine:
                        s.fill(block, own, np.arange(len(s.windows.anchor)), s.windows.high, s.windows.low, False)
                    continue
                for label in np.unique(own["label"]).tolist():
                    part = own["label"] == label
                    block, longest = Block(vectors[part]), 0
                    longest = int(np.ceil(block.tails[:, 0].max(initial=0))) + 1
                    for s in mine:
                        bound = (np.ceil(_tails(s.vectors)[:, 0]).astype(np.int64) + 1) * longest  # no product exceeds that of the norms
                        s.fill(block, {c: x[part] for c, x in own.items()}, np.flatnonzero(s.labels == label), bound, -bound, True)
        for _, s in states:
            w, score, ids, keys = s.windows.held
            number = w - np.searchsorted(s.windows.anchor, s.windows.anchor[w])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (s.keys[s.windows.anchor[w]], number, ids, keys, score)], ["anchor", "window", "vec_id", "key", "score"])

    return rows.select("key", "vec_id", "label", "vector").mapInArrow(run, "anchor long, window long, vec_id long, key long, score long")


def _in_sets(rows: DataFrame, anchors: DataFrame, size: int, same: bool, set_bytes: int) -> DataFrame:
    """joined() with all anchors, a set of about set_bytes at a time, ranked over all tasks."""
    columns = ["key", "label", "vector", *([] if same else ["low", "high"])]
    bytes_ = anchors.agg(F.sum(4 * F.size("vector") + (24 if same else 24 + 16 * F.size("low")))).first()[0] or 0
    sets, out = max(1, -(-bytes_ // set_bytes)), None
    for k in range(sets):
        own = anchors.where(F.pmod(F.xxhash64("key"), F.lit(sets)) == k).select(*columns).toArrow()  # of about set_bytes
        found = saved(joined(rows, own, size, same), "found")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= size)


def mine(vectors: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, set_bytes: int = SET_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best `positives` rows of equal label, the best `negatives` rows of other labels whose score is from low to high hundredths of the positive's.

    vectors: vec_id, label, vector (whole numbers up to LARGEST), as scaled() gives them; anchors: which rows are anchors, those whose vec_id is divisible by 100 if not given.
    """
    rows = saved(vectors.withColumn("key", F.monotonically_increasing_id()), "vectors")
    chosen = rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    first = saved(_in_sets(rows, chosen, positives, True, set_bytes), "positives")
    # low * p <= 100 * s <= high * p in whole numbers; where p < 0 no score is in the window
    ends = first.where("score >= 0").select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"{high} * score div 100").alias("high"))
    windows = ends.groupBy(F.col("anchor").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # `positives` at most
    asked = chosen.join(windows, "key").select("key", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _in_sets(rows, asked, negatives, False, set_bytes)
    # scores fall with the rank, so those below 0 come last and windows are numbered as ranks are
    told = ends.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), "positive_id", "positive_score")
    out = second.select("anchor", "window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(told, ["anchor", "window"])
    out = out.join(chosen.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings, every seventh with the next label: hard negatives of the anchors, the rows whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(scaled(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), 256))
