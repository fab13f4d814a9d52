"""Ranked lexical search with the Best Position Algorithm (operator 12).

Terms are runs of ASCII letters and digits and of all other code points above 127; A to Z are lower-cased. One pass over the
documents counts the queries' terms in each and writes these postings with the document's length; counts of documents and
terms come from what is written. A second pass reads blocks of about BLOCK documents. A block has an impact list for each
term, highest first. For each query the lists are read in parallel; each document that is seen is looked up in all lists
of the query, which gives its score and its places there. The best position of a list is the end of its unbroken run of
seen places; no unseen document can score more than the sum of the impacts that follow the best positions. When this sum
falls strictly below the score of the last of the `top` documents (of this block or of those that the task has read
before), the query has been answered. Tasks give their best documents, and a window over these few ranks them.

Queries are worked in sets of SET_TERMS terms or so, chosen by hash, so that what every task holds has a bound that doesn't
depend on their number. Words are compared by 64-bit hashes; two different ones meet with a chance of 2**-64.

Null and empty texts have no term: they are not counted and not found. A document of any length is one row of postings, of a
set's terms at most. Null and repeated doc_ids are documents like others, null ones after the rest where scores are equal;
items with a null or repeated item_id are queries of their own; an item without a term, or whose terms no document holds,
has no rows. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.llm import hashing
from reckoner.llm.common import flat_text, forget, saved, slices, table

TOP = 50
#: Documents of a block; terms of all queries of a set; places of each list that are read at first.
BLOCK, SET_TERMS, STEP = 8_192, 100_000, 64
#: Terms of a query times documents of a block, at most: blocks are smaller where a query is very long.
CELLS = 1 << 24
#: Fixed values of the score: 1000 times the ratio of lengths, and scales of weights and impacts.
SCALE, WEIGHT, SLOPE, FLAT, LONG = 1_000_000_000, 1_000, 20, 50, 50

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array):
    """For runs of texts: the first text, the hash of each of their terms, and the index of each text's first term (one more than texts)."""
    data, offsets = flat_text(texts)
    for first, last in slices(offsets):
        own = _LOWER[data[offsets[first] : offsets[last]]]
        yield first, *hashing.word_hashes(own, offsets[first : last + 1] - offsets[first], _APART)


def queries(items: DataFrame) -> DataFrame:
    """item_id, item (a number for each row) and terms (distinct hashes) of the rows of items (item_id, text) that have a term."""

    def run(batches):
        for b in batches:
            for first, words, starts in terms(b.column("text")):
                n = len(starts) - 1
                own = [np.unique(words[starts[k] : starts[k + 1]]).view(np.int64).tolist() for k in range(n)]
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(first, n), b.column("item").slice(first, n), pa.array(own, pa.list_(pa.int64()))], ["item_id", "item", "terms"])

    numbered = items.select("item_id", F.monotonically_increasing_id().alias("item"), "text")
    return numbered.mapInArrow(run, "item_id long, item long, terms array<long>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), term (indexes into the sorted vocabulary) and tf of each document with a term; both as packed 32-bit numbers."""

    def run(batches):
        for b in batches:
            for first, words, starts in terms(b.column("text")):
                n = np.diff(starts)
                at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
                doc = np.repeat(np.arange(len(n)), n)
                key, tf = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * len(vocabulary))
                term, tf = (key % max(len(vocabulary), 1)).astype(np.int32), tf.astype(np.int32)
                has = np.flatnonzero(n)
                packed = [[x[ends[k] : ends[k + 1]].tobytes() for k in has.tolist()] for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(n)).take(pa.array(has)), pa.array(n[has].astype(np.int64)), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed 32-bit numbers of a binary column, and each row's first (one more than rows)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.int32), (offsets - offsets[0]) // 4


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of `size` terms occurs; each task sends one packed row."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column("term"))[0], minlength=size)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


class Lists:
    """Impact lists of a block of documents: for each term its documents with their impacts before weighting, highest first."""

    def __init__(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray, first: np.ndarray, size: int, documents: int, length: int):
        self.documents = len(n)
        ratio = np.array([100 - FLAT + LONG * int(x) * documents // length for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        impact = SCALE * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + SLOPE * ratio[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))

    def best(self, own: np.ndarray, weight: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that score more than 0 and could be among the best `top`, by best positions; own: the query's terms; floor: a score that `top` documents elsewhere reach."""
        lengths = self.starts[own + 1] - self.starts[own]
        own, weight, lengths = own[lengths > 0], weight[lengths > 0], lengths[lengths > 0]
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        deepest = int(lengths.max())
        direct = np.zeros((len(own), self.documents), np.int64)  # impacts of each document in each list
        place = np.full((len(own), self.documents), -1, np.int32)
        listed, following = np.full((len(own), deepest), -1, np.int32), np.zeros((len(own), deepest + 1), np.int64)
        for k, t in enumerate(own.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            docs, worth = self.doc[at], self.impact[at] * weight[k]
            direct[k, docs], place[k, docs] = worth, np.arange(len(docs))
            listed[k, : len(docs)], following[k, : len(docs)] = docs, worth
        seen, seen_places = np.zeros(self.documents, bool), np.zeros((len(own), deepest + 1), bool)
        rows, found, scores, depth, step = np.arange(len(own)), [], [], 0, STEP
        kth, pool = floor, np.zeros(0, np.int64)
        while depth < deepest:
            new = listed[:, depth : depth + step].ravel()
            new = np.unique(new[new >= 0])
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                worth = direct[:, new].sum(0)  # direct accesses
                at = place[:, new]
                who, which = np.nonzero(at >= 0)
                seen_places[who, at[who, which]] = True
                found.append(new)
                scores.append(worth)
                pool = np.concatenate([pool, worth])
                if len(pool) >= top:
                    pool = np.partition(pool, len(pool) - top)[-top:]
                    kth = max(kth, int(pool.min()))
            depth, step = depth + step, 2 * step
            best = seen_places.argmin(1)  # the first place of each list that no document seen so far has
            if int(following[rows, best].sum()) < kth:
                break
        docs, scores = np.concatenate(found), np.concatenate(scores)
        keep = (scores > 0) & (scores >= kth)
        return docs[keep], scores[keep]


class Best:
    """The best `top` documents of each query so far: more than `top` only for an instant."""

    def __init__(self, top: int):
        self.top, self.kth = top, {}
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, query: int, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        old = self.held.get(query)
        if old is not None:
            score, missing, doc = (np.concatenate([a, b]) for a, b in zip(old, (score, missing, doc), strict=True))
        order = np.lexsort((doc, missing, -score))[: self.top]
        self.held[query] = score[order], missing[order], doc[order]
        self.kth[query] = int(score[order[-1]]) if len(order) == self.top else 0


def _blocks(batches, rows: int):
    """Batches of about `rows` rows."""
    held, n = [], 0
    for b in batches:
        for k in range(0, b.num_rows, rows):
            held.append(b.slice(k, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def answer(found: DataFrame, asked: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, length: int, top: int, block: int) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each query; asked: (item, indexes of terms)."""

    def run(batches):
        best = Best(top)
        for b in _blocks(batches, block):
            term, first = _numbers(b.column("term"))
            lists = Lists(b.column("n").to_numpy(), term, _numbers(b.column("tf"))[0], first, len(weight), documents, length)
            ids = b.column("doc_id")
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for k, (_, own) in enumerate(asked):
                docs, scores = lists.best(own, weight[own], top, best.kth.get(k, 0))
                if len(docs):
                    best.add(k, scores, missing[docs], ids[docs])
        for k, (score, missing, doc) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([asked[k][0]] * len(doc), pa.int64()), pa.array(doc, mask=missing), pa.array(score)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, set_terms: int = SET_TERMS, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of docs (doc_id, text) that score highest for each row of items (item_id, text)."""
    spark = docs.sparkSession
    known = saved(queries(items), "queries")
    size = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets, out = max(1, -(-size // set_terms)), None
    for k in range(sets):
        asked = [(r["item"], np.array(r["terms"], np.int64).view(np.uint64)) for r in known.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == k).select("item", "terms").toLocalIterator()]  # of one set, so about set_terms terms
        if not asked:
            continue
        vocabulary = np.unique(np.concatenate([t for _, t in asked]))
        found = saved(postings(docs, vocabulary), "postings")
        documents, length = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = document_counts(found, len(vocabulary))
        weight = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        rows = max(1, min(block, CELLS // max(len(t) for _, t in asked)))
        own = saved(answer(found, [(item, np.searchsorted(vocabulary, t)) for item, t in asked], weight, documents, length, top, rows), "best")
        forget(found)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(known.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item: item_id, rank, doc_id, score."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
