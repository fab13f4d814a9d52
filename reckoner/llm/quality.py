"""Quality of documents by their lines (operator 6): a linear-chain conditional random field labels lines good or bad.

A line's features are bins of simple measures of itself and of the lines before and after it. fit() takes at most SAMPLE
labelled documents of each class, whose lines carry the document's label. Forward-backward marginals of a text's lines,
weighted by the lines' lengths, give the document's features; a logistic regression on the sample turns them into a score.

Scores use the text only. A null text counts as empty, an empty text is one empty line. Null and repeated doc_ids are rows
like others; without labels all score 0.5. score() keeps the columns it is given, but replaces one named score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import crf
from reckoner.llm.common import table

#: Labelled documents of each class that a model is fitted on, at most.
SAMPLE = 2_500
THRESHOLD = 0.3
BINS, CHUNK = 8, 64
_LETTERS, _UPPER, _MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s.,;:'\"()\-]")
MEASURES = 11


def measures(line: str) -> tuple[float, ...]:
    """Simple measures of one line, most of them shares."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * MEASURES
    distinct = len(set(words))
    letters = sum(map(len, _LETTERS.findall(line)))
    marks = _MARKS.findall(line)
    return (
        size,
        n,
        distinct / n,
        size / n,
        letters / size,
        len(_UPPER.findall(line)) / max(1, letters),
        len(marks) / n,
        len(set(marks)),
        sum(x.isdigit() for x in line) / size if any(x in line for x in "0123456789") else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(map(len, words)),
    )


@dataclass
class Model:
    chain: crf.Chain
    edges: np.ndarray  # [measure, inner edge of bins]
    head: np.ndarray

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features of each line [lines, 3 * measures] and the lines' lengths."""
        lines = text.split("\n")
        m = np.array([measures(x) for x in lines])
        own = np.empty(m.shape, np.int64)
        for k in range(MEASURES):
            own[:, k] = 1 + k * BINS + np.searchsorted(self.edges[k], m[:, k], side="right")
        size = MEASURES * BINS
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1] + size, own[1:] + 2 * size
        return np.concatenate([own, before, after], 1), m[:, 0] + 1

    def read(self, texts: list[str]) -> np.ndarray:
        """Features of each document: length-weighted mean of its lines' marginals of state 1, in log-odds too, and the least."""
        found = [self.lines(t) for t in texts]
        scores = [self.chain.emissions(f) for f, _ in found]
        out = np.zeros((len(texts), 3))
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(scores):
            by_size.setdefault(len(s) if len(s) <= 4 else 1 << (len(s) - 1).bit_length(), []).append(k)
        for rows in by_size.values():  # chains of like lengths go together
            lengths = np.array([len(scores[k]) for k in rows])
            block = np.zeros((len(rows), lengths.max()))
            for x, k in enumerate(rows):
                block[x, : len(scores[k])] = scores[k]
            marginal, _ = crf.forward_backward(block, lengths, self.chain.pairs)
            for x, k in enumerate(rows):
                m, w = marginal[x, : lengths[x]], found[k][1]
                mean = float((m * w).sum() / w.sum())
                out[k] = mean, np.log((mean + 1e-4) / (1 - mean + 1e-4)), m.min()
        return out


def fit(docs: DataFrame, labels: DataFrame, train_rows) -> Model:
    texts, y, weight = crf.labelled_sample(docs, labels, "quality", train_rows, SAMPLE)
    size = 1 + 3 * MEASURES * BINS
    model = Model(crf.Chain(np.zeros(size), 0.0, np.zeros((2, 2))), np.zeros((MEASURES, BINS - 1)), np.zeros(4))
    if not len(y) or y.min() == y.max():
        return model
    every = np.array([measures(x) for t in texts for x in t.split("\n")])
    model.edges = np.quantile(every, np.arange(1, BINS) / BINS, axis=0).T + 1e-12
    chunks = []
    for t, label in zip(texts, y, strict=True):
        f, _ = model.lines(t)
        chunks += [(f[k : k + CHUNK], label) for k in range(0, len(f), CHUNK)]
    width = max(len(f) for f, _ in chunks)
    feature, state = np.zeros((len(chunks), width, 3 * MEASURES), np.int32), np.zeros((len(chunks), width), np.int8)
    for k, (f, label) in enumerate(chunks):
        feature[k, : len(f)], state[k, : len(f)] = f, label
    model.chain = crf.train(feature, state, np.array([len(f) for f, _ in chunks]), size, steps=50)
    model.head = crf.logistic(model.read(texts), y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    docs = docs.drop("score")
    names = docs.columns

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                p = crf.probability(model.read([t.as_py() or "" for t in part.column("text")]), model.head)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*names, "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{k}` {v}" for k, v in docs.dtypes), "score double"]))


def training_rows():
    return ~crf.held_out(5, 0)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels"), training_rows()))
    return found.select("doc_id", crf.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
