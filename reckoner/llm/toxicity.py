"""Toxic spans and document scores (operator 3): a linear-chain conditional random field over the words of a text.

fit() takes at most SAMPLE labelled documents of each class. Words and beginnings of words that mark toxic documents there
become the field's features, and tokens with such a mark in toxic documents are the tokens labelled 1. In a text, words
without any feature all have the same potentials, so that forward-backward runs exactly over the marked words, with
powers of the transition for what lies between. Marginals give spans (offsets of words whose marginal is SPAN or more) and,
through a logistic regression, the document's score.

Scores use the text only. Null and empty texts have no words; they and texts without marked words score the rate that
such texts have in the sample. Null and repeated doc_ids are rows like others; without labels all score 0.5. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import crf
from reckoner.llm.common import table

#: Labelled documents of each class that a model is fitted on, at most.
SAMPLE = 1_500
THRESHOLD, SPAN = 0.3, 0.5
BEGINNINGS = (4, 5, 6)
#: A mark occurs in so many toxic documents of the sample at least, with such log-odds; MARKS are kept at most.
SEEN, ODDS, MARKS = 3, 2.5, 20_000
#: Words of one chain in training; all chains of the sample's documents are trained on.
CHUNK = 128
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    chain: crf.Chain
    words: dict[str, int] = field(default_factory=dict)  # word, or beginning with "^", to its feature
    head: np.ndarray = field(default_factory=lambda: np.zeros(4))
    _powers: dict[int, np.ndarray] = field(default_factory=dict)

    def features(self, word: str) -> tuple[int, ...]:
        get = self.words.get
        return (get(word, 0), *(get("^" + word[:n], 0) if len(word) >= n else 0 for n in BEGINNINGS))

    def power(self, n: int) -> np.ndarray:
        """n steps over words without features, up to a factor."""
        if n not in self._powers:
            if len(self._powers) > 20_000:
                self._powers.clear()
            plain = np.exp(self.chain.pairs) * np.array([1.0, math.exp(self.chain.bias)])
            out, left = np.eye(2), n
            while left:
                out = out @ plain if left & 1 else out
                plain = plain @ plain
                plain, out, left = plain / plain.sum(), out / out.sum(), left >> 1
            self._powers[n] = out
            return out
        return self._powers[n]

    def marginals(self, at: list[int], marks: list[tuple[int, ...]], words: int) -> np.ndarray:
        """Marginals of the marked words, at positions `at` of a text of so many words."""
        emit = np.exp(np.clip(self.chain.emissions(np.array(marks)), -30, 30))
        step, n = np.exp(self.chain.pairs), len(at)
        alpha, beta = np.empty((n, 2)), np.ones((n, 2))
        plain = np.array([1.0, math.exp(self.chain.bias)])
        a = np.ones(2) if at[0] == 0 else (plain @ self.power(at[0] - 1)) @ step
        for k in range(n):
            if k:
                a = alpha[k - 1] @ self.power(at[k] - at[k - 1] - 1) @ step
            a = a * np.array([1.0, emit[k]])
            alpha[k] = a / a.sum()
        beta[-1] = self.power(words - 1 - at[-1]) @ np.ones(2)
        for k in range(n - 2, -1, -1):
            b = self.power(at[k + 1] - at[k] - 1) @ step @ (np.array([1.0, emit[k + 1]]) * beta[k + 1])
            beta[k] = b / b.sum()
        both = alpha * beta
        return both[:, 1] / both.sum(1)

    def read(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """The document's features and its toxic spans (start, end, marginal); offsets in characters."""
        words = _WORD.findall(text)
        get, marked = self.known, []
        for k, w in enumerate(words):
            f = get.get(w)
            if f is None:
                f = get[w] = self.features(w.lower())
                f = get[w] = f if any(f) else ()
            if f:
                marked.append((k, f))
        if len(get) > 500_000:
            get.clear()
        if not marked:
            return np.zeros(3), []
        m = self.marginals([k for k, _ in marked], [f for _, f in marked], len(words))
        spans = []
        if (m >= SPAN).any():
            hit = {k: float(p) for (k, _), p in zip(marked, m, strict=True) if p >= SPAN}
            places = [x.span() for x in _WORD.finditer(text)]
            spans = [(*places[k], p) for k, p in sorted(hit.items())]
        return np.array([m.max(), math.log1p(m.sum()), m.sum() / len(words)]), spans

    @property
    def known(self) -> dict:
        if not hasattr(self, "_known"):
            self._known = {}
        return self._known


def fit(docs: DataFrame, labels: DataFrame, train_rows) -> Model:
    texts, y, weight = crf.labelled_sample(docs, labels, "toxic", train_rows, SAMPLE)
    if not len(y) or y.min() == y.max():
        return Model(crf.Chain(np.zeros(1), 0.0, np.zeros((2, 2))))
    cut = [[w.lower() for w in _WORD.findall(t)] for t in texts]  # lower case of a whole text may have other words
    seen = [Counter(), Counter()]
    for words, label in zip(cut, y, strict=True):
        own = set(words)
        seen[int(label)].update(own | {"^" + w[:n] for w in own for n in BEGINNINGS if len(w) >= n})
    number = [int((y == 0).sum()), int(y.sum())]
    odds = {w: math.log((a + 0.5) / (number[1] - a + 0.5)) - math.log((seen[0][w] + 0.5) / (number[0] - seen[0][w] + 0.5)) for w, a in seen[1].items() if a >= SEEN}
    marks = sorted((w for w, z in odds.items() if z >= ODDS), key=lambda w: (-odds[w], w))[:MARKS]
    model = Model(crf.Chain(np.zeros(1), 0.0, np.zeros((2, 2))), {w: k + 1 for k, w in enumerate(marks)})
    kinds = 1 + len(BEGINNINGS)
    chunks, plain = [], Counter()  # chunks without marks are alike: one for each length, with their number
    for words, label in zip(cut, y, strict=True):
        f = np.array([model.features(w) for w in words], np.int32).reshape(-1, kinds)
        s = (f.any(1) & (label == 1)).astype(int)
        for k in range(0, len(f), CHUNK):
            part = f[k : k + CHUNK]
            if part.any():
                chunks.append((part, s[k : k + CHUNK]))
            else:
                plain[len(part)] += 1
    times = np.array([1.0] * len(chunks) + [float(plain[n]) for n in sorted(plain)])
    chunks += [(np.zeros((n, kinds), np.int32), np.zeros(n, int)) for n in sorted(plain)]
    del cut, seen, odds
    feature, state = np.zeros((len(chunks), CHUNK, kinds), np.int32), np.zeros((len(chunks), CHUNK), np.int8)
    lengths = np.array([len(s) for _, s in chunks])
    for k, (f, s) in enumerate(chunks):
        feature[k, : len(f)], state[k, : len(s)] = f, s
    model.chain = crf.train(feature, state, lengths, len(marks) + 1, times=times)
    x = np.array([model.read(t)[0] for t in texts])
    model.head = crf.logistic(x, y, weight)
    model._powers.clear()
    model.known.clear()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans (start, end, marginal) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                read = [model.read(t.as_py() or "") for t in part.column("text")]
                p = crf.probability(np.array([x for x, _ in read]), model.head)
                spans = [[{"start": s, "end": e, "marginal": m} for s, e, m in x] for _, x in read]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>")


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted, n_spans and spans (start, end, marginal)."""
    docs, out = table(spark, sf_dir, "documents"), crf.held_out(4, 2)
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), "spans")
