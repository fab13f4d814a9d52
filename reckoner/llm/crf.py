"""A linear-chain conditional random field with two states, trained on a bounded sample with numpy.

A position has a fixed number of features, each an index into a vector of weights for state 1 (index 0: no feature, its
weight stays 0). The chain adds a bias and a score for each pair of neighbouring states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import forget, saved

#: Chains whose marginals are held at once in training.
BLOCK = 1_000
#: UTF-8 bytes of all texts of a sample, at most.
SAMPLE_BYTES = 128 << 20


@dataclass
class Chain:
    weights: np.ndarray
    bias: float
    pairs: np.ndarray  # [state before, state after]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores of state 1 against state 0; features: [..., kinds]."""
        return self.weights[features].sum(-1) + self.bias


def forward_backward(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 [chains, positions] and expected counts of pairs [2, 2] for chains of given lengths, filled up to one width; each chain counts `times`, if given.

    Scores are those of state 1; positions past a chain's length are ignored.
    """
    n, width = scores.shape
    emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], -1)
    step = np.exp(pairs)
    alpha, beta = np.empty((n, width, 2)), np.ones((n, width, 2))
    if not n or not width:
        return np.zeros((n, width)), np.zeros((2, 2))
    a = emit[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, width):
        a = (alpha[:, t - 1] @ step) * emit[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (emit[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = np.where((t + 1 < lengths)[:, None], b / b.sum(1, keepdims=True), 1.0)
    both = alpha * beta
    marginal = both[..., 1] / both.sum(-1)
    inside = np.arange(width) < lengths[:, None]
    joint = alpha[:, :-1, :, None] * step * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint = joint / joint.sum((-1, -2), keepdims=True) * inside[:, 1:, None, None]
    if times is not None:
        joint = joint * times[:, None, None, None]
    return np.where(inside, marginal, 0.0), joint.sum((0, 1))


def train(features: np.ndarray, states: np.ndarray, lengths: np.ndarray, size: int, steps: int = 60, rate: float = 0.3, penalty: float = 1e-3, times: np.ndarray | None = None) -> Chain:
    """Maximises the conditional likelihood of states [chains, positions] by Adam over all chains; size: number of weights; times: how often each chain counts."""
    chain = Chain(np.zeros(size), 0.0, np.zeros((2, 2)))
    times = np.ones(len(features)) if times is None else times
    inside = np.arange(features.shape[1]) < lengths[:, None]
    truth = np.where(inside, states, 0)
    seen = np.zeros((2, 2))
    after = inside[:, 1:]
    for x in (0, 1):
        for y in (0, 1):
            seen[x, y] = (((truth[:, :-1] == x) & (truth[:, 1:] == y) & after).sum(1) * times).sum()
    total = max(1.0, (inside.sum(1) * times).sum())
    m = v = np.zeros(size + 5)
    for k in range(1, steps + 1):
        grad = np.concatenate([np.zeros(size + 1), seen.reshape(-1)])
        for a in range(0, len(features), BLOCK):
            b = slice(a, a + BLOCK)
            marginal, joint = forward_backward(chain.emissions(features[b]), lengths[b], chain.pairs, times[b])
            gap = np.where(inside[b], truth[b] - marginal, 0.0) * times[b, None]
            grad[:size] += np.bincount(features[b].reshape(-1), np.repeat(gap.reshape(-1), features.shape[2]), size)
            grad[size] += gap.sum()
            grad[size + 1 :] -= joint.reshape(-1)
        grad /= total
        now = np.concatenate([chain.weights, [chain.bias], chain.pairs.reshape(-1)])
        grad -= penalty * now / np.sqrt(total)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        now = now + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * (1 - k / (steps + 1)) ** 0.5
        now[0] = 0
        chain = Chain(now[:size], float(now[size]), now[size + 1 :].reshape(2, 2))
    return chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, penalty: float = 1e-2) -> np.ndarray:
    """Coefficients (the last one constant) of a weighted logistic regression, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * c)
    return c


def probability(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ c[:-1] + c[-1], -30, 30)))


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves `part` modulo `parts`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most `most` rows of each class, those with the least hashes of doc_id; weights restore the classes' shares.

    Rows without a doc_id or a label are left out; a doc_id that is labelled twice counts with its larger label, and one
    with several texts with one of them. Texts are taken in the order of their hashes; one that would go beyond SAMPLE_BYTES is
    left out, and later ones that fit are taken. Only these texts, the sizes of 2 * most texts and counts come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train_rows).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [r for y in sorted(shares) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not picked:
        return [], np.zeros(0), np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(size, F.xxhash64("text"))).alias("text"))
    found = saved(found, "sample")  # of 2 * most rows
    fits, held = [], 0
    for r in found.select("doc_id", size.cast("long").alias("size"), F.xxhash64("doc_id").alias("hash")).orderBy("hash", "doc_id").collect():
        if held + r["size"] <= SAMPLE_BYTES:
            fits.append(r["doc_id"])
            held += r["size"]
    rows = sorted(found.where(F.col("doc_id").isin(fits)).collect(), key=lambda r: r["doc_id"])
    forget(found)
    if not rows:
        return [], np.zeros(0), np.zeros(0)
    y = np.array([r["y"] for r in rows], float)
    number = {k: max(1, int((y == k).sum())) for k in shares}
    total = sum(shares.values())
    return [r["text"] or "" for r in rows], y, np.array([shares[k] / number[k] * len(rows) / total for k in y])
