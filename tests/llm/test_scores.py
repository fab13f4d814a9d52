"""Document scores of the two classifiers against plain versions: dense chains in logarithms, features one by one."""

import math
import re

import numpy as np
import pytest

from reckoner.llm import crf, quality, substring, toxicity
from reckoner.llm.common import table


def log_sum(values):
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def dense(scores, pairs):
    """Marginals of state 1 of a chain, position by position, in logarithms."""
    n = len(scores)
    forward = [[0.0, scores[0]]]
    for t in range(1, n):
        forward.append([log_sum([forward[-1][a] + pairs[a][b] for a in (0, 1)]) + (scores[t] if b else 0.0) for b in (0, 1)])
    back = [[0.0, 0.0]]
    for t in range(n - 1, 0, -1):
        back.insert(0, [log_sum([pairs[a][b] + (scores[t] if b else 0.0) + back[0][b] for b in (0, 1)]) for a in (0, 1)])
    whole = log_sum(forward[-1])
    return [math.exp(f[1] + b[1] - whole) for f, b in zip(forward, back, strict=True)]


def plain_score(features, head):
    z = sum(f * c for f, c in zip(features, head[:-1], strict=True)) + head[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def clipped(x):
    return max(-30.0, min(30.0, float(x)))


def test_toxicity_scores_and_spans(spark, sf, docs):
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(documents, labels, ~crf.held_out(4, 2))
    got = {r.doc_id: r for r in toxicity.op3_toxic_spans(spark, sf).collect()}
    assert len(model.words) > 10
    spans = 0
    for doc_id, text in docs:
        places = [m.span() for m in re.finditer(r"[^\W\d_]+", text)]
        features, marked, scores = [], [], []
        for s, e in places:
            w = text[s:e].lower()
            own = [model.words.get(x, 0) for x in (w, *("^" + w[:n] if len(w) >= n else "" for n in toxicity.BEGINNINGS))]
            features.append(own)
            marked.append(any(own))
            scores.append((clipped(sum(model.chain.weights[x] for x in own) + model.chain.bias)) if any(own) else model.chain.bias)
        if not any(marked):
            expected, hits = [0.0, 0.0, 0.0], []
        else:
            m = [p if x else 0.0 for p, x in zip(dense(scores, model.chain.pairs.tolist()), marked, strict=True)]
            expected, hits = [max(m), math.log1p(sum(m)), sum(m) / len(m)], [p for p, x in zip(places, m, strict=True) if x >= toxicity.SPAN]
        r = got[doc_id]
        assert r.score == pytest.approx(plain_score(expected, model.head.tolist()), abs=1e-9)
        assert r.predicted == (r.score >= 0.3) and r.n_spans == len(hits) == len(r.spans)
        assert [(s.start, s.end) for s in r.spans] == hits
        spans += len(hits)
    assert spans > 0


def plain_measures(line):
    words = line.split()
    if not words:
        return [0.0] * 11
    letters = sum(len(x) for x in re.findall(r"[^\W\d_]+", line))
    marks = re.findall(r"[^\w\s.,;:'\"()\-]", line)
    digits = sum(x.isdigit() for x in line) if re.search("[0-9]", line) else 0
    return [len(line), len(words), len(set(words)) / len(words), len(line) / len(words), letters / len(line), len(re.findall("[A-ZÀ-ÖØ-Þ]", line)) / max(1, letters), len(marks) / len(words), len(set(marks)), digits / len(line), sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / len(words), max(len(w) for w in words)]


def test_quality_scores(spark, sf, docs):
    model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"), quality.training_rows())
    got = {r.doc_id: r for r in quality.op6_line_quality(spark, sf).collect()}
    for doc_id, text in docs:
        lines = text.split("\n")
        measured = [plain_measures(x) for x in lines]
        bins = [[sum(v >= e for e in edges) for v, edges in zip(m, model.edges.tolist(), strict=True)] for m in measured]
        scores = []
        for k in range(len(lines)):
            total = model.chain.bias
            for turn, at in enumerate((k, k - 1, k + 1)):
                if 0 <= at < len(lines):
                    total += sum(model.chain.weights[1 + turn * 88 + f * 8 + b] for f, b in enumerate(bins[at]))
            scores.append(clipped(total))
        m, size = dense(scores, model.chain.pairs.tolist()), [len(x) + 1 for x in lines]
        mean = sum(p * w for p, w in zip(m, size, strict=True)) / sum(size)
        expected = plain_score([mean, math.log((mean + 1e-4) / (1 - mean + 1e-4)), min(m)], model.head.tolist())
        assert got[doc_id].score == pytest.approx(expected, abs=1e-7) and got[doc_id].predicted == (got[doc_id].score >= 0.3)


def test_regression_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x, weight = rng.standard_normal((200, 3)), rng.uniform(0.5, 2, 200)
    y = (x @ [1.0, -2.0, 0.5] + rng.standard_normal(200) > 0.3).astype(float)
    c = crf.logistic(x, y, weight)

    def loss(c):
        p = 1 / (1 + np.exp(-(x @ c[:-1] + c[-1])))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-2 * (c @ c)

    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert abs(loss(c + step) - loss(c - step)) / 2e-4 < 1e-3
        assert loss(c) <= loss(c + 10 * step) and loss(c) <= loss(c - 10 * step)


def test_blocks_of_windows_grow_with_the_square_root():
    assert substring.block_bytes(0) == substring.block_bytes(30 << 30) == 4 << 20
    assert substring.block_bytes(1 << 40) == 16 << 20 and substring.block_bytes(100 << 40) == 64 << 20
    for total in (1 << 30, 1 << 36, 1 << 44):  # rows between blocks and buckets, for a byte of input
        blocks = -(-total // substring.block_bytes(total))
        assert blocks * substring.buckets_for(blocks) / total < 2e-3
