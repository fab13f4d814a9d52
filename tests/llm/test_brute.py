"""Parts of the corpus operators, and the stages of the pipeline, against plain versions of what they compute."""

import collections
import itertools

import numpy as np
import pytest

import corpus_pipeline
from reckoner.llm import crf, embeddings, jaccard, links, media_ts, pii, quality, token_files, toxicity
from reckoner.llm.common import saved
from tests.llm.test_exact import base_spans, brute_vectors, components


def enumerated(scores, pairs):
    """Marginals of state 1 and expected pairs of one chain, from all sequences of labels."""
    n, total = len(scores), 0.0
    marginal, joint = np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s for s, x in zip(scores, y, strict=True) if x) + sum(pairs[a, b] for a, b in itertools.pairwise(y)))
        total += w
        marginal += w * np.array(y)
        for a, b in itertools.pairwise(y):
            joint[a, b] += w
    return marginal / total, joint / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths, pairs, times = np.array([1, 2, 5, 7]), rng.standard_normal((2, 2)), np.array([1.0, 2.0, 1.0, 3.0])
    scores = rng.standard_normal((4, 7)) * 2
    marginal, joint = crf.forward_backward(scores, lengths, pairs, times)
    every = [enumerated(s[:n], pairs) for s, n in zip(scores, lengths, strict=True)]
    for k, (m, _) in enumerate(every):
        assert np.allclose(marginal[k, : lengths[k]], m) and not marginal[k, lengths[k] :].any()
    assert np.allclose(joint, sum(t * j for t, (_, j) in zip(times, every, strict=True)))


def test_sparse_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(2)
    chain = crf.Chain(np.append(0.0, rng.standard_normal(5)), -0.7, rng.standard_normal((2, 2)))
    model = toxicity.Model(chain)
    for n in (1, 4, 9):
        features = rng.integers(0, 6, (n, 4)) * (rng.random((n, 1)) < 0.5)
        at = np.flatnonzero(features.any(1)).tolist()
        if at:
            expected, _ = enumerated(chain.emissions(features), chain.pairs)
            assert np.allclose(model.marginals(at, [tuple(f) for f in features[at]], n), expected[at])


def test_repeated_chains_train_like_one_that_counts_more():
    rng = np.random.default_rng(3)
    features, states, lengths = rng.integers(0, 5, (6, 8, 2)), rng.integers(0, 2, (6, 8)), np.full(6, 8)
    times = np.array([1, 2, 1, 3, 1, 1])
    one = crf.train(features, states, lengths, 5, times=times.astype(float))
    many = crf.train(np.repeat(features, times, 0), np.repeat(states, times, 0), np.repeat(lengths, times), 5)
    assert np.allclose(one.weights, many.weights) and np.allclose(one.pairs, many.pairs) and np.isclose(one.bias, many.bias)


def test_a_sample_takes_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    texts, y, _ = crf.labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert len(texts) == 2 and y.tolist() == [1, 1]


def test_small_leaves_split_and_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 30)
    monkeypatch.setattr(links, "TILE", 20)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((300, 16))
    rows = [(k, [float(x) for x in (centers[k % 300] + rng.standard_normal(16) * 0.07).astype(np.float32)], 0) for k in range(900)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, node string, tree string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found, n = brute_vectors(rows)
    of = components([v for v, _, _ in rows], found)
    assert len(found) > 200
    assert sum(got[v].n_links for v, _, _ in rows) >= 0.999 * 2 * len(found)
    assert sum((got[v].n_links, got[v].component_id) == (n[v], of[v]) for v, _, _ in rows) >= 0.998 * len(rows)


def test_deep_trees_are_fitted_and_passed_at_once(spark, monkeypatch):
    """Two dimensions and two labels, doubles, most cuts fitted on some vectors only, large groups and small ones, leaves cut into tiles: no more tables are written for 8 levels than for one, and links are whole."""
    rng = np.random.default_rng(7)
    rows = []
    for size, label in ((16, 0), (24, 0), (16, 1)):
        centers = rng.standard_normal((400, size))
        rows += [(len(rows) + k, [float(x) for x in centers[k % 400] + rng.standard_normal(size) * 0.07], label) for k in range(1_000)]
    rows += [(len(rows) + k, [float(x) for x in centers[0] + rng.standard_normal(16) * 0.03], 1) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, n = brute_vectors([r for r in rows if len(r[1]) == 16])
    more, m = brute_vectors([r for r in rows if len(r[1]) == 24])
    of, n = components([r[0] for r in rows], found + more), n + m
    assert len(found) > 400 and len(more) > 200
    written = []
    for leaf, most, group, tile in ((600, 50_000, 1 << 24, 8_000), (20, 50_000, 1 << 24, 8_000), (20, 500, 128 * 100, 8_000), (20, 50_000, 128 * 6, 10)):
        names = []
        monkeypatch.setattr(embeddings, "LEAF", leaf)
        monkeypatch.setattr(embeddings, "FIT_MOST", most, raising=False)
        monkeypatch.setattr(embeddings, "GROUP_BYTES", group, raising=False)
        monkeypatch.setattr(links, "TILE", tile)
        monkeypatch.setattr(embeddings, "saved", lambda table, name, names=names: names.append(name) or saved(table, name))
        got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
        written.append(names)
        assert sum(got[r[0]].n_links for r in rows) >= 0.999 * 2 * len(found + more)
        assert sum((got[r[0]].n_links, got[r[0]].component_id) == (n[r[0]], of[r[0]]) for r in rows) >= 0.998 * len(rows)
    assert written == [written[0]] * 4


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(docs):
    """Least doc_id of the group of each document."""
    sets = {d: shingles(t) for d, t in docs}
    ids = [d for d in sets if sets[d]]
    near = [(a, b) for a, b in itertools.combinations(ids, 2) if 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25 and 10 * (c := len(sets[a] & sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - c)]
    return components([d for d, _ in docs], near), len(near)


def test_buckets_that_are_split_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 3)
    monkeypatch.setattr(links, "TILE", 2)
    of, _ = brute_groups(docs)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == of


def test_files_are_ordered_by_their_numbers(spark):
    from pyspark.sql import functions as F

    names = [f"part-{k:05d}-x-c000.zstd.parquet" for k in (0, 9, 99_998, 99_999, 100_000, 100_001, 1_000_000)]
    rows = spark.createDataFrame([(n, 10) for n in names], "file string, n_tokens long").withColumn("part", token_files.part_number(F.col("file")))
    base = {r.part: r.base for r in token_files._base(rows).collect()}
    assert [base[k] for k in sorted(base)] == [10 * k for k in range(7)]


def test_damaged_repeated_and_long_packets():
    data = bytes(k * 7 % 256 for k in range(5000))
    stream, index = media_ts.pack(data)
    whole = media_ts.unpack(stream)
    assert [(p, k, k in whole["key_packets"]) for p, k in zip(whole["pts"], whole["starts"], strict=True)] == index
    bad = bytearray(stream)
    bad[188 * 6 + 3] |= 0x20
    bad[188 * 6 + 4] = 255
    out = media_ts.unpack(bytes(bad))
    assert out["damaged"] == 1 and len(out["payload"]) == 5000 - 184 and out["payload"][:500] == data[:500]
    out = media_ts.unpack(stream[: 188 * 6] + stream[188 * 5 : 188 * 6] + stream[188 * 6 :])
    assert (out["repeated"], out["breaks"], out["payload"]) == (1, 0, data)
    # a table that goes on in a second packet
    body = (0xE000 | media_ts.STREAM_PID).to_bytes(2, "big") + b"\xf0\xc8" + bytes(200) + b"\x06" + (0xE000 | media_ts.STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    section = media_ts._section(2, 1, body)
    packets = [bytes([0x47, 0x40 | 1, 0, 0x10]) + section[:184], bytes([0x47, 1, 0, 0x11]) + section[184:].ljust(184, b"\xff")]
    assert media_ts.unpack(stream[:188] + b"".join(packets) + stream[376:])["payload"] == data


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage of the pipeline took and gave, in Python."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = saved(stage(spark, docs, sf), name)
        out.append((docs.collect(), made.collect()))
        docs = made
    return out


def test_stage_of_quality_keeps_what_scores_enough(spark, sf, stages):
    before, after = stages[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality.training_rows())
    score = crf.probability(model.read([r.text or "" for r in before]), model.head)
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score, strict=True) if s >= quality.THRESHOLD)


def test_stage_of_copies_keeps_the_least_of_each_group(stages):
    before, after = stages[1]
    of, n = brute_groups([(r.doc_id, r.text) for r in before])
    assert n > 0 and sorted(r.doc_id for r in after) == sorted(set(of.values()))


def test_stage_of_passages_keeps_the_other_words(stages):
    before, after = stages[2]
    words = {r.doc_id: (r.text or "").encode().split() for r in before}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    text = {r.doc_id: r.text for r in before}
    for r in after:
        w = words[r.doc_id]
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        expected = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else text[r.doc_id]
        assert r.text == expected and (not gone or r.n_chars == len(expected))


def test_stage_of_personal_data_replaces_spans(spark, stages):
    before, after = stages[3]
    found = saved(pii.candidates(spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string")), "t")
    spans = {r.doc_id: r.spans for r in pii.classify(found, pii.fit(found)).collect()}
    text = {r.doc_id: r.text or "" for r in before}
    assert sum(map(len, spans.values())) > 0
    for r in after:
        own, out, at = sorted((s.start, pii.KINDS.index(s.kind), s.end, s.kind) for s in spans[r.doc_id]), [], 0
        for start, _, end, kind in own:
            out.append(text[r.doc_id][at : max(at, start)])
            out.append(f"[{kind.upper()}]" if end > at else "")
            at = max(at, end)
        assert (r.text or "") == "".join(out) + text[r.doc_id][at:]
        assert {(k, s, e) for k, s, e in ((s.kind, s.start, s.end) for s in spans[r.doc_id] if s.base)} == set(base_spans(text[r.doc_id]))


def test_stage_of_packing_places_every_token_once(stages):
    before, after = stages[4]
    by = collections.defaultdict(list)
    for r in after:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        assert all(o + n == p for (o, n), (p, _) in itertools.pairwise(sorted(own))) and min(own)[0] == 0 and sum(n for _, n in own) <= 2048
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
