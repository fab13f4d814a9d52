"""Hard negatives, lexical search and chats against plain versions on odd rows, in many blocks and sets."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.llm import chat, lexical, negatives

# Hard negatives


def plain_negatives(rows, positives=5, negatives=10):
    """rows: (vec_id, label, whole numbers)."""
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a % 100:
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, own) for j, (b, own, w) in enumerate(rows) if j != k and len(w) == len(v)]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dims, labels, spread):
    rng = np.random.default_rng(seed)
    return [(int(k), int(rng.integers(labels)), rng.integers(-spread, spread + 1, dims).tolist()) for k in range(n)]


@pytest.mark.parametrize(("seed", "n", "dims", "labels", "spread"), [(1, 450, 40, 3, 60), (2, 300, 5, 2, 2), (3, 250, 17, 40, 5), (4, 120, 1, 2, 1), (5, 300, 33, 2, 1 << 24)])
def test_negatives(spark, seed, n, dims, labels, spread, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP", 2)
    rows = vectors(seed, n, dims, labels, spread)
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<int>").repartition(5)
    got = negatives.mine(df, set_bytes=300).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_with_threshold_joins_of_every_depth():
    """What the index leaves out and what remaining norms rule out never is a pair that reaches its threshold."""
    rng = np.random.default_rng(6)
    for d in (0, 1, 16, 50, 64):
        x = (rng.standard_normal((300, d)) * np.geomspace(100, 1, d)).astype(np.int64)
        q = x[:20]
        block, full = negatives.Block(x), q @ x.T
        for t in (-50, 0, 1, 500, 5_000, 50_000):
            a, b, s = block.join(q, np.full(20, t))
            assert set(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == {(i, j, int(full[i, j])) for i, j in zip(*np.nonzero(full >= t), strict=True)}


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.7, 0.0]), (2, 2, [0.7, 0.0]), (3, 2, [0.6, 0.1]), (4, None, [0.7, 0.0]), (5, 2, None), (6, 2, [None, 1.0]), (None, 2, [0.6, 0.1]),
        (7, 2, [inf, 0.0]), (8, 2, [nan, 0.0]), (9, 2, [1e30, 0.0]), (10, 2, [0.7]), (11, 2, []), (100, 3, []), (200, 4, [-1.0, 0.0]), (201, 4, [1.0, 0.0]), (0, 1, [1.0, 0.5]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("key", "score", "rank", "anchor", "vector")})
    used = [(a, b, [math.floor(256 * float(np.float32(x))) for x in v]) for a, b, v in rows if None not in (a, b, v) and None not in v and all(abs(x) < 1e9 for x in v)]
    got = sorted(map(tuple, negatives.mine(negatives.scaled(df, 256)).collect()))
    assert got == plain_negatives(used) and {r[3] for r in got} == {2, 3, 201}
    assert negatives.mine(negatives.scaled(df.limit(0), 256)).count() == 0


# Lexical search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    words = [(k, plain_terms(t)) for k, t in docs]
    words = [(k, collections.Counter(w), len(w)) for k, w in words if w]
    total, number = sum(n for _, _, n in words), len(words)
    df = collections.Counter(t for _, w, _ in words for t in w)
    out = []
    for item, text in items:
        found = []
        for k, w, n in words:
            m = 100 - 50 + 50 * n * number // total
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w[t] // (1000 * w[t] + 20 * m)) for t in set(plain_terms(text)) if t in w)
            found += [(-s, k is None, k or 0)] if s > 0 else []
        out += [(item, r + 1, None if missing else k, -s) for r, (s, missing, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block", "set_terms", "step"), [(3, 7, 1 << 20, 1), (1, 40, 9, 2), (50, 16, 30, 64)])
def test_search(spark, top, block, set_terms, step, monkeypatch):
    monkeypatch.setattr(lexical, "STEP", step)
    rng = np.random.default_rng(top)
    names = ["the", "Of", "and", "né", "été", "x1", "ß", "日本", "a", "Zz", "rare", "other"]
    share = np.geomspace(1, 0.01, len(names))
    docs = [(int(k), " ".join(rng.choice(names, int(rng.integers(0, 30)), p=share / share.sum()))) for k in range(300)]
    docs += [(300, docs[0][1]), (300, docs[1][1]), (300, docs[1][1]), (301, None), (302, "-- ..\n"), (None, "rare the"), (None, "THE, the; rare!"), (303, "rare_of " * 5_000)]
    items = [(int(k), ", ".join(rng.choice(names, int(rng.integers(1, 9))))) for k in range(20)] + [(20, None), (21, "!"), (22, "unknown"), (None, "rare"), (3, "the the of")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("item", "item_id", "score", "n", "rank")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "item", "terms")})
    got = lexical.search(d, i, top, set_terms, block).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, top)


def test_a_query_of_very_many_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 4_000)
    docs = [(k, " ".join(f"w{x}" for x in range(k, 600, k + 1))) for k in range(60)]
    items = [(0, " ".join(f"w{x}" for x in range(600))), (1, "w59 w3")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == lexical.search(docs.where("text is null"), items).count() == 0
    assert lexical.search(docs, items).columns == lexical.search(docs.limit(0), items).columns


def test_search_stops_before_the_end_of_its_lists():
    """With one list far above the others the best positions soon rule the rest out; all documents that reach the last score are given, ties included."""
    n = 5_000
    term, first = np.tile(np.arange(2), n).astype(np.int32), np.arange(n + 1) * 2
    tf = np.ones(2 * n, np.int32)
    tf[:100] = 50
    lists = lexical.Lists(np.full(n, 60), term, tf, first, 2, n, 60 * n)
    docs, scores = lists.best(np.array([0, 1]), np.array([900, 1]), 10, 0)
    assert sorted(docs.tolist()) == list(range(50)) and len(set(scores.tolist())) == 1
    assert not len(lists.best(np.array([0, 1]), np.array([900, 1]), 10, 1 << 60)[0])


# Chats


def test_parts_are_flattened_and_read_back(spark):
    image, audio, paper, odd = ("image", "a < b", "i.png", 640, 480, None, None), ("audio", None, "s.wav", None, None, 2.5, None), ("document", "d", "d.pdf", None, None, None, 3), ("video", "v", None, None, None, None, None)
    text = ("text", r"\l <image> </turn>", None, None, None, None, None)
    rows = [(1, 1, "assistant", [text, image, odd, text]), (1, 0, "user", [audio, paper, image]), (1, None, None, []), (2, 0, "tool>\\g", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumns({c: F.lit("x") for c in ("formatted", "loss", "t", "ends", "pieces", "body")})
    made = chat.format_chats(df)
    by = {r.conv_id: r for r in made.collect()}
    body = r"\el \limage> \l/turn>"
    assert by[1].formatted == f"<turn >\n</turn>\n<turn user>\n<audio><document><image></turn>\n<turn assistant>\n{body}<image><attachment>{body}</turn>\n"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in by[1].attachments] == [(1, "audio", "s.wav", 63), (1, "document", "d.pdf", 1800), (1, "image", "i.png", 23 * 18), (2, "image", "i.png", 23 * 18), (2, "video", None, 0)]
    assert by[1].attached_tokens == 63 + 1800 + 2 * 23 * 18
    assert [by[1].formatted[s.start : s.end] for s in by[1].loss] == ["", "", f"{body}<image><attachment>{body}"]
    back = {r.conv_id: r for r in chat.read_chats(made).collect()}
    written = text[1] + "![a < b](i.png)![v]()" + text[1]
    assert [tuple(t) for t in back[1].turns] == [("", ""), ("user", "![](s.wav)![d](d.pdf)![a < b](i.png)"), ("assistant", written)] and back[1].learnt == written
    assert [tuple(t) for t in back[2].turns] == [("tool>\\g", "")] and back[2].learnt == ""
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


TEXTS = [None, "", "plain", "\\", "<", ">", "\\e\\l", "</turn>\n", "<turn user>\n", "![a](b.png)", "x ![<a>](b.MP3#t=1.5) y ![](c.pdf#pages=2)![](d.gif#w=10&h=900000000)", "![a](b)", "![![a](b.jpg)", "<image>![a](b.jpg)<audio>", "😀 日本\r\n\x00", "w " * 50_000, "![a](b.png) " * 700]


def test_texts_come_back_as_they_were(spark, tmp_path):
    roles = ["user", "assistant", None, "as>si<s\\tant"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate(itertools.product(roles, TEXTS)) for t in (0, 0, 1)] + [(None, t, roles[t % 2], TEXTS[t % 13]) for t in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    marked = "\\### Assistant: </turn> ok"
    by = collections.defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", marked), (-7, 1, "assistant", marked)]:
        by[c].append((t, (r or "").encode(), (x or "").encode()))
    got = chat.op13_typed_chats(spark, str(tmp_path)).collect()
    assert len(got) == len(by)
    for r in got:
        own = sorted(by[r.conv_id])
        learnt = b"".join(x for _, role, x in own if role == b"assistant")
        assert r.turns_sha256 == hashlib.sha256(b"".join(role + b"\n" + x + b"\n" for _, role, x in own)).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(learnt.decode()), hashlib.sha256(learnt).hexdigest())


def test_chats_run_no_python(spark, sf):
    plan = chat.op13_typed_chats(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
