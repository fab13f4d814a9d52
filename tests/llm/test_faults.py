"""Damaged, very long and repeated input; intermediate tables that go; operators in many blocks; the library's tokenizers as they come."""

import collections
import os
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reckoner.llm import common, crf, embeddings, media_ts, packing, pii, substring, token_files
from reckoner.llm.common import running, saved


def test_no_damage_ends_the_reading_of_streams():
    rng = np.random.default_rng(1)
    for k in range(4_000):
        size = int(rng.integers(0, 40_000)) if k % 40 == 0 else int(rng.integers(0, 700))
        data = rng.integers(0, 256, size, dtype=np.uint8).tobytes().ljust(64, b"\0")
        stream = bytearray(media_ts.pack(data)[0])
        for _ in range(int(rng.integers(1, 6))):
            at = int(rng.integers(len(stream))) if rng.random() < 0.5 else int(rng.integers(len(stream) // 188)) * 188 + int(rng.integers(24))
            stream[at] = int(rng.integers(256))
        cut = int(rng.integers(len(stream))) if k % 5 == 0 else len(stream)
        out = media_ts.unpack(bytes(stream[:cut]))
        assert len(out["pts"]) == len(out["starts"]) <= len(out["units"])


def test_an_announced_break_is_none():
    stream = bytearray(media_ts.pack(bytes(70_000))[0])
    whole = media_ts.unpack(bytes(stream))
    at = whole["starts"][-1] if whole["starts"][-1] in whole["key_packets"] else whole["key_packets"][-1]
    without = stream[: 188 * (at - 1)] + stream[188 * at :]
    assert media_ts.unpack(bytes(without))["breaks"] == 1
    without[188 * (at - 1) + 5] |= 0x80
    assert media_ts.unpack(bytes(without))["breaks"] == 0


def test_stored_index_says_what_the_stream_says(spark, odd):
    rows = media_ts.features(media_ts.store(odd)).collect()
    assert rows and all(r.index_ok for r in rows)


def test_spans_that_touch(spark):
    """Candidates that touch base spans go, by the plain rule, whatever the order."""
    rng = np.random.default_rng(2)
    kinds = [*pii.BASE, "secret", "number"]
    rows = []
    for k in range(60):
        spans = [(str(rng.choice(kinds)), int(s), int(s + rng.integers(1, 12))) for s in rng.integers(0, 60, int(rng.integers(0, 25)))]
        rows.append((k, [(kind, s, e, kind in pii.BASE, [1, 1, 1, 1], [0, 0, 0, 0]) for kind, s, e in spans]))
    df = spark.createDataFrame(rows, "doc_id long, _pii array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>,form:array<int>>>")
    model = {"prior": 5.0, "tables": [[0.0] * 6, [0.0] * 3, [0.0] * 3, [0.0] * 4, [0.0] * 4]}
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.classify(df, model).collect()}
    for k, spans in rows:
        base = [(s, e) for _, s, e, b, *_ in spans if b]
        left = [(s, pii.KINDS.index(kind), e, kind) for kind, s, e, b, *_ in spans if b or not any(x < e and s < y for x, y in base)]
        assert got[k] == [(s, kind, e) for s, _, e, kind in sorted(left)]


def test_running_results(spark):
    values = np.random.default_rng(3).integers(0, 50, 700).tolist()
    df = spark.createDataFrame([(values,), ([5],), ([],), ([None, 3, None, 1],)], "v array<long>")
    got = df.select(running(F.col("v")).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()
    assert got[0].s == np.cumsum(values).tolist() and got[0].m == np.maximum.accumulate(values).tolist()
    assert (got[1].s, got[2].s, got[3].m) == ([5], [], [None, 3, 3, 3])


def test_very_many_spans_in_one_text(spark):
    text = "é mail a.b@c.de now " * 32_000
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    began = time.time()
    found = saved(pii.candidates(docs), "t")
    rows = {r.doc_id: r for r in pii.redact(pii.classify(found, pii.fit(found))).collect()}
    took = time.time() - began
    assert len(rows[1].spans) == 32_000 and rows[1].text == "é mail [EMAIL] now " * 32_000
    assert (rows[2].text, rows[3].text) == ("none", None)
    assert took < 60, took


def test_sample_leaves_out_only_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(crf, "SAMPLE_BYTES", 1_000)
    docs = spark.createDataFrame([(k, "x" * (2_000 if k % 10 == 0 else 20)) for k in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, _, _ = crf.labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert len(texts) == 36


def test_equal_rows_are_dealt_out_and_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 50)
    docs = spark.createDataFrame([(None, "a b c")] * 3_000 + [(k, "a " * k) for k in range(300)], "doc_id long, text string").repartition(3)
    pieces = saved(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("_place", F.monotonically_increasing_id()), "t")
    ranked = packing.ranked(pieces, "length", ["doc_id", "_place"], 3_300, "rank").collect()
    by = collections.defaultdict(list)
    for r in ranked:
        by[r.length].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    rows = packing.pack(pieces).collect()
    assert len(rows) == 3_300
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        own.sort()
        assert own[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2_048
    assert len(seqs) <= 1 + -(-sum(r.length for r in rows) // 2_048)


def test_levels_of_the_forest_are_deleted(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 10)
    monkeypatch.setattr(common, "scratch", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("part", "path", "kept", "node", "tree")})
    assert embeddings.near_duplicates(df).count() == df.count()
    left = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)}
    assert "leaves" in left and not left & {"forest", "sizes", "cuts"}


def test_repeats_across_many_blocks(spark, docs, sf, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20_000)
    seen = collections.Counter()
    words = {k: t.encode().split() for k, t in docs}
    for w in words.values():
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for k, w in words.items():
        gone = {x for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for x in range(j, j + 35)}
        assert got[k] == len(gone)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library_as_it_comes(spark, docs, name, tmp_path):
    texts = [*docs[:60], (900, "a <|endoftext|> b"), (901, "<|startoftext|>x<|endoftext|>"), (902, "  <|ENDOFTEXT|>  é"), (903, " x <|endoftext|> \n\n y")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    end = 0 if name.startswith("word") else 2
    plain = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, end] for k, t in texts}
    if end:
        folder = str(tmp_path / "tokens")
        token_files.write_tokens(df, folder, public_tokenizers.path(name))
        assert {r.doc_id: r.tokens for r in token_files.read_tokens(spark, folder).collect()} == plain
        return
    for r in packing.pieces(df, public_tokenizers.path(name)).collect():
        own = plain[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_run_is_all_stages_in_turn(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = saved(stage(spark, df, sf), name)
    assert got.columns == df.columns
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, df.select(key).collect()))
