"""Each operator's query over a whole table against a brute-force version."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reckoner.llm import embeddings, jaccard, media_ts, packing, pieces, pii, registry, substring, token_files

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_personal_data(spark, sf, docs):
    got = {r.doc_id: r for r in pii.op1_personal_data(spark, sf).collect()}
    for doc_id, text in docs:
        base = base_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_personal_data_odd_texts(spark):
    from reckoner.llm.common import saved

    texts = ["", None, "a@b.c_d@e.f %@x..y a@b. 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111-4111-1111-1111-1111 é +1 (555) 123-4567 +33 1 23 45 67 89 0 +1(((((", "++1 234 567 8901)) x@y-.z.-" * 3, "5" * 3000, "a." * 5000 + "@", "1.1.1.1 " * 500, "é😀 b@c.de 😀 10.0.0.1"]
    found = saved(pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "t")
    out = pii.redact(pii.classify(found, pii.fit(found))).collect()
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_spans(texts[r.doc_id] or "")
    assert next(r.text for r in out if r.doc_id == 8) == "é😀 [EMAIL] 😀 [IP]"


def test_secrets_are_found(spark, sf, docs):
    got = {r.doc_id: r.spans for r in pii.op1_personal_data(spark, sf).collect()}
    for doc_id, text in docs:
        for m in re.finditer(r'token = "[0-9a-f]{40}"', text):
            assert f"secret:{m.start()}:{m.end()}" in got[doc_id].split(",")


def test_transport_streams(spark, sf, docs):
    got = {r.doc_id: r for r in media_ts.op2_transport_streams(spark, sf).collect()}
    for doc_id, text in docs:
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes % 188 == 0 and "breaks=0;lost=0" in r.feature


@pytest.mark.parametrize("size", [0, 1, 100, 157, 158, 159, 168, 169, 170, 171, 183, 184, 5000, 16384, 16385, 100_000])
def test_stream_round_trip(size):
    data = bytes(k * 7 % 256 for k in range(size))
    out = media_ts.unpack(media_ts.pack(data)[0])
    assert out["payload"] == data and out["breaks"] == 0
    assert out["pts"] == [k * media_ts.TICKS for k in range(max(1, -(-size // media_ts.UNIT)))]
    assert len(out["key_packets"]) == -(-len(out["pts"]) // media_ts.KEY_EVERY)


def test_damaged_stream_counts_breaks():
    stream = media_ts.pack(bytes(5000))[0]
    assert media_ts.unpack(stream[: 188 * 5] + stream[188 * 6 :])["breaks"] == 1
    assert media_ts.unpack(stream[: 188 * 5] + b"\0" * 188 + stream[188 * 6 :])["lost"] == 1


def test_substring_dedup(spark, sf, docs):
    words = [(d, t.encode().split()) for d, t in docs]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring.op4_substring_dedup(spark, sf).collect()}
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def brute_vectors(rows):
    by = collections.defaultdict(list)
    for v, e, label in rows:
        by[label].append((v, e))
    links, n = [], collections.Counter()
    for own in by.values():
        ids, m = [v for v, _ in own], np.array([e for _, e in own], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for i, j in np.argwhere(np.triu(m @ m.T >= 0.98, 1)):
            links.append((ids[i], ids[j]))
            n[ids[i]] += 1
            n[ids[j]] += 1
    return links, n


def test_embedding_forest(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((60, 16))
    rows = [(k, [float(x) for x in (centers[k % 60] + rng.standard_normal(16) * 0.09).astype(np.float32)], int(k % 60 % 2)) for k in range(1800)]
    rows += [(1800 + k, rows[0][1], 0) for k in range(40)]
    extra = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, rows[0][1], None), (9004, [None] + [1.0] * 15, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "x")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links, n = brute_vectors(rows)
    assert len(links) > 1000
    of = components([v for v, _, _ in rows], links)
    for v, _, _ in rows:
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (n[v], of[v], of[v] == v)
    assert all(got[v].n_links == 0 and got[v].kept for v, _, _ in extra)
    assert len(got) == len(rows) + len(extra)


def test_jaccard_join(spark, sf, docs):
    sets = {}
    for d, t in docs:
        w = t.encode().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [d for d, s in sets.items() if s]
    links, n = [], collections.Counter()
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    of = components([d for d, _ in docs], links)
    assert links
    for r in jaccard.op7_jaccard_join(spark, sf).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.doc_id], of[r.doc_id], of[r.doc_id] == r.doc_id)


def test_jaccard_links_in_a_large_group(spark):
    """A group that is larger than a tile and than a bucket's limit, with copies."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(1700):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 3), replace=False):
            w[at] = f"v{k}x{at}"
        texts.append(" ".join(w))
    sets = [frozenset(hash(tuple(t.split()[i : i + 5])) for i in range(116)) for t in texts]
    rows = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.n_links for r in rows}
    for d in range(0, 1700, 97):
        expected = sum(1 for e in range(1700) if e != d and (c := len(sets[d] & sets[e])) >= 0.8 * (len(sets[d]) + len(sets[e]) - c))
        assert got[d] == expected


def test_packing(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {}
    for d, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            expected[d, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    rows = packing.op8_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.05 * -(-sum(r.length for r in rows) // 2048) + 1


def test_configurations_cover_demand():
    sizes, demand = [1100, 900, 700, 450], [40, 60, 30, 25]
    made = packing.configurations(sizes, demand, 2048)
    used = collections.Counter()
    for times, copies in made:
        assert sum(sizes[k] * n for k, n in copies.items()) <= 2048
        for k, n in copies.items():
            used[k] += times * n
    assert sum(t for t, _ in made) <= 68 and sum(used[k] * s for k, s in enumerate(sizes)) >= 0.9 * sum(d * s for d, s in zip(demand, sizes, strict=True))


def scalar_sample(model, text, key, seed_words):
    """Forward filtering and backward sampling of one part, one step at a time."""
    weight = {model.raw[i].decode(): (int(i), float(w)) for i, w in zip(model.ids, model.weights, strict=True)}
    n = len(text)
    forward, edges = [1.0] + [0.0] * n, [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        edges[end].append((end - 1, -1, pieces.SPELLED))
        edges[end] += [(end - k, *weight[text[end - k : end]]) for k in range(1, 17) if k <= end and text[end - k : end] in weight]
        forward[end] = sum(forward[s] * w for s, _, w in edges[end])
    at, out, k = n, [], 0
    while at:
        u = seed_words(k)
        total = 0.0
        for s, i, w in edges[at]:
            total += forward[s] * w / forward[at]
            if u < total or (s, i, w) == edges[at][-1]:
                break
        out.append(i if i >= 0 else int(model.byte[ord(text[s])]))
        at, k = s, k + 1
    return out[::-1]


def test_sampled_pieces_follow_the_scalar_version(docs):
    from reckoner.llm import hashing

    model = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for word in (" the", " there", "walking", " Internationale"):
        keys = hashing.mix(np.arange(200, dtype=np.uint64))
        ids, at = model._part(word * 200, keys, np.arange(201) * len(word))
        stream = hashing.mix(keys ^ hashing.mix(np.array([1], np.uint64)))
        for k in range(200):
            u = lambda step, k=k: float(hashing.mix(stream[k : k + 1] + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64)))[0] >> np.uint64(11)) / 2**53
            assert ids[at[k] : at[k + 1]].tolist() == scalar_sample(model, word, None, u)


def test_long_runs_are_one_lattice():
    from decimal import Decimal

    from reckoner.llm import hashing

    model = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    weight = {model.raw[i].decode(): (int(i), Decimal(float(w))) for i, w in zip(model.ids, model.weights, strict=True)}
    for text in ("https://example.org/" + "international/transportation-" * 14, "\u0e01" * 300, "x" * 700):
        n, edges, forward = len(text), [[]], [Decimal(1)]
        for end in range(1, n + 1):
            edges.append([(end - 1, -1, Decimal(pieces.SPELLED))] + [(end - k, *weight[text[end - k : end]]) for k in range(1, 17) if k <= end and text[end - k : end] in weight])
            forward.append(sum(forward[s] * w for s, _, w in edges[end]))
        keys = hashing.mix(np.arange(20, dtype=np.uint64))
        ids, at = model._part(text * 20, keys, np.arange(21) * n)
        stream = hashing.mix(keys ^ hashing.mix(np.array([1], np.uint64)))
        for d in range(20):
            node, out, k = n, [], 0
            while node:
                u = float(hashing.mix(stream[d : d + 1] + np.uint64(k * 0xD1342543DE82EF95 % (1 << 64)))[0] >> np.uint64(11)) / 2**53
                total = 0.0
                for s, i, w in edges[node]:
                    total += float(forward[s] * w / forward[node])
                    if u < total or (s, i, w) == edges[node][-1]:
                        break
                out.append([i] if i >= 0 else model.byte[list(text[s].encode())].tolist())
                node, k = s, k + 1
            assert ids[at[d] : at[d + 1]].tolist() == [x for piece in out[::-1] for x in piece]


def test_sampled_pieces_are_lossless(spark, sf, docs):
    got = {r.doc_id: r.decoded_sha256 for r in registry.QUERIES["op9_sampled_pieces"](spark, sf).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in docs}


def test_sampled_pieces_do_not_depend_on_partitions(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id: r.tokens for r in pieces.encode(df.repartition(n), path).collect()} for n in (1, 7))
    other = {r.doc_id: r.tokens for r in pieces.encode(df, path, seed=5).collect()}
    assert one == many and one != other


def test_token_files(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op10_token_files(spark, sf).collect()}, 0
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_layout(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert columns["tokens.list.element"].has_dictionary_page


def test_toxic_spans_beside_letters_that_lower_case_splits():
    from reckoner.llm import crf, toxicity

    chain = crf.Chain(np.array([0.0, 20.0]), -5.0, np.zeros((2, 2)))
    model = toxicity.Model(chain, {"bad": 1})
    text = "\u0130stanbul BAD \u0130zmir, bad"
    assert [text[s:e] for s, e, _ in model.read(text)[1]] == ["BAD", "bad"]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_added_tokens_are_found_as_by_the_library(name, kind):
    import pyarrow as pa

    from reckoner.llm import bpe

    path = public_tokenizers.path(name)
    texts = ["a <|endoftext|> b", "plain words", None, "<|startoftext|>x<|endoftext|>", "more, plain\u00a0words", "", "<|ENDOFTEXT|> <|endoftext", "last <|endoftext|>"]
    tok, got = Tokenizer.from_file(path), {}
    for first, ids, at in bpe.Encoder(path, kind).encode(pa.array(texts)):
        got |= {first + k: ids[s:e].tolist() for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True))}
    assert [got[k] for k in range(len(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["op3_toxic_spans", "op6_line_quality"])
def test_scores_on_held_out_documents(spark, sf, labels, name):
    sf = sf.replace("sf0.001", "sf0.1")
    column = "toxic" if name.startswith("op3") else "quality"
    known = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES[name](spark, sf).collect()]
    parts, part = (4, 2) if column == "toxic" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    wins = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(wins) / len(wins) > 0.9
