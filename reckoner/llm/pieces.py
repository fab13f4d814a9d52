"""Sampled SentencePiece segmentations (operator 9): forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for each piece that matches at a place, and for each character one that spells it in
byte pieces. A piece of rank r (the vocabulary's order) weighs (r + 1) ** -THETA; spelling a character weighs SPELLED. The
forward pass sums the weights of all segmentations of each beginning, the backward pass draws edges from the end with the
exact conditional probabilities. Draws are hashes of the seed, the row's key, the place and the step, so a row gets
the same segmentation wherever and whenever it is encoded.

No piece has a space inside, or a line break, so the lattice is cut before spaces and around line breaks, and nowhere else.
Forward sums are kept as fractions and powers of two, so a part may have any length. Equal parts of a batch share their forward pass. Spaces stand as U+2581
in pieces; a U+2581 of the text itself is spelled in bytes, and nothing is normalised, so decoding gives the text back
without loss. A null text counts as empty and has no pieces. A null key is a key of its own; rows with equal keys and
texts get equal pieces.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reckoner.llm import hashing
from reckoner.llm.common import flat_text, slices, table

THETA, SPELLED, SEED = 1.0, 1e-6, 20240229
SPACE, NEWLINE, OWN_MARK = 0x2581, 0x0A, 0x110000
_BASE = 0xA0761D6478BD642F | 1
SLOTS = 20

_models: dict[str, "Pieces"] = {}


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []  # what each id stands for
        self.byte = np.zeros(256, np.int64)
        by_size: dict[int, list[tuple[int, int]]] = {}
        rank = 0
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace("▁", " ").encode())
                codes = np.array([ord(c) for c in piece], np.uint64)
                by_size.setdefault(len(codes), []).append((int(hashing._ranges(codes, _BASE, np.array([0]), np.array([len(codes)]))[0]), k, (rank + 1.0) ** -THETA))
                rank += 1
        self.lengths = np.array([len(x) for x in self.raw])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = sorted(by_size)
        every = sorted(x for v in by_size.values() for x in v)
        self.hashes, self.ids, self.weights = (np.array([x[k] for x in every], t) for k, t in enumerate((np.uint64, np.int64, float)))
        self.slots = [np.full(1 << SLOTS, -1, np.int32) for _ in range(2)]  # pieces by 20 bits of their hashes; one whose slot is taken goes by 20 others
        for k, h in enumerate(self.hashes.tolist()):
            for x, shift in zip(self.slots, (64 - SLOTS, 64 - 2 * SLOTS), strict=True):
                if x[h >> shift & (1 << SLOTS) - 1] < 0:
                    x[h >> shift & (1 << SLOTS) - 1] = k
                    break
            else:
                raise ValueError("two pieces share both slots")

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their numbers."""
        x = self.slots[0][h >> np.uint64(64 - SLOTS)]
        y = self.slots[1][h >> np.uint64(64 - 2 * SLOTS) & np.uint64((1 << SLOTS) - 1)]
        first, second = self.hashes[x] == h, self.hashes[y] == h
        first &= x >= 0
        second &= y >= 0
        hit = np.flatnonzero(first | second)
        return hit, np.where(first[hit], x[hit], y[hit])

    def _lattice(self, codes: np.ndarray, first: np.ndarray):
        """Edges into each node of the parts' lattices, ordered by node; the first edge into each node; each edge's probability with those of the node's edges before it.

        Part p has the characters codes[first[p]:first[p + 1]] and the nodes from first[p] + p on, one more than characters.
        """
        sizes = np.diff(first)
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        left = np.repeat(first[1:], sizes) - np.arange(len(codes))  # characters to the part's end
        node = np.arange(len(codes), dtype=np.int32) + part
        power, inverse = hashing._tables(_BASE, len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[: len(codes)], dtype=np.uint64, out=total[1:])
        at, size, ident, weight = [np.arange(len(codes), dtype=np.int32)], [np.ones(len(codes), np.int32)], [np.full(len(codes), -1, np.int32)], [np.full(len(codes), SPELLED)]
        for n in self.sizes:
            places = np.flatnonzero(left >= n)
            hit, found = self._find(hashing.mix((total[places + n] - total[places]) * inverse[places]))
            at.append(places[hit].astype(np.int32))
            size.append(np.full(len(hit), n, np.int32))
            ident.append(self.ids[found].astype(np.int32))
            weight.append(self.weights[found])
        at, size, ident, weight = map(np.concatenate, (at, size, ident, weight))
        start, end = node[at], node[at] + size
        order = np.argsort(end, kind="stable")
        start, end, ident, weight, at = start[order], end[order], ident[order], weight[order], at[order]
        depth = end - (first[part[at]] + part[at])  # the end's place in its part
        forward, scale = np.zeros(len(codes) + len(sizes)), np.zeros(len(codes) + len(sizes), np.int32)  # a node's sum is forward * 2 ** scale
        forward[first[:-1] + np.arange(len(sizes))] = 1
        longest = int(sizes.max(initial=0))
        by_depth = np.argsort(depth.astype(np.min_scalar_type(longest)), kind="stable")
        edges = np.searchsorted(depth, np.arange(1, longest + 2), sorter=by_depth)
        share = np.zeros(len(start))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            e = by_depth[a:b]
            s, t = start[e], end[e]
            mass = np.ldexp(forward[s] * weight[e], scale[s] - scale[t - 1])  # by the scale of the node before, which each node has an edge from
            np.add.at(forward, t, mass)
            share[e] = mass / forward[t]
            own = t[ident[e] < 0]
            forward[own], power = np.frexp(forward[own])
            scale[own] = scale[own - 1] + power
        run = np.cumsum(share)
        new = np.append(True, end[1:] != end[:-1])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(end)), 0))
        inside = run - np.where(begins > 0, run[begins - 1], 0.0)
        below = np.where(np.append(new[1:], True), 1.0, np.minimum(inside, 1.0))
        into = np.zeros(len(forward), np.int64)
        into[end[new]] = np.flatnonzero(new)
        return start, ident, at, into, below

    def _part(self, text: str, keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run (offsets in characters), and each text's offset in them."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        spelled = codes.copy()
        codes[spelled == SPACE] = OWN_MARK + SPACE
        space, line = codes == 0x20, codes == NEWLINE
        codes[space] = SPACE
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, n))
        hashes = hashing._ranges(codes + np.uint64(1), _BASE, begin, begin + size)
        _, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = size[sample]
        first = np.concatenate([[0], np.cumsum(counts)])
        flat = np.arange(first[-1]) + np.repeat(begin[sample] - first[:-1], counts)
        start, ident, at, into, below = self._lattice(codes[flat], first)
        doc = np.searchsorted(offsets, begin, side="right") - 1
        ordinal = np.arange(len(begin)) - np.searchsorted(begin, offsets[:-1])[doc]
        stream = hashing.mix(keys[doc] ^ hashing.mix(ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        bottom = (first[:-1] + np.arange(len(counts)))[inverse]
        now, active = bottom + counts[inverse], np.arange(len(begin))
        taken, steps = [], np.zeros(len(begin), np.int64)
        while len(active):
            k = len(taken)
            u = (hashing.mix(stream[active] + np.uint64(k * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(11)).astype(float) / 2**53
            e, more = into[now[active]], np.arange(len(active))
            while len(more := more[below[e[more]] <= u[more]]):
                e[more] += 1
            taken.append((active, e))
            steps[active] += 1
            now[active] = start[e]
            active = active[now[active] > bottom[active]]
        ends = np.cumsum(steps)
        chosen = np.empty(int(ends[-1]), np.int64)
        for k, (who, e) in enumerate(taken):
            chosen[ends[who] - 1 - k] = e
        ids = ident[chosen]
        owner = np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # spelled characters become one id for each byte
            place = spelled[flat][at[chosen[odd]]].tolist()
            bytes_ = [chr(c).encode() for c in place]
            lengths = np.ones(len(ids), np.int64)
            lengths[odd] = [len(b) for b in bytes_]
            shift = np.concatenate([[0], np.cumsum(lengths)])
            out = np.repeat(ids, lengths)
            out[out < 0] = self.byte[np.frombuffer(b"".join(bytes_), np.uint8)]
            return out, shift[owner]
        return ids, owner

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts whose ids begin at the offsets `at` (one more than texts), in one array, and each text's offset there."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends[:-1], sizes)
        return self.bytes[index], ends[at]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _keys(column: pa.Array, seed: int) -> np.ndarray:
    values = np.array(column.fill_null(-1).cast(pa.int64())).astype(np.uint64)
    null = np.array(column.is_null(), bool)
    return hashing.mix(hashing.mix(values + np.uint64(seed)) ^ null.astype(np.uint64))


#: UTF-8 bytes of text whose lattices a worker holds at once, about; a longer text stands alone.
SLICE = 1 << 19


def _sampled(batches, path: str, seed: int):
    """Yields (doc_ids, ids of a run of texts in one array, offsets of the texts in it)."""
    model = pieces(path)
    for b in batches:
        for begin in range(0, b.num_rows, 1_000):
            rows = b.slice(begin, 1_000)
            data, offsets = flat_text(rows.column("text"))
            keys = _keys(rows.column("doc_id"), seed)
            for first, last in slices(offsets, SLICE):
                raw = data[offsets[first] : offsets[last]]
                begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
                yield rows.column("doc_id").slice(first, last - first), *model._part(raw.tobytes().decode(), keys[first:last], begins[offsets[first : last + 1] - offsets[first]])


def encode(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """doc_id and tokens (sampled piece ids) of each row of docs (doc_id, text)."""

    def run(batches):
        for doc_id, ids, at in _sampled(batches, path, seed):
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens and text of rows with tokens; null tokens give a null text."""

    def run(batches):
        model = pieces(path)
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                lists = part.column("tokens")
                data, at = model.decode(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]))
                raw = data.tobytes()
                texts = [raw[s:e].decode() if x else None for s, e, x in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "tokens")), pa.array(texts, pa.string())], ["doc_id", "tokens", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, tokens array<int>, text string")


def digests(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (sampled ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the text decoded from them): encode() and decode() in one pass of one Python worker, which holds one slice of texts at a time."""

    def run(batches):
        for doc_id, ids, at in _sampled(batches, path, seed):
            text, begins = pieces(path).decode(ids, at)
            raw, text = ids.astype("<u4").tobytes(), text.tobytes()
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(text[s:e]).hexdigest() for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with piece_bpe_32k: doc_id, n_tokens, ids_crc32, decoded_sha256."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
