"""Encoding of many texts with a vocabulary of the tokenizers library; repeated pieces of text are encoded once.

Both vocabularies split a text before the merges, and no merge crosses a split. So the ids of a text are the ids of its
pieces, if it is cut only where the vocabulary's own pattern is bound to split: before white space that follows
something else, and between a letter and an ASCII character that is neither a letter nor white space. Each Python worker
keeps the ids of the pieces that it has met in a task, up to CACHE of them; equal pieces are found by 64-bit hashes. Texts that hold
the literal of an added token are encoded whole, since the library looks for these before it splits.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from reckoner.llm import hashing
from reckoner.llm.common import flat_text, slices

CACHE = 300_000
#: White space outside ASCII, and controls that only some libraries count as such: texts with these are encoded whole. By first byte, what follows.
_ODD_SPACE = {
    **{b: [b""] for b in range(0x1C, 0x20)},
    0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE3: [b"\x80\x80"],
    0xE2: [*(bytes([0x80, b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"],
}
#: UTF-8 bytes of text that are worked on at once; a longer text stands alone.
SLICE = 1 << 20

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_ascii_other = np.zeros(256, bool)
_ascii_other[:128] = True
_ascii_other &= ~_letter & ~hashing._SPACE

_odd_first = np.zeros(256, bool)
_odd_first[list(_ODD_SPACE)] = True
_odd_rest = {(b, *(x + b"\0\0")[: len(x)]) for b, v in _ODD_SPACE.items() for x in v}

_encoders: dict[tuple[str, str], "Encoder"] = {}


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Tokens that are looked for in the normalised text count in any case.
        self.any_case = any(t.normalized for t in added)
        self.literals = [t.content.encode().lower() if self.any_case else t.content.encode() for t in added]
        self.kind, self.known, self.alphabet = kind, {}, _byte_level()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd_texts(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that are encoded whole: those with an added token's literal or, in a byte-level vocabulary, with odd white space."""
        raw = data.tobytes()
        if self.any_case:
            raw = raw.lower()
        at = []
        for x in self.literals:
            k = raw.find(x)
            while k >= 0:
                at.append(k)
                k = raw.find(x, k + 1)
        if self.kind == "byte":
            for k in np.flatnonzero(_odd_first[data]).tolist():
                if any(tuple(raw[k : k + n]) in _odd_rest for n in (1, 2, 3)):
                    at.append(k)
        return sorted(set((np.searchsorted(offsets, at, side="right") - 1).tolist()))

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letter: np.ndarray) -> None:
        """Encodes new pieces; those that are letters only, with or without a space before, go straight to the merges."""
        others = np.concatenate([[0], np.cumsum(~letter)])
        begin = starts + (data[starts] == 0x20)
        plain = (others[ends] == others[begin]) & (ends > begin)
        model, known = self.tokenizer.model, self.known
        if plain.any():
            first = begin[plain] if self.kind == "word" else starts[plain]
            sizes = ends[plain] - first + 1  # with a line break after each
            total = np.cumsum(sizes)
            index = np.arange(total[-1]) + np.repeat(first - (total - sizes), sizes)
            joined = np.append(data, np.uint8(10))[np.minimum(index, len(data))]
            joined[total - 1] = 10
            text = joined.tobytes()
            if self.kind == "word":
                text = text.decode().lower().encode()
            words = text.decode("latin-1").translate(self.alphabet).split(self.alphabet[10])
            for key, word in zip(keys[plain].tolist(), words, strict=False):
                known[key] = array("I", [x.id for x in model.tokenize(word)]).tobytes()
        hard = np.flatnonzero(~plain)
        raw = data.tobytes() if len(hard) else b""
        for x in range(0, len(hard), 20_000):
            part = hard[x : x + 20_000]
            texts = [raw[s:e].decode() for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            known.update(zip(keys[part].tolist(), self._whole(texts), strict=True))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice in one array, and each text's offset in it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space, letter = hashing._SPACE[data], _letter[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (letter[:-1] & _ascii_other[data[1:]])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = hashing._ranges(data.astype(np.uint64) + np.uint64(1), hashing.BYTE_BASE, starts, ends)
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        keys, known = distinct.tolist(), self.known
        new = [x for x, k in enumerate(keys) if k not in known]
        if new:
            letter[:-1] |= (data[:-1] == 0xC3) & letter[1:]  # the first bytes of two-byte letters too
            self._learn(distinct[new], data, starts[sample[new]], ends[sample[new]], letter)
        found = [known[k] for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, at = np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        counts = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        index = np.arange(total[-1]) + np.repeat(at[inverse] - total[:-1], counts)
        return pool[index], total[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array):
        """Yields (first text, ids of a run of texts in one array, offsets of the run's texts in it); null counts as empty."""
        data, offsets = flat_text(texts)
        for first, last in slices(offsets, SLICE):
            part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            done = 0
            for k in [*self._odd_texts(part, own), last - first]:
                if done < k:
                    yield first + done, *self._slice(part[own[done] : own[k]], own[done : k + 1] - own[done])
                if k < last - first:
                    ids = np.frombuffer(self._whole([part[own[k] : own[k + 1]].tobytes().decode()])[0], "<u4")
                    yield first + k, ids, np.array([0, len(ids)])
                done = k + 1


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder; kind is "byte" (byte-level pattern) or "word" (white space dropped)."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
