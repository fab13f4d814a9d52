"""Removal of repeated passages (operator 4): Rabin-Karp hashes of every window of consecutive words, counted in Spark.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Each word that a window of WINDOW words covers, whose word sequence also
starts anywhere else (same document included), is removed; repeated windows merge into maximal intervals. Windows are
judged on the input.

How it is dealt out. Rows go to blocks of about block_bytes() of text by a hash of doc_id and text. A block hashes its
windows and sends, for each bucket of hashes, one row: its distinct hashes and which of them it holds more than once.
That is the pre-aggregation: a passage that a third of all documents share reaches its bucket once a block. A bucket
answers each block with one bit a hash: counted twice or more over all blocks. The block, with its texts again from the
same shuffle, looks its windows up and merges. Nothing depends on the order of rows, so lost tasks can be repeated.
Hashes have 64 bits: among n windows about n**2 / 2**65 pairs are taken as equal wrongly (2 of 10**10 windows).

Null texts have no words. Null and repeated doc_ids are rows like others. Texts shorter than a window lose nothing. Other
columns stay, whatever their names, unless they clash with the columns that are added: `_block`, and the results
n_words, n_removed, removed and kept, which replace columns of these names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import hashing
from reckoner.llm.common import flat_text, slices, table, text_bytes

WINDOW = 35
#: Text of a block, at least and at most, and the input from which on blocks grow with its square root.
BLOCK_BYTES, LARGEST_BLOCK, GROWS_FROM = 4 << 20, 64 << 20, 64 << 30
#: Buckets of hashes, at least, where there are as many blocks.
FEW = 64
RESULTS = "n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


def _windows(texts: pa.Array, width: int):
    """Yields (first text, word counts by text, hashes of windows, index of each window's first word) for runs of texts."""
    data, offsets = flat_text(texts)
    for first, last in slices(offsets):
        words, start = hashing.word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, start, *hashing.window_hashes(words, start, width)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The high 32 bits scaled to the number of buckets: sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted hashes fall into, and where each begins among the hashes (one more)."""
    own = _bucket(hashes, buckets)
    at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[at], np.append(at, len(own))


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are among the wanted (sorted): the work grows with the hashes, not with what is wanted."""
    at = np.searchsorted(wanted, hashes)
    return np.append(wanted, np.uint64(0))[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)


def _bits(column: pa.Array, n: int, k: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(column[k].as_py(), np.uint8), count=n).astype(bool)


def repeated_windows(blocked: DataFrame, width: int, buckets: int) -> DataFrame:
    """For each block and bucket: a bit for each of the block's distinct hashes there, in ascending order, set if the window occurs more than once."""

    def emit(t: pa.Table) -> pa.Table:
        found = [h for _, _, h, _ in _windows(t.column("text"), width)]
        hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        full, at = _runs(hashes, buckets)
        block = t.column("_block")[0].as_py()
        return pa.table({
            "_block": pa.array([block] * len(full), pa.int64()),
            "_bucket": pa.array(full, pa.int64()),
            "hashes": pa.array([hashes[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            "many": pa.array([np.packbits(counts[s:e] > 1).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        })

    def count(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        many = [_bits(t.column("many"), len(h), k) for k, h in enumerate(own)]
        every = np.sort(np.concatenate(own))
        twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(h[m] for h, m in zip(own, many, strict=True))]))
        flags = [np.packbits(_among(h, twice)).tobytes() for h in own]
        return pa.table({"_block": t.column("_block"), "_bucket": t.column("_bucket"), "flags": pa.array(flags, pa.binary())})

    sent = blocked.groupBy("_block").applyInArrow(emit, "_block long, _bucket long, hashes binary, many binary")
    return sent.groupBy("_bucket").applyInArrow(count, "_block long, _bucket long, flags binary")


def block_bytes(total: int) -> int:
    """Text of a block for so much text in all: rows that blocks and buckets exchange would else grow with the square of the input."""
    return int(min(max(BLOCK_BYTES * math.sqrt(total / GROWS_FROM), BLOCK_BYTES), max(BLOCK_BYTES, LARGEST_BLOCK)))


def buckets_for(blocks: int) -> int:
    """Buckets for so many blocks: as many as blocks up to FEW, an eighth of them for large inputs, so that rows between blocks and buckets stay large. A bucket gets about 48 MB of hashes at most."""
    return min(blocks, max(FEW, -(-blocks // 8)))


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, removed (intervals of word numbers, last exclusive) and kept (the words that stay, joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "removed", "kept", "_block")
    total = text_bytes(docs)
    blocks = max(1, -(-total // block_bytes(total)))
    names = docs.columns
    blocked = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    buckets = buckets_for(blocks)
    flags = repeated_windows(blocked, width, buckets)

    def merge(t: pa.Table, f: pa.Table) -> pa.Table:
        flag = {b: x.as_py() for b, x in zip(f.column("_bucket").to_pylist(), f.column("flags"), strict=True)}
        runs = list(_windows(t.column("text"), width))
        hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in runs)]))
        full, at = _runs(hashes, buckets)
        twice = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(flag[b], np.uint8), count=n).astype(bool) for b, n in zip(full.tolist(), np.diff(at).tolist(), strict=True))])
        out = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        texts = t.column("text")
        for first, start, own, begin in runs:
            step = np.zeros(int(start[-1]) + 1, np.int64)
            hit = begin[twice[np.searchsorted(hashes, own)]] if len(own) else begin
            np.add.at(step, hit, 1)
            np.add.at(step, hit + width, -1)
            gone = np.cumsum(step[:-1]) > 0
            for k in range(len(start) - 1):
                words = (texts[first + k].as_py() or "").encode().split()
                g = gone[start[k] : start[k + 1]]
                out["n_words"].append(len(words))
                out["n_removed"].append(int(g.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                out["removed"].append([{"first": int(a), "last": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                if len(edge):
                    words = [w for w, x in zip(words, g.tolist(), strict=True) if not x]
                out["kept"].append(b" ".join(words).decode())
        made = pa.table({"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "removed": pa.array(out["removed"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), "kept": pa.array(out["kept"], pa.string())})
        for k, name in enumerate(names):
            made = made.add_column(k, name, t.column(name))
        return made

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return blocked.groupBy("_block").cogroup(flags.groupBy("_block")).applyInArrow(merge, f"{kinds}, {RESULTS}")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
