"""Packing of token sequences (operator 8): the linear grouping scheme, then best fit.

Lengths are at most CAPACITY, so a count for each length (CAPACITY rows at most, whatever the input) is all that the
driver needs to plan:

1. Large pieces, ordered by length, fall into GROUPS groups of equal size; each length is rounded up to its group's
   longest. A linear program over configurations of these few sizes, solved by column generation with an integer knapsack,
   says how often to use each configuration; the whole part of that is used.
2. Spark substitutes actual pieces: a piece's rank among the large ones says its group, configuration and sequence.
3. What is left in each sequence is counted by actual lengths. Pieces without a sequence, the longest first, go by best
   fit to the sequences with the least sufficient room; new sequences open when none has room. This too is planned on
   counts and carried out by ranks.

Ranks come from running numbers inside (length, salt) and sums over salts, and the salt from a row's place in the written
table of pieces; so a length that a third of all pieces share is dealt out, and so are rows that are the same. Null texts count as empty; every document ends with END_ID, so an empty one is a piece of length 1. Documents
longer than CAPACITY are cut into pieces of CAPACITY tokens and a rest. Null and repeated doc_ids are rows like others. An
empty table packs into no sequence. Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.llm.bpe import encoder
from reckoner.llm.common import saved, table

CAPACITY, END_ID = 2048, 0
#: Pieces longer than this share of the capacity are large.
LARGE = 0.2
GROUPS = 96
#: Pieces for each salt of a length.
SALTED = 200_000
ROUNDS = 600
KEYS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, path: str, kind: str = "word", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs (doc_id, text)."""

    def run(batches):
        enc = encoder(path, kind)
        for b in batches:
            for first, ids, offsets in enc.encode(b.column("text")):
                n = len(offsets) - 1
                raw = np.insert(ids, offsets[1:], end_id).astype("<u4").tobytes()
                at = offsets + np.arange(n + 1)
                size = np.diff(at)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], KEYS)
        enc.known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(df: DataFrame, key: str, by: list[str | Column], rows: int, name: str) -> DataFrame:
    """df with name: the running number from 0 of each row among those of equal key. Rows are dealt out by their place, if they have one, else by a hash of what orders them."""
    place = F.col("_place") if "_place" in df.columns else F.xxhash64(*by)
    df = df.withColumn("_salt", F.pmod(place, F.lit(max(16, -(-rows // SALTED)))))
    before = df.groupBy(key, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(key, "_salt").orderBy(*by)) - 1
    return df.withColumn("_own", own).join(before, [key, "_salt"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(times, {index of size: copies}) of a basic solution of the configuration program, times rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)  # columns are configurations
    need, at = np.array(demand, float), np.arange(capacity + 1)
    use = np.linalg.solve(basis, need)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = [x for x in range(k) if worth[x] > 1e-12]
        s, w = np.array([sizes[x] for x in order]), worth[order]
        for c in range(int(s.min()) if len(s) else capacity + 1, capacity + 1):
            value = np.where(s <= c, best[np.maximum(c - s, 0)] + w, -1.0)
            x = int(value.argmax())
            best[c], chosen[c] = (value[x], x) if value[x] > best[c - 1] + 1e-15 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), int(at[-1])
        while c > 0:
            if chosen[c] < 0:
                c -= 1
            else:
                column[order[chosen[c]]] += 1
                c -= int(s[chosen[c]])
        step = np.linalg.solve(basis, column)
        grows = step > 1e-9
        if not grows.any():
            break
        leaves = int(np.where(grows, use / np.where(grows, step, 1), np.inf).argmin())
        basis[:, leaves] = column
        use = np.maximum(np.linalg.solve(basis, need), 0)
    return [(int(use[x] + 1e-6), {int(j): int(basis[j, x]) for j in np.flatnonzero(basis[:, x])}) for x in range(k) if use[x] >= 1 - 1e-6]


def plan_large(counts: dict[int, int], capacity: int, large: float = LARGE, groups: int = GROUPS) -> tuple[dict[int, int], list[tuple[int, int, int]], int]:
    """From counts of lengths: the first rank of each large length (longest first), runs (first rank, last rank, first sequence) and the number of sequences."""
    lengths = sorted((x for x in counts if x > large * capacity), reverse=True)
    first, rank = {}, 0
    for x in lengths:
        first[x], rank = rank, rank + counts[x]
    if not rank:
        return first, [], 0
    edges = sorted({rank * g // groups for g in range(groups + 1)})
    starts = np.array([first[x] for x in lengths])
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    longest = [lengths[int(np.searchsorted(starts, a, side="right")) - 1] for a, _ in spans]
    merged: dict[int, list[int]] = {}  # neighbouring groups of one size are one size to the program
    for (a, b), size in zip(spans, longest, strict=True):
        merged.setdefault(size, [a, b])[1] = b
    sizes = list(merged)
    free = {s: list(merged[s]) for s in sizes}
    runs, sequences = [], 0
    for times, copies in sorted(configurations(sizes, [merged[s][1] - merged[s][0] for s in sizes], capacity), key=lambda x: sorted(x[1].items())):
        if times <= 0 or any(free[sizes[g]][1] - free[sizes[g]][0] < n * times for g, n in copies.items()):
            continue
        for g, n in copies.items():
            for _ in range(n):
                a = free[sizes[g]][0]
                runs.append((a, a + times, sequences))
                free[sizes[g]][0] = a + times
        sequences += times
    return first, sorted(runs), sequences


def plan_best_fit(rooms: dict[int, int], counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length, runs (first rank, last rank, room, first number of a sequence among those with that room); room -1: a new one. And how many new ones."""
    classes: dict[int, list[tuple[int, int, int]]] = {}  # room left: (room at first, first number, sequences)
    order: list[int] = []

    def put(left: int, entry: tuple[int, int, int]) -> None:
        if left > 0 and entry[2] > 0:
            if left not in classes:
                classes[left] = []
                order.insert(int(np.searchsorted(order, left)), left)
            classes[left].append(entry)

    for room, n in sorted(rooms.items()):
        put(room, (room, 0, n))
    new, out = 0, {}
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            x = int(np.searchsorted(order, length))
            if x == len(order):
                n = min(left, max(1, left // (capacity // length)))
                put(capacity, (-1, new, n))
                new += n
                continue
            room = order[x]
            at_first, number, n = classes[room].pop()
            if not classes[room]:
                del classes[room], order[x]
            take = min(left, n)
            put(room, (at_first, number + take, n - take))
            put(room - length, (at_first, number, take))
            runs.append((rank, rank + take, at_first, number))
            rank, left = rank + take, left - take
        out[length] = runs
    return out, new


def _runs_of(rows: DataFrame, key: Column, runs: list[tuple], fields: list[str]) -> DataFrame:
    """rows with the fields of the run that holds key's value (null where none does): field + (key - first rank) for `+field`."""
    first, last = [np.array([r[k] for r in runs], np.int64) for k in (0, 1)]
    given = [np.array([r[2 + k] for r in runs], np.int64) for k in range(len(fields))]
    names = rows.columns

    def run(batches):
        for b in batches:
            at = b.column("_key").to_numpy(zero_copy_only=False)
            x = np.searchsorted(first, at, side="right") - 1
            inside = (x >= 0) & (at < last[x]) if len(first) else np.zeros(len(at), bool)
            made = []
            for f, v in zip(fields, given, strict=True):
                value = (v[x] + (at - first[x] if f[0] == "+" else 0)) if len(first) else at
                made.append(pa.array(value.astype(np.int64), pa.int64(), mask=~inside))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, *(f.lstrip("+") for f in fields)])

    kinds = ", ".join([*(f"`{k}` {v}" for k, v in rows.dtypes), *(f"{f.lstrip('+')} long" for f in fields)])
    return rows.withColumn("_key", key.cast("long")).mapInArrow(run, kinds)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (KEYS, and `_place`: a number of each row's own) with sequence_id and offset. rows is read several times: pass a written table."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    tie = ["doc_id", "piece", "ids_crc32"]
    by = [*tie, "_place"]
    if "_place" not in rows.columns:
        rows = rows.withColumn("_place", F.xxhash64(*tie))
    first, runs, sequences = plan_large(counts, capacity)
    starts = F.create_map(*(F.lit(x) for pair in first.items() for x in pair)) if first else F.create_map()
    large = F.col("length") > LARGE * capacity
    place = _runs_of(ranked(rows.where(large), "length", by, total, "_rank"), F.col("_rank") + F.element_at(starts, F.col("length")) if first else F.lit(0), runs, ["+sequence_id"]).drop("_rank")
    placed = saved(place, "placed")
    used = saved(placed.where("sequence_id is not null").groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")), "rooms")
    rooms = {r["room"]: r["n"] for r in used.groupBy("room").agg(F.count("*").alias("n")).collect()}
    rest = rows.where(~large).unionByName(placed.where("sequence_id is null").drop("sequence_id"))
    fit, new = plan_best_fit(rooms, {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    width = total + 1  # keys of one length lie between those of the next
    flat = sorted((length * width + a, length * width + b, room, number) for length, r in fit.items() for a, b, room, number in r)
    filled = _runs_of(ranked(rest, "length", by, total, "_rank"), F.col("length") * width + F.col("_rank"), flat, ["room", "+number"]).drop("_rank")
    numbered = ranked(used, "room", ["sequence_id"], sequences, "number")
    small = filled.where("room >= 0").join(numbered, ["room", "number"]).select(*KEYS, "sequence_id")
    opened = filled.where("room < 0").select(*KEYS, (F.col("number") + sequences).alias("sequence_id"))
    every = placed.where("sequence_id is not null").select(*KEYS, "sequence_id").unionByName(small).unionByName(opened)
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), *tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return every.withColumn("offset", F.sum("length").over(before) - F.col("length"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces of docs."""
    return pack(saved(pieces(docs, path).withColumn("_place", F.monotonically_increasing_id()), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with word_bpe_49k in sequences of 2,048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
