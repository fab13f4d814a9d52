"""Token ids as Parquet list columns (operator 10).

write_tokens() encodes texts and writes one row per document, in ascending doc_id order over all files:
doc_id (delta encoded), n_tokens (delta encoded), tokens (a list of 32-bit ids, dictionary encoded while the dictionary of
a row group fits its page, else delta encoded). Row groups and pages have fixed sizes and the files carry column and
offset indexes, so that a reader takes single columns, row groups or pages: metadata without tokens, or some documents'
tokens without the others'.

Null texts count as empty; each document ends with END_ID, so that an empty one has that one id. Null doc_ids come first.
Rows with equal doc_ids all stay, ordered by a hash of their text. An empty table gives files without rows. Other columns
than doc_id and text are left out unless named in `keep`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.llm.bpe import encoder
from reckoner.llm.common import scratch, table, text_bytes

END_ID = 2
SCHEMA = "doc_id long, n_tokens long, tokens array<int>"
#: Parquet's settings: format version 2 (delta encoding), row groups of 32 MB, pages of 256 KB or 5,000 rows, so that indexes are fine enough to skip by; no dictionary for columns that only grow.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: UTF-8 bytes of text for each file.
FILE_BYTES = 24 << 20


def encode(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and tokens of each row of docs (doc_id, text)."""

    def run(batches):
        enc = encoder(path, kind)
        for b in batches:
            doc_id = b.column("doc_id")
            for first, ids, offsets in enc.encode(b.column("text")):
                n = len(offsets) - 1
                closed = np.insert(ids.astype(np.int32), offsets[1:], end_id)
                at = (offsets + np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(closed))
                yield pa.RecordBatch.from_arrays([doc_id.slice(first, n), pa.array(np.diff(at).astype(np.int64)), lists], ["doc_id", "n_tokens", "tokens"])
        enc.known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = END_ID) -> None:
    """Writes the token files; the texts are ranged by doc_id before they are encoded, so only texts are shuffled. Rows of one doc_id are ranged by their texts, and rows that are the same at random, so that no task has to take all of them."""
    files = max(1, -(-text_bytes(docs) // FILE_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").withColumn("_any", F.rand(1)).repartitionByRange(files, *order, "_any").sortWithinPartitions(*order)
    encode(ordered, tokenizer, kind, end_id).write.options(**LAYOUT).parquet(folder)


def part_number(file: Column) -> Column:
    """The place of a file among those of one write, from its name; names themselves don't sort in that order from 100,000 files on."""
    return F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")


def _read(spark: SparkSession, folder: str) -> DataFrame:
    place = (part_number(F.col("_metadata.file_name")).alias("part"), F.col("_metadata.row_index").alias("row"))
    return spark.read.schema(SCHEMA).parquet(folder).select("*", *place)


def _base(rows: DataFrame) -> DataFrame:
    """part and base (ids of all files before): a row for each file, added up in thousands of files, and then over the thousands."""
    before = lambda w: F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("thousand", F.floor(F.col("part") / 1000))
    thousands = files.groupBy("thousand").agg(F.sum("n").alias("n")).withColumn("over", before(W.orderBy("thousand"))).drop("n")
    files = files.withColumn("inside", before(W.partitionBy("thousand").orderBy("part"))).join(thousands, "thousand")
    return files.select("part", (F.col("inside") + F.col("over")).alias("base"))


def with_start(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows (part, row, n_tokens) with start: the ids of all rows before."""
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = rows.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return own.join(base, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the row's place (number of its file, row in it), read without any token page."""
    rows = _read(spark, folder).select("doc_id", "n_tokens", "part", "row")
    return with_start(rows, _base(rows)).select("doc_id", "start", "n_tokens", "part", "row")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, tokens; filters on doc_id skip row groups and pages by their indexes."""
    return spark.read.schema(SCHEMA).parquet(folder)


def checksums(rows: DataFrame) -> DataFrame:
    """ids_crc32 (unsigned crc32 of a row's ids as little-endian unsigned 32-bit integers) instead of tokens; other columns stay."""
    names = [c for c in rows.columns if c != "tokens"]
    kinds = [f"`{k}` {t}" for k, t in rows.dtypes if k != "tokens"]

    def run(batches):
        for b in batches:
            lists = b.column("tokens")
            offsets, raw = np.asarray(lists.offsets), memoryview(np.ascontiguousarray(lists.values).view(np.uint8))  # little-endian in Arrow as in the result
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return rows.mapInArrow(run, ", ".join([*kinds, "ids_crc32 long"]))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with byte_bpe_50k, written and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    rows = _read(spark, folder)
    return with_start(checksums(rows), _base(rows)).select("doc_id", "start", "n_tokens", "ids_crc32")
