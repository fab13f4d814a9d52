"""Tables, shared scratch folders and Arrow helpers that the corpus operators use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset, below the machine's temp folder if driver and executors are one process (local tests); on a cluster that would lose rows, so it is an error there.

    What is not deleted before lies below the application's own folder, which can be removed when the application has ended.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "reckoner-shared")
    return f"{top.rstrip('/')}/reckoner/{spark.conf.get('spark.app.id', 'application')}/{name}-{uuid.uuid4().hex}"


#: Rows of a batch that goes to Python, at most.
BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python in batches of BATCH at most: a batch of texts is held several times over, outside of the heap by the executor and by its Python workers, and all of a pipeline's stages run in the same ones. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: later stages start from files, not from lineage."""
    path = scratch(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of saved() tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the number of blocks and buckets."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, with each text's offsets (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string()) if not pa.types.is_null(column.type) else pa.array([""] * len(column), pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Runs (first, last) of texts of about `most` bytes; a longer text stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def running(values: Column, step: Callable[[Column, Column], Column] | None = None, block: int = 128) -> Column:
    """Running sums of an array of integers, or what step makes of the result so far (null before the first) and a value; blocks keep the copying of partial results small in long arrays."""
    step = step or (lambda so_far, v: F.coalesce(so_far, F.lit(0).cast("long")) + v)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / block).cast("int"), F.lit(0))), lambda k: F.slice(values, k * block + 1, F.lit(block)))

    def fold(x: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(x, F.array().cast("array<long>"), lambda acc, v: F.concat(acc, F.array(step(F.try_element_at(acc, F.lit(-1)), value(v)))))

    inner = F.transform(blocks, lambda b: fold(b, lambda v: v.cast("long")))
    before = F.concat(F.array(F.lit(None).cast("long")), fold(inner, lambda b: F.try_element_at(b, F.lit(-1))))
    return F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda b, o: F.transform(b, lambda y: step(o, y))))
