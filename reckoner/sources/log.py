"""A source that is read by cursor: a topic whose partitions have offsets, for batches and for streams.

What is behind the topic is a client: a class with `bounds()` (for each partition the first offset and the one after the
last), `schema()` and `read(partition, first, last)` (Arrow batches). ParquetTopic takes the Parquet files of a folder as
the partitions, in the order of their names, and the place of a row in its file as its offset.

A read is planned once: the ranges of offsets that it will take are frozen, cut into pieces of `rowsPerPartition` (wider
ones where there would be more than MOST_PIECES, since each is a task of its own that opens its partition), and a
task that is run again takes the same rows; it passes them on in batches, however many they are. A stream takes `rowsPerBatch` rows at most from all partitions together in a
micro-batch; its offsets are the cursors in its checkpoint, so a restart goes on where the last committed batch ended. A
batch that is planned before the position is known (the first after a restart may be) has no budget: it takes what there is,
in pieces of the same size. A run that ends with what is there (availableNow) asks once how far to go, and so should have no
budget either.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

NAME = "reckoner_log"
#: Pieces of a read, about.
MOST_PIECES = 256
#: Columns that say where a row comes from.
PLACE = [StructField("_partition", StringType()), StructField("_offset", LongType())]


class ParquetTopic:
    """The Parquet files of a folder (or one file) as a topic."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _files(self) -> tuple[pafs.FileSystem, dict[str, str]]:
        system, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = system.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"there is no topic at {self.path}")
        if info.type == pafs.FileType.File:
            return system, {info.base_name: info.path}
        return system, {f.base_name: f.path for f in sorted(system.get_file_info(pafs.FileSelector(at)), key=lambda f: f.base_name) if f.base_name.endswith(".parquet")}

    def bounds(self) -> dict[str, tuple[int, int]]:
        system, files = self._files()
        return {name: (0, pq.read_metadata(path, filesystem=system).num_rows) for name, path in files.items()}

    def schema(self) -> StructType:
        system, files = self._files()
        if not files:
            raise ValueError(f"the topic at {self.path} has no partition")
        return from_arrow_schema(pq.read_schema(next(iter(files.values())), filesystem=system))

    def read(self, partition: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        system, files = self._files()
        with system.open_input_file(files[partition]) as file:
            parquet, at = pq.ParquetFile(file), 0
            for k in range(parquet.num_row_groups):
                end = at + parquet.metadata.row_group(k).num_rows
                if at < last and end > first:  # other groups aren't read
                    place = at
                    for b in parquet.iter_batches(10_000, row_groups=[k]):
                        if place >= last:
                            return
                        low, high = max(first - place, 0), min(last - place, b.num_rows)
                        if low < high:
                            yield b.slice(low, high - low)
                        place += b.num_rows
                at = end


def _client(options: dict[str, str]):
    module, _, name = options.get("client", f"{__name__}:ParquetTopic").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Piece(InputPartition):
    """A frozen range of offsets of one partition."""

    def __init__(self, partition: str, first: int, last: int):
        self.partition, self.first, self.last = partition, first, last


def pieces(start: dict[str, int], end: dict[str, int], rows: int) -> list[Piece]:
    """The ranges from start to end in pieces of `rows`, or of as many as keep their number near MOST_PIECES; a partition that start doesn't name is new, and taken from 0."""
    out = []
    rows = max(rows, -(-sum(max(0, end[p] - start.get(p, 0)) for p in end) // MOST_PIECES))
    for p in sorted(end):
        at = start.get(p, 0)
        while at < end[p]:
            out.append(Piece(p, at, min(at + rows, end[p])))
            at = out[-1].last
    return out


def positions(bounds: dict[str, tuple[int, int]], asked: str, partial: str) -> dict[str, int]:
    """Offsets of all partitions for EARLIEST, LATEST, or JSON of offsets by partition; those that JSON doesn't name are as `partial` says. An offset out of bounds is moved to the nearest that exists, one of an unknown partition is an error."""
    word = asked.strip().upper()
    if word in ("EARLIEST", "LATEST"):
        return {p: b[word == "LATEST"] for p, b in bounds.items()}
    named = json.loads(asked)
    if unknown := sorted(set(named) - set(bounds)):
        raise ValueError(f"the topic has no partition {', '.join(unknown)}")
    return {p: min(max(int(named[p]), b[0]), b[1]) if p in named else b[partial == "LATEST"] for p, b in bounds.items()}


class _Rows:
    """What both readers do with a piece."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.rows = int(options.get("rowspartition", 100_000))

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # a read without any piece
            return
        arrow, at = to_arrow_schema(self.schema), piece.first
        for b in _client(self.options).read(piece.partition, piece.first, piece.last):
            own = pa.Table.from_batches([b]).select([f.name for f in self.schema.fields[: -len(PLACE)]]).cast(pa.schema(list(arrow)[: -len(PLACE)])).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.repeat(piece.partition, b.num_rows), pa.array(np.arange(at, at + b.num_rows))], schema=arrow)
            at += b.num_rows
        if at != piece.last:
            raise ValueError(f"partition {piece.partition} has no rows from {at} to {piece.last} any more")


class LogReader(_Rows, DataSourceReader):
    def partitions(self) -> list[Piece]:
        bounds = _client(self.options).bounds()
        start = positions(bounds, self.options.get("startingoffsets", "EARLIEST"), "EARLIEST")
        return pieces(start, positions(bounds, self.options.get("endingoffsets", "LATEST"), "LATEST"), self.rows)


class LogStreamReader(_Rows, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.budget = int(options.get("rowsperbatch", 0))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        self.at = positions(_client(self.options).bounds(), self.options.get("startingoffsets", "EARLIEST"), "EARLIEST")
        return dict(self.at)

    def latestOffset(self) -> dict[str, int]:
        end = {p: last for p, (_, last) in _client(self.options).bounds().items()}
        if not self.budget or self.at is None:
            return end
        left, out = self.budget, dict(self.at)
        waiting = sorted((end[p] - self.at.get(p, 0), p) for p in end)  # those with the least to give first, so that the rest share what they leave
        for k, (n, p) in enumerate(waiting):
            take = min(n, -(-left // (len(waiting) - k)))
            out[p], left = self.at.get(p, 0) + take, left - take
        return out

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        self.at = dict(end)
        return pieces(start, end, self.rows)

    def commit(self, end: dict[str, int]) -> None:
        self.at = dict(end)


class LogSource(DataSource):
    """Options: path (or client, `module:class`, and what it needs), startingOffsets, endingOffsets (batches), rowsPerBatch (streams), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _plain(self) -> dict[str, str]:
        return {k.lower().replace("rowsperpartition", "rowspartition"): v for k, v in self.options.items()}

    def schema(self) -> StructType:
        return StructType([*_client(self._plain()).schema().fields, *PLACE])

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self._plain())

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(schema, self._plain())


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A topic as it is now: its columns, `_partition` and `_offset`."""
    spark.dataSource.register(LogSource)
    return spark.read.format(NAME).options(path=path, **options).load()


def follow_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A topic as a stream."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(NAME).options(path=path, **options).load()
