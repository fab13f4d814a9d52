"""Chunks of a source: the unit that is read, accounted for and resumed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.sources.scratch import folder


def record_key(df: DataFrame, columns: list[str], sep: str = "|") -> Column:
    """Key columns joined as text; null if any part is null."""
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNotNull()
    return F.when(every, F.concat_ws(sep, *(F.col(c).cast("string") for c in columns)))


@dataclass(frozen=True)
class Ranges:
    """Ranges of one width over the whole parts of a key: Python's numbers, so that no span overflows. A key with a fraction belongs to the range of its whole part."""

    low: int
    high: int
    step: int
    kind: str

    @property
    def chunks(self) -> int:
        return -(-(self.high - self.low + 1) // self.step)

    def table(self, spark: SparkSession) -> DataFrame:
        """chunk, first, last (inclusive): numbered by Spark, however many there are."""
        n = self.chunks
        big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
        chunk = F.col("id").cast("decimal(19,0)")
        first = (big(self.low) + chunk * big(self.step)).cast("decimal(38,0)")
        rest = big(self.high) - first
        out = spark.range(n).withColumn("first", first).withColumn("last", F.when(rest >= big(self.step - 1), first + big(self.step - 1)).otherwise(big(self.high)))
        return out.select(F.col("id").cast("int" if n < 1 << 31 else "long").alias("chunk"), F.col("first").cast(self.kind), F.col("last").cast(self.kind))

    def chunk_of(self, key: Column) -> Column:
        """The range of a key, null outside of all."""
        kind = "int" if self.chunks < 1 << 31 else "long"
        if self.kind == "long" and self.high - self.low < 1 << 63:
            inside = key.between(F.lit(self.low), F.lit(self.high))
            return F.when(inside, F.call_function("div", key.cast("long") - F.lit(self.low), F.lit(self.step)).cast(kind))
        whole = F.floor(key.cast("decimal(38,0)") if self.kind == "long" else key).cast("decimal(38,0)")
        inside = whole.between(F.lit(str(self.low)).cast("decimal(38,0)"), F.lit(str(self.high)).cast("decimal(38,0)"))
        return F.when(inside, F.call_function("div", (whole - F.lit(str(self.low)).cast("decimal(38,0)")).cast("decimal(38,0)"), F.lit(str(self.step)).cast("decimal(38,0)")).cast(kind))


def _planned(df: DataFrame, key: str, step: Callable[[int, int], int], rows: bool = False) -> DataFrame:
    """The table of ranges whose width is step(span, rows); its bounds (and the number of rows, if asked for) are read at once, and `ranges` of the result has them for assign()."""
    n, low, high = df.agg(F.count(key) if rows else F.lit(None), F.floor(F.min(key)), F.floor(F.max(key))).first()
    kind = "decimal(38,0)" if isinstance(df.schema[key].dataType, T.DecimalType) else "long"
    if low is None:
        out = df.sparkSession.createDataFrame([], f"chunk int, first {kind}, last {kind}")
        out.ranges = None
        return out
    low, high = int(low), int(high)
    if high - low >= 10**38:
        raise ValueError(f"the span of {key} has more than 38 digits")
    ranges = Ranges(low, high, step(high - low + 1, n), kind)
    out = ranges.table(df.sparkSession)
    out.ranges = ranges
    return out


def _one(df: DataFrame) -> DataFrame:
    """The plan of a source whose key has no order of numbers: one chunk, if there are rows."""
    return df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).alias("chunk"), *(F.lit(None).cast("long").alias(c) for c in ("first", "last")))


def _whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, (T.IntegralType, T.DecimalType))


def plan_ranges(df: DataFrame, key: str, rows: int, max_chunks: int) -> DataFrame:
    """Ranges of `rows` key values from the least key to the greatest; wider ones where there would be more than max_chunks. A key that isn't a number without a floating point makes one chunk without bounds. An empty source has none."""
    if not _whole(df, key):
        return _one(df)
    return _planned(df, key, lambda span, _: rows if -(-span // rows) <= max_chunks else -(-span // max_chunks))


def plan_by_count(df: DataFrame, key: str, target: int, max_chunks: int) -> DataFrame:
    """Equal slices of the key space, as many as `target` rows each need on average, max_chunks at most; decimal keys of any size too, and one chunk for a key of another kind."""
    if not _whole(df, key):
        return _one(df)
    return _planned(df, key, lambda span, n: -(-span // max(1, min(max_chunks, -(-n // target)))), rows=True)


def plan_even(df: DataFrame, key: str, chunks: int, accuracy: int = 10_000) -> DataFrame:
    """chunk, first, last (inclusive) of about `chunks` ranges that hold equally many rows: bounds come from a sketch of the key's quantiles, off by a share of 1 / accuracy of the rows each. Equal keys stay together, so there may be fewer."""
    if not _whole(df, key):
        return _one(df)
    kind = "decimal(38,0)" if isinstance(df.schema[key].dataType, T.DecimalType) else "long"
    whole = df.select(F.floor(key).cast(kind).alias("k"))
    low, high, cuts = whole.agg(F.min("k"), F.max("k"), F.percentile_approx("k", [x / chunks for x in range(1, chunks)] or [1.0], accuracy)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], f"chunk int, first {kind}, last {kind}")
    ends = sorted({int(c) for c in cuts if int(c) < int(high)} | {int(high)})
    firsts = [int(low), *(e + 1 for e in ends[:-1])]
    rows = df.sparkSession.createDataFrame([(k, str(a), str(b)) for k, (a, b) in enumerate(zip(firsts, ends, strict=True))], "chunk int, first string, last string")
    return rows.select("chunk", F.col("first").cast(kind), F.col("last").cast(kind))


def object_id_number(c: Column) -> Column:
    """A 24-digit hexadecimal id as a number that keeps its order."""
    half = lambda s: F.conv(F.substring(c, s, 12), 16, 10).cast("decimal(38,0)")
    return half(1) * F.lit(1 << 48).cast("decimal(18,0)") + half(13)


def assign(df: DataFrame, key: str, plan: DataFrame) -> DataFrame:
    """df with `_chunk` by a plan of ranges of one width: the number follows from the key, without a join; keys outside the plan have none. A plan that was read from a file says its bounds itself."""
    if not _whole(df, key):
        return df.withColumn("_chunk", F.lit(0))
    if not hasattr(plan, "ranges"):
        low, high, step = plan.agg(F.min("first"), F.max("last"), F.max(F.col("last") - F.col("first") + 1)).first()
        plan.ranges = None if low is None else Ranges(int(low), int(high), int(step), "decimal(38,0)" if isinstance(df.schema[key].dataType, T.DecimalType) else "long")
    return df.withColumn("_chunk", plan.ranges.chunk_of(F.col(key)) if plan.ranges else F.lit(None).cast("int"))


def sequence(df: DataFrame, order: list[str], chunk: str = "_chunk") -> DataFrame:
    """df with `_seq`: the place in the chunk from 1, in a total order."""
    return df.withColumn("_seq", F.row_number().over(W.partitionBy(chunk).orderBy(*order)).cast("long"))


def _steps(low: Column, last: Column, step: int, block: int = 1_000) -> tuple[Column, Callable[[Column], Column]]:
    """low, low + step, ... up to last in two goes, so that no row holds more than a thousandth of it: an array of blocks, and the array of a block that begins at a given place."""
    blocks = F.sequence(low.cast("long"), last.cast("long"), F.lit(step * block).cast("long"))
    return blocks, lambda at: F.sequence(at, F.least(at + step * (block - 1), last.cast("long")), F.lit(step).cast("long"))


def plan_offsets(bounds: DataFrame, rows: int) -> DataFrame:
    """chunk, partition, first, last (exclusive) of a topic's read, frozen from bounds (partition, begin, end): `rows` offsets each, no chunk across partitions, none for an empty partition."""
    blocks, inner = _steps(F.col("begin"), F.col("end") - 1, rows)
    full = bounds.where("end > begin").select("partition", "begin", "end", F.explode(blocks).alias("block"))
    full = full.repartition("partition", "block").select("partition", "begin", "end", F.explode(inner(F.col("block"))).alias("first"))
    per = bounds.where("end > begin").select("partition", F.ceil((F.col("end") - F.col("begin")) / rows).alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(W.orderBy("partition")) - F.col("_n")).drop("_n")  # a row for each partition
    chunk = F.col("_before") + F.expr(f"(first - begin) div {rows}")
    return full.join(F.broadcast(before), "partition").select(chunk.alias("chunk"), "partition", "first", F.least(F.col("first") + rows, F.col("end")).alias("last"))


def cursor_pages(df: DataFrame, order: list[str], budget: int) -> DataFrame:
    """Reads of a source that gives no counts: page N + 1 begins after page N's last key, each takes `budget` rows, and a page that takes fewer, or none, finds the source dry. page, records, cursor (key that the page began after, null for the first), last and dry."""
    rows = numbered(df, order).withColumn("page", F.floor(F.col("_row") / budget))
    key = F.struct(*order)
    found = rows.groupBy("page").agg(F.count("*").alias("records"), F.max(key).alias("last"))
    end = df.agg(F.floor(F.count("*") / budget).alias("page")).withColumns({"records": F.lit(0).cast("long"), "last": F.lit(None).cast(found.schema["last"].dataType)})
    every = found.unionByName(end.join(found.select("page"), "page", "left_anti"))
    before = found.select((F.col("page") + 1).alias("page"), F.col("last").alias("cursor"))
    return every.join(before, "page", "left").withColumn("dry", F.col("records") < budget)


def after(df: DataFrame, key: str, cursor) -> DataFrame:
    """The rows that a resumed read still has to take."""
    return df.where(F.col(key) > F.lit(cursor))


def resume(df: DataFrame, key: str, entries: DataFrame, sep: str = "|") -> DataFrame:
    """The rows that a run still has to take after the last key that its ledger (record_key) accounts for, in order of the key inside each task's range; all rows if it accounts for none. A ledger whose keys are of another kind, as keys of several columns are, can't say where to go on."""
    kind = df.schema[key].dataType
    own = F.col("record_key").try_cast(kind)
    done, odd = entries.agg(F.max(own), F.min(F.when(F.col("record_key").isNotNull() & own.isNull(), F.col("record_key")))).first()
    if odd is not None:
        raise ValueError(f"{odd!r} is a key of several columns" if sep in odd else f"{odd!r} is no key of the kind of {key}")
    rest = df if done is None else after(df, key, done)
    return rest.repartitionByRange(key).sortWithinPartitions(key)


def packed(parts: DataFrame, group: str, rows: str) -> DataFrame:
    """Packs of greedy_pack(): group, pack, parts and planned rows, which are 0 if any count is unknown."""
    known = F.count(rows) == F.count("*")
    return parts.groupBy(group, F.col("_pack").cast("long").alias("pack")).agg(F.count("*").alias("parts"), F.when(known, F.sum(rows)).otherwise(0).cast("long").alias("planned"))


def tasks(df: DataFrame, most: int = 250_000, least: int = 20_000) -> int:
    """Into how many tasks a shuffle of df's rows is cut: `most` rows each at most, whatever they have in compressed bytes, and no fewer than `least` to make more of them than the session's number of shuffle partitions. Counting the rows of a table's files takes their footers alone."""
    n = df.count()
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // most), min(usual, -(-n // least)))


def numbered(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """df with a number from 0 in the given order, over all rows, without one task holding them all: rows are ranged, sorted and written once, a file for each range, and a row's number is its place in its file and the rows of the files before."""
    path = folder(df.sparkSession, "ranges")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    ranged = df.sparkSession.read.schema(df.schema).parquet(path)
    ranged = ranged.select("*", F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("int").alias("_range_file"), F.col("_metadata.row_index").alias("_range_at"))
    counts = ranged.groupBy("_range_file").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(W.orderBy("_range_file")) - F.col("_n")).drop("_n")  # a row for each range
    return ranged.join(F.broadcast(base), "_range_file").withColumn(name, F.col("_range_at") + F.col("_base")).drop("_range_file", "_range_at", "_base")


def offset_windows(df: DataFrame, rows: int) -> DataFrame:
    """chunk, offset, rows of windows that cover df; the last one may be short."""
    n = df.count()
    chunks = -(-n // rows)
    out = df.sparkSession.range(chunks).select(F.col("id").cast("int" if chunks < 1 << 31 else "long").alias("chunk"), (F.col("id") * rows).alias("offset"))
    return out.select("chunk", "offset", F.least(F.lit(rows), F.lit(n) - F.col("offset")).cast("long").alias("rows"))


def greedy_pack(parts: DataFrame, group: str, order: str, rows: str, target: int, max_chunks: int) -> DataFrame:
    """parts with `_pack`: consecutive parts of a group go together until they have `target` rows, which grows so that there are at most max_chunks packs; a count that is null counts as none (see packed())."""
    total = F.sum(F.coalesce(F.col(rows), F.lit(0))).over(W.partitionBy(group))
    aim = F.greatest(F.lit(target), F.ceil(total / max_chunks))
    listed = parts.withColumn("_aim", aim).groupBy(group).agg(F.max("_aim").alias("_aim"), F.sort_array(F.collect_list(F.struct(order, rows))).alias("_parts"))

    def add(acc: Column, x: Column) -> Column:
        full = acc["held"] >= acc["aim"]
        pack = acc["pack"] + F.when(full, 1).otherwise(0)
        held = F.when(full, 0).otherwise(acc["held"]) + F.coalesce(x[rows], F.lit(0))
        entry = F.struct(x[order].alias(order), x[rows].alias(rows), pack.alias("_pack"))
        return F.struct(pack.alias("pack"), held.cast("long").alias("held"), acc["aim"].alias("aim"), F.concat(acc["out"], F.array(entry)).alias("out"))

    kinds = dict(parts.dtypes)
    zero = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("held"), F.col("_aim").cast("long").alias("aim"), F.array().cast(f"array<struct<`{order}`:{kinds[order]},`{rows}`:{kinds[rows]},_pack:int>>").alias("out"))
    return listed.select(group, F.explode(F.aggregate("_parts", zero, add)["out"]).alias("p")).select(group, "p.*")
