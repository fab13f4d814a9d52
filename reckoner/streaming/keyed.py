"""A keyed table that micro-batches are written to: the last entry of each key, in buckets, as a base and a few deltas.

Each batch becomes a delta: the last entry of each of its keys, in the bucket of the key's hash. A manifest says which base
and which deltas make up the table; it is written beside and renamed into place under the next number, so readers see the
table before a batch or after it, and of two writers one fails. A batch that comes again, after a failure, changes nothing.
After MOST_DELTAS deltas the table is written anew as a base. So a read touches the base and a few deltas however long the
history is, and a read of some keys only their buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

MOST_DELTAS, BUCKETS = 8, 16
#: Manifests that stay, for readers that began before the last commits.
KEPT = 3


class KeyedTable:
    """folder: where the table is; key: its column; order: the column by which the last entry of a key counts (of equal ones that of the later batch)."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", order: str = "occurred_at", buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.folder, self.key, self.order, self.most_deltas = spark, folder.rstrip("/"), key, order, most_deltas
        self.buckets = self.manifest().get("buckets", buckets)  # a table keeps those that it was made with

    # Files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, system = self._path(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _remove(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def manifest(self) -> dict:
        """The table as it is: version, batch (the last one that it holds), base, deltas, schema."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "batch": -1, "base": None, "deltas": []}
        path, system = self._path(f"manifests/{names[-1]}")
        stream = system.open(path)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, now: dict, **changes) -> dict:
        after = now | {"buckets": self.buckets} | changes | {"version": now["version"] + 1}
        held, system = self._path(f"manifests/.{uuid.uuid4().hex}")
        target, _ = self._path(f"manifests/{after['version']:012d}.json")
        stream = system.create(held, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        if system.exists(target) or not system.rename(held, target):
            system.delete(held, False)
            raise RuntimeError(f"{self.folder} has been written to by another")
        for name in [n for n in self._names("manifests") if n.endswith(".json")][:-KEPT]:
            self._remove(f"manifests/{name}")
        return after

    # Rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame, *more: str) -> DataFrame:
        names = [c for c in rows.columns if c not in more]
        # an aggregate and no window: the entries of a key that has very many meet as one row of each task
        return rows.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(F.struct(*names), F.struct(self.order, *more)).alias("_e")).select("_e.*")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{name}")

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """Takes a batch; false if the table holds it already. Rows without a key are an error: they go to dead letters before."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return False
        known = StructType.fromJson(now["schema"]) if now.get("schema") else None
        if known and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in batch.schema]:
            raise ValueError(f"the table has {known.simpleString()}, the batch {batch.schema.simpleString()}")
        checked = batch.withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error(F.lit("an entry has no key"))).otherwise(F.col(self.key)))
        name = f"delta-{batch_id:012d}-{uuid.uuid4().hex}"  # what a failed attempt has left is never looked at
        self._write(self._last(checked), name)
        after = self._commit(now, batch=batch_id, deltas=[*now["deltas"], name], schema=json.loads(batch.schema.json()))
        if len(after["deltas"]) > self.most_deltas:
            self.compact()
        return True

    def _rows(self, now: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        out = None
        for k, name in enumerate([*([now["base"]] if now["base"] else []), *now["deltas"]]):
            own = self.spark.read.schema(StructType([*schema.fields]).add("_bucket", IntegerType())).parquet(f"{self.folder}/{name}")
            own = (own.where(F.col("_bucket").isin(only)) if only is not None else own).drop("_bucket").withColumn("_age", F.lit(k))
            out = own if out is None else out.unionByName(own)
        return self._last(out, "_age") if now["deltas"] else out.drop("_age")

    def read(self, keys: list | None = None) -> DataFrame:
        """The last entry of each key, or of some keys only. A table that has no batch yet can't be read."""
        now = self.manifest()
        if not now.get("schema"):
            raise ValueError(f"{self.folder} has no batch yet")
        if keys is None:
            return self._rows(now)
        kind = StructType.fromJson(now["schema"])[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        only = sorted({r[0] for r in asked.select(self._bucket()).collect()})
        return self._rows(now, only).where(F.col(self.key).isin(keys))

    def compact(self) -> None:
        """Writes the table as one base. Folders that no kept manifest names are deleted."""
        now = self.manifest()
        if not now["deltas"]:
            return
        name = f"base-{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        self._write(self._rows(now), name)
        self._commit(now, base=name, deltas=[])
        wanted = set()
        for m in [n for n in self._names("manifests") if n.endswith(".json")]:
            path, system = self._path(f"manifests/{m}")
            stream = system.open(path)
            held = json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
            stream.close()
            wanted |= {held["base"], *held["deltas"]}
        for n in self._names(""):
            if n.startswith(("base-", "delta-")) and n not in wanted:
                self._remove(n)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """A stream without entries of a key that has been seen within the delay of its time, ahead of an upsert; what comes later than the delay goes on, since the upsert takes the last entry of a key anyway."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_upserts(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], table: KeyedTable, dead: str, checkpoint: str, once: bool = True):
    """Each micro-batch of messages goes through parse, which gives entries, and `raw`, the message; those without a key go to `dead`, by batch, the others to the table. A batch that comes again overwrites its dead letters and leaves the table as it is."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made = parse(batch).persist()
        try:
            broken = made.where(F.col(table.key).isNull()).select("raw", F.lit(batch_id).cast("long").alias("batch_id"))
            broken.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(dead)
            table.write(made.where(F.col(table.key).isNotNull()).drop("raw"), batch_id)
        finally:
            made.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="10 seconds")).start()
