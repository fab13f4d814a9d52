"""Payloads of records that failed: kept once each, found by the record's place, and sent again from there.

A run writes two tables below one folder. `letters` has a dead letter for each record that failed (`_chunk`, `_seq`,
`_ordinal`), with the hash of what was to be delivered and the hash of what had been read, where a transform made a
difference. `payloads` has each content once, under its hash (32 bytes, which no codec makes smaller, so that they are
neither staged nor dealt out where the content is), with what it was: `sent`, to be delivered, or `read`. Both are partitioned by run_id: a repeated run overwrites its
own partitions, and a run that expires takes its payloads along.

A replay reads these tables alone. The source is not asked again, and records are told apart by their places and not by
their keys, so that equal keys, null keys and siblings make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions import paths
from reckoner.operators import ledger

PLACE = ["_chunk", "_seq", "_ordinal"]


def as_json(df: DataFrame, columns: list[str]) -> Column:
    """A record's fields as JSON text."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), paths.EXACT)


def from_json(payload: Column, schema: T.StructType) -> Column:
    return F.from_json(payload, schema, paths.EXACT)


def with_source(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df as it is read, with `_source`: the record as JSON, which later steps pass along with the envelope."""
    return df.withColumn("_source", as_json(df, columns or [c for c in df.columns if not c.startswith("_")]))


def letters(df: DataFrame, key: Column, occurred: Column, redact: dict[str, str] | None = None, most_bytes: int = 0, days: int = 365, node: Column | None = None) -> DataFrame:
    """Dead letters of df (places, outcome, error_code, error_message, `_source`): run-independent columns, record and source as JSON text, source null where it is the same.

    Payloads are cut to a marker over most_bytes (0: never), then masked at JSON pointers, before anything is written.
    """
    fields = [c for c in df.columns if not c.startswith("_") and c not in ("outcome", "error_code", "error_message")]
    ordinal = F.col("_ordinal") if "_ordinal" in df.columns else F.lit(0)
    record, source = as_json(df, fields), F.col("_source")
    failed = df.where(F.col("outcome").isin(*ledger.FAILURES)).select(
        "_chunk", "_seq", ordinal.cast("int").alias("_ordinal"), key.alias("record_key"), (node if node is not None else F.lit(None).cast("string")).alias("node_id"), F.col("error_code").alias("code"), F.col("error_message").alias("message"),
        ledger.signature(F.col("error_code"), F.col("error_message")).alias("signature"), occurred.alias("occurred_at"), (occurred + F.make_interval(days=F.lit(days))).alias("expires_at"),
        record.alias("record"), F.when(source != record, source).alias("source"),
    )
    for c in ("record", "source"):
        failed = failed.withColumn(c, paths.ceiling(F.col(c), F.col("record_key"), most_bytes))
        failed = paths.redact(failed, {f"/{c}/{pointer.strip('/')}": mode for pointer, mode in (redact or {}).items()})
    return failed


def store(df: DataFrame, folder: str, run_id: int) -> None:
    """Writes letters() of one run: the letters with hashes, and each payload once."""
    spark = df.sparkSession
    named = df.withColumn("run_id", F.lit(run_id).cast("long"))

    def hashed(column: str) -> Column:
        return F.unhex(F.sha2(column, 256))

    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("run_id").parquet(f"{folder}/{name}")

    # contents are written first, with all that a letter needs: a letter never points at a payload that isn't there
    staged = f"{folder}/_staged/{run_id}"
    named.write.mode("overwrite").option("compression", "zstd").parquet(staged)
    held = spark.read.schema(named.schema).parquet(staged)
    alone = F.col("source").isNull()  # what was read is what was to be delivered
    contents = F.array(F.struct(F.col("record").alias("payload"), F.lit(True).alias("sent"), alone.alias("read")), F.struct(F.col("source").alias("payload"), F.lit(False).alias("sent"), F.lit(True).alias("read")))
    every = held.select("run_id", F.inline(contents)).where("payload is not null")
    write(every.groupBy("run_id", "payload").agg(F.max("sent").alias("sent"), F.max("read").alias("read")).withColumn("hash", hashed("payload")), "payloads")
    write(held.withColumns({f"{c}_hash": hashed(c) for c in ("record", "source")}).drop("record", "source"), "letters")
    where = spark._jvm.org.apache.hadoop.fs.Path(staged)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(spark: SparkSession, folder: str, run_id: int, name: str = "letters") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").where(F.col("run_id") == run_id)


def replay(spark: SparkSession, folder: str, run_id: int, transforms: bool = True, redacted: bool = False, acknowledged: bool = False, state: str = "COMPLETED", signatures: list[str] | None = None) -> DataFrame:
    """What a run's dead letters hold, to be sent again: places, record_key, payload (JSON), `_replay_of`.

    With transforms: one row for each source record of which any output failed, with `_wanted`, the ordinals that failed;
    the outputs go through only_failed(). Without: one row for each record that failed, as it was to be delivered.
    A run that is under way, one without dead letters, and one whose payloads were masked (unless that is acknowledged) are
    refused. signatures: only faults of these kinds.
    """
    if state not in ("COMPLETED", "FAILED", "STOPPED"):
        raise ValueError(f"run {run_id} is {state}: more records may fail before it ends")
    own = stored(spark, folder, run_id)
    own = own.where(F.col("signature").isin(signatures)) if signatures else own
    waiting = own.count()
    if not waiting:
        raise ValueError(f"run {run_id} has no dead letters")
    if redacted and not acknowledged:
        raise ValueError(f"payloads of run {run_id} are masked, and masks would be written for {waiting} records: acknowledge that")
    hash_ = F.coalesce("source_hash", "record_hash") if transforms else F.col("record_hash")
    wanted = own.withColumn("hash", hash_)
    if transforms:
        wanted = wanted.groupBy("_chunk", "_seq").agg(F.array_sort(F.collect_set("_ordinal")).alias("_wanted"), F.min("record_key").alias("record_key"), F.min("hash").alias("hash"))  # as many ordinals as siblings
    else:
        wanted = wanted.select(*PLACE, "record_key", "hash")
    found = stored(spark, folder, run_id, "payloads").where("read" if transforms else "sent").select("hash", "payload")
    return wanted.join(found, "hash").drop("hash").withColumn("_replay_of", F.lit(run_id).cast("long"))


def only_failed(df: DataFrame) -> DataFrame:
    """Of the outputs of replayed source records (`_ordinal`, `_wanted`) those that had failed: what had been written isn't written again."""
    return df.where(F.array_contains("_wanted", F.col("_ordinal").cast("int"))).drop("_wanted")


def windows(df: DataFrame, rows: int) -> DataFrame:
    """df with `_window`: chunks of `rows` in the order of places, however many records wait."""
    from reckoner.operators.chunks import numbered

    order = [c for c in PLACE if c in df.columns]
    return numbered(df, order).withColumn("_window", F.floor(F.col("_row") / rows).cast("int")).drop("_row")
