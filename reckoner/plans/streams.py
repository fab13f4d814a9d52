"""Queries of continuous runs, over events as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckoner.operators import ledger
from reckoner.plans.common import WITH_RUNS, index, table
from reckoner.sources.scratch import folder
from reckoner.sources.log import follow_log, read_log
from reckoner.streaming.keyed import KeyedTable, deduplicated, run_upserts
from reckoner.streaming.runner import index_entries, run_stream


#: Messages of a file, at most: what one task gets.
MESSAGES = 250_000


def _sent(spark, df, rows: int, parts: int):
    """df, of about `rows` rows, written as `parts` files, or as many times more as keep each at MESSAGES rows, and read as a stream, two of `parts` in a batch: so there are as many batches however large df is."""
    source, times = folder(spark, "stream-in"), max(1, -(-rows // (parts * MESSAGES)))
    df.repartition(parts * times).write.parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2 * times).parquet(source)


def _streamed(spark, df, transform, parts: int):
    """df written as files and read back as a stream, through transform, until there is nothing more."""
    out, checkpoint = (folder(spark, k) for k in ("stream-out", "stream-at"))
    stream = _sent(spark, df, df.count(), parts)
    run_stream(stream, transform, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


_ENTRY = "id string, run_id long, outcome string, occurred_at timestamp"


def _messages(spark, sf_dir):
    """Index entries as JSON messages."""
    entries = index(spark, sf_dir).select("id", "run_id", "outcome", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "event_id")
    keyed = entries.withColumn("id", F.concat_ws("/", F.col("run_id").cast("string"), "id"))
    return keyed.select(F.to_json(F.struct("id", "run_id", "outcome", "occurred_at")).alias("value"), "occurred_at", "event_id")


def stream_index_upsert(spark, sf_dir):
    """Messages of index entries, each sent twice, some broken, into a keyed table: it has each entry once, and the broken ones are dead letters."""
    every = _messages(spark, sf_dir)
    messages, broken = every.select("value"), every.where("event_id % 50 = 0").select(F.substring("value", 2, 40).alias("value"))
    out, dead, checkpoint = (folder(spark, k) for k in ("keyed", "dead", "stream-at"))
    stream = _sent(spark, messages.unionByName(messages).unionByName(broken), 2 * table(spark, sf_dir, "events").count(), 6)
    kept = KeyedTable(spark, out, most_deltas=1)
    run_upserts(stream, lambda b: index_entries(b, _ENTRY), kept, dead, checkpoint).awaitTermination()
    counted = kept.read().groupBy("run_id", "outcome").agg(F.count("*").alias("records"))
    letters = spark.read.schema("raw string, batch_id long").parquet(dead).agg(F.count("*").alias("records"))
    return counted.unionByName(letters.select(F.lit(None).cast("long").alias("run_id"), F.lit("BROKEN").alias("outcome"), "records"))


def stream_dedup(spark, sf_dir):
    """Entries that are sent again within the delay are gone before the upsert."""
    rows = _messages(spark, sf_dir).drop("event_id")
    out, checkpoint = (folder(spark, k) for k in ("stream-out", "stream-at"))
    stream = _sent(spark, rows.unionByName(rows), 2 * table(spark, sf_dir, "events").count(), 4)
    run_stream(deduplicated(stream, "value", "occurred_at", "60 days"), lambda b: b, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("records"), F.countDistinct("value").alias("entries"))


def log_batch(spark, sf_dir):
    """Events as a topic, read by offsets that are frozen when the read is planned: all of it, and what is there after the latest."""
    path = f"{sf_dir}/events.parquet"
    whole = read_log(spark, path, rowsPerPartition="700").groupBy("event_type").agg(F.count("*").alias("records"), F.min("event_id").alias("first"), F.max("_offset").alias("last_offset"))
    after = read_log(spark, path, startingOffsets="LATEST").groupBy("event_type").agg(F.count("*").alias("records"), F.min("event_id").alias("first"), F.max("_offset").alias("last_offset"))
    return whole.unionByName(after)


def log_stream(spark, sf_dir):
    """Events as a topic, followed by a stream to its end."""
    out, checkpoint = (folder(spark, k) for k in ("stream-out", "stream-at"))
    run_stream(follow_log(spark, f"{sf_dir}/events.parquet", rowsPerPartition="5000"), lambda b: b, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("records"), F.countDistinct("_offset").alias("places"), F.max("value").alias("largest"))


def stream_equals_batch(spark, sf_dir):
    """The batch function over a stream of events gives the counters of the batch run."""
    def judge(df):
        bad = (F.col("event_type") == "error") & (F.col("value") >= 50)
        return df.withColumns({"_error": F.when(bad, "refused"), "_filtered": F.col("event_type") == "signup"}).transform(ledger.with_outcome)

    stored = _streamed(spark, table(spark, sf_dir, "events"), judge, 4)
    return ledger.counters(stored, (F.col("user_id") % 12).alias("pipeline_id"))


QUERIES = {f.__name__: f for f in (stream_index_upsert, stream_dedup, log_batch, log_stream, stream_equals_batch)}
ORACLE_SQL = {
    "stream_index_upsert": WITH_RUNS + "d AS (SELECT run_id, outcome, count(*) AS records FROM idx GROUP BY 1, 2) SELECT run_id, outcome, records FROM d UNION ALL SELECT NULL, 'BROKEN', count(*) FROM events WHERE event_id % 50 = 0",
    "stream_dedup": "SELECT count(*) AS records, count(*) AS entries FROM events",
    "log_batch": "SELECT event_type, count(*) AS records, min(event_id) AS first, max(event_id) AS last_offset FROM events GROUP BY 1",
    "log_stream": "SELECT user_id, count(*) AS records, count(*) AS places, max(value) AS largest FROM events GROUP BY 1",
    "stream_equals_batch": "SELECT user_id % 12 AS pipeline_id, count(*) AS \"read\", count(*) FILTER (event_type = 'signup') AS filtered, count(*) FILTER (event_type <> 'signup') AS produced, count(*) FILTER (event_type <> 'signup' AND NOT (event_type = 'error' AND value >= 50)) AS written, count(*) FILTER (event_type = 'error' AND value >= 50) AS failed FROM events GROUP BY 1",
}
