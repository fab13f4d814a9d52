"""The account of every record: outcomes, counters, index, dead letters, signatures, and the sheet that must balance."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.functions import paths

WRITTEN, SENT, REJECTED, FILTERED, TRANSFORM_FAILED, CALL_FAILED = OUTCOMES = ("WRITTEN", "SENT", "REJECTED", "FILTERED", "TRANSFORM_FAILED", "CALL_FAILED")
FAILURES = (REJECTED, TRANSFORM_FAILED, CALL_FAILED)
#: Percentages of rejected records are judged from so many produced ones on, or at the end of a chunk.
PERCENT_FLOOR = 100

# What in a message differs between two equal faults, and the length of a signature.
_QUOTED = "'[^']*'|\"[^\"]*\""
_IDENTIFIER = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b|\b[0-9a-fA-F]{24}\b|\b[a-zA-Z0-9]{15,18}\b"
_LONGEST = 300


def with_outcome(df: DataFrame) -> DataFrame:
    """df (`_error`, `_filtered`) with outcome, error_code and error_message, before any write."""
    failed = F.col("_error").isNotNull()
    return df.withColumns({"outcome": F.when(failed, TRANSFORM_FAILED).when(F.col("_filtered"), FILTERED).otherwise(WRITTEN), "error_code": F.when(failed, TRANSFORM_FAILED), "error_message": F.col("_error")})


def counters(df: DataFrame, *by: str) -> DataFrame:
    """Records read, filtered, produced, written and failed by group. Siblings of one read record (ordinals above 0) are produced but not read."""
    n = lambda c: F.count_if(c).cast("long")
    first = F.col("_ordinal") == 0 if "_ordinal" in df.columns else F.lit(True)
    return df.groupBy(*by).agg(
        n(first).alias("read"), n(F.col("outcome") == FILTERED).alias("filtered"), n(F.col("outcome") != FILTERED).alias("produced"),
        n(F.col("outcome").isin(WRITTEN, SENT)).alias("written"), n(F.col("outcome").isin(*FAILURES)).alias("failed"),
    )


def record_index(df: DataFrame, key: Column, occurred: Column, days: int = 365, record: Column | None = None, source: Column | None = None) -> DataFrame:
    """One entry for each output record: id `chunk:seq:ordinal`, trace `chunk#batch`, key, outcome, error, time and expiry; with record (JSON text), also what was to be delivered, and what had been read where a transform made a difference."""
    kept = [] if record is None else [record.alias("record"), F.when(source != record, source).alias("source")]
    ordinal = F.col("_ordinal") if "_ordinal" in df.columns else F.lit(0)
    batch = F.col("_batch") if "_batch" in df.columns else F.lit(0)
    return df.select(
        F.concat_ws(":", F.col("_chunk").cast("string"), F.col("_seq").cast("string"), ordinal.cast("string")).alias("id"), F.concat_ws("#", F.col("_chunk").cast("string"), batch.cast("string")).alias("trace_id"),
        F.col("_chunk").alias("chunk"), F.col("_seq").alias("seq"), ordinal.alias("ordinal"), key.alias("record_key"), "outcome", "error_code", "error_message",
        occurred.alias("occurred_at"), (occurred + F.make_interval(days=F.lit(days))).alias("expires_at"), *kept,
    )


def latest_entries(index: DataFrame, order: str, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Indexing a record again replaces its entry."""
    return index.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def normalise(message: Column) -> Column:
    t = F.trim(F.coalesce(message, F.lit("")))
    for pattern, put in ((_QUOTED, "?"), (_IDENTIFIER, "?"), (r"\d+", "?"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, put)
    return F.substring(t, 1, _LONGEST)


def signature(code: Column, message: Column) -> Column:
    """What two equal faults share: the code, and the message without what differs between records."""
    own = F.trim(F.coalesce(code, F.lit("")))
    return F.concat(F.when(own == "", "NO_CODE").otherwise(own), F.lit("|"), normalise(message))


def signatures(errors: DataFrame, run: str = "run_id") -> DataFrame:
    """errors (run, code, message, seq, node, occurred_at) by run and signature: exact counts, first and last time, a node and a message."""
    out = errors.withColumn("signature", signature(F.col("code"), F.col("message")))
    return out.groupBy(run, "signature").agg(F.count("*").alias("errors"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.min_by("message", F.struct("occurred_at", "seq")).alias("sample"))


def sample_errors(errors: DataFrame, most: int, order: list[str], run: str = "run_id") -> DataFrame:
    """At most `most` dead letters of each signature of a run (0: all); counts stay those of signatures()."""
    out = errors.withColumn("signature", signature(F.col("code"), F.col("message")))
    if not most:
        return out
    return out.withColumn("_n", F.row_number().over(W.partitionBy(run, "signature").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def breach(produced: Column, failed: Column, finished: Column, most: int | None = None, percent: int | None = None) -> Column:
    """Why a chunk has too many rejected records, or null: an absolute limit, then a share in whole percent; a limit of 0 percent means any."""
    out = F.lit(None).cast("string")
    share = F.floor(failed * 100 / F.nullif(produced, F.lit(0))).cast("long")
    if percent is not None:
        judged = (failed > 0) & (produced > 0) & (share >= percent) & (F.lit(percent == 0) | finished | (produced >= PERCENT_FLOOR))
        out = F.when(judged, F.concat(F.lit("PERCENT:"), share.cast("string")))
    if most is not None:
        out = F.when((failed > 0) & (failed >= most), F.concat(F.lit("COUNT:"), failed.cast("string"))).otherwise(out)
    return out


def first_breaches(batches: DataFrame, most: int | None = None, percent: int | None = None) -> DataFrame:
    """batches (chunk, batch, produced, failed) up to and with the first one of each chunk whose running totals breach."""
    so_far = W.partitionBy("chunk").orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.col("batch") == F.max("batch").over(W.partitionBy("chunk"))
    out = batches.select("chunk", "batch", F.sum("produced").over(so_far).alias("produced"), F.sum("failed").over(so_far).alias("failed"), last.alias("last"))
    out = out.withColumn("breach", breach(F.col("produced"), F.col("failed"), F.col("last"), most, percent)).where("breach is not null")
    return out.withColumn("_n", F.row_number().over(W.partitionBy("chunk").orderBy("batch"))).where("_n = 1").drop("_n", "last")


def retained(index: DataFrame, now: Column) -> DataFrame:
    return index.where(F.col("expires_at") > now)


def search(index: DataFrame, key=None, outcome=None, since=None, until=None, value=None, fields: list[str] | None = None, run=None, pipeline=None, payloads: tuple[str, ...] = (), field: str | None = None) -> DataFrame:
    """Entries by exact key, outcome, run, pipeline, inclusive time range, and a value; newest first is the caller's order.

    The value is looked for in the text columns `fields` (all, if not given), or, with payloads (columns of JSON text, such as
    the record and its source), in their leaves at any depth: in all of them, or in the one at a dotted path `field`.
    """
    out = index
    for c, x in (("record_key", key), ("outcome", outcome), ("run_id", run), ("pipeline_id", pipeline)):
        out = out.where(F.col(c) == x) if x is not None else out
    out = out.where(F.col("occurred_at") >= F.lit(since).cast("timestamp")) if since is not None else out
    out = out.where(F.col("occurred_at") <= F.lit(until).cast("timestamp")) if until is not None else out
    if value is None:
        return out
    if payloads:
        return _with_leaf(out, str(value), payloads, field)
    hit = F.lit(False)
    for f in fields or [c for c, t in index.dtypes if t == "string"]:
        hit = hit | F.coalesce(F.col(f).cast("string") == str(value), F.lit(False))
    return out.where(hit)


def _with_leaf(index: DataFrame, value: str, payloads: tuple[str, ...], field: str | None) -> DataFrame:
    """Entries (id) one of whose payloads has a leaf of this value. Only entries whose text has the value's characters at all are taken apart."""
    import json

    bare, escaped = json.dumps(value, ensure_ascii=False)[1:-1], json.dumps(value)[1:-1]
    found = None
    for c in payloads:
        likely = index.where(F.contains(c, F.lit(bare)) | F.contains(F.lower(c), F.lit(escaped.lower())) | F.contains(c, F.lit("\\u")) | F.contains(c, F.lit("\\/")) | (F.lit(_is_number(value)) & F.col(c).rlike("[0-9]")))
        leaf = paths.leaves(likely.select("id", c), c, ["id"]).where(F.col("value") == value)
        if field is not None:
            pointer = "/" + "/".join(x.replace("~", "~0").replace("/", "~1") for x in field.split("."))
            leaf = leaf.where(F.col("path") == pointer)
        found = leaf.select("id") if found is None else found.unionByName(leaf.select("id"))
    return index.join(found.distinct(), "id", "left_semi")


def _is_number(value: str) -> bool:
    """Whether numbers that are written otherwise could be this value."""
    try:
        float(value)
    except ValueError:
        return False
    return True


def page(df: DataFrame, order: list, size: int, number: int = 0) -> DataFrame:
    """One page of a list, in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def sheet(runs: DataFrame) -> DataFrame:
    """The reconciliation lines of each run (run_id, counters, and a count for each kind of failure from the index): line, label, value."""
    c = F.col
    lines = [
        ("Read", c("read")), ("Filtered", c("filtered")), ("Produced", c("produced")), ("Written", c("written")), ("Transform failed", c("n_transform_failed")),
        ("Rejected", c("n_rejected")), ("Call failed", c("n_call_failed")), ("Awaiting verdict", F.when(c("n_sent") > 0, c("n_sent"))), ("Unaccounted", c("produced") - c("written") - c("failed")),
    ]
    rows = F.array(*(F.struct(F.lit(k + 1).alias("line"), F.lit(label).alias("label"), v.cast("long").alias("value")) for k, (label, v) in enumerate(lines)))
    return runs.select("run_id", F.explode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("x")).select("run_id", "x.*")


def outcome_counts(index: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run with the index's own count of each outcome."""
    return index.groupBy(run).agg(*(F.count_if(F.col("outcome") == o).cast("long").alias(f"n_{o.lower()}") for o in OUTCOMES))


def checks(runs: DataFrame) -> DataFrame:
    """Run counters against the index's counts, one row for each comparison."""
    c = F.col
    failed = c("n_rejected") + c("n_call_failed") + c("n_transform_failed")
    written = c("n_written") + c("n_sent")
    pairs = [("written", c("written"), written), ("failed", c("failed"), failed), ("filtered", c("filtered"), c("n_filtered")), ("total", c("produced") + c("filtered"), written + failed + c("n_filtered"))]
    rows = F.array(*(F.struct(F.lit(n).alias("check"), a.cast("long").alias("counted"), b.cast("long").alias("indexed"), (a == b).alias("passed")) for n, a, b in pairs))
    indexed = c("n_written").isNotNull()  # a run that isn't indexed has nothing to compare
    return runs.where(indexed).select("run_id", F.explode(rows).alias("x")).select("run_id", "x.*")


def verdict(runs: DataFrame) -> Column:
    """INCOMPLETE until the run has ended, DISCREPANCY if anything is unaccounted or a check fails, else BALANCED."""
    c = F.col
    unexplained = F.greatest(F.lit(0), c("read") - c("filtered") - c("produced"))
    failed = c("n_rejected") + c("n_call_failed") + c("n_transform_failed")
    agree = (c("written") == c("n_written") + c("n_sent")) & (c("failed") == failed) & (c("filtered") == c("n_filtered"))
    agree = F.when(c("n_written") + c("n_sent") + failed + c("n_filtered") == 0, True).otherwise(agree)
    wrong = (c("produced") - c("written") - c("failed") != 0) | (unexplained != 0) | ~agree
    return F.when(~c("state").isin("COMPLETED", "FAILED", "STOPPED"), "INCOMPLETE").when(wrong, "DISCREPANCY").otherwise("BALANCED")


def write_index(entries: DataFrame, folder: str) -> dict[str, int]:
    """Writes index entries and returns the counters of what went into the files: they are counted in the same pass, and not from what is there afterwards."""
    seen = Observation("index")
    n = lambda o: F.count_if(F.col("outcome") == o)
    first = F.count_if(F.col("ordinal") == 0)
    entries.observe(seen, first.alias("read"), F.count("*").alias("entries"), *(n(o).alias(o) for o in OUTCOMES)).write.parquet(folder)
    return seen.get


def counted_run(spark: SparkSession, run_id: int, seen: dict[str, int], state: str = "COMPLETED") -> DataFrame:
    """The row of a run from write_index()'s counters."""
    failed = sum(seen[o] for o in FAILURES)
    row = (run_id, state, seen["read"], seen[FILTERED], seen["entries"] - seen[FILTERED], seen[WRITTEN] + seen[SENT], failed)
    return spark.createDataFrame([row], "run_id long, state string, read long, filtered long, produced long, written long, failed long")


def audited(entries: DataFrame, level: str) -> DataFrame:
    """What a level of auditing keeps of the index: COUNTERS nothing, ERRORS failures, INDEXED every record. FULL, which would copy all payloads, is refused."""
    level = level.upper()
    if level not in ("COUNTERS", "ERRORS", "INDEXED"):
        raise ValueError(f"no audit level {level!r} here")
    return entries.where(F.lit(False)) if level == "COUNTERS" else entries.where(F.col("outcome").isin(*FAILURES)) if level == "ERRORS" else entries


def by_node(errors: DataFrame, nodes: DataFrame, run: str = "run_id") -> DataFrame:
    """Errors (run, node_id) of each run by the node's name; nodes: node_id, name (a row for each node of a pipeline)."""
    named = errors.groupBy(run, "node_id").agg(F.count("*").alias("errors")).join(nodes, "node_id", "left")
    return named.groupBy(run, F.coalesce("name", "node_id").alias("node")).agg(F.sum("errors").alias("errors"))


def stage_log(df: DataFrame, stages: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row for each stage of each batch (`_chunk`, `_batch`): trace_id, stage, records in and out; a stage is its name and what goes in and comes out."""
    trace = F.concat_ws("#", F.col("_chunk").cast("string"), F.col("_batch").cast("string")).alias("trace_id")
    counts = [c for k, (_, into, out) in enumerate(stages) for c in (F.count_if(into).alias(f"i{k}"), F.count_if(out).alias(f"o{k}"))]
    rows = F.array(*(F.struct(F.lit(k).alias("number"), F.lit(name).alias("stage"), F.col(f"i{k}").alias("records_in"), F.col(f"o{k}").alias("records_out")) for k, (name, _, _) in enumerate(stages)))
    return df.groupBy(trace).agg(*counts).select("trace_id", F.explode(rows).alias("x")).select("trace_id", "x.*")


class StageLog:
    """What the stages of a run took in and gave, counted while they ran: wrap each stage with stage(), and what makes Spark run them with ran().

    Counts are Spark's observations at the borders of stages, so nothing runs twice; a stage's time and duration are those of
    the action that it was part of. position is a stage's place in the run.
    """

    _ROW = "run_id long, position int, stage string, node_id string, records_in long, records_out long, outcome string, error string, occurred_at timestamp, duration_ms long"

    def __init__(self, spark: SparkSession, run_id: int):
        self.spark, self.run_id, self.rows, self._made = spark, run_id, [], 0
        self._open: list[tuple[str, str | None, Observation, Observation]] = []

    def stage(self, name: str, df: DataFrame, made: Callable[[DataFrame], DataFrame], node_id: str | None = None) -> DataFrame:
        """made(df), with what goes in and what comes out counted."""
        self._made += 1
        into, out = (Observation(f"{self._made}-{side}") for side in ("in", "out"))
        after = made(df.observe(into, F.count("*").alias("n"))).observe(out, F.count("*").alias("n"))
        self._open.append((name, node_id, into, out))
        return after

    def ran(self, action: Callable[[], object]) -> object:
        """The action's result; the stages since the last action, and those that it makes itself, are logged, as failed if it fails."""
        began, clock, error = time.time(), time.monotonic(), None
        try:
            return action()
        except Exception as e:
            error = str(e)[:_LONGEST]
            raise
        finally:
            took = int((time.monotonic() - clock) * 1000)
            stages, self._open = self._open, []
            for name, node_id, into, out in stages:
                counts = (None, None) if error else (into.get["n"], out.get["n"])
                self.rows.append((self.run_id, len(self.rows), name, node_id, *counts, "FAILED" if error else "DONE", error, datetime.datetime.fromtimestamp(began), took))

    def entries(self) -> DataFrame:
        """The log, with delta: what came out less what went in."""
        return self.spark.createDataFrame(self.rows, self._ROW).withColumn("delta", F.col("records_out") - F.col("records_in"))


def find_stages(log: DataFrame, run=None, chunk=None, stage: str | None = None, outcome: str | None = None) -> DataFrame:
    """Entries of a stage log by run, chunk, stage and outcome, in the order in which they happened: by time, then position."""
    out = log
    for c, x in (("run_id", run), ("chunk", chunk), ("stage", stage), ("outcome", outcome)):
        out = out.where(F.col(c) == x) if x is not None else out
    return out.orderBy("occurred_at", "position")


def cycles(entries: DataFrame, log: DataFrame) -> DataFrame:
    """The stage log beside what the index says of the same trace: entries, and those written."""
    own = entries.groupBy("trace_id").agg(F.count("*").alias("entries"), F.count_if(F.col("outcome") == WRITTEN).alias("written"))
    return log.join(own, "trace_id").select("trace_id", "entries", "written", "stage", "records_in", "records_out")
