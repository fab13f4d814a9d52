"""Queries of what people read of runs, and of retries and purges."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckoner.operators import health, ledger, reports
from reckoner.plans.accounts import _BOTH, _ERR, _OUTCOMES, _counted, outcomes
from reckoner.plans.common import WITH_RUNS, errors, runs, table
from reckoner.plans.operations import _CH, _FIND, _at, _chunks, findings, live_runs
from reckoner.sources.scratch import folder


def reconciliation_export(spark, sf_dir):
    """The report of each run as a file, written and read back."""
    path = folder(spark, "reports")
    reports.export(reports.export_lines(_counted(spark, sf_dir)), path)
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return back.select(F.col("run_id").cast("long").alias("run_id"), "section", "label", "value", "detail", "note")


def headline_board(spark, sf_dir):
    """Headlines of all pipelines: the worst findings, what runs now, and what was moved."""
    place = F.create_map(*(F.lit(x) for k, c in enumerate(health.SEVERITY) for x in (c, k)))
    df = findings(spark, sf_dir).where("severity > 1").withColumn("_place", F.element_at(place, F.col("code")))
    worst = df.groupBy("pipeline_id").agg(F.max("severity").alias("severity"), F.min_by("code", F.struct(-F.col("severity"), "_place")).alias("code"))
    live = live_runs(spark, sf_dir).join(runs(spark, sf_dir).select("run_id", "pipeline_id"), "run_id")
    return reports.board(worst, live, runs(spark, sf_dir), "the last 31 days", health.TOP_HEADLINES)


def signature_summary(spark, sf_dir):
    """The two most frequent signatures of each run, with the node that raised the first."""
    return reports.signature_summary(errors(spark, sf_dir).withColumn("node_id", F.concat(F.lit("node-"), F.col("code"))), 20, 2)


def run_search_total(spark, sf_dir):
    """A page of runs that a schedule started, with the number of all of them; the sort that was asked for is unknown."""
    df = runs(spark, sf_dir).withColumn("trigger", F.when(F.col("k") % 3 == 0, "MANUAL").otherwise("SCHEDULE"))
    found = reports.search_runs(df, states=("COMPLETED", "FAILED"), trigger="SCHEDULE", since="2024-01-03", until="2024-01-25", roots=True)
    return reports.paged(found, "drop table", {"read": "read", "created": "created_at"}, "created", "run_id", 15, 1).select("run_id", "read", "total")


def retry_resume(spark, sf_dir):
    """Chunks that a retry takes up, each from its checkpoint."""
    df = _chunks(spark, sf_dir).withColumn("checkpoint", F.col("written"))
    return reports.retry_plan(df, unfinished=False)


def expired_partitions(spark, sf_dir):
    """An index by month of expiry after a purge."""
    path = folder(spark, "expiring")
    entries = reports.by_expiry(ledger.record_index(outcomes(spark, sf_dir), F.col("_key"), F.col("_at")))
    entries.repartition("expires_month").write.partitionBy("expires_month").parquet(path)
    reports.purge(spark, path, F.lit("1996-05-15").cast("timestamp"))
    return spark.read.schema(entries.schema).parquet(path).groupBy(F.date_format("expires_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("entries"))


def dry_run_report(spark, sf_dir):
    """The counters of a dry run and what its sink would have been sent, in delivery groups; nothing is written."""
    df = outcomes(spark, sf_dir)
    sent = df.where(F.col("outcome") == ledger.WRITTEN).groupBy("_chunk", F.floor((F.col("_seq") - 1) / 40).alias("batch")).agg(F.count("*").alias("records"))
    would = sent.agg(F.count("*").alias("calls"), F.sum("records").alias("would_write"))
    return ledger.counters(df).withColumn("dry_run", F.lit(True)).join(would, F.col("written") == F.col("would_write"), "left")


QUERIES = {f.__name__: f for f in (reconciliation_export, headline_board, signature_summary, run_search_total, retry_resume, expired_partitions, dry_run_report)}


def _line(section, label, value, detail, note, when="true"):
    return f"SELECT run_id, '{section}' AS section, {label} AS label, CAST({value} AS VARCHAR) AS value, {detail} AS detail, {note} AS note FROM b WHERE {when}"


def _check(label, a, b):
    said = f"{b} || CASE WHEN {a} = {b} THEN ' (ok)' ELSE ' (differs by ' || abs({a} - {b}) || ')' END"
    return _line("check", f"'{label}'", a, said, "''")


_WRONG = "produced - written - failed <> 0 OR \"read\" - filtered > produced OR written <> n_written OR failed <> n_rejected OR filtered <> n_filtered"
_EXPORT = " UNION ALL ".join([
    _line("verdict", "'Verdict'", f"CASE WHEN {_WRONG} THEN 'DISCREPANCY' ELSE 'BALANCED' END", "''", "''"), _line("verdict", "'Run'", "run_id", "''", "''"),
    _line("verdict", "'Dry run'", "'true'", "''", "'a trial: no record left for the destination'", "dry_run"),
    _line("sheet", "'Read from source'", '"read"', "'TOTAL'", "'all records that came out of the source'"), _line("sheet", "'Filtered by rules'", "filtered", "'DEDUCTION'", "'left out on purpose, by a rule or a function'"),
    _line("sheet", "'Entered delivery'", "produced", "'SUBTOTAL'", "'one for each record that was not left out'"), _line("sheet", "'Written'", "written", "'RESULT'", "'taken by the destination'"),
    _line("sheet", "'Failed in transform'", 0, "'DEDUCTION'", "'a mapping, a rule or a function failed'"), _line("sheet", "'Rejected by destination'", "n_rejected", "'DEDUCTION'", "'refused one by one, with a reason each'"), _line("sheet", "'Lost to a failed call'", 0, "'DEDUCTION'", "'nothing is known of them: their request did not end well'"),
    _line("sheet", "'Unaccounted'", "produced - written - failed", "'BALANCE'", "CASE WHEN produced - written - failed = 0 THEN 'none: all that was produced is written or failed' ELSE 'produced, but neither written nor failed' END"),
    _check("written", "written", "n_written"), _check("failed", "failed", "n_rejected"), _check("filtered", "filtered", "n_filtered"), _check("total", "(produced + filtered)", "(n_written + n_rejected + n_filtered)"),
])
_RUNNING = "(SELECT (user_id % 12) AS p, (user_id % 12) * 100 + day(ts) AS run_id FROM events WHERE ((user_id % 12) * 100 + day(ts) + event_id % 4) % 17 <> 0 AND ((user_id % 12) * 100 + day(ts) + event_id % 4) % 19 = 0 GROUP BY 1, 2)"
ORACLE_SQL = {
    "reconciliation_export": _BOTH.rstrip(", ") + " " + _EXPORT,
    "headline_board": _FIND + f""", w AS (SELECT pipeline_id, max(severity) AS severity, arg_min(code, place) AS code FROM g WHERE severity > 1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY severity DESC, pipeline_id) AS n FROM w)
      SELECT CAST(n AS INTEGER) AS place, CAST(severity AS INTEGER) AS severity, CAST(pipeline_id AS BIGINT) AS pipeline_id, code AS title FROM o WHERE n <= 5
      UNION ALL SELECT 6, 2, NULL, (count(*) - 5) || CASE WHEN count(*) = 6 THEN ' more job' ELSE ' more jobs' END || ' need attention' FROM o HAVING count(*) > 5
      UNION ALL SELECT 7, 1, CASE WHEN count(*) = 1 THEN min(p) END, CASE WHEN count(*) = 1 THEN 'Running now' ELSE count(*) || ' jobs running now' END FROM {_RUNNING} HAVING count(*) > 0
      UNION ALL SELECT 8, 1, NULL, format('{{:,}}', CAST(sum(written) AS BIGINT)) || ' records transferred in the last 31 days' FROM runs HAVING sum(written) > 0
      UNION ALL SELECT 0, 1, NULL, 'Nothing has failed in the last 31 days' FROM o HAVING count(*) = 0""",
    "signature_summary": _ERR + "SELECT run_id, signature, count(*) AS errors, least(count(*), 20) AS samples, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, 'node-' || arg_min(code, (occurred_at, chunk, seq)) AS node_id FROM err GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, signature) <= 2",
    "run_search_total": WITH_RUNS + "s AS (SELECT * FROM runs WHERE k % 3 <> 0 AND retry_of IS NULL AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25') SELECT run_id, \"read\", (SELECT count(*) FROM s) AS total FROM (SELECT * FROM s ORDER BY created_at DESC, run_id LIMIT 15 OFFSET 15)",
    "retry_resume": _CH + "SELECT run_id, chunk, state, written AS after FROM ch WHERE state = 'ABANDONED'",
    "expired_partitions": f"SELECT strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m') AS month, count(*) AS entries FROM {_OUTCOMES} WHERE o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1996-05-01' GROUP BY 1",
    "dry_run_report": f"""WITH o AS (SELECT *, (row_number() OVER (PARTITION BY chunk ORDER BY o_orderkey) - 1) // 40 AS batch FROM {_OUTCOMES}), c AS (SELECT count(*) AS calls, CAST(sum(n) AS BIGINT) AS would_write FROM (SELECT count(*) AS n FROM o WHERE outcome = 'WRITTEN' GROUP BY chunk, batch))
      SELECT count(*) AS "read", count(*) FILTER (outcome = 'FILTERED') AS filtered, count(*) FILTER (outcome <> 'FILTERED') AS produced, count(*) FILTER (outcome = 'WRITTEN') AS written, count(*) FILTER (outcome = 'TRANSFORM_FAILED') AS failed, true AS dry_run, any_value(calls) AS calls, any_value(would_write) AS would_write FROM o, c""",
}
