"""Queries of chunks, retries and the health of pipelines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckoner.operators import health, ledger
from reckoner.plans.common import WITH_RUNS, errors, health_runs, runs, table

#: The end of the derived history stands for the present.
NOW, SINCE = "2024-01-31", "2024-01-29"


def _at(text):
    return F.lit(text).cast("timestamp")


def _chunks(spark, sf_dir):
    """Chunks of runs: events of a run by event_id % 4, with a state."""
    e = table(spark, sf_dir, "events").withColumn("run_id", (F.col("user_id") % 12) * 100 + F.dayofmonth("ts")).withColumn("chunk", F.col("event_id") % 4)
    df = e.groupBy("run_id", "chunk").agg(F.count("*").alias("planned"), F.count_if(F.col("event_type") != "error").alias("written"))
    k = F.col("run_id") + F.col("chunk")
    return df.withColumn("state", F.when(k % 17 == 0, "ABANDONED").when(k % 19 == 0, "RUNNING").otherwise("COMPLETED"))


def chunk_state_counts(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("state").agg(F.count("*").alias("chunks"))


def records_at_risk(spark, sf_dir):
    bad = F.col("state").isin("FAILED", "ABANDONED")
    return _chunks(spark, sf_dir).groupBy("run_id").agg(F.count_if(bad).alias("failed"), F.count_if(~bad & (F.col("state") != "COMPLETED")).alias("unfinished"), F.sum(F.when(bad, F.col("written")).otherwise(0)).alias("at_risk"))


def retry_selection(spark, sf_dir):
    """Chunks that a retry takes up: the failed ones and the unfinished."""
    df = _chunks(spark, sf_dir)
    return df.join(df.where("state = 'COMPLETED'").select("run_id", "chunk"), ["run_id", "chunk"], "left_anti").select("run_id", "chunk", "state")


def retry_chain(spark, sf_dir):
    return health.retry_chains(runs(spark, sf_dir).select("run_id", "retry_of")).withColumn("depth", F.col("depth").cast("long"))


def run_search_page(spark, sf_dir):
    found = runs(spark, sf_dir).where((F.col("state") == "COMPLETED") & F.col("retry_of").isNull() & (F.col("created_at") >= _at("2024-01-05")))
    return ledger.page(found, [F.desc("read"), "run_id"], 20, 1).select("run_id", "pipeline_id", "read")


def baseline_median(spark, sf_dir):
    return health.baselines(health_runs(spark, sf_dir))


def findings(spark, sf_dir):
    return health.findings(health_runs(spark, sf_dir), _at(SINCE))


def findings_order(spark, sf_dir):
    """Findings as people get them: each pipeline's worst first."""
    return health.ordered(findings(spark, sf_dir)).select("pipeline_id", "code", "place")


def severity_rank(spark, sf_dir):
    """Pipelines with their worst finding."""
    return findings(spark, sf_dir).groupBy("pipeline_id").agg(F.max("severity").alias("worst"), F.count("*").alias("findings"))


def headlines(spark, sf_dir):
    """The worst finding of each pipeline, the worst TOP_HEADLINES of them in full and the others as a number."""
    place = F.create_map(*(F.lit(x) for k, c in enumerate(health.SEVERITY) for x in (c, k)))
    df = findings(spark, sf_dir).where("severity > 1").withColumn("_place", F.element_at(place, F.col("code")))
    worst = df.groupBy("pipeline_id").agg(F.max("severity").alias("severity"), F.min_by("code", F.struct(-F.col("severity"), "_place")).alias("code"))
    ranked = worst.withColumn("_n", F.row_number().over(W.orderBy(F.desc("severity"), "pipeline_id")))  # a row for each pipeline
    top = ranked.where(F.col("_n") <= health.TOP_HEADLINES).select("pipeline_id", "code", F.lit(0).cast("long").alias("more"))
    more = ranked.where(F.col("_n") > health.TOP_HEADLINES).agg(F.count("*").alias("more")).where("more > 0").select(F.lit(None).cast("long").alias("pipeline_id"), F.lit("MORE").alias("code"), "more")
    return top.unionByName(more)


def did_not_run(spark, sf_dir):
    r = runs(spark, sf_dir)
    schedules = r.groupBy("pipeline_id").agg(F.lit(True).alias("enabled")).withColumn("expected_at", F.when(F.col("pipeline_id") % 3 == 0, _at("2024-02-02")).otherwise(_at("2024-01-30")))
    return health.did_not_run(schedules, r.where("pipeline_id % 2 = 0 OR dom < 30"), _at(NOW))


def volume(spark, sf_dir):
    df = runs(spark, sf_dir).where(F.col("created_at") >= _at("2024-01-10"))
    done = F.count_if(F.col("state") == "COMPLETED")
    return df.groupBy("pipeline_id").agg(F.count("*").alias("runs"), done.alias("completed"), F.sum("read").alias("read"), F.sum("written").alias("written"), F.sum("seconds").alias("seconds"), F.floor(done * 100 / F.count("*")).alias("success_percent"))


def totals(spark, sf_dir):
    return volume(spark, sf_dir).agg(F.sum("runs").alias("runs"), F.sum("completed").alias("completed"), F.sum("read").alias("read"), F.sum("written").alias("written"))


def trend(spark, sf_dir):
    df = health.newest(runs(spark, sf_dir).where("NOT dry_run")).where(F.col("age") <= health.TREND)
    return df.select("pipeline_id", F.col("age").cast("long").alias("age"), "run_id", "state", "read", "written", "failed", "seconds")


def top_reasons(spark, sf_dir):
    latest = health.newest(runs(spark, sf_dir)).where("age = 1").select("run_id")
    own = errors(spark, sf_dir).join(latest, "run_id").withColumn("message", F.concat(F.lit("Transform x threw: Error: "), F.col("message")))
    own = own.withColumn("reason", ledger.normalise(health.readable(F.col("message")))).groupBy("run_id", "code", "reason").agg(F.count("*").alias("errors"))
    return own.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("errors"), "code"))).where(F.col("_n") <= health.TOP_REASONS).drop("_n")


def live_runs(spark, sf_dir):
    """Runs with chunks still under way: progress in percent, records in all, age."""
    done = F.count_if(F.col("state").isin("COMPLETED", "ABANDONED"))
    df = _chunks(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("chunks"), done.alias("finished"), F.count_if(F.col("state") == "RUNNING").alias("running")).where("running > 0")
    aged = df.join(runs(spark, sf_dir).select("run_id", "created_at"), "run_id").withColumn("_s", F.unix_seconds(_at(NOW)) - F.unix_seconds(F.col("created_at").cast("timestamp")))
    return aged.select("run_id", F.floor(F.col("finished") * 100 / F.col("chunks")).alias("progress"), health.humanise(F.col("_s")).alias("age"))


def throughput(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", F.when(F.col("seconds") > 0, F.floor(F.col("written") * 3600 / F.col("seconds"))).alias("per_hour"))


def audit_search(spark, sf_dir):
    found = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase") & (F.col("user_id") == 7) & (F.col("ts") >= _at("2024-01-03")))
    return ledger.page(found, [F.desc("ts"), "event_id"], 25).select("event_id", "event_type", "ts")


def idempotent_start(spark, sf_dir):
    """Requests for runs (a schedule's key is its id and the time it fires) less those that a run answers already."""
    asked = table(spark, sf_dir, "events").select(F.concat_ws("@", (F.col("user_id") % 12).cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("key")).distinct()
    there = runs(spark, sf_dir).where("state = 'COMPLETED'").select(F.concat_ws("@", F.col("pipeline_id").cast("string"), F.date_format("created_at", "yyyy-MM-dd")).alias("key"))
    return asked.join(there, "key", "left_anti")


QUERIES = {f.__name__: f for f in (chunk_state_counts, records_at_risk, retry_selection, retry_chain, run_search_page, baseline_median, findings, findings_order, severity_rank, headlines, did_not_run, volume, totals, trend, top_reasons, live_runs, throughput, audit_search, idempotent_start)}

_CH = WITH_RUNS + "ch AS (SELECT *, CASE WHEN (run_id + chunk) % 17 = 0 THEN 'ABANDONED' WHEN (run_id + chunk) % 19 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS state FROM (SELECT (user_id % 12) * 100 + day(ts) AS run_id, event_id % 4 AS chunk, count(*) AS planned, count(*) FILTER (event_type <> 'error') AS written FROM events GROUP BY 1, 2)) "
_NEW = WITH_RUNS + "h AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, run_id DESC) AS age FROM health), u AS (SELECT * FROM h WHERE age BETWEEN 2 AND 15 AND NOT dry_run AND state = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY age) <= 10), base AS (SELECT pipeline_id, CASE WHEN count(*) >= 3 THEN list_sort(list(\"read\"))[count(*) // 2 + 1] END AS usual_rows, CASE WHEN count(*) >= 3 THEN list_sort(list(seconds))[count(*) // 2 + 1] END AS usual_seconds FROM u GROUP BY 1), "
_FIND = _NEW + f"""f AS (SELECT pipeline_id, run_id, unnest(list_filter([CASE WHEN state = 'FAILED' THEN 'FAILED' END, CASE WHEN produced - written - failed <> 0 THEN 'UNACCOUNTED' END, CASE WHEN state = 'COMPLETED' AND "read" = 0 THEN 'NO_ROWS' END,
  CASE WHEN state = 'COMPLETED' AND usual_rows > 0 AND "read" > 0 AND "read" < usual_rows * 0.5 THEN 'VOLUME_LOW' END, CASE WHEN state = 'COMPLETED' AND usual_rows > 0 AND "read" > usual_rows * 2 THEN 'VOLUME_HIGH' END,
  CASE WHEN produced > 0 AND failed * 100 // produced >= 10 THEN 'REJECTIONS' END, CASE WHEN usual_seconds > 0 AND seconds > usual_seconds * 3 THEN 'SLOW' END, CASE WHEN created_at < TIMESTAMP '{SINCE}' THEN 'NOTHING_RECENT' END], lambda x: x IS NOT NULL)) AS code FROM h LEFT JOIN base USING (pipeline_id) WHERE age = 1),
  g AS (SELECT *, CASE WHEN code IN ('FAILED', 'UNACCOUNTED') THEN 3 WHEN code = 'NOTHING_RECENT' THEN 1 ELSE 2 END AS severity, list_position(['FAILED', 'UNACCOUNTED', 'NO_ROWS', 'VOLUME_LOW', 'VOLUME_HIGH', 'REJECTIONS', 'SLOW', 'DID_NOT_RUN', 'NOTHING_RECENT'], code) AS place FROM f) """
_VOL = WITH_RUNS + "v AS (SELECT pipeline_id, count(*) AS runs, count(*) FILTER (state = 'COMPLETED') AS completed, CAST(sum(\"read\") AS BIGINT) AS \"read\", CAST(sum(written) AS BIGINT) AS written, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) FILTER (state = 'COMPLETED') * 100 // count(*) AS success_percent FROM runs WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY 1) "
ORACLE_SQL = {
    "chunk_state_counts": _CH + "SELECT state, count(*) AS chunks FROM ch GROUP BY 1",
    "records_at_risk": _CH + "SELECT run_id, count(*) FILTER (state = 'ABANDONED') AS failed, count(*) FILTER (state = 'RUNNING') AS unfinished, CAST(coalesce(sum(written) FILTER (state = 'ABANDONED'), 0) AS BIGINT) AS at_risk FROM ch GROUP BY 1",
    "retry_selection": _CH + "SELECT run_id, chunk, state FROM ch WHERE state <> 'COMPLETED'",
    "retry_chain": WITH_RUNS + "c AS (SELECT run_id AS root, run_id, CAST(0 AS BIGINT) AS depth FROM runs r WHERE retry_of IS NULL OR retry_of NOT IN (SELECT run_id FROM runs) UNION ALL SELECT c.root, r.run_id, c.depth + 1 FROM c JOIN runs r ON r.retry_of = c.run_id WHERE c.depth < 20) SELECT root, run_id, depth FROM c",
    "run_search_page": WITH_RUNS + "p AS (SELECT * FROM runs WHERE state = 'COMPLETED' AND retry_of IS NULL AND created_at >= TIMESTAMP '2024-01-05' ORDER BY \"read\" DESC, run_id LIMIT 20 OFFSET 20) SELECT run_id, pipeline_id, \"read\" FROM p",
    "baseline_median": _NEW.rstrip(", ") + " SELECT * FROM base",
    "findings": _FIND + "SELECT pipeline_id, run_id, code, severity FROM g",
    "findings_order": _FIND + "SELECT pipeline_id, code, CAST(row_number() OVER (PARTITION BY pipeline_id ORDER BY severity DESC, place) AS INTEGER) AS place FROM g",
    "severity_rank": _FIND + "SELECT pipeline_id, max(severity) AS worst, count(*) AS findings FROM g GROUP BY 1",
    "headlines": _FIND + ", w AS (SELECT pipeline_id, max(severity) AS severity, arg_min(code, place) AS code FROM g WHERE severity > 1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY severity DESC, pipeline_id) AS n FROM w) SELECT pipeline_id, code, CAST(0 AS BIGINT) AS more FROM o WHERE n <= 5 UNION ALL SELECT NULL, 'MORE', count(*) FROM o WHERE n > 5 HAVING count(*) > 0",
    "did_not_run": WITH_RUNS + f"s AS (SELECT pipeline_id, CASE WHEN pipeline_id % 3 = 0 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-01-30' END AS expected_at, max(created_at) FILTER (pipeline_id % 2 = 0 OR dom < 30) AS last_run FROM runs GROUP BY 1) SELECT pipeline_id, expected_at FROM s WHERE expected_at + INTERVAL 30 MINUTE < TIMESTAMP '{NOW}' AND (last_run IS NULL OR last_run < expected_at)",
    "volume": _VOL + "SELECT * FROM v",
    "totals": _VOL + "SELECT CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(\"read\") AS BIGINT) AS \"read\", CAST(sum(written) AS BIGINT) AS written FROM v",
    "trend": WITH_RUNS + "t AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, run_id DESC) AS age FROM runs WHERE NOT dry_run) SELECT pipeline_id, age, run_id, state, \"read\", written, failed, seconds FROM t WHERE age <= 7",
    "top_reasons": WITH_RUNS + "l AS (SELECT run_id FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, run_id DESC) = 1), r AS (SELECT run_id, code, 'value ? of user ? was refused' AS reason, count(*) AS errors FROM idx JOIN l USING (run_id) WHERE outcome = 'REJECTED' GROUP BY 1, 2) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY errors DESC, code) <= 3",
    "live_runs": _CH + f", q AS (SELECT run_id, count(*) FILTER (state <> 'RUNNING') * 100 // count(*) AS progress FROM ch GROUP BY 1 HAVING count(*) FILTER (state = 'RUNNING') > 0), a AS (SELECT run_id, progress, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(created_at)) AS BIGINT) // 60 AS m FROM q JOIN runs USING (run_id)) SELECT run_id, progress, CASE WHEN m < 60 THEN greatest(m, 0) || 'm' WHEN m // 60 < 48 THEN m // 60 || 'h' ELSE m // 1440 || 'd' END AS age FROM a",
    "throughput": WITH_RUNS + "t AS (SELECT run_id, CASE WHEN seconds > 0 THEN written * 3600 // seconds END AS per_hour FROM runs) SELECT * FROM t",
    "audit_search": "SELECT event_id, event_type, ts FROM events WHERE event_type IN ('signup', 'purchase') AND user_id = 7 AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts DESC, event_id LIMIT 25",
    "idempotent_start": WITH_RUNS + "a AS (SELECT DISTINCT (user_id % 12) || '@' || strftime(ts, '%Y-%m-%d') AS key FROM events) SELECT key FROM a WHERE key NOT IN (SELECT pipeline_id || '@' || strftime(created_at, '%Y-%m-%d') FROM runs WHERE state = 'COMPLETED')",
}
