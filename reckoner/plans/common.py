"""Tables, and the history of runs that ledger and health queries read: it is derived from events, with the same SQL in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RUNS = """
SELECT pipeline_id * 100 + dom AS run_id, pipeline_id, dom, pipeline_id + dom AS k, created_at, ended_at,
  CASE WHEN (pipeline_id + dom) % 11 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS state, (pipeline_id + dom) % 13 = 0 AS dry_run,
  CASE WHEN (pipeline_id + dom) % 5 = 0 AND dom > 1 THEN pipeline_id * 100 + dom - 1 END AS retry_of,
  n AS read, n_signup AS filtered, n_bad AS failed, n - n_signup AS produced,
  greatest(0, n - n_signup - n_bad - CASE WHEN (pipeline_id + dom) % 7 = 0 THEN 1 ELSE 0 END) AS written, {seconds} AS seconds
FROM (SELECT user_id % 12 AS pipeline_id, CAST(day(ts) AS BIGINT) AS dom, min(ts) AS created_at, max(ts) AS ended_at, count(*) AS n,
  count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_signup, count(CASE WHEN event_type = 'error' AND value >= 50 THEN 1 END) AS n_bad
  FROM {events} GROUP BY 1, 2) e
"""
_HEALTH = """
SELECT run_id, pipeline_id, created_at, state, dry_run, retry_of,
  CASE WHEN k % 6 = 0 THEN read * 4 WHEN k % 10 = 4 THEN 0 WHEN k % 9 = 1 THEN CAST(floor(read / 4) AS BIGINT) ELSE read END AS read,
  CASE WHEN k % 6 = 0 THEN filtered WHEN k % 10 = 4 OR k % 9 = 1 THEN 0 ELSE filtered END AS filtered,
  CASE WHEN k % 6 = 0 THEN failed WHEN k % 10 = 4 OR k % 9 = 1 THEN 0 ELSE failed END AS failed,
  CASE WHEN k % 6 = 0 THEN produced * 4 WHEN k % 10 = 4 THEN 0 WHEN k % 9 = 1 THEN CAST(floor(read / 4) AS BIGINT) ELSE produced END AS produced,
  CASE WHEN k % 6 = 0 THEN written * 4 WHEN k % 10 = 4 THEN 0 WHEN k % 9 = 1 THEN CAST(floor(read / 4) AS BIGINT) ELSE written END AS written,
  CASE WHEN k % 8 = 0 THEN seconds * 5 ELSE seconds END AS seconds
FROM {runs} r
"""
_INDEX = """
SELECT concat(CAST(event_id % 4 AS VARCHAR(20)), ':', CAST(seq AS VARCHAR(20)), ':0') AS id, run_id, event_id % 4 AS chunk, seq, CAST(0 AS BIGINT) AS ordinal, CAST(user_id AS VARCHAR(20)) AS record_key,
  CASE WHEN event_type = 'error' AND value >= 50 THEN 'REJECTED' WHEN event_type = 'signup' THEN 'FILTERED' ELSE 'WRITTEN' END AS outcome,
  concat('E', CAST(event_id % 3 AS VARCHAR(20))) AS code, concat('value ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), ' of user ''', CAST(user_id AS VARCHAR(20)), '''  was refused') AS message, ts AS occurred_at, event_id
FROM (SELECT *, (user_id % 12) * 100 + CAST(day(ts) AS BIGINT) AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id % 12, day(ts), event_id % 4 ORDER BY ts, event_id) AS BIGINT) AS seq FROM {events}) e
"""

RUNS = _RUNS.format(events="events", seconds="CAST(floor(epoch(ended_at)) - floor(epoch(created_at)) AS BIGINT)")
#: Common table expressions for DuckDB.
WITH_RUNS = f"WITH RECURSIVE runs AS ({RUNS}), health AS ({_HEALTH.format(runs='runs')}), idx AS ({_INDEX.format(events='events')}), "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = "unix_seconds(CAST(ended_at AS TIMESTAMP)) - unix_seconds(CAST(created_at AS TIMESTAMP))"
    return spark.sql(_RUNS.format(events="{events}", seconds=seconds), events=table(spark, sf_dir, "events"))


def health_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HEALTH, runs=runs(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_INDEX, events=table(spark, sf_dir, "events"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).where("outcome = 'REJECTED'")
