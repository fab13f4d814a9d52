"""Queries of outcomes, errors, the record index and reconciliation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions import paths
from reckoner.operators import chunks, delivery, ledger, payloads, reports
from reckoner.operators.mapper import apply_mapping, apply_rules
from reckoner.plans.common import WITH_RUNS, errors, index, runs, table
from reckoner.sources.scratch import folder

#: Keys of a chunk, the bound of its windows; their number grows with the table, far beyond any run's.
CHUNK, MOST_CHUNKS = 1_000, 1_000_000_000
_MAP = {"mappings": [{"from": "o_orderkey", "to": "orderNumber", "required": True}, {"from": "o_totalprice", "to": "amount", "type": "NUMBER"}, {"from": "o_orderstatus", "to": "stage", "values": {"P": "Pending", "F": "Finished", "O": "Open"}}, {"to": "source", "default": "orders"}]}
_LEAST = {"rules": [{"field": "amount", "check": "MIN", "value": 20000}]}
_OPEN = {"rules": [{"field": "stage", "check": "ONE_OF", "value": ["Pending", "Finished"]}], "onFail": "DROP"}


def outcomes(spark, sf_dir, source=False):
    """orders in chunks, mapped, judged, each with its outcome; with source, each carries what was read."""
    df = table(spark, sf_dir, "orders")
    df = payloads.with_source(df) if source else df
    df = chunks.sequence(chunks.assign(df, "o_orderkey", chunks.plan_ranges(df, "o_orderkey", CHUNK, MOST_CHUNKS)), ["o_orderkey"])
    return judged(df.withColumns({"_key": F.col("o_orderkey").cast("string"), "_at": F.col("o_orderdate")}))


def judged(df):
    df = apply_rules(apply_rules(apply_mapping(df, _MAP), _OPEN).withColumnRenamed("_filtered", "_dropped"), _LEAST)
    return ledger.with_outcome(df.withColumn("_filtered", F.col("_dropped")).withColumn("_error", F.when(~F.col("_dropped"), F.col("_error"))))


_OUTCOMES = "(SELECT o_orderkey, o_orderdate, CAST((o_orderkey - lo) // step AS INTEGER) AS chunk, CASE WHEN o_orderstatus = 'O' THEN 'FILTERED' WHEN o_totalprice < 20000 THEN 'TRANSFORM_FAILED' ELSE 'WRITTEN' END AS outcome FROM orders, (SELECT min(o_orderkey) AS lo, 1000 AS step FROM orders))"


def outcome_counts(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("records"))


def chunk_counters(spark, sf_dir):
    return ledger.counters(outcomes(spark, sf_dir), "_chunk").withColumnRenamed("_chunk", "chunk")


def dry_run_counts(spark, sf_dir):
    """What a write would have done: the same plan without it."""
    return ledger.counters(outcomes(spark, sf_dir))


def record_index(spark, sf_dir):
    df = outcomes(spark, sf_dir)
    return ledger.record_index(df, F.col("_key"), F.col("_at")).select("id", "trace_id", "record_key", "outcome", "occurred_at", "expires_at")


def fanout_index_identity(spark, sf_dir):
    """Lines of orders as siblings of one record; indexing twice changes nothing."""
    df = table(spark, sf_dir, "lineitem")
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", *(c for c in df.columns if c not in ("l_orderkey", "l_linenumber")))
    df = df.select(F.lit(0).alias("_chunk"), F.col("l_orderkey").alias("_seq"), (F.row_number().over(place) - 1).alias("_ordinal")).withColumns({"outcome": F.lit("WRITTEN"), "error_code": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
    one = ledger.record_index(df, F.col("_seq").cast("string"), F.lit("2024-01-01").cast("timestamp"))
    twice = ledger.latest_entries(one.unionByName(one), "occurred_at")
    return twice.groupBy("record_key").agg(F.count("*").alias("entries"), F.max("ordinal").cast("long").alias("last_ordinal"))


def error_signatures(spark, sf_dir):
    return ledger.signatures(errors(spark, sf_dir)).select("run_id", "signature", "errors", "first_seen", "last_seen", "sample")


def signature_samples(spark, sf_dir):
    return ledger.sample_errors(errors(spark, sf_dir), 2, ["chunk", "seq", "ordinal"]).select("run_id", "signature", "id")


def dead_letters(spark, sf_dir):
    return errors(spark, sf_dir).where("run_id = 105").orderBy("chunk", "seq").limit(1000).select("id", "record_key", "code", "message")


def rejection_breach(spark, sf_dir):
    batches = index(spark, sf_dir).groupBy("chunk", F.floor(F.col("event_id") / 500).alias("batch")).agg(F.count("*").alias("produced"), F.count_if(F.col("outcome") == "REJECTED").alias("failed"))
    return ledger.first_breaches(batches, 60, 8)


def shortfall(spark, sf_dir):
    """Chunks whose planned rows differ from those read."""
    df = table(spark, sf_dir, "orders")
    read = chunks.assign(df.where("o_orderkey % 311 <> 0"), "o_orderkey", chunks.plan_ranges(df, "o_orderkey", CHUNK, MOST_CHUNKS)).groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("read"))
    plan = chunks.plan_ranges(df, "o_orderkey", CHUNK, MOST_CHUNKS).select("chunk", (F.col("last") - F.col("first") + 1).alias("planned"))
    return reports.shortfall(plan, read)


def redact_modes(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("who"), F.col("c_name").alias("name"))
    out = paths.redact(df, {"/who/name": "MASK", "/who/segment": "DROP", "/name": "HASH"})
    return out.select("c_custkey", F.to_json("who").alias("who"), "name")


def payload_ceiling(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("payload"))
    return df.select("o_orderkey", paths.ceiling(F.col("payload"), F.col("o_orderkey").cast("string"), 48).alias("payload"))


def retention_purge(spark, sf_dir):
    df = ledger.record_index(outcomes(spark, sf_dir), F.col("_key"), F.col("_at"))
    return ledger.retained(df, F.lit("2000-01-01").cast("timestamp")).select("id", "expires_at")


def record_search(spark, sf_dir):
    found = ledger.search(index(spark, sf_dir), outcome="REJECTED", since="2024-01-05", until="2024-01-20", value="E1")
    return ledger.page(found, [F.desc("occurred_at"), "id"], 50, 1).select("id", "record_key", "occurred_at")


def key_history(spark, sf_dir):
    return ledger.search(index(spark, sf_dir), key="7").select("run_id", "id", "outcome", "occurred_at")


def stage_cycles(spark, sf_dir):
    """Stages of each trace, and what each lost."""
    df = outcomes(spark, sf_dir).withColumn("batch", F.floor((F.col("_seq") - 1) / 50).cast("int"))
    stages = df.groupBy(F.concat_ws("#", F.col("_chunk").cast("string"), F.col("batch").cast("string")).alias("trace_id")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "WRITTEN").alias("w"))
    rows = F.array(F.struct(F.lit("TRANSFORM").alias("stage"), F.col("n").alias("records_in"), F.col("w").alias("records_out")), F.struct(F.lit("WRITE").alias("stage"), F.col("w").alias("records_in"), F.col("w").alias("records_out")))
    return stages.select("trace_id", F.explode(rows).alias("x")).select("trace_id", "x.*").withColumn("delta", F.col("records_out") - F.col("records_in"))


def _counted(spark, sf_dir):
    return runs(spark, sf_dir).join(ledger.outcome_counts(index(spark, sf_dir)), "run_id", "left")


def reconciliation_sheet(spark, sf_dir):
    return ledger.sheet(_counted(spark, sf_dir))


def reconciliation_checks(spark, sf_dir):
    return ledger.checks(_counted(spark, sf_dir))


def reconciliation_verdict(spark, sf_dir):
    df = _counted(spark, sf_dir)
    return df.select("run_id", ledger.verdict(df).alias("verdict"))


def reconciliation_report(spark, sf_dir):
    """Sheet, checks and verdict of each run as one list of lines."""
    text = lambda c: F.col(c).cast("string")
    lines = reconciliation_sheet(spark, sf_dir).select("run_id", F.lit("SHEET").alias("section"), "label", text("value").alias("value"), F.lit("").alias("detail"))
    tests = reconciliation_checks(spark, sf_dir).select("run_id", F.lit("CHECK").alias("section"), F.col("check").alias("label"), text("counted").alias("value"), text("indexed").alias("detail"))
    said = reconciliation_verdict(spark, sf_dir).select("run_id", F.lit("VERDICT").alias("section"), F.lit("").alias("label"), F.col("verdict").alias("value"), F.lit("").alias("detail"))
    return lines.unionByName(tests).unionByName(said)


def reconciliation_sheet_orders(spark, sf_dir):
    """The slice from end to end: chunks, mapping, rules, outcomes, counters against the index, sheet with verdict."""
    df = outcomes(spark, sf_dir)
    counted = ledger.counters(df, F.lit(1).alias("run_id")).withColumn("state", F.lit("COMPLETED"))
    again = ledger.outcome_counts(ledger.record_index(df, F.col("_key"), F.col("_at")).withColumn("run_id", F.lit(1)))
    both = counted.join(again, "run_id")
    return ledger.sheet(both).join(both.select("run_id", ledger.verdict(both).alias("verdict")), "run_id").drop("run_id")


def reconciliation_written_index(spark, sf_dir):
    """Counters as they were when the index was written, against the index as it is read back."""
    path = folder(spark, "index")
    counted = ledger.write_index(ledger.record_index(outcomes(spark, sf_dir), F.col("_key"), F.col("_at")), path)
    both = ledger.counted_run(spark, 1, counted).join(ledger.outcome_counts(spark.read.parquet(path).withColumn("run_id", F.lit(1).cast("long"))), "run_id", "left")
    return ledger.sheet(both).join(both.select("run_id", ledger.verdict(both).alias("verdict")), "run_id").drop("run_id")


def replay_run(spark, sf_dir):
    """The failed orders of a run, out of its stored payloads, with their amounts put right and sent through the same pipeline into a new run."""
    path = folder(spark, "payloads")
    payloads.store(payloads.letters(outcomes(spark, sf_dir, source=True), F.col("_key"), F.col("_at")), path, 1)
    waiting = payloads.replay(spark, path, 1)
    read = waiting.select("_chunk", "_seq", "_wanted", "_replay_of", F.col("record_key").alias("_key"), payloads.from_json(F.col("payload"), table(spark, sf_dir, "orders").schema).alias("r")).select("*", "r.*").drop("r")
    fixed = read.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 20000).otherwise(F.col("o_totalprice")))
    again = payloads.only_failed(judged(fixed).withColumn("_ordinal", F.lit(0)))
    return again.select(F.col("_key").alias("record_key"), F.col("_replay_of").cast("int").alias("replay_of"), "outcome")


_ITEMS = [("A", "l_quantity < 10"), ("B", "l_returnflag = 'R'")]


def _line_outputs(df):
    """Two outputs of each line of an order, either of which may be refused."""
    out = delivery.fan_out(df, F.array(*(F.lit(k) for k, _ in _ITEMS)))
    refused = F.expr(" OR ".join(f"(item = '{k}' AND {rule})" for k, rule in _ITEMS))
    return out.withColumns({"outcome": F.when(refused, "REJECTED").otherwise("WRITTEN"), "error_code": F.when(refused, "E1"), "error_message": F.when(refused, F.concat(F.lit("output "), "item", F.lit(" was refused")))})


def replay_places(spark, sf_dir):
    """Lines of orders, whose keys repeat or are null, as two outputs each: exactly those that failed are sent again, out of what was to be delivered, and out of what was read by way of the transform."""
    path, names = folder(spark, "payloads"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    df = table(spark, sf_dir, "lineitem").select(*names, F.xxhash64("_metadata.file_name").alias("_chunk"), F.col("_metadata.row_index").alias("_seq"))
    df = payloads.with_source(df, names).withColumn("_key", F.when(F.col("l_linenumber") != 3, F.col("l_orderkey").cast("string")))
    payloads.store(payloads.letters(_line_outputs(df), F.col("_key"), F.lit("2024-01-01").cast("timestamp")), path, 1)
    schema = table(spark, sf_dir, "lineitem").select(*names).schema
    as_is = payloads.replay(spark, path, 1, transforms=False).select("record_key", payloads.from_json(F.col("payload"), T.StructType([*schema.fields, T.StructField("item", T.StringType())])).alias("r"))
    again = payloads.replay(spark, path, 1).select("_chunk", "_seq", "_wanted", "record_key", payloads.from_json(F.col("payload"), schema).alias("r")).select("_chunk", "_seq", "_wanted", "record_key", "r.*")
    again = payloads.only_failed(_line_outputs(again)).select("record_key", F.struct("l_quantity", "item").alias("r"))
    both = as_is.select(F.lit("as it was").alias("sent"), "record_key", "r.l_quantity", "r.item").unionByName(again.select(F.lit("transformed").alias("sent"), "record_key", "r.l_quantity", "r.item"))
    return both.groupBy("sent", "record_key", "item").agg(F.count("*").alias("records"), F.sum("l_quantity").cast("double").alias("quantity"))


def _with_payloads(spark, sf_dir):
    """Index entries with what was delivered (nested) and what was read (JSON of the source)."""
    props = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    df = index(spark, sf_dir).withColumn("id", F.concat_ws("/", F.col("run_id").cast("string"), "id")).withColumn("pipeline_id", F.floor(F.col("run_id") / 100)).join(props, "event_id")
    record = F.to_json(F.struct(F.struct(F.col("record_key").cast("long").alias("id"), F.array(F.struct(F.col("event_type").alias("kind")), F.struct(F.lit("a/b").alias("kind"))).alias("seen")).alias("user")))
    return df.withColumns({"record": record, "source": F.col("props")})


def payload_search(spark, sf_dir):
    """Entries of a pipeline with a value in any field of either payload, those with it in one field, and the number of all: the first page."""
    df = _with_payloads(spark, sf_dir)
    anywhere = ledger.search(df, value="69", pipeline=9, payloads=("record", "source")).withColumn("asked", F.lit("any"))
    one = ledger.search(df, value="click", run=105, payloads=("record", "source"), field="user.seen.0.kind").withColumn("asked", F.lit("one"))
    return anywhere.unionByName(one).groupBy("asked", "run_id").agg(F.count("*").alias("entries"), F.min("id").alias("first_id"))


def redact_nested(spark, sf_dir):
    """Masks inside JSON text and inside elements of arrays."""
    text = F.concat(F.lit('{"who": {"name":"'), "c_name", F.lit('", "n" : 1.50},"tags":[{"m":"'), "c_mktsegment", F.lit('"},{"m":7}],"last":null}'))
    seen = F.array(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), F.struct(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("nation")))
    df = table(spark, sf_dir, "customer").select("c_custkey", text.alias("payload"), seen.alias("seen"))
    out = paths.redact(df, {"/payload/who/name": "MASK", "/payload/tags/0/m": "HASH", "/payload/tags/1": "MASK", "/payload/who/none": "MASK", "/seen/1/name": "MASK", "/seen/0/nation": "MASK"})
    out = paths.redact(out, {"/payload/last": "DROP"})
    return out.select("c_custkey", "payload", F.to_json("seen").alias("seen"))


def audit_levels(spark, sf_dir):
    """Entries that each level of auditing keeps of the index."""
    entries = index(spark, sf_dir)
    kept = [ledger.audited(entries, level).groupBy("outcome").agg(F.count("*").alias("entries")).withColumn("level", F.lit(level)) for level in ("COUNTERS", "ERRORS", "INDEXED")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def errors_by_node(spark, sf_dir):
    """Errors of runs by the name of the node that raised them; nodes without a name go by their id."""
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("node_id"), F.when(F.col("n_nationkey") > 0, F.col("n_name")).alias("name"))
    return ledger.by_node(errors(spark, sf_dir).withColumn("node_id", F.col("code")), nodes)


def stage_log_cycles(spark, sf_dir):
    """The index joined with the stage log on trace ids: what each cycle took in, lost and kept."""
    df = outcomes(spark, sf_dir).withColumn("_batch", F.floor((F.col("_seq") - 1) / 50).cast("int"))
    entries = ledger.record_index(df, F.col("_key"), F.col("_at"))
    log = ledger.stage_log(df, [("TRANSFORM", F.lit(True), F.col("outcome") != ledger.TRANSFORM_FAILED), ("FILTER", F.col("outcome") != ledger.TRANSFORM_FAILED, F.col("outcome") == ledger.WRITTEN)])
    return ledger.cycles(entries, log)


def index_payloads(spark, sf_dir):
    """Index entries with what was delivered, and with what was read where mapping made a difference."""
    df = outcomes(spark, sf_dir, source=True)
    fields = [c for c in df.columns if not c.startswith("_") and c not in ("outcome", "error_code", "error_message")]
    out = ledger.record_index(df, F.col("_key"), F.col("_at"), record=payloads.as_json(df, fields), source=F.col("_source"))
    return out.select("record_key", F.get_json_object("record", "$.stage").alias("stage"), F.get_json_object("source", "$.o_orderstatus").alias("status"))


def stage_log_run(spark, sf_dir):
    """What each stage of a run took in and gave, counted while the run wrote its records."""
    log = ledger.StageLog(spark, 1)
    read = table(spark, sf_dir, "orders")
    kept = log.stage("FILTER", read, lambda d: d.where("o_orderstatus <> 'O'"), "rules")
    out = log.stage("FAN_OUT", kept, lambda d: d.select("o_orderkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("item")), "split")
    path = folder(spark, "written")
    log.ran(lambda: log.stage("WRITE", out, lambda d: d).write.parquet(path))
    log.ran(lambda: log.stage("REPORT", spark.read.schema(out.schema).parquet(path), lambda d: d.groupBy("item").count()).collect())
    found = ledger.find_stages(log.entries(), run=1, outcome="DONE")
    return found.select("position", "stage", "node_id", "records_in", "records_out", "delta", (F.col("duration_ms") >= 0).alias("timed"))


def error_list(spark, sf_dir):
    """A page of a run's dead letters of one fault, with the number of all."""
    own = reports.error_page(errors(spark, sf_dir), 105, 2, 1, "E1|value ? of user ? was refused")
    return own.select("id", "code", "total")


QUERIES = {f.__name__: f for f in (outcome_counts, chunk_counters, dry_run_counts, record_index, fanout_index_identity, error_signatures, signature_samples, dead_letters, rejection_breach, shortfall, redact_modes, payload_ceiling, retention_purge, record_search, key_history, stage_cycles, reconciliation_sheet, reconciliation_checks, reconciliation_verdict, reconciliation_report, reconciliation_sheet_orders, reconciliation_written_index, replay_run, replay_places, payload_search, redact_nested, index_payloads, stage_log_run, error_list, audit_levels, errors_by_node, stage_log_cycles)}

_SEQ = f"(SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY o_orderkey) AS seq FROM {_OUTCOMES})"
_COUNTS = "count(*) AS \"read\", count(*) FILTER (outcome = 'FILTERED') AS filtered, count(*) FILTER (outcome <> 'FILTERED') AS produced, count(*) FILTER (outcome = 'WRITTEN') AS written, count(*) FILTER (outcome = 'TRANSFORM_FAILED') AS failed"
_ERR = WITH_RUNS + "err AS (SELECT *, code || '|value ? of user ? was refused' AS signature FROM idx WHERE outcome = 'REJECTED') "
_BOTH = WITH_RUNS + "n AS (SELECT run_id, count(*) FILTER (outcome = 'WRITTEN') AS n_written, count(*) FILTER (outcome = 'REJECTED') AS n_rejected, count(*) FILTER (outcome = 'FILTERED') AS n_filtered FROM idx GROUP BY 1), b AS (SELECT * FROM runs LEFT JOIN n USING (run_id)), "
_SHEET = "sheet AS (SELECT run_id, CAST(line AS INTEGER) AS line, label, CAST(value AS BIGINT) AS value FROM (SELECT run_id, unnest([1, 2, 3, 4, 5, 6, 7, 9]) AS line, unnest(['Read', 'Filtered', 'Produced', 'Written', 'Transform failed', 'Rejected', 'Call failed', 'Unaccounted']) AS label, unnest([\"read\", filtered, produced, written, 0, n_rejected, 0, produced - written - failed]) AS value FROM b)), "
_CHECKS = "checks AS (SELECT *, counted = indexed AS passed FROM (SELECT run_id, unnest(['written', 'failed', 'filtered', 'total']) AS \"check\", unnest([written, failed, filtered, produced + filtered]) AS counted, unnest([n_written, n_rejected, n_filtered, n_written + n_rejected + n_filtered]) AS indexed FROM b)), "
_VERDICT = "verdicts AS (SELECT run_id, CASE WHEN produced - written - failed <> 0 OR \"read\" - filtered > produced OR written <> n_written OR failed <> n_rejected OR filtered <> n_filtered THEN 'DISCREPANCY' ELSE 'BALANCED' END AS verdict FROM b) "
ORACLE_SQL = {
    "outcome_counts": f"SELECT outcome, count(*) AS records FROM {_OUTCOMES} GROUP BY 1",
    "chunk_counters": f"SELECT chunk, {_COUNTS} FROM {_OUTCOMES} GROUP BY 1",
    "dry_run_counts": f"SELECT {_COUNTS} FROM {_OUTCOMES}",
    "record_index": f"SELECT chunk || ':' || seq || ':0' AS id, chunk || '#0' AS trace_id, CAST(o_orderkey AS VARCHAR) AS record_key, outcome, o_orderdate AS occurred_at, o_orderdate + INTERVAL 365 DAY AS expires_at FROM {_SEQ}",
    "fanout_index_identity": "SELECT CAST(l_orderkey AS VARCHAR) AS record_key, count(*) AS entries, count(*) - 1 AS last_ordinal FROM lineitem GROUP BY 1",
    "error_signatures": _ERR + "SELECT run_id, signature, count(*) AS errors, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, arg_min(message, (occurred_at, seq)) AS sample FROM err GROUP BY 1, 2",
    "signature_samples": _ERR + "SELECT run_id, signature, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, signature ORDER BY chunk, seq, ordinal) AS n FROM err) WHERE n <= 2",
    "dead_letters": _ERR + "SELECT id, record_key, code, message FROM err WHERE run_id = 105 ORDER BY chunk, seq LIMIT 1000",
    "rejection_breach": WITH_RUNS + """t AS (SELECT chunk, event_id // 500 AS batch, count(*) AS p, count(*) FILTER (outcome = 'REJECTED') AS f FROM idx GROUP BY 1, 2), u AS (SELECT chunk, batch, CAST(sum(p) OVER w AS BIGINT) AS produced, CAST(sum(f) OVER w AS BIGINT) AS failed, batch = max(batch) OVER (PARTITION BY chunk) AS fin FROM t WINDOW w AS (PARTITION BY chunk ORDER BY batch)),
      v AS (SELECT *, CASE WHEN failed >= 60 THEN 'COUNT:' || failed WHEN failed > 0 AND failed * 100 // produced >= 8 AND (fin OR produced >= 100) THEN 'PERCENT:' || failed * 100 // produced END AS breach FROM u) SELECT chunk, batch, produced, failed, breach FROM v WHERE breach IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY batch) = 1""",
    "shortfall": f"SELECT chunk, count(*) AS planned, count(*) FILTER (o_orderkey % 311 <> 0) AS \"read\" FROM {_OUTCOMES} GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 311 = 0) > 0",
    "redact_modes": """SELECT c_custkey, '{"name":"***","nation":' || c_nationkey || '}' AS who, 'sha256:' || substr(sha256(c_name), 1, 16) AS name FROM customer""",
    "payload_ceiling": """SELECT o_orderkey, CASE WHEN length(p) > 48 THEN '{"_truncated":true,"_bytes":' || length(p) || ',"_id":"' || o_orderkey || '"}' ELSE p END AS payload FROM (SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS p FROM orders)""",
    "retention_purge": f"SELECT chunk || ':' || seq || ':0' AS id, o_orderdate + INTERVAL 365 DAY AS expires_at FROM {_SEQ} WHERE o_orderdate + INTERVAL 365 DAY > TIMESTAMP '2000-01-01'",
    "record_search": WITH_RUNS + "d AS (SELECT * FROM idx WHERE outcome = 'REJECTED' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at <= TIMESTAMP '2024-01-20' AND code = 'E1') SELECT id, record_key, occurred_at FROM d ORDER BY occurred_at DESC, id LIMIT 50 OFFSET 50",
    "key_history": WITH_RUNS + "d AS (SELECT * FROM idx WHERE record_key = '7') SELECT run_id, id, outcome, occurred_at FROM d",
    "replay_run": "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, 1 AS replay_of, CASE WHEN o_orderkey % 2 = 0 THEN 'WRITTEN' ELSE 'TRANSFORM_FAILED' END AS outcome FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice < 20000",
    "replay_places": "WITH f AS (SELECT CASE WHEN l_linenumber <> 3 THEN CAST(l_orderkey AS VARCHAR) END AS record_key, 'A' AS item, l_quantity FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT CASE WHEN l_linenumber <> 3 THEN CAST(l_orderkey AS VARCHAR) END, 'B', l_quantity FROM lineitem WHERE l_returnflag = 'R') SELECT sent, record_key, item, count(*) AS records, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM f, (VALUES ('as it was'), ('transformed')) s(sent) GROUP BY 1, 2, 3",
    "payload_search": WITH_RUNS + "d AS (SELECT idx.*, e.event_type, json_extract_string(e.props, '$.k') AS k, run_id || '/' || id AS full_id FROM idx JOIN events e USING (event_id)) SELECT 'any' AS asked, run_id, count(*) AS entries, min(full_id) AS first_id FROM d WHERE run_id // 100 = 9 AND (record_key = '69' OR k = '69') GROUP BY 1, 2 UNION ALL SELECT 'one', run_id, count(*), min(full_id) FROM d WHERE run_id = 105 AND event_type = 'click' GROUP BY 1, 2",
    "redact_nested": """SELECT c_custkey, '{"who": {"name":"***", "n" : 1.50},"tags":[{"m":"sha256:' || substr(sha256(c_mktsegment), 1, 16) || '"},{"m":7}]}' AS payload, '[{"name":"' || c_name || '","nation":"***"},{"name":"***","nation":"' || c_nationkey || '"}]' AS seen FROM customer""",
    "index_payloads": "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Finished' ELSE 'Open' END AS stage, o_orderstatus AS status FROM orders",
    "stage_log_run": "WITH n AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus <> 'O') AS b, (SELECT count(*) FROM (SELECT o_orderstatus FROM orders WHERE o_orderstatus <> 'O' UNION SELECT o_orderpriority FROM orders WHERE o_orderstatus <> 'O')) AS c FROM orders) SELECT 0 AS position, 'FILTER' AS stage, 'rules' AS node_id, a AS records_in, b AS records_out, b - a AS delta, true AS timed FROM n UNION ALL SELECT 1, 'FAN_OUT', 'split', b, 2 * b, b, true FROM n UNION ALL SELECT 2, 'WRITE', NULL, 2 * b, 2 * b, 0, true FROM n UNION ALL SELECT 3, 'REPORT', NULL, 2 * b, c, c - 2 * b, true FROM n",
    "error_list": _ERR + "SELECT id, code, (SELECT count(*) FROM err WHERE run_id = 105 AND code = 'E1') AS total FROM err WHERE run_id = 105 AND code = 'E1' ORDER BY chunk, seq LIMIT 2 OFFSET 2",
    "audit_levels": WITH_RUNS + "d AS (SELECT outcome, count(*) AS entries FROM idx GROUP BY 1) SELECT outcome, entries, 'INDEXED' AS level FROM d UNION ALL SELECT outcome, entries, 'ERRORS' FROM d WHERE outcome = 'REJECTED'",
    "errors_by_node": _ERR + "SELECT run_id, CASE WHEN n_nationkey > 0 THEN n_name ELSE code END AS node, count(*) AS errors FROM err LEFT JOIN nation ON code = 'E' || n_nationkey GROUP BY 1, 2",
    "stage_log_cycles": f"SELECT trace_id, n AS entries, w AS written, unnest(['TRANSFORM', 'FILTER']) AS stage, unnest([n, n - t]) AS records_in, unnest([n - t, w]) AS records_out FROM (SELECT chunk || '#' || (seq - 1) // 50 AS trace_id, count(*) AS n, count(*) FILTER (outcome = 'WRITTEN') AS w, count(*) FILTER (outcome = 'TRANSFORM_FAILED') AS t FROM {_SEQ} GROUP BY 1)",
    "stage_cycles": f"SELECT trace_id, unnest(['TRANSFORM', 'WRITE']) AS stage, unnest([n, w]) AS records_in, unnest([w, w]) AS records_out, unnest([w - n, 0]) AS delta FROM (SELECT chunk || '#' || (seq - 1) // 50 AS trace_id, count(*) AS n, count(*) FILTER (outcome = 'WRITTEN') AS w FROM {_SEQ} GROUP BY 1)",
    "reconciliation_sheet": _BOTH + _SHEET.rstrip(", ") + " SELECT run_id, line, label, value FROM sheet",
    "reconciliation_checks": _BOTH + _CHECKS.rstrip(", ") + ' SELECT run_id, "check", counted, indexed, passed FROM checks',
    "reconciliation_verdict": _BOTH + _VERDICT + "SELECT run_id, verdict FROM verdicts",
    "reconciliation_report": _BOTH + _SHEET + _CHECKS + _VERDICT + "SELECT run_id, 'SHEET' AS section, label, CAST(value AS VARCHAR) AS value, '' AS detail FROM sheet UNION ALL SELECT run_id, 'CHECK', \"check\", CAST(counted AS VARCHAR), CAST(indexed AS VARCHAR) FROM checks UNION ALL SELECT run_id, 'VERDICT', '', verdict, '' FROM verdicts",
    "reconciliation_sheet_orders": f"SELECT CAST(unnest([1, 2, 3, 4, 5, 6, 7, 9]) AS INTEGER) AS line, unnest(['Read', 'Filtered', 'Produced', 'Written', 'Transform failed', 'Rejected', 'Call failed', 'Unaccounted']) AS label, unnest([\"read\", filtered, produced, written, failed, 0, 0, produced - written - failed]) AS value, 'BALANCED' AS verdict FROM (SELECT {_COUNTS} FROM {_OUTCOMES})",
}
ORACLE_SQL["reconciliation_written_index"] = ORACLE_SQL["reconciliation_sheet_orders"]
