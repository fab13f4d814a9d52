"""Queries of values between systems, pages, files and writes with verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckoner.operators import chunks, delivery, ledger
from reckoner.plans.common import table
from reckoner.plans.delivering import _G20, _ORDERS, _TARGET, _orders
from reckoner.sources import normal, params, readers
from reckoner.sources.scratch import folder


def sql_types(spark, sf_dir):
    """Columns of a database's kinds as records."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("int").alias("whole"), F.col("o_totalprice").cast("decimal(12,2)").alias("exact"), F.col("o_totalprice").cast("float").alias("near"), (F.col("o_orderkey") % 2 == 0).alias("flag"),
        F.to_date("o_orderdate").alias("day"), (F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 3 * 0.25)")).alias("at"), F.col("o_orderpriority").cast("binary").alias("raw"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("{not json")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(' {"n":'), F.col("o_orderkey").cast("string"), F.lit("}"))).otherwise("text").alias("other"),
    )
    out = normal.records(df, ("other",))
    return out.withColumns({"near": F.round("near", 0), "other": F.to_json("other")})


def document_types(spark, sf_dir):
    """Texts of records as a document stores them."""
    k = F.col("o_orderkey")
    hexes = F.substring(F.md5(k.cast("string")), 1, 24)
    value = F.when(k % 4 == 0, F.concat(F.lit("oid:"), hexes)).when(k % 4 == 1, F.concat(F.lit("oid:"), F.substring(hexes, 1, 8))).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", normal.document_value(value).alias("x")).select("o_orderkey", "x.*")


def bind_types(spark, sf_dir):
    """Texts of records as they are bound to a statement."""
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM")).otherwise("2024-13-45")
    return table(spark, sf_dir, "orders").select("o_orderkey", normal.bound_text(value).alias("x")).select("o_orderkey", "x.*")


def page_requests(spark, sf_dir):
    """Requests that read the orders of each customer by numbers of pages, and by offsets, and where a header leads."""
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    kinds = [normal.page_numbers(sizes, "n", 7, kind).withColumn("kind", F.lit(kind)) for kind in ("PAGE", "OFFSET", "NONE")]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    header = F.concat(F.lit('<https://x/?p=1>; rel="first", <https://x/?p='), (F.col("page") + 1).cast("string"), F.lit('>; rel="next"'))
    return every.select("kind", "o_custkey", "page", "at", normal.next_link(F.when(F.col("page") < 2, header)).alias("next"))


def row_limit(spark, sf_dir):
    """A source's row limit, over a text in a total order."""
    return params.run_sql(spark, "SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice >= :least ORDER BY o_orderkey", {"least": "100000"}, 250, o=table(spark, sf_dir, "orders"))


def window_values(spark, sf_dir):
    """Named values of a schedule's window, and the day of the week."""
    at = F.col("ts")
    named = params.window_values(at, "UTC", {"from": ("day", 1), "to": ("day", 0), "month": ("month", 1)})
    return table(spark, sf_dir, "events").select("event_id", *(v.alias(f"w_{k}") for k, v in named.items()), params.day_of_week(at, "UTC").alias("weekday"))


def packed_parts(spark, sf_dir):
    """Packs of result parts, some of which have no count."""
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count("*").alias("n"))
    unknown = parts.withColumn("n", F.when(F.substring("part", 6, 2) != "07", F.col("n")))
    return chunks.packed(chunks.greedy_pack(unknown, "status", "part", "n", 100, 1000), "status", "n")


def resumed_read(spark, sf_dir):
    """A read that goes on after the last key that the ledger accounts for."""
    df = table(spark, sf_dir, "orders")
    entries = df.where("o_orderkey <= 700").select(F.col("o_orderkey").cast("string").alias("record_key"))
    return chunks.resume(df, "o_orderkey", entries).select("o_orderkey", "o_custkey")


def csv_places(spark, sf_dir):
    """Files of one export by chunk: their records, last place and last key; empty fields are null."""
    path = folder(spark, "places")
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_nationkey")
    df.repartitionByRange(3, "Id").sortWithinPartitions("Id").write.csv(path, header=True, nullValue="")
    out = readers.read_delimited(spark, path, empty_is_null=True, key=["Id"], rows=True)
    first = F.min_by("_key", "_row").cast("long")
    return out.groupBy("_file").agg(F.count("*").alias("records"), F.count("segment").alias("segments"), F.max("_row").alias("last"), first.alias("first_key"), F.min(F.col("_key").cast("long")).alias("least")).agg(
        F.sum("records").alias("records"), F.sum("segments").alias("segments"), F.count_if(F.col("records") == F.col("last")).alias("counted"), F.count_if(F.col("first_key") == F.col("least")).alias("in_order"), F.count("*").alias("files"))


def bulk_insert(spark, sf_dir):
    """Documents that a bulk insert refuses, each by itself."""
    target = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    batch = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    after, judged = delivery.bulk_write(target, batch, "id", "INSERT", "seq")
    told = judged.groupBy(F.coalesce("_error", F.lit("inserted")).alias("result")).agg(F.count("*").alias("records"))
    return told.unionByName(after.agg(F.lit("documents").alias("result"), F.count("*").alias("records")))


def delivery_outcomes(spark, sf_dir):
    """Outcomes of groups whose call failed, or was answered, at a destination that decides later."""
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), 20)
    groups = df.select("_chunk", "_batch", "_group").distinct()
    calls = groups.where("_batch % 3 = 0").select("*", F.lit("timed out").alias("failure"))
    answers = groups.select("*", F.lit(3).alias("index"), F.lit("E1").alias("code"), F.lit("refused").alias("message"))
    return delivery.delivered(df, answers, calls, later=True).groupBy("outcome", F.coalesce("message", F.lit("")).alias("message")).agg(F.count("*").alias("records"))


def late_counters(spark, sf_dir):
    """Counters of each status after late verdicts."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("SENT").alias("outcome"))
    counted = ledger.counters(df, "status").select("status", "written", "failed")
    results = df.where("id % 7 = 0").select("id", F.lit("too late").alias("message"))
    return delivery.settle_counters(counted, delivery.settle(df, results, "id"), "status")


def staged_deletes(spark, sf_dir):
    """A staged export that deletes carries ids only."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), "o_orderstatus")
    out = delivery.staged_export(df, folder(spark, "deletes"), 64 << 10, "\r\n", delete=True)
    return out.agg(F.sum("rows").alias("rows"), F.sum(F.col("bytes") - len("Id\r\n")).alias("bytes"))


def document_reads(spark, sf_dir):
    """Documents with an id, nested values and bytes, read in a range of ids in their order, as records; and the ids turned back."""
    hexed = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 24)
    docs = table(spark, sf_dir, "orders").select(hexed.alias("_id"), F.struct(F.upper(hexed).alias("oid")).alias("ref"), F.array(F.struct(F.col("o_totalprice").cast("decimal(12,2)").alias("exact"), F.to_date("o_orderdate").alias("day"))).alias("parts"), F.create_map(F.lit("raw"), F.col("o_orderstatus").cast("binary")).alias("more"), "o_orderkey")
    rows = readers.read_documents(docs, F.col("o_orderkey") % 2 == 0, first="4", last="c", after="5")
    made = normal.document_records(rows)
    return made.select("o_orderkey", "_key", "ref", F.to_json("parts").alias("parts"), F.col("more")["raw"].alias("raw"), normal.document_value(F.col("ref"))["object_id"].alias("back"))


QUERIES = {f.__name__: f for f in (sql_types, document_types, bind_types, page_requests, row_limit, window_values, packed_parts, resumed_read, csv_places, bulk_insert, delivery_outcomes, late_counters, staged_deletes, document_reads)}

_AT = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
_NEW = f"(SELECT o_custkey AS id FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey NOT IN (SELECT id FROM {_TARGET}))"
ORACLE_SQL = {
    "sql_types": f"""SELECT o_orderkey AS whole, CAST(o_totalprice AS DECIMAL(12, 2)) AS exact, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 0) AS near, o_orderkey % 2 = 0 AS flag, strftime(o_orderdate, '%Y-%m-%d') AS day,
      {_AT} || CASE o_orderkey % 3 WHEN 1 THEN '.250' WHEN 2 THEN '.500' ELSE '' END || 'Z' AS at, base64(encode(o_orderpriority)) AS raw, CASE o_orderkey % 3 WHEN 0 THEN '"{{not json"' WHEN 1 THEN '{{"n":' || o_orderkey || '}}' ELSE '"text"' END AS other FROM orders""",
    "document_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN h END AS object_id, CASE WHEN o_orderkey % 4 = 2 THEN CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) END AS at, CASE o_orderkey % 4 WHEN 1 THEN substr(h, 1, 8) WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS text FROM (SELECT *, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 24) AS h FROM orders)",
    "bind_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 1 THEN CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) END AS at, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN '2024-13-45' END AS text FROM orders",
    "page_requests": """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, unnest(range(0, CAST(ceil(n / 7.0) AS BIGINT))) AS page FROM s), r AS (SELECT 'PAGE' AS kind, o_custkey, page, page + 1 AS at FROM p UNION ALL SELECT 'OFFSET', o_custkey, page, page * 7 FROM p UNION ALL SELECT 'NONE', o_custkey, 0, NULL FROM s)
      SELECT *, CASE WHEN page < 2 THEN 'https://x/?p=' || (page + 1) END AS next FROM r""",
    "row_limit": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_orderkey LIMIT 250",
    "window_values": "SELECT event_id, strftime(date_trunc('day', ts) - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS w_from, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS w_to, strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%SZ') AS w_month, CAST(isodow(ts) AS INTEGER) AS weekday FROM events",
    "packed_parts": """WITH RECURSIVE p AS (SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS part, CASE WHEN month(o_orderdate) <> 7 THEN count(*) END AS n FROM orders GROUP BY 1, 2, month(o_orderdate)), q AS (SELECT *, coalesce(n, 0) AS m, row_number() OVER (PARTITION BY status ORDER BY part) AS i, greatest(100, ceil(sum(n) OVER (PARTITION BY status) / 1000.0)) AS aim FROM p),
      f AS (SELECT status, part, n, i, aim, m AS held, CAST(0 AS BIGINT) AS pack FROM q WHERE i = 1 UNION ALL SELECT q.status, q.part, q.n, q.i, q.aim, CASE WHEN f.held >= f.aim THEN q.m ELSE f.held + q.m END, f.pack + CASE WHEN f.held >= f.aim THEN 1 ELSE 0 END FROM f JOIN q ON q.status = f.status AND q.i = f.i + 1)
      SELECT status, pack, count(*) AS parts, CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS BIGINT) ELSE 0 END AS planned FROM f GROUP BY 1, 2""",
    "resumed_read": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT coalesce(max(o_orderkey), -1) FROM orders WHERE o_orderkey <= 700)",
    "csv_places": "SELECT count(*) AS records, count(nullif(c_mktsegment, 'BUILDING')) AS segments, 3 AS counted, 3 AS in_order, 3 AS files FROM customer",
    "bulk_insert": f"""SELECT 'inserted' AS result, count(DISTINCT id) AS records FROM {_NEW} UNION ALL SELECT 'a document has no key', count(*) FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'a document with this key exists', (SELECT count(*) FROM orders WHERE o_orderkey % 9 <> 0) - (SELECT count(DISTINCT id) FROM {_NEW})
      UNION ALL SELECT 'documents', (SELECT count(*) FROM {_TARGET}) + (SELECT count(DISTINCT id) FROM {_NEW})""",
    "delivery_outcomes": f"SELECT outcome, message, count(*) AS records FROM (SELECT CASE WHEN batch % 3 = 0 THEN 'CALL_FAILED' WHEN (seq - 1) % 20 = 3 THEN 'REJECTED' ELSE 'SENT' END AS outcome, CASE WHEN batch % 3 = 0 THEN 'timed out' WHEN (seq - 1) % 20 = 3 THEN 'refused' ELSE '' END AS message FROM {_G20}) GROUP BY 1, 2",
    "late_counters": "SELECT o_orderstatus AS status, count(*) FILTER (o_orderkey % 7 <> 0) AS written, count(*) FILTER (o_orderkey % 7 = 0) AS failed FROM orders GROUP BY 1",
    "document_reads": """SELECT o_orderkey, h AS _key, 'oid:' || h AS ref, '[{"exact":' || CAST(o_totalprice AS DECIMAL(12, 2)) || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}]' AS parts, base64(encode(o_orderstatus)) AS raw, h AS back FROM (SELECT *, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 24) AS h FROM orders) WHERE o_orderkey % 2 = 0 AND h > '5' AND h <= 'c'""",
    "staged_deletes": "SELECT count(*) AS rows, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 2) AS BIGINT) AS bytes FROM orders",
}
