"""Queries of chunk planning, reads, parameters and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckoner.operators import chunks
from reckoner.plans.common import WITH_RUNS, errors, table
from reckoner.sources import params, readers
from reckoner.sources.scratch import folder


def chunk_ranges(spark, sf_dir):
    return chunks.plan_ranges(table(spark, sf_dir, "orders"), "o_orderkey", 1000, 12)


def chunk_assign(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    out = chunks.sequence(chunks.assign(df, "o_orderkey", chunks.plan_ranges(df, "o_orderkey", 1000, 1_000_000_000)), ["o_orderkey"])
    return out.groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("records"), F.max("_seq").alias("last_seq"), F.min("o_orderkey").alias("first_key"))


def chunk_by_count(spark, sf_dir):
    return chunks.plan_by_count(table(spark, sf_dir, "customer"), "c_custkey", 400, 16)


def offset_windows(spark, sf_dir):
    return chunks.offset_windows(table(spark, sf_dir, "lineitem"), 7000)


def offset_rows(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    out = chunks.numbered(table(spark, sf_dir, "lineitem").select(*order), order)
    return out.groupBy(F.floor(F.col("_row") / 7000).alias("window")).agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


def greedy_pack(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count("*").alias("n"))
    return chunks.greedy_pack(parts, "status", "part", "n", 100, 1000).select("status", "part", "n", F.col("_pack").cast("long").alias("pack"))


def decimal_chunks(spark, sf_dir):
    """Keys with fractions in ranges of whole numbers: each belongs to the range of its whole part, and none is lost."""
    df = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(12,2)").alias("k"))
    out = chunks.assign(df, "k", chunks.plan_ranges(df, "k", 7_000, 1_000_000))
    return out.groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("records"), F.min("k").cast("double").alias("least"))


def even_chunks(spark, sf_dir):
    """Ranges of about equally many rows of a key that is not spread evenly: they cover every row, and none has much more than its share."""
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") * F.col("o_custkey")).alias("k"))
    plan = chunks.plan_even(df, "k", 8)
    held = df.join(F.broadcast(plan), df["k"].between(plan["first"], plan["last"])).groupBy("chunk").agg(F.count("*").alias("n"))  # eight rows
    return held.agg(F.count("*").alias("chunks"), F.sum("n").alias("records"), (F.max("n") * 8 < F.sum("n") * 1.5).alias("even"))


def text_key_chunk(spark, sf_dir):
    """A text key makes one chunk."""
    df = table(spark, sf_dir, "customer")
    out = chunks.assign(df, "c_name", chunks.plan_ranges(df, "c_name", 100, 10))
    return out.join(F.broadcast(chunks.plan_by_count(df, "c_name", 100, 10)), F.col("chunk") == F.col("_chunk")).groupBy("chunk").agg(F.count("*").alias("records"), F.count("first").alias("bounded"))


def object_id_chunks(spark, sf_dir):
    """24-digit ids in slices of their key space."""
    df = table(spark, sf_dir, "events").select(chunks.object_id_number(F.substring(F.md5(F.col("event_id").cast("string")), 1, 24)).cast("decimal(38,0)").alias("id"))
    out = chunks.assign(df, "id", chunks.plan_by_count(df, "id", 500, 1000))
    return out.groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("records"))


def topic_offsets(spark, sf_dir):
    """Reads of a topic's partitions in chunks of 700 offsets."""
    bounds = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 3).alias("partition")).agg(F.min("event_id").alias("begin"), (F.max("event_id") + 1).alias("end"))
    empty = bounds.select((F.col("partition") + 3).alias("partition"), "end", F.col("end").alias("begin"))
    return chunks.plan_offsets(bounds.unionByName(empty), 700)


def cursor_pages(spark, sf_dir):
    out = chunks.cursor_pages(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 50)
    return out.select("page", "records", F.col("cursor.c_custkey").alias("cursor"), "dry")


def keyset_resume(spark, sf_dir):
    df = chunks.after(table(spark, sf_dir, "orders"), "o_orderkey", 1000)
    return df.select("o_orderkey", "o_custkey")


def record_keys(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return df.groupBy(chunks.record_key(df, ["l_orderkey", "l_returnflag"]).alias("record_key")).agg(F.count("*").alias("records"))


def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    readers.write_delimited(table(spark, sf_dir, "customer"), path, "pipe")
    df = readers.read_delimited(spark, path, delimiter="pipe")
    return readers.typed_text(df, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def sql_named_params(spark, sf_dir):
    conf = params.pick_query({"queries": [{"name": "all", "sql": "SELECT * FROM {o}"}, {"name": "big", "sql": "SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice >= :least AND o_orderstatus IN (:states)"}]}, "big")
    return params.run_sql(spark, conf["sql"], {"least": "250000", "states": ["P", "F"]}, o=table(spark, sf_dir, "orders"))


def in_list_params(spark, sf_dir):
    return params.in_list(table(spark, sf_dir, "customer"), "c_nationkey", [1, 5, 7]).select("c_custkey", "c_nationkey")


def filter_document(spark, sf_dir):
    doc = {"$or": [{"event_type": ":kind", "value": {"$gte": ":least"}}, {"user_id": {"$in": [3, 4]}}], "event_type": {"$ne": "view"}}
    return table(spark, sf_dir, "events").where(params.filter_column(doc, {"kind": "error", "least": "60"})).select("event_id", "event_type")


def page_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 100)).alias("page"), "event_id", "event_type")
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_id"].alias("id"), x["event_type"].alias("kind")))
    pages = rows.groupBy("page").agg(items.alias("_i")).select("page", F.to_json(F.struct(F.struct(F.col("_i").alias("items")).alias("data"), F.struct((F.col("page") + 1).alias("next")).alias("paging"))).alias("body"))
    out = readers.page_records(pages, "body", "/data/items", "/id", "/paging/next")
    return out.select("page", F.col("index").cast("long").alias("index"), "record_key", F.get_json_object("record", "$.kind").alias("kind"), "cursor")


def message_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, F.col("event_type")).otherwise(F.col("props"))
    return readers.decode_messages(e.select("event_id", value.alias("value"))).select("event_id", "payload", "tombstone")


def message_lineage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("topic"), (F.col("event_id") % 3).alias("partition"), F.col("event_id").alias("offset"), F.lit(0).alias("timestamp"), F.array(F.struct(F.lit("kind").alias("key"), F.col("event_type").alias("value"))).alias("headers"))
    h = readers.lineage(e)
    return e.select("offset", h["source.topic"].alias("topic"), h["source.partition"].alias("partition"), h["header.kind"].alias("kind"))


def typed_text(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("size"))
    return readers.typed_text(df, {"size": "int"})


def preview_limit(spark, sf_dir):
    df = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name")
    rows, _ = readers.preview(df)
    return spark.createDataFrame(rows, df.schema)


def window_bounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day, hour = params.period(F.col("ts"), "UTC", "day", back=1), params.period(F.col("ts"), "UTC", "hour")
    week = params.period(F.col("ts"), "UTC", "week")
    return e.select("event_id", day[0].alias("day_start"), day[1].alias("day_end"), hour[0].alias("hour_start"), week[0].alias("week_start"))


def replay_windows(spark, sf_dir):
    e = errors(spark, sf_dir)
    return readers.dead_letters(e, 105, 5).select("run_id", "chunk", "seq", F.col("window").cast("long").alias("window"))


QUERIES = {f.__name__: f for f in (decimal_chunks, even_chunks, text_key_chunk, object_id_chunks, topic_offsets, cursor_pages, chunk_ranges, chunk_assign, chunk_by_count, offset_windows, offset_rows, greedy_pack, keyset_resume, record_keys, csv_round_trip, sql_named_params, in_list_params, filter_document, page_extract, message_decode, message_lineage, typed_text, preview_limit, window_bounds, replay_windows)}

_STEP = "(SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CASE WHEN ceil((max(o_orderkey) - min(o_orderkey) + 1) / 1000.0) > 12 THEN CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 12.0) AS BIGINT) ELSE 1000 END AS step FROM orders)"
ORACLE_SQL = {
    "decimal_chunks": "WITH p AS (SELECT CAST(o_totalprice AS DECIMAL(12, 2)) AS k FROM orders), b AS (SELECT CAST(floor(min(k)) AS BIGINT) AS lo FROM p) SELECT CAST((CAST(floor(k) AS BIGINT) - lo) // 7000 AS INTEGER) AS chunk, count(*) AS records, CAST(min(k) AS DOUBLE) AS least FROM p, b GROUP BY 1",
    "even_chunks": "SELECT CAST(8 AS BIGINT) AS chunks, count(*) AS records, true AS even FROM orders",
    "text_key_chunk": "SELECT 0 AS chunk, count(*) AS records, CAST(0 AS BIGINT) AS bounded FROM customer HAVING count(*) > 0",
    "object_id_chunks": """WITH i AS (SELECT CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) AS HUGEINT) * 281474976710656 + CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 13, 12) AS BIGINT) AS id FROM events),
      b AS (SELECT min(id) AS lo, (max(id) - min(id)) // CAST(greatest(1, least(1000, ceil(count(*) / 500.0))) AS HUGEINT) + 1 AS step FROM i) SELECT CAST((id - lo) // step AS INTEGER) AS chunk, count(*) AS records FROM i, b GROUP BY 1""",
    "topic_offsets": "WITH b AS (SELECT event_id % 3 AS p, min(event_id) AS lo, max(event_id) + 1 AS hi FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY p, f) - 1 AS chunk, p AS partition, f AS first, least(f + 700, hi) AS last FROM (SELECT p, hi, unnest(range(lo, hi, 700)) AS f FROM b)",
    "cursor_pages": "WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS page FROM customer), p AS (SELECT page, count(*) AS records, max(c_custkey) AS last FROM r GROUP BY 1), e AS (SELECT page, records, last FROM p UNION ALL SELECT n // 50, 0, NULL FROM (SELECT count(*) AS n FROM customer) WHERE n % 50 = 0) SELECT page, records, lag(last) OVER (ORDER BY page) AS cursor, records < 50 AS dry FROM e",
    "chunk_ranges": f"SELECT CAST(i AS INTEGER) AS chunk, lo + i * step AS first, least(lo + (i + 1) * step - 1, hi) AS last FROM {_STEP}, range(0, 12) r(i) WHERE lo + i * step <= hi",
    "chunk_assign": f"SELECT CAST((o_orderkey - lo) // 1000 AS INTEGER) AS chunk, count(*) AS records, count(*) AS last_seq, min(o_orderkey) AS first_key FROM orders, (SELECT min(o_orderkey) AS lo FROM orders) GROUP BY 1",
    "chunk_by_count": "SELECT CAST(i AS INTEGER) AS chunk, lo + i * step AS first, least(lo + (i + 1) * step - 1, hi) AS last FROM (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi, CAST(ceil((max(c_custkey) - min(c_custkey) + 1) / CAST(greatest(1, least(16, ceil(count(*) / 400.0))) AS DOUBLE)) AS BIGINT) AS step FROM customer), range(0, 16) r(i) WHERE lo + i * step <= hi",
    "offset_windows": "SELECT CAST(i AS INTEGER) AS chunk, i * 7000 AS \"offset\", least(7000, n - i * 7000) AS rows FROM (SELECT count(*) AS n FROM lineitem), range(0, 100000) r(i) WHERE i * 7000 < n",
    "offset_rows": "SELECT w AS \"window\", count(*) AS rows, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1) // 7000 AS w FROM lineitem) GROUP BY 1",
    "greedy_pack": """WITH RECURSIVE p AS (SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n FROM orders GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY part) AS i, greatest(100, ceil(sum(n) OVER (PARTITION BY status) / 1000.0)) AS aim FROM p),
      f AS (SELECT status, part, n, i, aim, n AS held, CAST(0 AS BIGINT) AS pack FROM q WHERE i = 1 UNION ALL SELECT q.status, q.part, q.n, q.i, q.aim, CASE WHEN f.held >= f.aim THEN q.n ELSE f.held + q.n END, f.pack + CASE WHEN f.held >= f.aim THEN 1 ELSE 0 END FROM f JOIN q ON q.status = f.status AND q.i = f.i + 1) SELECT status, part, n, pack FROM f""",
    "keyset_resume": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000",
    "record_keys": "SELECT CAST(l_orderkey AS VARCHAR) || '|' || nullif(l_returnflag, 'R') AS record_key, count(*) AS records FROM lineitem GROUP BY 1",
    "csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "sql_named_params": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus IN ('P', 'F')",
    "in_list_params": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 5, 7)",
    "filter_document": "SELECT event_id, event_type FROM events WHERE (event_type = 'error' AND value >= 60 OR user_id IN (3, 4)) AND event_type <> 'view'",
    "page_extract": "SELECT event_id // 100 AS page, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS index, CAST(event_id AS VARCHAR) AS record_key, event_type AS kind, CAST(event_id // 100 + 1 AS VARCHAR) AS cursor FROM events",
    "message_decode": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"value":null}' WHEN event_id % 5 = 1 THEN '{"value":"' || event_type || '"}' ELSE props END AS payload, event_id % 5 = 0 AS tombstone FROM events""",
    "message_lineage": "SELECT event_id AS \"offset\", 'events' AS topic, CAST(event_id % 3 AS VARCHAR) AS partition, event_type AS kind FROM events",
    "typed_text": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, CASE WHEN p_size % 2 <> 0 THEN p_name END AS size_raw FROM part",
    "preview_limit": "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10",
    "window_bounds": "SELECT event_id, CAST(date_trunc('day', ts) - INTERVAL 1 DAY AS TIMESTAMP) AS day_start, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_end, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_start, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start FROM events",
    "replay_windows": WITH_RUNS + "d AS (SELECT * FROM idx WHERE outcome = 'REJECTED' AND run_id = 105) SELECT run_id, chunk, seq, (row_number() OVER (ORDER BY chunk, seq) - 1) // 5 AS \"window\" FROM d",
}
