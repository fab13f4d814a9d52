"""Queries of batches, groups, user functions and writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from reckoner.operators import chunks, delivery, mapper
from reckoner.plans.common import table
from reckoner.sources import readers
from reckoner.sources.scratch import folder


#: Records of a chunk: the bound of every window and of every task that works on a chunk.
CHUNK = 1_000


def _orders(spark, sf_dir, columns=("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")):
    """orders in chunks of CHUNK rows, as many as the table needs, with a place in each and the size of the record; of all columns that a query may need, or of those that it names (without the priority there is no size)."""
    orders = table(spark, sf_dir, "orders").select(*columns)
    rows = chunks.numbered(orders, ["o_orderkey"])
    df = rows.withColumns({"_chunk": F.floor(F.col("_row") / CHUNK).cast("int"), "_seq": F.col("_row") % CHUNK + 1}).drop("_row")
    df = df.repartition(chunks.tasks(orders), "_chunk")  # what goes on by chunk, batch or group stays there
    return df.withColumn("_bytes", F.length("o_orderpriority") + 20) if "o_orderpriority" in columns else df


_ORDERS = f"(SELECT * EXCLUDE (place), CAST((place - 1) // {CHUNK} AS INTEGER) AS chunk, (place - 1) % {CHUNK} + 1 AS seq FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders))"


def _siblings(spark, sf_dir):
    """Three siblings of each order, with values that fall."""
    df = _orders(spark, sf_dir)
    out = delivery.fan_out(df, F.array(F.lit("z"), F.col("o_orderstatus"), F.lit("A")))
    return out.withColumn("_bytes", F.when(F.col("item") == "z", 300).otherwise(F.col("_bytes")))


_SIBLINGS = f"(SELECT chunk, seq, ordinal, o_orderkey, ['z', o_orderstatus, 'A'][ordinal + 1] AS item, CASE WHEN ordinal = 0 THEN 300 ELSE length(o_orderpriority) + 20 END AS b FROM {_ORDERS}, range(0, 3) r(ordinal))"


def fanout_byte_batches(spark, sf_dir):
    df = delivery.assign_batches(_siblings(spark, sf_dir), 40, 1000)
    return df.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch")).agg(F.count("*").alias("records"), F.sum("_bytes").alias("bytes"), F.min("_seq").alias("first_seq"))


def fanout_envelopes(spark, sf_dir):
    df = delivery.assign_groups(delivery.assign_batches(_siblings(spark, sf_dir), 40), 30)
    out = delivery.envelopes(df, ["o_orderkey", "item"])
    return out.select(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").cast("int").alias("grp"), "records", "body")


def fanout_verdicts(spark, sf_dir):
    """The second record of each request is refused, by its place in the body."""
    df = delivery.assign_groups(delivery.assign_batches(_siblings(spark, sf_dir), 40), 30)
    answers = df.select("_chunk", "_batch", "_group").distinct().select("*", F.lit(1).alias("index"), F.lit("E1").alias("code"), F.lit("refused").alias("message"))
    return delivery.join_verdicts(df, answers).select("o_orderkey", F.col("_ordinal").alias("ordinal"), "item", "outcome")


def fanout_twice(spark, sf_dir):
    """Siblings that are fanned out again are numbered through."""
    out = delivery.fan_out(_siblings(spark, sf_dir), F.array(F.col("item"), F.lower("item")), "part")
    return out.select("o_orderkey", F.col("_ordinal").alias("ordinal"), "part")


def fanout_groups(spark, sf_dir):
    """A function over groups of siblings keeps each one's place and envelope."""
    df = delivery.assign_groups(delivery.assign_batches(_siblings(spark, sf_dir).select("_chunk", "_seq", "_ordinal", "o_orderkey", "item"), 40), 30)
    out = delivery.apply_groups(df, lambda pdf: pdf, "o_orderkey long, item string")
    return out.select(F.col("_chunk").alias("chunk"), F.col("_seq").alias("seq"), F.col("_ordinal").alias("ordinal"), "o_orderkey", "item")


def split_function(spark, sf_dir):
    """A user's split function: labels by status; batches whose last record is low priority get one label too few."""
    df = delivery.assign_batches(_orders(spark, sf_dir), 40)
    out = delivery.run_splitter(df, lambda pdf: list(pdf["o_orderstatus"])[: len(pdf) - int(pdf["o_orderpriority"].iloc[-1].startswith("5"))])
    return out.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_label").alias("label"), F.coalesce("_error", F.lit("")).alias("error")).agg(F.count("*").alias("records"))


def script_test(spark, sf_dir):
    """A record function tried on a sample, with notes."""
    def fn(r):
        if r["o_orderstatus"] == "O":
            return None
        return [{"label": r["o_orderstatus"]}, {"label": r["o_orderpriority"]}] if r["o_orderstatus"] == "F" else {"label": r["o_orderstatus"]}

    df = _orders(spark, sf_dir).where("_chunk = 0").withColumn("_key", F.col("o_orderkey")).select("_key", "_seq", "o_orderstatus", "o_orderpriority")
    return delivery.try_out(df, fn, "label string", 50).select(F.col("_key").alias("o_orderkey"), "label", F.coalesce("note", F.lit("")).alias("note"))


def topic_messages(spark, sf_dir):
    df = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("_key"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_custkey").alias("customer"))
    return delivery.to_messages(df, "status")


def fan_out_ordinals(spark, sf_dir):
    df = _orders(spark, sf_dir)
    items = F.when(F.col("o_orderstatus") == "P", F.array(F.col("o_orderpriority"), F.lit(None), F.lit("copy"))).when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return delivery.fan_out(df, items).select("o_orderkey", F.col("_ordinal").alias("ordinal"), "item", F.col("_filtered").alias("filtered"))


def script_filter(spark, sf_dir):
    def fn(r):
        if r["o_orderstatus"] == "O":
            return None
        if r["o_orderpriority"].startswith("5"):
            raise ValueError("low priority")
        return [{"label": r["o_orderstatus"]}, {"label": r["o_orderpriority"]}] if r["o_orderstatus"] == "F" else {"label": r["o_orderstatus"]}

    df = _orders(spark, sf_dir).withColumn("_key", F.col("o_orderkey")).select("_key", "o_orderstatus", "o_orderpriority")
    out = delivery.apply_record(df, fn, "label string")
    return out.select(F.col("_key").alias("o_orderkey"), "label", F.col("_ordinal").alias("ordinal"), F.col("_filtered").alias("filtered"), F.col("_error").alias("error"))


def batch_replace_stamp(spark, sf_dir):
    def fn(pdf):
        if len(pdf) < 20:
            return pdf.head(1)[["o_orderkey"]].assign(share=0.0)
        customers = pdf["o_custkey"]
        # on the array: for groups of 20 records pandas' own steps take most of the time
        return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "share": customers.to_numpy() - customers.min() + 0.0})

    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir, ["o_orderkey", "o_custkey"]), 40), 20)
    out = delivery.apply_groups(df, fn, "o_orderkey long, share double")
    return out.select(F.col("_chunk").alias("chunk"), F.col("_seq").alias("seq"), "o_orderkey", "share", F.coalesce("_error", F.lit("")).alias("error"))


def batch_envelope(spark, sf_dir):
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), 20)
    out = delivery.envelopes(df, ["o_orderkey", "o_orderstatus"], "records")
    return out.select(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").cast("int").alias("grp"), "records", "body")


def split_labels(spark, sf_dir):
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), label=F.nullif("o_orderpriority", F.lit("5-LOW")))
    return df.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").cast("int").alias("grp"), F.col("_label").alias("label")).agg(F.count("*").alias("records"))


def split_running_total(spark, sf_dir):
    """Groups that begin anew whenever the priority changes from the record before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("_chunk", "_batch").orderBy("_seq")
    df = delivery.assign_batches(_orders(spark, sf_dir), 40)
    change = F.coalesce((F.lag("o_orderstatus").over(w) != F.col("o_orderstatus")).cast("int"), F.lit(0))
    df = df.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    out = delivery.assign_groups(df, label=F.col("_run"))
    return out.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch")).agg((F.max("_group") + 1).cast("int").alias("groups"), F.count("*").alias("records"))


def fixed_groups(spark, sf_dir):
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 50), 15)
    return df.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").alias("grp")).agg(F.count("*").alias("records"), F.min("_seq").alias("first_seq"))


def byte_batches(spark, sf_dir):
    df = delivery.assign_batches(_orders(spark, sf_dir), 40, 1000)
    return df.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch")).agg(F.count("*").alias("records"), F.sum("_bytes").alias("bytes"))


def _merge(spark, sf_dir, mode):
    """Balances of customers, rewritten by their orders."""
    target = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    batch = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    return delivery.merge(target, batch, ["id"], mode, "seq")


def merge_upsert(spark, sf_dir):
    return _merge(spark, sf_dir, "UPSERT")


def merge_ignore(spark, sf_dir):
    return _merge(spark, sf_dir, "IGNORE")


def merge_replace(spark, sf_dir):
    return _merge(spark, sf_dir, "REPLACE")


def verdict_join(spark, sf_dir):
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), 20)
    first = df.groupBy("_chunk", "_batch", "_group").agg(F.count("*").alias("n"))
    answers = first.select("_chunk", "_batch", "_group", F.explode(F.array(F.lit(0), F.lit(7), F.lit(500))).alias("index"), F.lit("E1").alias("code"), F.lit("refused").alias("message"))
    out = delivery.join_verdicts(df, answers)
    return out.select("o_orderkey", "outcome", "code")


def verdict_twice(spark, sf_dir):
    """Two answers for one record, answers without a code or a message, and one for a record that isn't there: each record has one outcome."""
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), 20)
    groups = df.select("_chunk", "_batch", "_group").distinct()
    none = F.lit(None).cast("string")
    said = [(1, F.lit("E2"), F.lit("late")), (1, F.lit("E1"), F.lit("refused")), (4, none, none), (5, F.lit("E3"), none), (999, F.lit("E4"), none)]
    answers = groups.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("index"), code.alias("code"), message.alias("message")) for k, code, message in said))))
    return delivery.join_verdicts(df, answers, chunks.tasks(table(spark, sf_dir, "orders"))).groupBy("outcome", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("message", F.lit("")).alias("message")).agg(F.count("*").alias("records"))


def late_verdicts(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    sent = df.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "SENT").otherwise("FILTERED").alias("outcome"))
    results = df.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.lit("too late").alias("message"))
    return delivery.settle(sent, results, "id").groupBy("outcome").agg(F.count("*").alias("records"), F.count("verdict").alias("verdicts"))


def staged_export_manifest(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = delivery.staged_export(df, folder(spark, "staged"), 64 << 10, order=["o_orderkey"])
    width = F.octet_length(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")) + 1
    header = len("o_orderkey,o_orderstatus\n")
    told = out.agg(F.sum("rows").alias("rows"), F.sum(F.col("bytes") - header).alias("bytes"), F.max(F.col("bytes")).alias("largest"))
    return told.join(F.broadcast(df.agg(F.sum(width).alias("data"))), F.col("bytes") == F.col("data"), "left").select("rows", "bytes", F.col("data").isNotNull().alias("whole"), (F.col("largest") <= 64 << 10).alias("small"))


def jdbc_round_trip(spark, sf_dir):
    """Customers in a database that every executor can open, read back in ranges of the key."""
    url = readers.pack_derby(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "customers", "\"c_custkey\"")
    return readers.read_jdbc(spark, url, "customers", ["\"c_custkey\"", "\"c_nationkey\"", "\"c_acctbal\""], "\"c_nationkey\" < 10", "\"c_custkey\"", 100, **readers.DERBY)


def batch_payload(spark, sf_dir):
    """A function that makes one payload of each group: for a destination that takes a group in one request, and refused for one that writes records one by one."""
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir, ["o_orderkey"]), 40), 20)

    def wrap(pdf):
        return {"first": int(pdf["o_orderkey"].iloc[0]), "n": len(pdf)}

    one = delivery.apply_batches(df, wrap, "o_orderkey long", single_request=True, node="wrap").where("_envelope is not null")
    other = delivery.apply_batches(df, wrap, "o_orderkey long", single_request=False, node="wrap").where("_error is not null")
    sent = one.select(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").cast("int").alias("grp"), F.col("_envelope").alias("body"), F.lit(1).cast("long").alias("records"), F.lit(None).cast("string").alias("node"))
    refused = other.groupBy(F.col("_chunk").alias("chunk"), F.col("_batch").alias("batch"), F.col("_group").cast("int").alias("grp"), F.col("_node").alias("node")).agg(F.count("*").alias("records"))
    return sent.unionByName(refused.withColumn("body", F.lit(None).cast("string")))


def group_messages(spark, sf_dir):
    """A message for each group: its body under the key of its first record."""
    df = delivery.assign_groups(delivery.assign_batches(_orders(spark, sf_dir), 40), 20).withColumn("_key", F.col("o_orderkey").cast("string"))
    bodies = delivery.envelopes(df, ["o_orderkey"]).select("_chunk", "_batch", "_group", "body")
    return delivery.envelope_messages(df.join(bodies, ["_chunk", "_batch", "_group"])).select("key", "value")


def lookup_translation(spark, sf_dir):
    """Customers of orders by a lookup table, which doesn't list all of them."""
    lookup = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    out = mapper.translated(table(spark, sf_dir, "orders"), "o_custkey", lookup, "c_custkey", "c_mktsegment", "segment", F.lit("none"))
    return out.groupBy("segment").agg(F.count("*").alias("orders"))


def split_preview(spark, sf_dir):
    """The calls that a splitter would make of the first records."""
    out = delivery.try_out_groups(_orders(spark, sf_dir).where("_chunk = 0"), lambda pdf: pdf["o_orderstatus"].tolist(), "SPLIT", n=60)
    return out.select("o_orderkey", F.col("call").cast("int").alias("call"), F.col("calls").cast("int").alias("calls"), "note")


QUERIES = {f.__name__: f for f in (fan_out_ordinals, script_filter, batch_replace_stamp, batch_envelope, split_labels, split_running_total, fixed_groups, byte_batches, merge_upsert, merge_ignore, merge_replace, verdict_join, verdict_twice, late_verdicts, staged_export_manifest, fanout_byte_batches, fanout_envelopes, fanout_verdicts, fanout_twice, fanout_groups, split_function, script_test, topic_messages, jdbc_round_trip, batch_payload, group_messages, lookup_translation, split_preview)}

_LAST = "(SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1)"
_TARGET = "(SELECT c_custkey AS id, c_acctbal AS amount FROM customer WHERE c_custkey % 3 <> 0)"
_G20 = f"(SELECT *, CAST((seq - 1) // 40 AS INTEGER) AS batch, CAST(((seq - 1) % 40) // 20 AS INTEGER) AS grp FROM {_ORDERS})"
_S30 = f"(SELECT *, CAST((row_number() OVER (PARTITION BY chunk, batch ORDER BY seq, ordinal) - 1) // 30 AS INTEGER) AS grp FROM (SELECT *, CAST((seq - 1) // 40 AS INTEGER) AS batch FROM {_SIBLINGS}))"
ORACLE_SQL = {
    "fan_out_ordinals": "SELECT o_orderkey, 0 AS ordinal, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS item, o_orderstatus = 'O' AS filtered FROM orders UNION ALL SELECT o_orderkey, 1, 'copy', false FROM orders WHERE o_orderstatus = 'P'",
    "script_filter": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderpriority LIKE '5%' THEN NULL ELSE o_orderstatus END AS label, 0 AS ordinal, o_orderstatus = 'O' AS filtered, CASE WHEN o_orderstatus <> 'O' AND o_orderpriority LIKE '5%' THEN 'low priority' END AS error FROM orders
      UNION ALL SELECT o_orderkey, o_orderpriority, 1, false, NULL FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%'""",
    "batch_replace_stamp": f"SELECT chunk, seq, CASE WHEN n >= 20 OR n = 1 THEN o_orderkey END AS o_orderkey, CASE WHEN n = 1 THEN 0.0 WHEN n >= 20 THEN CAST(o_custkey - least_key AS DOUBLE) END AS share, CASE WHEN n >= 20 OR n = 1 THEN '' ELSE n || ' records went in and 1 came out' END AS error FROM (SELECT *, count(*) OVER g AS n, min(o_custkey) OVER g AS least_key FROM {_G20} WINDOW g AS (PARTITION BY chunk, batch, grp))",
    "batch_envelope": f"""SELECT chunk, batch, grp, count(*) AS records, '{{"records":[' || string_agg('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}', ',' ORDER BY seq) || ']}}' AS body FROM {_G20} GROUP BY 1, 2, 3""",
    "split_labels": f"SELECT chunk, batch, CAST(row_number() OVER (PARTITION BY chunk, batch ORDER BY f) - 1 AS INTEGER) AS grp, label, records FROM (SELECT chunk, batch, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS label, count(*) AS records, min(seq) AS f FROM {_G20} GROUP BY 1, 2, 3)",
    "split_running_total": f"SELECT chunk, batch, CAST(sum(c) + 1 AS INTEGER) AS groups, count(*) AS records FROM (SELECT chunk, batch, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY chunk, batch ORDER BY seq) <> o_orderstatus THEN 1 ELSE 0 END AS c FROM {_G20}) GROUP BY 1, 2",
    "fixed_groups": f"SELECT chunk, CAST((seq - 1) // 50 AS INTEGER) AS batch, CAST(((seq - 1) % 50) // 15 AS INTEGER) AS grp, count(*) AS records, min(seq) AS first_seq FROM {_ORDERS} GROUP BY 1, 2, 3",
    "byte_batches": f"""WITH RECURSIVE o AS (SELECT chunk, seq, length(o_orderpriority) + 20 AS b FROM {_ORDERS}), f AS (SELECT chunk, seq, b, b AS held, 1 AS n, 0 AS batch FROM o WHERE seq = 1 UNION ALL SELECT o.chunk, o.seq, o.b, CASE WHEN f.n >= 40 OR f.held >= 1000 THEN o.b ELSE f.held + o.b END, CASE WHEN f.n >= 40 OR f.held >= 1000 THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN f.n >= 40 OR f.held >= 1000 THEN 1 ELSE 0 END FROM f JOIN o ON o.chunk = f.chunk AND o.seq = f.seq + 1)
      SELECT chunk, batch, count(*) AS records, CAST(sum(b) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""",
    "merge_upsert": f"SELECT id, coalesce(l.amount, t.amount) AS amount FROM {_TARGET} t FULL JOIN {_LAST} l USING (id)",
    "merge_ignore": f"SELECT id, coalesce(t.amount, l.amount) AS amount FROM {_TARGET} t FULL JOIN {_LAST} l USING (id)",
    "merge_replace": f"SELECT id, coalesce(l.amount, t.amount) AS amount FROM {_TARGET} t LEFT JOIN {_LAST} l USING (id)",
    "verdict_join": f"SELECT o_orderkey, CASE WHEN (seq - 1) % 20 IN (0, 7) THEN 'REJECTED' ELSE 'WRITTEN' END AS outcome, CASE WHEN (seq - 1) % 20 IN (0, 7) THEN 'E1' END AS code FROM {_ORDERS}",
    "verdict_twice": f"SELECT CASE WHEN i IN (1, 4, 5) THEN 'REJECTED' ELSE 'WRITTEN' END AS outcome, CASE i WHEN 1 THEN 'E1' WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'E3' ELSE '' END AS code, CASE WHEN i = 1 THEN 'refused' WHEN i IN (4, 5) THEN 'The destination refused this record' ELSE '' END AS message, count(*) AS records FROM (SELECT (seq - 1) % 20 AS i FROM {_ORDERS}) GROUP BY 1, 2, 3",
    "late_verdicts": "SELECT CASE WHEN o_orderstatus <> 'O' THEN 'FILTERED' WHEN o_orderkey % 7 = 0 THEN 'REJECTED' ELSE 'WRITTEN' END AS outcome, count(*) AS records, count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) AS verdicts FROM orders GROUP BY 1",
    "fanout_byte_batches": f"""WITH RECURSIVE o AS (SELECT chunk, seq, b, row_number() OVER (PARTITION BY chunk ORDER BY seq, ordinal) AS i FROM {_SIBLINGS}), f AS (SELECT chunk, seq, i, b, b AS held, 1 AS n, 0 AS batch FROM o WHERE i = 1 UNION ALL SELECT o.chunk, o.seq, o.i, o.b, CASE WHEN f.n >= 40 OR f.held >= 1000 THEN o.b ELSE f.held + o.b END, CASE WHEN f.n >= 40 OR f.held >= 1000 THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN f.n >= 40 OR f.held >= 1000 THEN 1 ELSE 0 END FROM f JOIN o ON o.chunk = f.chunk AND o.i = f.i + 1)
      SELECT chunk, batch, count(*) AS records, CAST(sum(b) AS BIGINT) AS bytes, min(seq) AS first_seq FROM f GROUP BY 1, 2""",
    "fanout_envelopes": f"""SELECT chunk, batch, grp, count(*) AS records, '[' || string_agg('{{"o_orderkey":' || o_orderkey || ',"item":"' || item || '"}}', ',' ORDER BY seq, ordinal) || ']' AS body FROM {_S30} GROUP BY 1, 2, 3""",
    "fanout_verdicts": f"SELECT o_orderkey, CAST(ordinal AS INTEGER) AS ordinal, item, CASE WHEN row_number() OVER (PARTITION BY chunk, batch, grp ORDER BY seq, ordinal) = 2 THEN 'REJECTED' ELSE 'WRITTEN' END AS outcome FROM {_S30}",
    "fanout_twice": f"SELECT o_orderkey, CAST(2 * ordinal + k AS INTEGER) AS ordinal, CASE WHEN k = 0 THEN item ELSE lower(item) END AS part FROM {_SIBLINGS}, range(0, 2) s(k)",
    "fanout_groups": f"SELECT chunk, seq, CAST(ordinal AS INTEGER) AS ordinal, o_orderkey, item FROM {_SIBLINGS}",
    "split_function": f"SELECT chunk, batch, CASE WHEN NOT low THEN o_orderstatus END AS label, CASE WHEN low THEN n || ' records went in and ' || (n - 1) || ' labels came out' ELSE '' END AS error, count(*) AS records FROM (SELECT *, count(*) OVER (PARTITION BY chunk, batch) AS n, last_value(o_orderpriority LIKE '5%') OVER (PARTITION BY chunk, batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS low FROM {_G20}) GROUP BY 1, 2, 3, 4",
    "script_test": f"SELECT o_orderkey, CASE WHEN k = 1 THEN o_orderpriority WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS label, CASE o_orderstatus WHEN 'O' THEN 'dropped' WHEN 'F' THEN 'fanned out into 2' ELSE '' END AS note FROM {_ORDERS}, range(0, 2) s(k) WHERE chunk = 0 AND seq <= 50 AND (k = 0 OR o_orderstatus = 'F')",
    "topic_messages": """SELECT coalesce(nullif(o_orderstatus, 'P'), CAST(o_orderkey AS VARCHAR)) AS key, '{' || CASE WHEN o_orderstatus <> 'P' THEN '"status":"' || o_orderstatus || '",' ELSE '' END || '"customer":' || o_custkey || '}' AS value FROM orders""",
    "batch_payload": f"""SELECT chunk, batch, grp, '{{"first": ' || arg_min(o_orderkey, seq) || ', "n": ' || count(*) || '}}' AS body, 1 AS records, NULL AS node FROM {_G20} GROUP BY 1, 2, 3 UNION ALL SELECT chunk, batch, grp, NULL, count(*), 'wrap' FROM {_G20} GROUP BY 1, 2, 3""",
    "group_messages": f"""SELECT CAST(arg_min(o_orderkey, seq) AS VARCHAR) AS key, '[' || string_agg('{{"o_orderkey":' || o_orderkey || '}}', ',' ORDER BY seq) || ']' AS value FROM {_G20} GROUP BY chunk, batch, grp""",
    "lookup_translation": "SELECT coalesce(c_mktsegment, 'none') AS segment, count(*) AS orders FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey GROUP BY 1",
    "split_preview": f"WITH d AS (SELECT o_orderkey, o_orderstatus, seq FROM {_ORDERS} WHERE chunk = 0 AND seq <= 60), c AS (SELECT o_orderstatus, row_number() OVER (ORDER BY min(seq)) - 1 AS call FROM d GROUP BY 1) SELECT o_orderkey, CAST(call AS INTEGER) AS call, CAST((SELECT count(*) FROM c) AS INTEGER) AS calls, CAST(NULL AS VARCHAR) AS note FROM d JOIN c USING (o_orderstatus)",
    "jdbc_round_trip": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 10",
    "staged_export_manifest": "SELECT count(*) AS rows, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus) + 2) AS BIGINT) AS bytes, true AS whole, true AS small FROM orders",
}
