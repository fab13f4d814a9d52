"""Queries of the mapper and the validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckoner.operators.mapper import apply_mapping, apply_rules, to_record
from reckoner.plans.common import table

SHAPE = {"mappings": [
    {"from": "o_orderkey", "to": "orderNumber", "required": True}, {"from": "o_custkey", "to": "customer", "type": "STRING"}, {"from": "o_totalprice", "to": "amount", "type": "NUMBER"},
    {"from": "o_orderstatus", "to": "stage", "values": {"P": "Pending", "F": "Finished"}, "otherwise": "Unknown"}, {"from": "o_orderdate", "to": "placedAt", "type": "DATE"}, {"to": "source", "default": "orders"},
]}
RULES = [{"field": "o_totalprice", "check": "MIN", "value": 100000, "name": "too small"}, {"field": "o_totalprice", "check": "MAX", "value": 400000}, {"field": "o_orderstatus", "check": "ONE_OF", "value": ["P", "F"]}, {"field": "o_orderpriority", "check": "MATCHES", "value": "^[1-3]"}, {"field": "o_orderpriority", "check": "MAX_LENGTH", "value": 10}, {"field": "o_orderpriority", "check": "NOT_BLANK"}]


def _orders(spark, sf_dir):
    """orders with '' and null among the priorities."""
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(p == "5-LOW", "").when(p != "4-NOT SPECIFIED", p))


_ORDERS = "(SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority) FROM orders)"


def map_orders_shape(spark, sf_dir):
    return apply_mapping(table(spark, sf_dir, "orders"), SHAPE).drop("_error")


def map_keep_unmapped(spark, sf_dir):
    spec = {"keepUnmapped": True, "mappings": [{"from": "n_name", "to": "n_name", "case": "LOWER"}, {"from": "n_regionkey", "to": "region", "type": "STRING"}]}
    return apply_mapping(table(spark, sf_dir, "nation"), spec).drop("_error")


def map_nested_paths(spark, sf_dir):
    spec = {"mappings": [{"from": "event_id", "to": "id"}, {"from": "props.k", "to": "detail.k", "type": "INTEGER"}, {"from": "event_type", "to": "detail.kind.name"}, {"from": "props.none", "to": "missing"}]}
    return apply_mapping(table(spark, sf_dir, "events"), spec).select("id", F.col("detail.k").alias("k"), F.col("detail.kind.name").alias("kind"), "missing")


def map_join_default_const(spark, sf_dir):
    spec = {"mappings": [{"from": "o_orderkey", "to": "id"}, {"from": ["o_orderpriority", "o_orderstatus"], "to": "label", "join": "/"}, {"from": "o_orderpriority", "to": "priority", "default": "NONE", "required": True}, {"to": "load", "default": "1", "type": "INTEGER"}]}
    return apply_mapping(_orders(spark, sf_dir), spec).drop("_error")


def map_translate_otherwise(spark, sf_dir):
    table_ = {"BUILDING": "B", "MACHINERY": "M"}
    spec = {"mappings": [{"from": "c_custkey", "to": "id"}, {"from": "c_mktsegment", "to": "code", "values": table_, "otherwise": "?"}, {"from": "c_mktsegment", "to": "same", "values": table_}]}
    return apply_mapping(table(spark, sf_dir, "customer"), spec).drop("_error")


def map_text_tidy(spark, sf_dir):
    spec = {"mappings": [{"from": "p_partkey", "to": "id"}, {"from": "p_brand", "to": "brand", "trim": True, "case": "UPPER", "prefix": "MIG-", "suffix": "/x", "replace": {"find": "#", "with": "."}, "maxLength": 12}]}
    return apply_mapping(table(spark, sf_dir, "part"), spec).drop("_error")


def map_coercions(spark, sf_dir):
    spec = {"mappings": [{"from": "o_totalprice", "to": "whole", "type": "INTEGER"}, {"from": "o_orderpriority", "to": "flag", "type": "BOOLEAN"}]}
    df = _orders(spark, sf_dir).withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1)).withColumn("_key", F.col("o_orderkey"))
    return apply_mapping(df, spec).select(F.col("_key").alias("id"), "whole", "flag", F.coalesce("_error", F.lit("")).alias("error"))


def map_required_errors(spark, sf_dir):
    spec = {"mappings": [{"from": "o_orderkey", "to": "id"}, {"from": "o_orderpriority", "to": "priority", "required": True}]}
    out = apply_mapping(_orders(spark, sf_dir), spec).where("_error is not null")
    return out.groupBy(F.col("_error").alias("error")).agg(F.count("*").alias("records"))


def map_record_json(spark, sf_dir):
    spec = {"mappings": [{"from": "o_orderkey", "to": "id"}, {"from": "o_orderstatus", "to": "status"}, {"from": "o_orderpriority", "to": "priority", "onMissing": "NULL"}]}
    out = apply_mapping(_orders(spark, sf_dir), spec)
    return out.select("id", to_record(out, spec).alias("record"))


def _nested(spark, sf_dir):
    """events with an object, which some rows don't have."""
    e = table(spark, sf_dir, "events")
    own = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.col("value").alias("value")).alias("by"))
    return e.select("event_id", F.when(F.col("event_id") % 4 > 0, own).alias("what"), F.nullif("event_type", F.lit("view")).alias("state"))


def map_over_object(spark, sf_dir):
    """keepUnmapped with nested targets keeps the other fields of the object."""
    spec = {"keepUnmapped": True, "mappings": [{"from": "state", "to": "what.state"}, {"from": "event_id", "to": "what.by.event"}, {"from": "state", "to": "more.state"}]}
    out = apply_mapping(_nested(spark, sf_dir), spec)
    return out.select("event_id", F.to_json("what").alias("what"), F.to_json("more").alias("more"))


def map_nested_missing(spark, sf_dir):
    """onMissing at any depth of the target."""
    spec = {"mappings": [{"from": "event_id", "to": "id"}, {"from": "what.kind", "to": "p.q"}, {"from": "state", "to": "p.r", "onMissing": "NULL"}, {"from": "state", "to": "s.t"}]}
    out = apply_mapping(_nested(spark, sf_dir), spec)
    return out.select("id", to_record(out, spec).alias("record"))


def map_translate_values(spark, sf_dir):
    """Translations to null, truth values and numbers, of numbers."""
    spec = {"mappings": [{"from": "n_nationkey", "to": "id"}, {"from": "n_regionkey", "to": "a", "values": {0: True, 1: 2.0, 2: None}, "otherwise": None}, {"from": "n_regionkey", "to": "b", "values": {"3": "three"}, "otherwise": False}]}
    return apply_mapping(table(spark, sf_dir, "nation"), spec).drop("_error")


def map_odd_values(spark, sf_dir):
    """Words for numbers and truth values with white space, and endless numbers."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "-Infinity").when(F.col("n_nationkey") % 3 == 1, " Infinity ").otherwise("7").alias("n"), F.when(F.col("n_nationkey") % 2 == 0, "YES").otherwise(" yes ").alias("b"))
    number = apply_mapping(df.withColumn("_key", F.col("n_nationkey")), {"mappings": [{"from": "n", "to": "n", "type": "NUMBER"}, {"from": "b", "to": "b"}]})
    out = apply_mapping(number.drop("_error"), {"mappings": [{"from": "n", "to": "n"}, {"from": "b", "to": "b", "type": "BOOLEAN"}]})
    return out.select(F.col("_key").alias("id"), (F.col("n") > 1e300).alias("endless"), "b", F.coalesce("_error", F.lit("")).alias("error"))


def _judged(spark, sf_dir, **more):
    return apply_rules(_orders(spark, sf_dir), {"rules": RULES} | more)


def validate_all_labels(spark, sf_dir):
    return _judged(spark, sf_dir).select("o_orderkey", F.coalesce("_error", F.lit("")).alias("error"))


def validate_first(spark, sf_dir):
    return _judged(spark, sf_dir, report="FIRST").groupBy(F.coalesce("_error", F.lit("")).alias("error")).agg(F.count("*").alias("records"))


def validate_drop(spark, sf_dir):
    out = _judged(spark, sf_dir, onFail="DROP")
    return out.groupBy(F.col("_filtered").alias("filtered")).agg(F.count("*").alias("records"), F.count("_error").alias("errors"))


def validate_checks_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    checks = [("p_size", "MIN", 10), ("p_size", "MAX", 40), ("p_name", "MATCHES", "bolt"), ("p_brand", "ONE_OF", ["Brand#1", "Brand#2"]), ("p_name", "MAX_LENGTH", 9), ("p_retailprice", "IS_NUMBER", None), ("p_brand", "IS_NUMBER", None), ("p_type", "REQUIRED", None)]
    for k, (field, check, value) in enumerate(checks):
        df = apply_rules(df, {"rules": [{"field": field, "check": check, "value": value}]}).withColumn(f"c{k}", F.col("_error").isNull().cast("int")).drop("_error", "_filtered")
    return df.select("p_partkey", *(f"c{k}" for k in range(len(checks))))


QUERIES = {f.__name__: f for f in (map_over_object, map_nested_missing, map_translate_values, map_odd_values, map_orders_shape, map_keep_unmapped, map_nested_paths, map_join_default_const, map_translate_otherwise, map_text_tidy, map_coercions, map_required_errors, map_record_json, validate_all_labels, validate_first, validate_drop, validate_checks_matrix)}

_LABELS = """list_filter([CASE WHEN NOT o_totalprice >= 100000 THEN 'too small' END, CASE WHEN NOT o_totalprice <= 400000 THEN 'o_totalprice failed MAX' END,
  CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN 'o_orderstatus failed ONE_OF' END, CASE WHEN NOT coalesce(regexp_matches(o_orderpriority, '^[1-3]'), false) THEN 'o_orderpriority failed MATCHES' END,
  CASE WHEN length(o_orderpriority) > 10 THEN 'o_orderpriority failed MAX_LENGTH' END, CASE WHEN coalesce(o_orderpriority, '') = '' THEN 'o_orderpriority failed NOT_BLANK' END], lambda x: x IS NOT NULL)"""

ORACLE_SQL = {
    "map_over_object": """SELECT event_id, '{' || CASE WHEN event_id % 4 > 0 THEN '"kind":"' || event_type || '",' ELSE '' END || '"by":{' || CASE WHEN event_id % 4 > 0 THEN '"user":' || user_id || ',"value":' || value || ',' ELSE '' END || '"event":' || event_id || '}' || CASE WHEN event_type <> 'view' THEN ',"state":"' || event_type || '"' ELSE '' END || '}' AS what,
      CASE WHEN event_type <> 'view' THEN '{"state":"' || event_type || '"}' ELSE '{}' END AS more FROM events""",
    "map_nested_missing": """SELECT event_id AS id, '{"id":' || event_id || ',"p":{' || CASE WHEN event_id % 4 > 0 THEN '"q":"' || event_type || '",' ELSE '' END || '"r":' || CASE WHEN event_type <> 'view' THEN '"' || event_type || '"' ELSE 'null' END || '}' || CASE WHEN event_type <> 'view' THEN ',"s":{"t":"' || event_type || '"}' ELSE '' END || '}' AS record FROM events""",
    "map_translate_values": "SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'true' WHEN 1 THEN '2' END AS a, CASE n_regionkey WHEN 3 THEN 'three' ELSE 'false' END AS b FROM nation",
    "map_odd_values": """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 3 = 1 END AS endless, CASE WHEN n_nationkey % 2 = 0 THEN true END AS b, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '" yes " is not true or false' END AS error FROM nation""",
    "map_orders_shape": "SELECT o_orderkey AS \"orderNumber\", CAST(o_custkey AS VARCHAR) AS customer, o_totalprice AS amount, CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Finished' ELSE 'Unknown' END AS stage, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS \"placedAt\", 'orders' AS source FROM orders",
    "map_keep_unmapped": "SELECT n_nationkey, n_regionkey, lower(n_name) AS n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
    "map_nested_paths": "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, json_extract_string(props, '$.none') AS missing FROM events",
    "map_join_default_const": f"SELECT o_orderkey AS id, CASE WHEN coalesce(o_orderpriority, '') = '' THEN o_orderstatus ELSE o_orderpriority || '/' || o_orderstatus END AS label, CASE WHEN coalesce(o_orderpriority, '') = '' THEN 'NONE' ELSE o_orderpriority END AS priority, CAST(1 AS BIGINT) AS load FROM {_ORDERS}",
    "map_translate_otherwise": "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS code, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS same FROM customer",
    "map_text_tidy": "SELECT p_partkey AS id, substr(replace('MIG-' || upper(trim(p_brand)) || '/x', '#', '.'), 1, 12) AS brand FROM part",
    "map_coercions": f"""SELECT id, CASE WHEN error = '' THEN CAST(price AS BIGINT) END AS whole, CASE WHEN error = '' THEN p = '1' END AS flag, error FROM (SELECT o_orderkey AS id, o_totalprice AS price, substr(o_orderpriority, 1, 1) AS p,
      CASE WHEN o_totalprice <> floor(o_totalprice) THEN '"' || CAST(o_totalprice AS VARCHAR) || '" is not a whole number' WHEN substr(o_orderpriority, 1, 1) <> '1' THEN '"' || substr(o_orderpriority, 1, 1) || '" is not true or false' ELSE '' END AS error FROM {_ORDERS})""",
    "map_required_errors": f"SELECT 'priority is required and had no value (from o_orderpriority)' AS error, count(*) AS records FROM {_ORDERS} WHERE coalesce(o_orderpriority, '') = '' HAVING count(*) > 0",
    "map_record_json": f"""SELECT o_orderkey AS id, '{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":' || coalesce('"' || o_orderpriority || '"', 'null') || '}}' AS record FROM {_ORDERS}""",
    "validate_all_labels": f"SELECT o_orderkey, array_to_string(list_slice(l, 1, 5), '; ') || CASE WHEN len(l) > 5 THEN '; and ' || (len(l) - 5) || ' more' ELSE '' END AS error FROM (SELECT o_orderkey, {_LABELS} AS l FROM {_ORDERS})",
    "validate_first": f"SELECT coalesce(({_LABELS})[1], '') AS error, count(*) AS records FROM {_ORDERS} GROUP BY 1",
    "validate_drop": f"SELECT len({_LABELS}) > 0 AS filtered, count(*) AS records, CAST(0 AS BIGINT) AS errors FROM {_ORDERS} GROUP BY 1",
    "validate_checks_matrix": "SELECT p_partkey, CAST(p_size >= 10 AS INTEGER) AS c0, CAST(p_size <= 40 AS INTEGER) AS c1, CAST(contains(p_name, 'bolt') AS INTEGER) AS c2, CAST(p_brand IN ('Brand#1', 'Brand#2') AS INTEGER) AS c3, CAST(length(p_name) <= 9 AS INTEGER) AS c4, 1 AS c5, 0 AS c6, 1 AS c7 FROM part",
}
