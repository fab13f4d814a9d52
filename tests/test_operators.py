"""Cases of single operators with their results written out."""

import datetime as dt
import json
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.functions import js, paths
from reckoner.operators import chunks, delivery, health, ledger, reports
from reckoner.operators.mapper import apply_mapping, apply_rules, to_record
from reckoner.sources import normal, params, readers


def mapped(spark, record, *mappings, **more):
    df = spark.createDataFrame([record]) if isinstance(record, dict) else record
    return apply_mapping(df, {"mappings": list(mappings)} | more).first().asDict()


def test_only_mapped_fields_stay(spark):
    out = mapped(spark, {"a": 1, "b": 2, "c": 3}, {"from": "a", "to": "x"}, {"from": "b", "to": "y"})
    assert out == {"x": 1, "y": 2, "_error": None}


def test_keep_unmapped(spark):
    assert mapped(spark, {"a": 1, "b": "q"}, {"from": "b", "to": "b", "case": "UPPER"}, keepUnmapped=True) == {"a": 1, "b": "Q", "_error": None}


@pytest.mark.parametrize(("text", "value"), [("50.0", 50.0), (" 12 ", 12.0), ("1e3", 1000.0), ("0x10", 16.0), ("", 0.0), (".5", 0.5), ("-3", -3.0), ("1d", None), ("NaN", None), ("about fifty", None), ("5.", 5.0)])
def test_numbers(spark, text, value):
    v, e = js.number(F.col("t"), T.StringType())
    row = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), e.alias("e")).first()
    assert row.v == value and row.e == (None if value is not None else f'"{text}" is not a number')


@pytest.mark.parametrize(("text", "value"), [("yes", True), ("Y", True), ("0", False), ("No", False), ("maybe", None), ("", None)])
def test_booleans(spark, text, value):
    v, e = js.boolean(F.col("t"), T.StringType())
    row = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), e.alias("e")).first()
    assert row.v == value and (row.e is None) == (value is not None)


def test_text_of_values(spark):
    df = spark.createDataFrame([(50.0, 1.5, True, dt.datetime(2024, 1, 2, 3, 4, 5))], "a double, b double, c boolean, d timestamp")
    assert list(df.select(*(js.text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).first()) == ["50", "1.5", "true", "2024-01-02T03:04:05.000Z"]


def test_tidy_steps_have_one_order(spark):
    out = mapped(spark, {"a": "  ab-9 "}, {"from": "a", "to": "x", "trim": True, "case": "upper", "prefix": "MIG-", "replace": {"find": "-", "with": "+"}, "maxLength": 6})
    assert out["x"] == "MIG+AB"


def test_required_names_both_ends(spark):
    assert mapped(spark, {"a": ""}, {"from": "a", "to": "x", "required": True})["_error"] == "x is required and had no value (from a)"
    assert mapped(spark, {"a": ""}, {"from": "a", "to": "x", "required": True, "default": "d"}) == {"x": "d", "_error": None}


def test_first_error_in_order_of_the_spec(spark):
    out = mapped(spark, {"a": "q", "b": "r"}, {"from": "b", "to": "y", "type": "NUMBER"}, {"from": "a", "to": "x", "type": "BOOLEAN"})
    assert out == {"y": None, "x": None, "_error": '"r" is not a number'}


def test_paths_and_nested_targets(spark):
    df = spark.createDataFrame([(("v",), '{"k": {"a.b": 7}}')], "s struct<p:string>, j string")
    out = apply_mapping(df, {"mappings": [{"from": "s.p", "to": "o.p"}, {"from": "s.none", "to": "o.q"}, {"from": "j.k", "to": "k"}]}).first()
    assert (out.o.p, out.o.q, json.loads(out.k)) == ("v", None, {"a.b": 7})


def test_omit_or_null(spark):
    spec = {"mappings": [{"from": "a", "to": "a"}, {"from": "b", "to": "b"}, {"from": "c", "to": "c", "onMissing": "NULL"}]}
    df = apply_mapping(spark.createDataFrame([(1, None, None)], "a int, b string, c string"), spec)
    assert df.select(to_record(df, spec).alias("r")).first().r == '{"a":1,"c":null}'


@pytest.mark.parametrize("spec", [{"mappings": []}, {"mappings": [{"from": "a"}]}, {"mappings": [{"to": "x"}]}, {"mappings": [{"from": "a", "to": "x", "type": "MONEY"}]}, {"mappings": [{"from": "a", "to": "x", "case": "TITLE"}]}, {"mappings": [{"from": "a", "to": "x", "values": {}}]}])
def test_wrong_specs(spark, spec):
    with pytest.raises(ValueError):
        apply_mapping(spark.createDataFrame([("v",)], "a string"), spec)


def test_many_broken_rules_are_counted(spark):
    df = spark.createDataFrame([(None,)], "a string")
    rules = [{"field": "a", "check": "REQUIRED", "name": f"r{k}"} for k in range(7)]
    assert apply_rules(df, {"rules": rules}).first()._error == "r0; r1; r2; r3; r4; and 2 more"
    assert apply_rules(df, {"rules": rules, "report": "FIRST"}).first()._error == "r0"
    row = apply_rules(df, {"rules": rules, "onFail": "DROP"}).first()
    assert row._filtered and row._error is None


def test_signatures_collapse_what_differs(spark):
    said = ["row 12 of 'alice' at 5f2b6c1d-0000-4000-8000-0123456789ab  bad", 'row 7 of "bob" at 507f1f77bcf86cd799439011 bad', None, " "]
    rows = spark.createDataFrame([(m,) for m in said], "m string").select(ledger.signature(F.lit(" E1 "), F.col("m")).alias("s")).collect()
    assert [r.s for r in rows] == ["E1|row ? of ? at ? bad", "E1|row ? of ? at ? bad", "E1|", "E1|"]
    assert spark.range(1).select(ledger.signature(F.lit(None), F.lit("x" * 400)).alias("s")).first().s == "NO_CODE|" + "x" * 300


@pytest.mark.parametrize(("produced", "failed", "finished", "most", "percent", "broken"), [(5, 3, False, None, 50, False), (5, 3, True, None, 50, True), (100, 10, False, None, 10, True), (1_000_000, 1, False, None, 1, False), (5, 1, False, None, 0, True), (5, 2, False, 2, None, True), (5, 0, True, 0, 0, False), (100, 99, True, None, 100, False)])
def test_breaches(spark, produced, failed, finished, most, percent, broken):
    got = spark.range(1).select(ledger.breach(F.lit(produced), F.lit(failed), F.lit(finished), most, percent).alias("b")).first().b
    assert (got is not None) == broken


@pytest.mark.parametrize(("state", "counts", "index", "said"), [("RUNNING", (10, 0, 10, 10, 0), (10, 0, 0, 0, 0, 0), "INCOMPLETE"), ("COMPLETED", (10, 1, 9, 7, 2), (6, 1, 2, 1, 0, 0), "BALANCED"), ("COMPLETED", (10, 0, 10, 9, 0), (9, 0, 0, 0, 0, 0), "DISCREPANCY"), ("COMPLETED", (10, 0, 10, 10, 0), (0, 0, 0, 0, 0, 0), "BALANCED"), ("COMPLETED", (10, 0, 30, 30, 0), (30, 0, 0, 0, 0, 0), "BALANCED"), ("COMPLETED", (10, 0, 10, 10, 0), (9, 0, 0, 0, 0, 0), "DISCREPANCY"), ("FAILED", (10, 0, 8, 8, 0), (8, 0, 0, 0, 0, 0), "DISCREPANCY")])
def test_verdicts(spark, state, counts, index, said):
    names = ["read", "filtered", "produced", "written", "failed", *(f"n_{o.lower()}" for o in ledger.OUTCOMES)]
    df = spark.createDataFrame([(state, *counts, *index)], ["state", *names])
    assert df.select(ledger.verdict(df).alias("v")).first().v == said


def test_placeholders_and_lists():
    sql = "SELECT ':no', x::int, \"a:b\" FROM t WHERE a = :a AND b IN (:b) -- :c"
    assert params.placeholders(sql) == ["a", "b"]
    assert params.bind_sql(sql, {"a": "5", "b": ["x", "2024-01-02"]}) == (sql.replace("(:b)", "(:b_0, :b_1)"), {"a": 5, "b_0": "x", "b_1": dt.date(2024, 1, 2)})
    for bad in ({"a": 1}, {"a": 1, "b": []}, {"a": "", "b": [1]}):
        with pytest.raises(ValueError):
            params.bind_sql(sql, bad)


def test_named_queries():
    conf = {"sql": "base", "url": "u", "queries": [{"name": "one", "sql": "1"}, {"name": "two", "sql": "2"}]}
    assert [params.pick_query(conf, n)["sql"] for n in (None, "two", "none", "")] == ["1", "2", "base", "base"]


def test_a_day_across_a_clock_change(spark):
    a, b = params.period(F.lit("2024-03-31 12:00:00").cast("timestamp"), "Europe/Berlin", "day")
    row = spark.range(1).select((F.unix_seconds(b) - F.unix_seconds(a)).alias("s"), a.cast("string").alias("a")).first()
    assert (row.s, row.a) == (23 * 3600, "2024-03-30 23:00:00")


def test_filter_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    n = lambda doc, **kw: sorted(r.n for r in df.where(params.filter_column(doc, kw)).collect())
    assert n({"s": {"$exists": False}}) == [2] and n({"s": {"$ne": "a"}}) == [2, 3] and n({"$not": {"n": {"$gt": ":x"}}}, x="1") == [1] and n({"n": {"$nin": [1, 3]}}) == [2]
    with pytest.raises(ValueError):
        params.filter_column({"n": {"$near": 1}})


def test_chunks_cover_their_source(spark):
    df = spark.range(17, 1017).withColumnRenamed("id", "k")
    plan = chunks.plan_ranges(df, "k", 300, 100).orderBy("chunk").collect()
    assert [(r.first, r.last) for r in plan] == [(17, 316), (317, 616), (617, 916), (917, 1016)]
    assert chunks.plan_ranges(df.limit(0), "k", 300, 100).count() == 0
    got = chunks.numbered(df.repartition(5), ["k"]).collect()
    assert all(r._row == r.k - 17 for r in got) and len(got) == 1000


def test_object_ids_keep_their_order(spark):
    ids = ["507f1f77bcf86cd799439011", "507f1f77bcf86cd799439012", "ffffffffffffffffffffffff", "000000000000000000000000"]
    rows = spark.createDataFrame([(i,) for i in ids], "i string").select("i", chunks.object_id_number(F.col("i")).alias("n")).collect()
    assert all(int(r.n) == int(r.i, 16) for r in rows)


def test_labelled_groups_in_order_of_appearance(spark):
    df = spark.createDataFrame([(0, k, lab) for k, lab in enumerate(["b", "a", None, "b", "", "a"], 1)], "_chunk int, _seq long, lab string")
    rows = delivery.assign_groups(delivery.assign_batches(df, 10), label=F.col("lab")).orderBy("_seq").collect()
    assert [r._group for r in rows] == [0, 1, 2, 0, 2, 1]


def test_a_group_fails_alone(spark):
    df = delivery.assign_groups(delivery.assign_batches(spark.createDataFrame([(0, k, k) for k in range(1, 7)], "_chunk int, _seq long, v long"), 6), 2)
    out = delivery.apply_groups(df, lambda p: 1 / 0 if 3 in set(p["v"]) else pd.DataFrame({"v": p["v"] * 2}), "v long").orderBy("_seq").collect()
    assert [r.v for r in out] == [2, 4, None, None, 10, 12] and [r._error is None for r in out] == [True, True, False, False, True, True]


def test_merge_refuses_null_and_known_keys(spark):
    target, batch = spark.createDataFrame([(1, "a")], "k int, v string"), lambda *r: spark.createDataFrame(r, "k int, v string, n int")
    assert sorted(map(tuple, delivery.merge(target, batch((1, "b", 1), (1, "c", 2), (2, "d", 1)), ["k"], "UPSERT", "n").collect())) == [(1, "c"), (2, "d")]
    for rows, mode in (([(None, "x", 1)], "UPSERT"), ([(1, "x", 1)], "INSERT")):
        with pytest.raises(Exception, match="key"):
            delivery.merge(target, batch(*rows), ["k"], mode, "n").collect()


def test_redaction_and_ceiling(spark):
    df = spark.createDataFrame([(("n", "s"), "t", None)], "p struct<a:string,b:string>, q string, r string")
    row = paths.redact(df, {"/p/a": "MASK", "/p/b": "DROP", "/q": "HASH", "/r": "MASK", "/none": "MASK"}).first()
    assert row.p.asDict() == {"a": "***"} and row.q.startswith("sha256:") and len(row.q) == 23 and row.r is None
    got = spark.range(1).select(paths.ceiling(F.lit("x" * 10), F.lit("k"), 9).alias("a"), paths.ceiling(F.lit("x" * 10), F.lit("k"), 0).alias("b")).first()
    assert json.loads(got.a)["_id"] == "k" and got.b == "x" * 10


def test_upper_median(spark):
    got = [spark.range(1).select(health.upper_median(F.array(*map(F.lit, v))).alias("m")).first().m for v in ([5, 1], [3, 1, 2], [4, 1, 3, 2])]
    assert got == [None, 2, 3]


def test_retry_cycles_end(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "run_id long, retry_of long")
    assert sorted((r.root, r.run_id, r.depth) for r in health.retry_chains(df).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id, name ,x\n1, ann ,\n\n2,'b'\n")
    df = readers.read_delimited(spark, str(tmp_path)).orderBy("id")
    assert [(r.id, r.name, r._file) for r in df.collect()] == [("1", "ann", "a.csv"), ("2", "'b'", "a.csv")]
    (tmp_path / "b.tsv").write_text("1\tq\n2\tr\n")
    assert readers.read_delimited(spark, str(tmp_path), "*.tsv", "tab", header=False).select("column_1", "column_2").count() == 2


def test_database_round_trip(spark):
    url, driver = "jdbc:derby:memory:round;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(k, k * 1.07, f"c{k}") for k in range(1, 501)], "id long, amount double, name string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    readers.write_jdbc(df.coalesce(2), url, "orders", "overwrite", 100, **driver)
    back = readers.read_jdbc(spark, url, "orders", ['"id"', '"amount"'], '"id" <= 450', '"id"', 100, **driver)
    assert back.rdd.getNumPartitions() == 5 and back.count() == 450
    assert str(back.where('id = 333').first().amount) == "356.31"


def test_keyed_statements():
    assert readers.keyed_statement("postgresql", "t", ["k", "v"], ["k"], "UPSERT") == "INSERT INTO t (k, v) VALUES (?, ?) ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v"
    assert readers.keyed_statement("postgresql", "t", ["k"], ["k"], "UPSERT").endswith("DO NOTHING")
    assert readers.keyed_statement("mysql", "t", ["k", "v"], ["k"], "IGNORE").startswith("INSERT IGNORE")
    assert "WHEN NOT MATCHED" in readers.keyed_statement("oracle", "t", ["k", "v"], ["k"], "UPSERT")


def test_preview(spark):
    assert readers.preview(spark.range(5), 3)[1] and not readers.preview(spark.range(5), 5)[1]


def test_entry_without_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_order_is_fanned_out(spark, sf):
    from reckoner.plans import accounts

    got = {(r.record_key, r.entries, r.last_ordinal) for r in accounts.fanout_index_identity(spark, sf).collect()}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").count().collect()
    assert got == {(str(r.l_orderkey), r["count"], r["count"] - 1) for r in lines}


def test_byte_batches_fold_a_chunk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(delivery, "FOLD", 1)
    sizes = {(c, k): (k * 7919 + c * 31) % 97 if k % 10 else None for c, n in ((0, 1403), (1, 250), (2, 3)) for k in range(1, n + 1)}
    df = spark.createDataFrame([(c, k, x) for (c, k), x in sizes.items()], "_chunk int, _seq long, _bytes int")
    made = delivery.assign_batches(df, 5, 190)
    want, state = {}, {}
    for (c, k), x in sizes.items():
        batch, n, held = state.get(c, (0, 0, 0))
        want[c, k] = batch
        n, held = n + 1, held + (x or 0)
        state[c] = (batch + 1, 0, 0) if n >= 5 or held >= 190 else (batch, n, held)
    assert {(r._chunk, r._seq): r._batch for r in made.collect()} == want
    assert "_block" in made._jdf.queryExecution().toString()  # no task folds a whole chunk


def test_siblings_keep_their_order(spark):
    df = spark.createDataFrame([(0, 1, "c"), (0, 2, "b")], "_chunk int, _seq long, v string")
    out = delivery.fan_out(df, F.array(F.lit("z"), F.col("v"), F.lit("a"))).withColumn("_bytes", F.lit(10))
    assert delivery.assign_batches(out, 10, 25).count() == 6
    grouped = delivery.assign_groups(delivery.assign_batches(out, 10, 25), 2)
    bodies = [json.loads(r.body) for r in delivery.envelopes(grouped, ["item"]).orderBy("_batch", "_group").collect()]
    assert [[x["item"] for x in b] for b in bodies] == [["z", "c"], ["a"], ["z", "b"], ["a"]]


def test_verdict_hits_the_sibling_at_its_place(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, k, v) for k, v in enumerate("cba")], "_chunk int, _batch int, _group int, _seq long, _ordinal int, v string")
    answers = spark.createDataFrame([(0, 0, 0, 0, "E1", "no")], "_chunk int, _batch int, _group int, index int, code string, message string")
    assert {r.v: r.outcome for r in delivery.join_verdicts(df, answers).collect()} == {"a": "WRITTEN", "b": "WRITTEN", "c": "REJECTED"}


def test_a_lost_part_of_the_index_is_a_discrepancy(spark, tmp_path):
    import pathlib

    df = spark.range(100).select(F.lit(0).alias("_chunk"), F.col("id").alias("_seq"), F.lit("WRITTEN").alias("outcome"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message")).repartition(4)
    folder = str(tmp_path / "index")
    seen = ledger.write_index(ledger.record_index(df, F.col("_seq").cast("string"), F.lit("2024-01-01").cast("timestamp")), folder)

    def said():
        both = ledger.counted_run(spark, 1, seen).join(ledger.outcome_counts(spark.read.parquet(folder).withColumn("run_id", F.lit(1).cast("long"))), "run_id", "left")
        return both.select(ledger.verdict(both)).first()[0]

    assert said() == "BALANCED"
    next(pathlib.Path(folder).glob("part-*.parquet")).unlink()
    assert said() == "DISCREPANCY"


def test_a_run_that_is_not_indexed_has_no_checks(spark):
    runs = spark.createDataFrame([(1, 5, 5, 0, 0)], "run_id long, produced long, written long, failed long, filtered long").selectExpr("*", *(f"CAST(NULL AS BIGINT) AS n_{o.lower()}" for o in ledger.OUTCOMES))
    assert ledger.checks(runs).count() == 0


def test_names_that_look_like_code_are_names(spark):
    df = spark.createDataFrame([(1,)], ["a) OR (1=1"])
    value, _ = paths.read(df, "a) OR (1=1")
    assert df.select(value.alias("v")).first().v == 1


def test_keys_at_the_edge_of_a_chunk(spark):
    df = spark.createDataFrame([(Decimal(10**28 + k),) for k in range(7)], "id decimal(38,0)")
    plan = chunks.plan_by_count(df, "id", 3, 100)
    own = {int(r.id) - 10**28: r._chunk for r in chunks.assign(df, "id", plan).collect()}
    edges = {r["chunk"]: (int(r["first"]) - 10**28, int(r["last"]) - 10**28) for r in plan.collect()}
    assert all(edges[c][0] <= k <= edges[c][1] for k, c in own.items()) and len(own) == 7


def test_scratch_on_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from reckoner.sources.scratch import folder

    conf = SimpleNamespace(get=lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))
    with pytest.raises(ValueError, match="checkpoint"):
        folder(SimpleNamespace(conf=conf), "x")


def test_keyed_statements_run(spark, tmp_path):
    path = str(tmp_path / "target.db")

    def connect():
        import sqlite3

        return sqlite3.connect(path, timeout=60)

    with connect() as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        c.execute("INSERT INTO t VALUES (1, 'old'), (2, 'old')")
    rows = spark.createDataFrame([(2, "new"), (3, "new")], "id long, name string").repartition(2)
    for mode, second in (("IGNORE", "old"), ("UPSERT", "new"), ("UPSERT", "new")):
        delivery.write_keyed(rows, connect, readers.keyed_statement("postgresql", "t", ["id", "name"], ["id"], mode), 1)
        with connect() as c:
            assert c.execute("SELECT * FROM t ORDER BY id").fetchall() == [(1, "old"), (2, second), (3, "new")]


def test_documents_are_refused_one_by_one(spark):
    target = spark.createDataFrame([(1, "a")], "id long, v string")
    batch = spark.createDataFrame([(1, "b", 1), (2, "c", 2), (2, "d", 3), (None, "e", 4)], "id long, v string, n long")
    said = {}
    for mode in ("INSERT", "UPSERT", "REPLACE"):
        after, judged = delivery.bulk_write(target, batch, "id", mode, "n")
        said[mode] = (sorted(map(tuple, after.collect())), [r["_error"] is None for r in judged.orderBy("n").collect()])
    assert said == {"INSERT": ([(1, "a"), (2, "c")], [False, True, False, False]), "UPSERT": ([(1, "b"), (2, "d")], [True, True, True, False]), "REPLACE": ([(1, "b")], [True, False, False, False])}


def test_texts_of_documents_and_binds(spark):
    texts = ["oid:0123456789abcdef01234567", "oid:xyz", "2024-02-30T00:00:00Z", "2024-02-29T12:00:00.5Z", "2024-02-29T12:00Z", "2024-02-29", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select(normal.document_value(F.col("t")).alias("d"), normal.bound_text(F.col("t")).alias("b")).orderBy("k").collect()
    noon = dt.datetime(2024, 2, 29, 12, tzinfo=None)
    assert [tuple(r["d"]) for r in rows[:4]] == [("0123456789abcdef01234567", None, None), (None, None, "xyz"), (None, None, texts[2]), (None, noon.replace(microsecond=500_000), None)]
    assert [tuple(r["d"]) for r in rows[4:]] == [(None, None, texts[4]), (None, None, texts[5]), (None, None, None), (None, None, "")]
    assert [r["b"]["at"] for r in rows] == [None, None, None, noon.replace(microsecond=500_000), noon, None, None, None]
    assert rows[5]["b"]["day"] == dt.date(2024, 2, 29) and rows[2]["b"]["text"] == texts[2]


def test_offsets_across_a_clock_change(spark):
    at = spark.createDataFrame([(dt.datetime(2024, 3, 31, 12),), (dt.datetime(2024, 1, 1, 23, 30),)], "at timestamp")
    values = params.window_values(F.col("at"), "Europe/Berlin", {"from": ("day", 0), "week": ("week", 0)})
    out = at.select(*(v.alias(k) for k, v in values.items()), params.day_of_week(F.col("at"), "Europe/Berlin").alias("d"), params.offset_text(F.col("at"), "America/St_Johns").alias("s")).orderBy("at").collect()
    assert [tuple(r) for r in out] == [("2024-01-02T00:00:00+01:00", "2024-01-01T00:00:00+01:00", 2, "2024-01-01T20:00:00-03:30"), ("2024-03-31T00:00:00+01:00", "2024-03-25T00:00:00+01:00", 7, "2024-03-31T09:30:00-02:30")]


def test_duplicates_have_to_be_acknowledged(spark):
    df = spark.createDataFrame([(1, 0, "FAILED", 5, 5), (1, 1, "RUNNING", 2, 2), (1, 2, "COMPLETED", 9, 9)], "run_id long, chunk int, state string, checkpoint long, written long")
    with pytest.raises(ValueError, match="acknowledge"):
        reports.retry_plan(df, resume=False, idempotent=False)
    assert {(r["chunk"], r["after"]) for r in reports.retry_plan(df, resume=False, idempotent=False, acknowledged=True).collect()} == {(0, None), (1, None)}
    assert {(r["chunk"], r["after"]) for r in reports.retry_plan(df, unfinished=False, idempotent=False).collect()} == {(0, 5)}


def test_headlines_when_all_is_well(spark):
    none = spark.createDataFrame([], "pipeline_id long, severity int, code string")
    live, volume = spark.createDataFrame([(4,)], "pipeline_id long"), spark.createDataFrame([(1234,)], "written long")
    out = reports.board(none, live, volume, "the last 24 hours", 5).orderBy("place").collect()
    assert [(r["pipeline_id"], r["title"]) for r in out] == [(None, "Nothing has failed in the last 24 hours"), (4, "Running now"), (None, "1,234 records transferred in the last 24 hours")]


def test_report_of_a_run_that_is_not_indexed(spark):
    df = spark.createDataFrame([(1, "COMPLETED", False, 5, 1, 3, 2, 1, *(None,) * 5)], "run_id long, state string, dry_run boolean, read long, filtered long, produced long, written long, failed long, n_written long, n_sent long, n_rejected long, n_call_failed long, n_transform_failed long").withColumn("n_filtered", F.lit(None).cast("long"))
    out = {r["label"]: r["value"] for r in reports.export_lines(df).collect()}
    assert out == {"Verdict": "DISCREPANCY", "Run": "1", "Read from source": "5", "Filtered by rules": "1", "Produced by transforms": "3", "Written": "2", "Failed": "1", "Unaccounted": "0"}
