"""Odd input of chunk plans, writes, links, masks, searches and payload stores, against plain versions."""

import collections
import hashlib
import json
import os
import random
import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reckoner.functions import paths
from reckoner.operators import chunks, delivery, ledger, payloads, reports
from reckoner.sources import normal, readers

# Chunk plans


@pytest.mark.parametrize(("kind", "keys", "rows"), [
    ("decimal(12,2)", ["10.75", "10.00", "-3.01", "99.99", None], 5),
    ("decimal(38,0)", [str(10**37), str(-(10**37)), "0"], 10**36),
    ("decimal(38,10)", ["1.5", "1.0000000001", "7"], 1),
    ("long", [str(-(1 << 63)), str((1 << 63) - 1), "0", None], 1 << 60),
    ("long", [str((1 << 63) - 1), str((1 << 63) - 5)], 2),
    ("short", ["-32768", "32767"], 1000),
])
@pytest.mark.parametrize("by", ["rows", "count"])
def test_every_key_has_a_chunk(spark, kind, keys, rows, by):
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(F.col("k").cast(kind).alias("k"))
    plan = chunks.plan_ranges(df, "k", rows, 1_000) if by == "rows" else chunks.plan_by_count(df, "k", 1, 7)
    ranges = {r["chunk"]: (int(r["first"]), int(r["last"])) for r in plan.collect()}
    low, high = min(a for a, _ in ranges.values()), max(b for _, b in ranges.values())
    assert sorted(ranges) == list(range(len(ranges))) and all(ranges[k + 1][0] == ranges[k][1] + 1 for k in range(len(ranges) - 1))
    for r in chunks.assign(df, "k", plan).collect():
        if r.k is None:
            assert r["_chunk"] is None
            continue
        a, b = ranges[r["_chunk"]]
        assert a <= Decimal(r.k) < b + 1 and low <= r.k < high + 1
    outside = spark.createDataFrame([(1,)], "x int").select(F.lit(str(high + 1 if high < 1 << 62 else low)).cast("decimal(38,0)").alias("k"))
    assert kind == "long" or chunks.assign(outside, "k", plan).first()["_chunk"] in (None, 0)


def test_plans_of_very_many_chunks_hold_no_array(spark):
    df = spark.createDataFrame([(0,), (10**15,)], "k long")
    plan = chunks.plan_ranges(df, "k", 1_000, 1_000_000_000)
    assert "sequence" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 999_000_000 < plan.ranges.chunks <= 1_000_000_000 and plan.where(F.col("chunk") == plan.ranges.chunks - 1).first()["last"] == 10**15
    again = spark.createDataFrame(plan.limit(3).collect(), plan.schema)  # a plan from elsewhere, without its ranges
    assert chunks.assign(df, "k", again).first()["_chunk"] == 0
    assert chunks.assign(df, "k", chunks.plan_ranges(df.limit(0), "k", 10, 10)).first()["_chunk"] is None


def test_resume_refuses_keys_of_several_columns(spark):
    df = spark.createDataFrame([(k,) for k in range(9)], "k long")
    ledger_ = lambda *keys: spark.createDataFrame([(x,) for x in keys], "record_key string")
    assert sorted(r.k for r in chunks.resume(df, "k", ledger_("3", None, "6")).collect()) == [7, 8]
    assert chunks.resume(df, "k", ledger_()).count() == 9
    with pytest.raises(ValueError, match="several columns"):
        chunks.resume(df, "k", ledger_("3", "3|a"))


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_follow_the_order(spark, parts):
    values = random.Random(1).sample(range(10_000), 3_000)
    df = spark.createDataFrame([(v, f"x{v}", "kept") for v in values], "v long, t string, _part string").repartition(parts)
    got = sorted((r["_row"], r.v, r["_part"]) for r in chunks.numbered(df, ["v"]).collect())
    assert got == [(k, v, "kept") for k, v in enumerate(sorted(values))]
    assert chunks.numbered(df.limit(0), ["v"]).count() == 0


# Delivery


@pytest.mark.parametrize("fold", [1 << 20, 30])
def test_batches_by_bytes(spark, fold, monkeypatch):
    monkeypatch.setattr(delivery, "FOLD", fold)
    rng = random.Random(2)
    rows = [(c, s + 1, rng.choice([None, 0, 1, 50, 400])) for c in (0, 1, 7) for s in range((400, 1, 55)[c % 3])]
    df = spark.createDataFrame(rows, "_chunk int, _seq long, _bytes int").withColumn("_note", F.lit("kept")).repartition(3)
    got = {(r["_chunk"], r["_seq"]): r["_batch"] for r in delivery.assign_batches(df, 9, 500).collect()}
    held = n = number = 0
    for c, s, b in sorted(rows, key=lambda r: r[:2]):
        if s == 1:
            held = n = number = 0
        elif held >= 500 or n >= 9:
            held, n, number = 0, 0, number + 1
        held, n = held + (b or 0), n + 1
        assert got[c, s] == number


def test_siblings_beside_a_column_of_the_same_name(spark):
    df = spark.createDataFrame([(0, 1, "x", "2024")], "_chunk int, _seq long, v string, _at string")
    assert [(r["_ordinal"], r["_at"]) for r in delivery.fan_out(delivery.fan_out(df, F.array(F.lit(1), F.lit(2))), F.array(F.lit(3)), "more").collect()] == [(0, "2024"), (1, "2024")]


@pytest.mark.parametrize("mode", ["INSERT", "UPSERT", "REPLACE"])
def test_documents_have_a_key_of_any_name(spark, mode):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "_id long, v string")
    batch = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (None, "e", 3)], "_id long, v string, n int")
    after, judged = delivery.bulk_write(target, batch, "_id", mode, "n")
    assert {(r["_id"], r.v) for r in after.collect()} == {"INSERT": {(1, "a"), (2, "b"), (3, "d")}, "UPSERT": {(1, "a"), (2, "c"), (3, "d")}, "REPLACE": {(1, "a"), (2, "c")}}[mode]
    assert judged.where("_error is null").count() == {"INSERT": 1, "UPSERT": 2, "REPLACE": 1}[mode]


@pytest.mark.parametrize("order", [None, ["k"]])
def test_no_exported_file_is_over_its_limit(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", 'q"uo,te', "é" * rng.randint(0, 300), None, "x\r\ny" if order is None else "z"])) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(4)
    out = delivery.staged_export(df, str(tmp_path / "e"), 5_000, order=order).collect()
    files = sorted((tmp_path / "e").rglob("*.csv"))
    assert len(files) > 20 and max(f.stat().st_size for f in files) <= 5_000
    assert {(r.file, r.bytes) for r in out} == {(f"{f.parent.name}/{f.name}", f.stat().st_size) for f in files}
    if order:
        assert sum(r.rows for r in out) == 3_000
        by = {r.file: r.number for r in out}
        keys = [int(line.split(",")[0]) for f in sorted(files, key=lambda f: by[f"{f.parent.name}/{f.name}"]) for line in f.read_text().splitlines()[1:]]
        assert keys == list(range(3_000))
    with pytest.raises(ValueError, match="a record takes"):
        delivery.staged_export(df, str(tmp_path / "f"), 300)
    assert not Path(tmp_path / "f").exists()


def test_retry_without_a_checkpoint_is_acknowledged(spark):
    df = spark.createDataFrame([(1, 0, "FAILED", None, 5), (1, 1, "FAILED", None, 0), (1, 2, "FAILED", 7, 7)], "run_id int, chunk int, state string, checkpoint long, written long")
    with pytest.raises(ValueError, match="acknowledge"):
        reports.retry_plan(df, idempotent=False)
    assert reports.retry_plan(df, idempotent=False, acknowledged=True).count() == 3
    assert reports.retry_plan(df.where("chunk > 0"), idempotent=False).count() == 2


@pytest.mark.parametrize(("header", "address"), [
    ('<https://x/?a=1,2;3>; rel="next"', "https://x/?a=1,2;3"), ("<https://x/2>; rel=next", "https://x/2"), ('<a>; rel=prev, <b>; title="x, rel=next"; rel="first next"', "b"),
    ('<a>; title="rel=next"', None), ('<a>; rel="nextone"', None), ('<a>;REL=NEXT;x=1,<b>;rel=next', "a"), ("<a>; rel=prev; rel=next", None), (None, None), ("", None), ('<a>; rel="prev", <>; rel="next"', ""),
])
def test_next_links(spark, header, address):
    assert spark.createDataFrame([(header,)], "h string").select(normal.next_link(F.col("h"))).first()[0] == address


# Masks and searches in payloads


def _put(value, steps, mode):
    value = json.loads(json.dumps(value))
    at = value
    for s in steps[:-1]:
        if isinstance(at, dict) and s in at:
            at = at[s]
        elif isinstance(at, list) and s.isdigit() and int(s) < len(at):
            at = at[int(s)]
        else:
            return value
    if not isinstance(at, dict) or steps[-1] not in at:
        return value
    own = at[steps[-1]]
    if mode == "DROP":
        del at[steps[-1]]
    elif own is not None:
        shown = own if isinstance(own, str) else json.dumps(own)
        at[steps[-1]] = "***" if mode == "MASK" else "sha256:" + hashlib.sha256(shown.encode()).hexdigest()[:16]
    return value


def _any(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return {rng.choice(["a", "b", 'q"', "é", "0", "a/b"]): _any(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 5:
        return [_any(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [None, rng.choice([True, False, 1, -2.5, 10**20]), rng.choice(["", 'x"y', "é,", "}{", "\\"]), 0][kind]


def test_masks_in_text_by_the_plain_rule():
    rng = random.Random(4)
    for _ in range(3_000):
        value = _any(rng, 4)
        steps = [rng.choice(["a", "b", 'q"', "é", "0", "1", "a/b"]) for _ in range(rng.randint(1, 4))]
        mode = rng.choice(paths.MODES)
        text = json.dumps(value, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert json.loads(paths.redact_text(text, steps, mode)) == _put(value, steps, mode)
    for text in ("", "no json", "{", '{"a":1} x', None):
        assert paths.redact_text(text, ["a"], "MASK") == text


def test_masks_in_columns_of_any_kind(spark):
    row = '{"m": {"a": {"x": "1"}}}'
    df = spark.createDataFrame([(1,)], "k int").select(
        F.create_map(F.lit("a"), F.struct(F.lit(7).alias("x"), F.lit("y").alias("y")), F.lit("b"), F.struct(F.lit(8).alias("x"), F.lit("z").alias("y"))).alias("m"), F.parse_json(F.lit(row)).alias("v"), F.array(F.lit(row), F.lit("{}")).alias("t"),
        F.array(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")), F.struct(F.lit(3).alias("x"), F.lit(4).alias("y"))).alias("s"), F.struct(F.lit(1).alias("only")).alias("o"),
    )
    out = paths.redact(df, {"/m/a/x": "MASK", "/v/m/a/x": "HASH", "/t/0/m": "DROP", "/s/1/x": "DROP", "/s/0": "MASK", "/o/only": "DROP", "/nothing/x": "MASK", "/s/x": "MASK"}).select("m", F.to_json("v").alias("v"), "t", "s").first()
    assert {k: (v.x, v.y) for k, v in out.m.items()} == {"a": ("***", "y"), "b": ("8", "z")}
    assert json.loads(out.v) == {"m": {"a": {"x": "sha256:" + hashlib.sha256(b"1").hexdigest()[:16]}}}
    assert [json.loads(x) for x in out.t] == [{}, {}] and [(x.x, x.y) for x in out.s] == [(1, 2), (None, 4)]
    with pytest.raises(ValueError, match="no redaction mode"):
        paths.redact(df, {"/m/a/x": "HIDE"})


def _leaves(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _leaves(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in _leaves(v, f"{path}/{k}")]
    return [(path, value if value is None or isinstance(value, str) else json.dumps(value))]


def test_leaves_and_values_in_any_field(spark):
    values = [{"a": {"b": ["x", 5, None]}, "a/b": "x", "~": True}, ["x", {}], "x", {"c": 'say "x"'}, {}, {"n": 5.0, "d": [[[["deep"]]]]}]
    texts = [(str(k), json.dumps(v), None) for k, v in enumerate(values)] + [("p", "plain x", None), ("n", None, '{"z": "x"}')]
    df = spark.createDataFrame(texts, "id string, record string, source string").withColumns({"run_id": F.lit(1), "pipeline_id": F.lit(2)})
    got = collections.defaultdict(list)
    for r in paths.leaves(df, "record", ["id"]).collect():
        got[r.id].append((r.path, r.value))
    for k, v in enumerate(values):
        if k != 5:
            assert sorted(got[str(k)], key=str) == sorted(_leaves(v), key=str)
    assert got["p"] == [("", "plain x")] and "n" not in got and ("/d/0/0/0/0", "deep") in got["5"]

    def ids(**asked):
        return {r.id for r in ledger.search(df, payloads=("record", "source"), **asked).collect()}

    assert ids(value="x") == {"0", "1", "2", "n"} and ids(value="x", field="a.b.0") == {"0"} and ids(value='say "x"') == {"3"}
    assert ids(value="5") >= {"0"} and ids(value="deep", run=1, pipeline=2) == {"5"} and ids(value="x", run=3) == set() and ids(value="plain x") == {"p"}


# Payload stores


@pytest.fixture
def failed(spark):
    rows = [(0, 1, "k", "WRITTEN", 1.5), (0, 2, "k", "REJECTED", 2.5), (0, 3, None, "REJECTED", None), (1, 1, "k", "CALL_FAILED", 2.5)]
    df = spark.createDataFrame(rows, "_chunk int, _seq long, key string, outcome string, v double").withColumns({"error_code": F.lit("E"), "error_message": F.concat(F.lit("bad "), F.col("_seq").cast("string"))})
    return df.withColumn("_source", F.to_json(F.struct("v"))).withColumn("v", F.col("v") * 2)


def test_payloads_are_stored_once_and_replayed_by_place(spark, failed, tmp_path):
    at = F.lit("2024-01-01").cast("timestamp")
    made = payloads.letters(failed.select("_chunk", "_seq", "v", "outcome", "error_code", "error_message", "_source", F.col("key").alias("_key")), F.col("_key"), at)
    for _ in range(2):  # a run that is stored again changes nothing
        payloads.store(made, str(tmp_path), 7)
        payloads.store(made.where("_chunk = 1"), str(tmp_path), 8)
    assert payloads.stored(spark, str(tmp_path), 7, "payloads").count() == 4  # two records, two sources
    got = {(r["_chunk"], r["_seq"]): (r.record_key, json.loads(r.payload).get("v"), r["_wanted"]) for r in payloads.replay(spark, str(tmp_path), 7).collect()}
    assert got == {(0, 2): ("k", 2.5, [0]), (0, 3): (None, None, [0]), (1, 1): ("k", 2.5, [0])}
    as_is = {(r["_chunk"], r["_seq"], r["_ordinal"]): json.loads(r.payload)["v"] for r in payloads.replay(spark, str(tmp_path), 7, transforms=False).collect()}
    assert as_is == {(0, 2, 0): 5.0, (0, 3, 0): None, (1, 1, 0): 5.0}
    assert {r["_window"] for r in payloads.windows(payloads.replay(spark, str(tmp_path), 7), 2).collect()} == {0, 1}
    assert payloads.replay(spark, str(tmp_path), 8).count() == 1
    for wrong, said in (({"run_id": 9}, "no dead letters"), ({"run_id": 7, "state": "RUNNING"}, "RUNNING"), ({"run_id": 7, "redacted": True}, "3 records"), ({"run_id": 7, "signatures": ["none"]}, "no dead letters")):
        with pytest.raises(ValueError, match=said):
            payloads.replay(spark, str(tmp_path), **wrong)
    assert payloads.replay(spark, str(tmp_path), 7, redacted=True, acknowledged=True).count() == 3


def test_payloads_are_masked_and_cut_before_they_are_written(spark, failed):
    at = F.lit("2024-01-01").cast("timestamp")
    df = failed.select("_chunk", "_seq", "v", F.lit("x" * 90).alias("long"), "outcome", "error_code", "error_message", "_source", F.col("key").alias("_key"))
    rows = payloads.letters(df, F.col("_key"), at, {"/v": "MASK"}).collect()
    assert {json.loads(r.record)["v"] for r in rows} == {"***", None}
    assert all("_truncated" in json.loads(r.record) for r in payloads.letters(df, F.col("_key"), at, most_bytes=50).collect())


def test_times_and_decimals_of_payloads_come_back(spark):
    df = spark.sql("SELECT 0 AS _chunk, 1L AS _seq, timestamp'2024-03-01 01:02:03.123456' AS at, timestamp_ntz'2024-03-01 01:02:03.000001' AS ntz, CAST('12345678901234567890.123456789' AS decimal(38,9)) AS d, double('NaN') AS x, date'2024-01-01' AS day, CAST(NULL AS string) AS none, map('a', array(1)) AS m")
    names = [c for c in df.columns if c[0] != "_"]
    back = payloads.with_source(df).select(payloads.from_json(F.col("_source"), df.select(names).schema).alias("r")).select("r.*")
    a, b = df.select(names).first(), back.first()
    assert (a.at, a.ntz, a.d, a.day, a.none, a.m) == (b.at, b.ntz, b.d, b.day, b.none, b.m) and str(b.x) == "nan"


# Writes that can't be repeated, functions over groups, the stage log


def test_staged_writes_are_there_once(spark, tmp_path):
    """A job whose task has failed half-way, is run again, and then once more."""
    import sqlite3

    path, flag = str(tmp_path / "db"), tmp_path / "failed"

    def connect():
        return sqlite3.connect(path, timeout=60)

    with connect() as c:
        c.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    df = spark.range(0, 1_000, 1, 4).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))

    def breaks(batches):
        for b in batches:
            if b.num_rows and b.column("id")[0].as_py() >= 750 and not flag.exists():
                yield b.slice(0, 100)
                flag.touch()
                raise RuntimeError("lost")
            yield b

    lossy = df.mapInArrow(breaks, df.schema)
    with pytest.raises(Exception, match="lost"):
        delivery.write_staged(lossy, connect, "t", "job-1", batch=30)
    assert connect().execute("SELECT count(*) FROM t").fetchone() == (0,) and connect().execute("SELECT count(*) FROM t_staged").fetchone()[0] > 0
    assert delivery.write_staged(lossy, connect, "t", "job-1", batch=30) == 1_000
    assert delivery.write_staged(lossy, connect, "t", "job-1") == 0
    assert connect().execute("SELECT count(*), count(DISTINCT id) FROM t").fetchone() == (1_000, 1_000)
    assert connect().execute("SELECT count(*) FROM t_staged").fetchone() == (0,)
    with connect() as c:
        c.execute("CREATE UNIQUE INDEX u ON t (id)")
    more = df.where("id < 10").select((F.col("id") + 995).alias("id"), F.lit("new").alias("v"))
    with pytest.raises(sqlite3.IntegrityError):
        delivery.write_staged(more, connect, "t", "job-2")
    assert delivery.write_staged(more, connect, "t", "job-3", "INSERT INTO t (id, v) SELECT * FROM ({rows}) WHERE true ON CONFLICT (id) DO UPDATE SET v = excluded.v") == 10
    assert connect().execute("SELECT count(*), count(*) FILTER (WHERE v = 'new') FROM t").fetchone() == (1_005, 10)
    assert delivery.write_staged(df.limit(0), connect, "t", "job-4") == 0


def test_functions_over_many_small_groups_and_a_large_one(spark):
    rows = [(0, k // 3, 0, k + 1, k) for k in range(60)] + [(1, 0, 0, k + 1, k) for k in range(25_000)]
    df = spark.createDataFrame(rows, "_chunk int, _batch int, _group int, _seq long, v long").repartition(5)
    out = delivery.apply_groups(df, lambda pdf: pdf.assign(n=len(pdf), first=pdf["v"].iloc[0])[["v", "n", "first"]], "v long, n long, first long")
    got = sorted((r["_chunk"], r["_batch"], r["_seq"], r.v, r.n, r["first"]) for r in out.collect())
    assert got == sorted((c, b, s, v, 3 if c == 0 else 25_000, v - v % 3 if c == 0 else 0) for c, b, _, s, v in rows)
    assert delivery.apply_groups(df.limit(0), lambda pdf: pdf, "v long").count() == 0


def test_errors_name_their_node(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 5), (0, 0, 0, 2, 0)], "_chunk int, _batch int, _group int, _seq long, v long")
    by_record = delivery.apply_record(df, lambda r: {"v": 10 // r["v"]}, "v long", node="divide").collect()
    assert sorted((r["_seq"], r["_node"], r["_error"] is not None) for r in by_record) == [(1, None, False), (2, "divide", True)]
    by_group = delivery.apply_groups(df, lambda pdf: pdf.head(1), "v long", node="cut").collect()
    assert {(r["_node"], r["_error"]) for r in by_group} == {("cut", "2 records went in and 1 came out")}


def test_a_failed_action_is_logged(spark):
    log = ledger.StageLog(spark, 5)
    df = log.stage("BREAK", spark.range(3), lambda d: d.select(F.raise_error(F.lit("no")).alias("x")), "n1")
    with pytest.raises(Exception, match="no"):
        log.ran(df.collect)
    good = log.stage("PASS", spark.range(3), lambda d: d.where("id > 0"))
    log.ran(good.collect)
    rows = ledger.find_stages(log.entries(), run=5).collect()
    assert [(r.position, r.stage, r.outcome, r.records_in, r.records_out, r.delta) for r in rows] == [(0, "BREAK", "FAILED", None, None, None), (1, "PASS", "DONE", 3, 2, -1)]
    assert ledger.find_stages(log.entries(), stage="PASS").count() == 1 and "no" in rows[0].error


@pytest.mark.parametrize("small", [10, 1])
def test_lookups_of_any_size(spark, small, monkeypatch):
    from reckoner.operators import mapper

    monkeypatch.setattr(mapper, "SMALL_LOOKUP", small)
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, None, None, 2)], "k int").withColumn("_salt", F.lit("kept"))
    lookup = spark.createDataFrame([("1", "one"), ("2", "zwei"), ("2", "two"), (None, "none"), ("9", None)], "code string, name string")
    got = sorted(((r.k, r.said) for r in mapper.translated(df.drop("_salt"), "k", lookup, "code", "name", "said").collect()), key=str)
    assert got == sorted([(1, "one"), (2, "two"), (3, "3"), (None, None), (None, None), (2, "two")], key=str)
    other = {(r.k, r.said) for r in mapper.translated(df.drop("_salt"), "k", lookup, "code", "name", "said", F.lit("?")).collect()}
    assert other == {(1, "one"), (2, "two"), (3, "?"), (None, "?")}


def test_groups_that_lie_by_chunk_are_not_shuffled_again(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("_chunk"), F.floor(F.col("id") / 2).alias("_seq"), F.col("id").alias("v"))
    df = delivery.assign_groups(delivery.assign_batches(df.withColumn("_seq", F.col("_seq") + 1).repartition(3, "_chunk"), 40), 30)
    out = delivery.apply_groups(df, lambda pdf: pdf, "v long")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r["v"] for r in out.collect()) == list(range(200))


def test_payloads_keep_whole_numbers_beside_failed_groups(spark):
    big = (1 << 60) + 1
    df = spark.range(40).select(F.lit(0).alias("_chunk"), F.lit(0).alias("_batch"), F.floor(F.col("id") / 20).cast("int").alias("_group"), F.col("id").alias("_seq"), (F.col("id") + big).alias("v")).coalesce(1)

    def wrap(pdf):
        if pdf["v"].iloc[0] == big:
            raise ValueError("no")
        return {"n": len(pdf)}

    out = delivery.apply_batches(df, wrap, "v long", single_request=True, node="w").orderBy("_seq").collect()
    assert [r["v"] for r in out] == [None] * 20 + [big + k for k in range(20, 40)]
    assert [r["_envelope"] for r in out] == [None] * 20 + ['{"n": 20}'] + [None] * 19
    assert {(r["_error"], r["_node"]) for r in out} == {("no", "w"), (None, None)}
    assert delivery.apply_batches(delivery.assign_groups(df.drop("_group").repartition(2, "_chunk"), 20), wrap, "v long", single_request=True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rewritten_groups_keep_whole_numbers_beside_failed_ones(spark):
    big = (1 << 60) + 1
    df = spark.range(30).select(F.lit(0).alias("_chunk"), F.lit(0).alias("_batch"), F.floor(F.col("id") / 10).cast("int").alias("_group"), F.col("id").alias("_seq"), (F.col("id") + big).alias("v")).coalesce(1)
    out = delivery.apply_groups(df, lambda pdf: pdf.head(1) if pdf["v"].iloc[0] == big else pdf.assign(v=pdf["v"] + 1), "v long").orderBy("_seq").collect()
    assert [r["v"] for r in out] == [None] * 10 + [big + k + 1 for k in range(10, 30)]
    assert [r["_error"] for r in out] == ["10 records went in and 1 came out"] * 10 + [None] * 20


def test_verdicts_in_tasks_by_rows(spark):
    df = spark.range(40).select(F.lit(0).alias("_chunk"), F.lit(0).alias("_batch"), F.floor(F.col("id") / 20).cast("int").alias("_group"), F.col("id").alias("_seq"))
    answers = df.select("_chunk", "_batch", "_group", F.lit(3).alias("index"), F.lit("E").alias("code"), F.lit("m").alias("message")).distinct()
    out = delivery.join_verdicts(df, answers, 7)
    assert out._jdf.queryExecution().toString().count("7), REPARTITION_BY_NUM") >= 2
    assert [r["_seq"] for r in out.where("outcome = 'REJECTED'").orderBy("_seq").collect()] == [3, 23]
    assert chunks.tasks(spark.range(1_000_001), most=250_000) == 5
    assert chunks.tasks(spark.range(0)) == 1


def test_payloads_are_stored_by_short_hashes_with_their_parts(spark, tmp_path):
    rows = [(0, 1, 0, "k", None, "E", "m", "E m", "a", "s"), (0, 2, 0, "k", None, "E", "m", "E m", "a", None), (0, 3, 0, "k", None, "E", "m", "E m", "b", "s")]
    df = spark.createDataFrame(rows, "_chunk int, _seq long, _ordinal int, record_key string, node_id string, code string, message string, signature string, record string, source string")
    payloads.store(df, str(tmp_path), 1)
    held = {r["payload"]: (r["sent"], r["read"], len(r["hash"])) for r in payloads.stored(spark, str(tmp_path), 1, "payloads").collect()}
    assert held == {"a": (True, True, 32), "b": (True, False, 32), "s": (False, True, 32)}
    assert sorted(r["payload"] for r in payloads.replay(spark, str(tmp_path), 1).collect()) == ["a", "s", "s"]
    assert sorted(r["payload"] for r in payloads.replay(spark, str(tmp_path), 1, transforms=False).collect()) == ["a", "a", "b"]


def test_packed_database_holds_any_text(spark):
    texts = ["plain", "", None, "a,b", 'say "x"', "two\nlines", "cr\r\nlf", " spaces ", "\\", 'back\\"q', "ünï 漢 😀", '"', '""', "tab\t", "\r", "null", "'"]
    rows = [(k, t, 0.1 * k if k % 2 else None, Decimal(10**17 + k) if k % 3 else None, k % 2 == 0 if k % 5 else None, date(1999, 12, 1 + k)) for k, t in enumerate(texts)]
    rows += [(None, "no key", 1e-300, Decimal("1.25"), None, None), (3, "same key", None, None, True, None)]
    df = spark.createDataFrame(rows, "`a key` long, t string, d double, n decimal(20,2), b boolean, day date")
    back = spark.read.jdbc(readers.pack_derby(df, "odd", '"a key"'), "odd", properties=readers.DERBY)
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert readers.read_jdbc(spark, readers.pack_derby(df.limit(0), "nothing", '"a key"'), "nothing", key='"a key"', **readers.DERBY).collect() == []
    with pytest.raises(ValueError, match="when"):
        readers.pack_derby(df.withColumn("when", F.current_timestamp()), "odd", '"a key"')


def test_database_of_several_processes(sf, duck, tmp_path):
    """Executors that are other processes than the driver read the database, too."""
    import subprocess

    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
e.queries()["jdbc_round_trip"](s, {sf!r}).write.parquet({str(tmp_path / "out")!r})
s.stop()
"""
    top = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.pathsep.join([top, os.environ.get("PYTHONPATH", "")])}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    got = duck.execute(f"SELECT c_custkey, c_nationkey, c_acctbal FROM '{tmp_path}/out/*.parquet' ORDER BY 1").fetchall()
    assert got == duck.execute("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 10 ORDER BY 1").fetchall()


@pytest.mark.parametrize(("name", "fields"), [("batch_payload", ["o_orderkey"]), ("batch_replace_stamp", ["o_custkey", "o_orderkey"])])
def test_groups_take_along_what_their_function_reads(spark, sf, monkeypatch, name, fields):
    from reckoner.plans import delivering

    staged, grouped = [], []
    numbered, by_group = chunks.numbered, delivery._by_group
    monkeypatch.setattr(chunks, "numbered", lambda df, *a: staged.append(df.columns) or numbered(df, *a))
    monkeypatch.setattr(delivery, "_by_group", lambda df, *a: grouped.append([c for c in df.columns if c not in ("_chunk", "_seq", "_batch", "_group")]) or by_group(df, *a))
    delivering.QUERIES[name](spark, sf)
    assert [sorted(c) for c in staged] == [fields] and grouped and all(sorted(c) == fields for c in grouped)
