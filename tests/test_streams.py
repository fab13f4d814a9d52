"""Topics by cursor, keyed tables and streams over them: restarts, repeats, compaction and late entries, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from reckoner.plans import streams
from reckoner.sources import log
from reckoner.streaming.keyed import KeyedTable, deduplicated, run_upserts
from reckoner.streaming.runner import index_entries, run_stream


def _part(spark, path, name, first, n):
    """One more partition of a topic: a file with a name of its own."""
    spark.range(first, first + n).select(F.col("id").alias("v"), F.timestamp_micros(F.col("id")).alias("at")).coalesce(1).write.parquet(f"{path}-{name}")
    import glob
    import os

    os.makedirs(path, exist_ok=True)
    os.rename(glob.glob(f"{path}-{name}/*.parquet")[0], f"{path}/{name}.parquet")


def test_topic_in_batches(spark, tmp_path):
    path = str(tmp_path / "topic")
    _part(spark, path, "a", 0, 1_000)
    _part(spark, path, "b", 1_000, 10)

    def read(**options):
        return sorted((r["_partition"], r["_offset"], r.v) for r in log.read_log(spark, path, **options).collect())

    whole = [("a.parquet", k, k) for k in range(1_000)] + [("b.parquet", k, 1_000 + k) for k in range(10)]
    assert read() == read(rowsPerPartition="7") == whole and read(startingOffsets="latest") == []
    assert log.read_log(spark, path, rowsPerPartition="100").rdd.getNumPartitions() == 11
    assert read(startingOffsets='{"a.parquet": 990}', endingOffsets='{"a.parquet": 995, "b.parquet": 2}') == whole[990:995] + whole[1_000:1_002]
    assert read(startingOffsets='{"a.parquet": 5000, "b.parquet": -3}') == whole[1_000:]
    with pytest.raises(Exception, match="no partition c"):
        read(startingOffsets='{"c": 1}')
    with pytest.raises(Exception, match="there is no topic"):
        log.read_log(spark, f"{path}-none").count()


def test_topic_as_a_stream_that_is_started_again(spark, tmp_path):
    path, out, at = (str(tmp_path / k) for k in ("topic", "out", "at"))
    _part(spark, path, "a", 0, 500)

    def run(once=True):
        if once:
            run_stream(log.follow_log(spark, path, rowsPerPartition="50"), lambda b: b, out, at).awaitTermination()
        else:
            query = log.follow_log(spark, path, rowsPerBatch="120").writeStream.foreachBatch(lambda b, k: b.withColumn("batch_id", F.lit(k)).write.mode("append").partitionBy("batch_id").parquet(out)).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
            query.processAllAvailable()
            query.stop()
        return sorted(r.v for r in spark.read.parquet(out).collect())

    assert run() == list(range(500))
    _part(spark, path, "b", 500, 300)
    assert run(once=False) == list(range(800)) and run() == list(range(800))
    _part(spark, path, "c", 800, 50)
    assert run() == list(range(850)) and spark.read.parquet(out).groupBy("batch_id").count().count() >= 4
    got = spark.read.parquet(out)
    assert got.select("_partition", "_offset").distinct().count() == 850


def test_budget_of_a_batch_is_shared_by_partitions():
    class Client:
        def __init__(self, options):
            pass

        def bounds(self):
            return {"a": (0, 1_000), "b": (0, 5), "c": (10, 400)}

    import sys
    import types

    sys.modules["_fake_client"] = types.SimpleNamespace(Client=Client)
    reader = log.LogStreamReader(log.StructType(log.PLACE), {"client": "_fake_client:Client", "rowsperbatch": "100", "rowspartition": "30"})
    assert reader.latestOffset() == {"a": 1_000, "b": 5, "c": 400}  # the position isn't known yet
    at, batches, seen = reader.initialOffset(), 0, 0
    assert at == {"a": 0, "b": 0, "c": 10}
    while True:
        end = reader.latestOffset()
        if end == at:
            break
        took = reader.partitions(at, end)
        assert all(p.last - p.first <= 30 for p in took) and sum(p.last - p.first for p in took) <= 100
        seen, at, batches = seen + sum(p.last - p.first for p in took), end, batches + 1
        reader.commit(end)
    assert seen == 1_395 and batches == 14 and at == {"a": 1_000, "b": 5, "c": 400}


def test_keyed_table_is_the_last_entry_of_each_key(spark, tmp_path):
    rng, state = random.Random(1), {}
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4, most_deltas=3)
    with pytest.raises(ValueError, match="no batch"):
        table.read()
    for batch in range(9):
        rows = [(f"k{rng.randrange(60)}", rng.randrange(20), f"{batch}-{k}") for k in range(40)]
        df = spark.createDataFrame(rows, "id string, occurred_at long, v string")
        for k in {r[0] for r in rows}:
            most = max(r[1] for r in rows if r[0] == k)
            if most >= state.get(k, (-1, set()))[0]:
                state[k] = most, {r[2] for r in rows if r[0] == k and r[1] == most}
        assert table.write(df, batch) and not table.write(df.limit(1), batch) and not table.write(df, batch - 1)
        got = {r.id: (r.occurred_at, r.v) for r in KeyedTable(spark, str(tmp_path / "t")).read().collect()}
        assert got.keys() == state.keys() and all(at == state[k][0] and v in state[k][1] for k, (at, v) in got.items())
        assert len(table.manifest()["deltas"]) <= 3
    some = sorted(state)[:5]
    assert sorted(r.id for r in table.read([*some, "none"]).collect()) == some
    table.compact()
    assert table.manifest()["deltas"] == [] and table.read().count() == len(state)
    folders = {n for n in table._names("") if n.startswith(("base", "delta"))}
    assert len(folders) <= 3 + 2 * 3
    with pytest.raises(ValueError, match="the batch"):
        table.write(spark.createDataFrame([("a",)], "id string"), 99)
    with pytest.raises(Exception, match="an entry has no key"):
        table.write(spark.createDataFrame([(None, 1, "x")], "id string, occurred_at long, v string"), 99)


def test_of_two_writers_one_fails(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, occurred_at long")
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.write(df, 0)
    before = table.manifest()
    table.write(df, 1)
    with pytest.raises(RuntimeError, match="written to by another"):
        table._commit(before, batch=1)
    assert table.manifest()["batch"] == 1


def test_stream_of_upserts_that_fails_between_its_steps(spark, tmp_path, monkeypatch):
    """A batch that was written, but whose checkpoint wasn't, comes again: nothing changes."""
    messages = [f'{{"id":"{k % 7}","occurred_at":{k}}}' for k in range(50)] + ["broken", None]
    spark.createDataFrame([(m,) for m in messages], "value string").repartition(4).write.parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "t"))
    write, calls = table.write, []

    def fails_once(batch, batch_id):
        done = write(batch, batch_id)
        calls.append((batch_id, done))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(table, "write", fails_once)

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = run_upserts(stream, lambda b: index_entries(b, "id string, occurred_at long"), table, str(tmp_path / "dead"), str(tmp_path / "at"))
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert (1, False) in calls
    assert {r.id: r.occurred_at for r in table.read().collect()} == {str(k % 7): k for k in range(43, 50)}
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2


def test_repeats_within_a_delay_are_gone_and_late_ones_are_upserted(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00") for k in range(30)]
    files = [rows[:15] + rows[:5], rows[15:], rows[:3] + rows[25:]]  # the third repeats late ones, and others within the delay
    for k, part in enumerate(files):
        spark.createDataFrame(part, "id long, t string").select("id", F.col("t").cast("timestamp").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_stream(deduplicated(stream, "id", "at", "10 minutes"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == set(range(30)) and all(got.count(k) == 1 for k in range(3, 30))


def test_pieces_of_a_large_topic_are_wider():
    out = log.pieces({"a": 100}, {"a": 10_000_000, "b": 5_000}, 700)
    assert len(out) <= log.MOST_PIECES + 2
    assert [(p.first, p.last) for p in out if p.partition == "b"] == [(0, 5_000)]
    own = [p for p in out if p.partition == "a"]
    assert own[0].first == 100 and own[-1].last == 10_000_000 and all(x.last == y.first for x, y in zip(own, own[1:]))
    assert [p.last - p.first for p in log.pieces({}, {"a": 1_500}, 700)] == [700, 700, 100]


def test_messages_of_a_stream_are_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(streams, "MESSAGES", 100)
    batches = []
    stream = streams._sent(spark, spark.range(1_000), 1_000, 4)
    stream.writeStream.foreachBatch(lambda b, k: batches.append(b.count())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    files = list((tmp_path / "stream-in").glob("*.parquet"))
    assert len(files) == 12 and max(spark.read.parquet(str(f)).count() for f in files) <= 100
    assert len(batches) == 2 and sum(batches) == 1_000
