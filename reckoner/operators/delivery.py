"""Batches, delivery groups, user functions over records and groups, and what a grouped write sends and hears back."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.sources.scratch import drop_folder, folder

# Code and message of a rejection whose answer gives none.
NO_CODE, NO_REASON = "REJECTED", "The destination refused this record"

#: Rows of a chunk that one task folds by bytes, at least.
FOLD = 20_000


def places(df: DataFrame) -> list[str]:
    """What orders the records of a chunk: the place of the record that was read, then the ordinal among its siblings."""
    return ["_seq", "_ordinal"] if "_ordinal" in df.columns else ["_seq"]


def assign_batches(df: DataFrame, max_records: int, max_bytes: int | None = None, size: str = "_bytes") -> DataFrame:
    """df (`_chunk`, `_seq` from 1 without gaps) with `_batch`, from 0: a batch is full when a record makes it reach max_records or max_bytes. With bytes (null counts as 0, none is negative) a chunk is folded in blocks of rows, however many it has: each block tells, for each place where its first batch may begin, where the first of the next block begins and how many batches lie between; these are chained, and blocks are numbered from the true places. Siblings count one by one by their bytes, and go with their record by max_records."""
    if max_bytes is None:
        return df.withColumn("_batch", F.floor((F.col("_seq") - 1) / max_records).cast("int"))
    longest = df.groupBy("_chunk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= FOLD:
        return _folded(df, max_records, max_bytes, size)
    span = max(FOLD, 50 * max_records)

    def follow(sizes: pd.Series) -> np.ndarray:
        """For each row, the place after the batch that begins there."""
        held = np.concatenate([[0], np.cumsum(sizes.fillna(0).to_numpy())])
        at = np.arange(len(sizes))
        return np.minimum(np.maximum(np.searchsorted(held, held[:-1] + max_bytes), at + 1), at + max_records)

    def offer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        after, n = follow(pdf[size]).tolist(), int((~pdf["_ahead"]).sum())
        hop, made = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            t = after[k]
            hop[k], made[k] = (t - n, 1) if t >= n else (hop[t], made[t] + 1)
        return pd.DataFrame({"_chunk": pdf["_chunk"].iloc[:1], "_block": pdf["_block"].iloc[:1], "_hop": [hop[:max_records]], "_made": [made[:max_records]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        entry, batch, out = 0, 0, []
        for hop, made in zip(pdf["_hop"], pdf["_made"], strict=True):
            out.append((entry, batch))
            if entry < len(hop):  # else the chunk ends before
                entry, batch = int(hop[entry]), batch + int(made[entry])
        return pd.DataFrame({"_chunk": pdf["_chunk"], "_block": pdf["_block"], "_entry": [x for x, _ in out], "_base": [x for _, x in out]})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        after, begins, k = follow(pdf[size]).tolist(), np.zeros(len(pdf), np.int64), int(pdf["_entry"].iloc[0])
        while k < len(begins):
            begins[k], k = 1, after[k]
        return pd.DataFrame({"_chunk": pdf["_chunk"], "_seq": pdf["_seq"], "_batch": pdf["_base"].iloc[0] - 1 + np.cumsum(begins)})

    block = F.floor((F.col("_seq") - 1) / span).cast("long")
    if "_ordinal" in df.columns:
        df = df.withColumn("_own", F.col("_seq")).withColumn("_seq", F.row_number().over(W.partitionBy("_chunk").orderBy("_own", "_ordinal")).cast("long"))
    rows = df.select("_chunk", "_seq", size).withColumn("_block", block)
    ahead = rows.where((F.col("_block") > 0) & ((F.col("_seq") - 1) % span < max_records)).withColumn("_block", F.col("_block") - 1)
    both = rows.withColumn("_ahead", F.lit(False)).unionByName(ahead.withColumn("_ahead", F.lit(True)))
    offers = both.groupBy("_chunk", "_block").applyInPandas(offer, "_chunk int, _block long, _hop array<int>, _made array<int>")
    entries = offers.groupBy("_chunk").applyInPandas(chain, "_chunk int, _block long, _entry int, _base int")  # max_records entries for each block
    numbered = rows.join(entries, ["_chunk", "_block"]).groupBy("_chunk", "_block").applyInPandas(number, "_chunk int, _seq long, _batch int")
    out = df.join(numbered, ["_chunk", "_seq"])
    return out.withColumn("_seq", F.col("_own")).drop("_own") if "_ordinal" in df.columns else out


def _folded(df: DataFrame, max_records: int, max_bytes: int, size: str) -> DataFrame:
    """assign_batches() for chunks of FOLD rows at most: tasks get whole chunks in order, and go through them once."""
    names, order = df.columns, places(df)
    at = {c: k for k, c in enumerate(names)}

    def run(batches):
        chunk = None
        held = records = number = 0
        for b in batches:
            out = np.empty(b.num_rows, np.int32)
            sizes = b.column(at[size]).fill_null(0).to_pylist()
            for k, (own, n) in enumerate(zip(b.column(at["_chunk"]).to_pylist(), sizes, strict=True)):
                if own != chunk:
                    chunk, held, records, number = own, 0, 0, 0
                elif held >= max_bytes or records >= max_records:
                    held, records, number = 0, 0, number + 1
                held, records = held + n, records + 1
                out[k] = number
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*names, "_batch"])

    dealt = df.repartition("_chunk").sortWithinPartitions("_chunk", *order)
    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())]))


def assign_groups(df: DataFrame, size: int | None = None, label: Column | None = None) -> DataFrame:
    """df with `_group`, from 0 in each batch: the whole batch, `size` records each, or one group for each label, in the order of first appearance; no label is a label of its own."""
    batch = W.partitionBy("_chunk", "_batch")
    if label is not None:
        df = df.withColumn("_label", F.coalesce(label.cast("string"), F.lit("")))
        df = df.withColumn("_first", F.min(F.struct(*places(df))).over(W.partitionBy("_chunk", "_batch", "_label")))
        return df.withColumn("_group", F.dense_rank().over(batch.orderBy("_first")) - 1).drop("_first")
    if size is None:
        return df.withColumn("_group", F.lit(0))
    return df.withColumn("_group", F.floor((F.row_number().over(batch.orderBy(*places(df))) - 1) / size).cast("int"))


def fan_out(df: DataFrame, outputs: Column, name: str = "item") -> DataFrame:
    """One row for each non-null output of a record, with `_ordinal` from 0; a record without outputs is kept once, as filtered. Siblings that are fanned out again are numbered through, in order."""
    left = F.filter(outputs, lambda x: x.isNotNull())
    out = df.select("*", F.posexplode_outer(left).alias("_fan_place", name)).withColumn("_filtered", F.col("_fan_place").isNull())
    if "_ordinal" in df.columns:
        return out.withColumn("_ordinal", F.row_number().over(W.partitionBy("_chunk", "_seq").orderBy("_ordinal", "_fan_place")) - 1).drop("_fan_place")
    return out.withColumn("_ordinal", F.coalesce("_fan_place", F.lit(0))).drop("_fan_place")


def apply_record(df: DataFrame, fn: Callable[[dict], object], schema: str, node: str | None = None) -> DataFrame:
    """A Python function over records: a dict maps the record, a list fans it out, None filters it; an exception becomes `_error`, with the node's id as `_node` if one is given. The envelope (names with an underscore) passes through. Columns do what they can; this is for the rest."""
    envelope = [c for c in df.columns if c.startswith("_") and c not in ("_ordinal", "_error", "_filtered", "_node")]
    kinds = dict(df.dtypes)

    def run(parts):
        for pdf in parts:
            rows = []
            for record in pdf.to_dict("records"):
                own = {k: record[k] for k in envelope}
                try:
                    made = fn({k: v for k, v in record.items() if not k.startswith("_")})
                    outs = [x for x in (made if isinstance(made, list) else [made]) if x is not None]
                    rows += [own | x | {"_ordinal": k, "_filtered": False} for k, x in enumerate(outs)] or [own | {"_ordinal": 0, "_filtered": True}]
                except Exception as e:  # what a user's function throws is data
                    rows.append(own | {"_ordinal": 0, "_filtered": False, "_error": str(e), "_node": node})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in envelope), schema, "_ordinal int, _filtered boolean, _error string", *(["_node string"] if node else [])])
    names = df.sparkSession.createDataFrame([], full).columns
    return df.mapInPandas(run, full)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """What groups gave for a column, one after another; as objects where their kinds differ, so that whole numbers beside missing ones stay as they are."""
    if len({x.dtype for x in parts}) > 1:
        parts = [x if x.dtype == object else pd.Series(x).astype(object).to_numpy() for x in parts]
    return np.concatenate(parts)


def _by_group(df: DataFrame, keys: list[str], passed: list[str], call: Callable[[pd.DataFrame], dict], schema: str, node: str | None = None) -> DataFrame:
    """What call makes of each group of keys (its fields, in the order of places): columns by name, as long as the group; an exception is the group's `_error`. Columns of `passed` go beside it as they are.

    A task gets its groups one after another, many in one exchange with Python, and only the fields are cut up by group. That
    a group is whole in a task is asked for by a window, so rows that lie together by chunk or batch aren't shuffled again.
    """
    kinds = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], schema).schema}
    fields = [c for c in df.columns if not c.startswith("_")]
    own = [c for c in kinds if c not in (*passed, "_error", "_node")]

    def block(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sizes, made, errors = np.diff(starts), [], []
        cut = pdf[fields]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            group = cut.iloc[a:b].copy()
            group.index = pd.RangeIndex(b - a)
            try:
                made.append(call(group))
                errors.append(None)
            except Exception as e:  # what a user's function throws is data
                made.append({})
                errors.append(str(e))
        out = {c: pdf[c] for c in passed}
        for c in own:
            value = _joined([x[c] if c in x else np.full(n, None, object) for x, n in zip(made, sizes, strict=True)])
            # texts as plain objects, as Arrow wants them; also those that are all missing
            out[c] = np.array([*(x if isinstance(x, str) else None for x in value), None], object)[:-1] if isinstance(kinds[c], T.StringType) else value
        out["_error"] = np.repeat(np.array([*errors, None], object)[:-1], sizes)
        if "_node" in kinds:
            out["_node"] = np.where(pd.notna(out["_error"]), node, None)
        return pd.DataFrame(out)[list(kinds)]

    def run(parts):
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            before = pdf[keys].shift()
            starts = np.flatnonzero(((pdf[keys] != before) & ~(pdf[keys].isna() & before.isna())).any(axis=1).to_numpy() | (np.arange(len(pdf)) == 0))
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1:
                yield block(pdf.iloc[: starts[-1]].reset_index(drop=True), starts)
        if rest is not None:
            yield block(rest, np.array([0, len(rest)]))

    order = places(df)
    dealt = df.withColumn("_group_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _frame(made: pd.DataFrame, n: int, columns: list[str]) -> dict:
    """The columns of what a function made of n records, which have to be as many."""
    if len(made) != n:
        raise ValueError(f"{n} records went in and {len(made)} came out")
    return {c: made[c].to_numpy() for c in columns if c in made.columns}


def _grouped(df: DataFrame, call: Callable[[pd.DataFrame], dict], schema: str, node: str | None) -> DataFrame:
    """call over each delivery group, beside the envelope."""
    kinds = dict(df.dtypes)
    kept = [c for c in df.columns if c.startswith("_") and c not in ("_error", "_node", "_envelope")]
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), schema, "_error string", *(["_node string"] if node else [])])
    return _by_group(df, ["_chunk", "_batch", "_group"], kept, call, full, node)


def apply_groups(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, node: str | None = None) -> DataFrame:
    """A function over each delivery group, in order: as many rows out as in, paired by position; else, or on an exception, the whole group carries `_error` (and `_node`, the node's id, if one is given). The envelope passes through."""
    columns = df.sparkSession.createDataFrame([], schema).columns

    def call(own: pd.DataFrame) -> dict:
        n = len(own)
        return _frame(fn(own), n, columns)

    return _grouped(df, call, schema, node)


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | dict | list], schema: str, single_request: bool, node: str | None = None) -> DataFrame:
    """A function over each delivery group that rewrites its records (a frame, as in apply_groups()) or gives one payload for all of them (an object or array), which goes to `_envelope` as JSON beside the group's first record; that is for destinations that take a group in one request, and for others every record of the group carries the error that says so."""
    columns = df.sparkSession.createDataFrame([], schema).columns
    known = {c for c in df.columns if not c.startswith("_")}.issuperset(columns)

    def call(own: pd.DataFrame) -> dict:
        n = len(own)
        made = fn(own)
        if isinstance(made, pd.DataFrame):
            return _frame(made, n, columns)
        if not single_request:
            raise ValueError("the function gave one payload for the whole group, and the destination writes records one by one")
        body = np.full(n, None, object)
        body[0] = json.dumps(made, ensure_ascii=False)
        return ({c: own[c].to_numpy() for c in columns} if known else {}) | {"_envelope": body}

    return _grouped(df, call, f"{schema}, _envelope string", node)


def envelopes(df: DataFrame, fields: list[str], wrap: str | None = None) -> DataFrame:
    """One request body for each delivery group: the records in order, as a JSON array or as a field of an object; a group is as large as the delivery policy makes it."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*places(df), F.struct(*fields).alias("r")))), lambda x: x["r"])
    body = F.to_json(F.struct(rows.alias(wrap))) if wrap else F.to_json(rows)
    return df.groupBy("_chunk", "_batch", "_group").agg(F.count("*").alias("records"), body.alias("body"))


def join_verdicts(df: DataFrame, answers: DataFrame, tasks: int | None = None) -> DataFrame:
    """df with the outcome of each record from answers (`_chunk`, `_batch`, `_group`, index, code, message): those named are REJECTED, with NO_CODE and NO_REASON where the answer says nothing, the others WRITTEN; of several answers for a record the one with the least code and message counts, and indexes that don't exist are ignored. tasks: into how many the join is cut (chunks.tasks()); Spark's choice goes by compressed bytes, of which places and codes have very few."""
    keys = ["_chunk", "_batch", "_group"]
    placed = df.withColumn("_index", F.row_number().over(W.partitionBy(*keys).orderBy(*places(df))) - 1)
    said = F.struct(F.coalesce("code", F.lit(NO_CODE)).alias("code"), F.coalesce("message", F.lit(NO_REASON)).alias("message"))
    named = answers.where("index is not null").groupBy(*keys, F.col("index").alias("_index")).agg(F.min(said).alias("_said"))
    if tasks:
        placed, named = (x.repartition(tasks, *keys, "_index") for x in (placed, named))
    out = placed.join(named, [*keys, "_index"], "left").drop("_index", "code", "message")
    return out.withColumns({"code": F.col("_said.code"), "message": F.col("_said.message"), "outcome": F.when(F.col("_said").isNotNull(), "REJECTED").otherwise("WRITTEN")}).drop("_said")


def delivered(df: DataFrame, answers: DataFrame, calls: DataFrame, later: bool = False) -> DataFrame:
    """df with the outcome of each record after its group's call. calls (`_chunk`, `_batch`, `_group`, failure): a group whose call failed is CALL_FAILED, since there was no verdict; of the others the records that answers name are REJECTED, and the rest WRITTEN, or SENT if the destination decides later."""
    keys = ["_chunk", "_batch", "_group"]
    failed = calls.groupBy(*keys).agg(F.min("failure").alias("failure"))
    out = join_verdicts(df, answers).join(failed, keys, "left")
    lost, rejected = F.col("failure").isNotNull(), F.col("outcome") == "REJECTED"
    return out.withColumns({
        "outcome": F.when(lost, "CALL_FAILED").when(rejected, "REJECTED").otherwise("SENT" if later else "WRITTEN"),
        "code": F.when(lost, "CALL_FAILED").otherwise(F.col("code")), "message": F.when(lost, F.col("failure")).otherwise(F.col("message")),
    }).drop("failure")


def settle_counters(counters: DataFrame, settled: DataFrame, by: str) -> DataFrame:
    """counters (by, written, failed) after late verdicts: each record of settled (by, outcome, verdict) that a verdict refused moves from written to failed."""
    late = settled.where(F.col("verdict").isNotNull() & (F.col("outcome") == "REJECTED")).groupBy(by).agg(F.count("*").alias("_late"))
    moved = F.coalesce("_late", F.lit(0))
    return counters.join(late, by, "left").withColumns({"written": F.col("written") - moved, "failed": F.col("failed") + moved}).drop("_late")


def bulk_write(target: DataFrame, batch: DataFrame, key: str, mode: str, order: str) -> tuple[DataFrame, DataFrame]:
    """target after an unordered write of documents, and batch with `_error` for each record that was refused while the others went through: no key, a key that exists (INSERT; also of a second one in the batch), or one that doesn't (REPLACE). UPSERT and REPLACE keep the last write of a key by `order`."""
    mode = mode.upper()
    if mode not in ("INSERT", "UPSERT", "REPLACE"):
        raise ValueError(f"no write mode {mode!r}")
    there = target.select(F.col(key).alias("_there_key")).distinct().withColumn("_there", F.lit(True))
    judged = batch.join(there, F.col(key) == F.col("_there_key"), "left").drop("_there_key")
    known, missing = F.coalesce("_there", F.lit(False)), F.col(key).isNull()
    error = F.when(missing, "a document has no key")
    if mode == "INSERT":
        # rows without a key are dealt out by their order, so that they don't meet in one task
        second = F.row_number().over(W.partitionBy(key, F.when(missing, F.col(order))).orderBy(order)) > 1
        error = error.when(known | second, "a document with this key exists")
    elif mode == "REPLACE":
        error = error.when(~known, "no document has this key")
    judged = judged.withColumn("_error", error).drop("_there")
    good = judged.where("_error is null").drop("_error")
    return _written_over(target, _last_writes(good, [key], order).select(*target.columns), [key], mode), judged


def write_keyed(df: DataFrame, connect: Callable[[], object], statement: str, batch: int = 1_000) -> None:
    """Runs a keyed statement (readers.keyed_statement) for each row, in transactions of `batch` rows, on a connection (Python's DB-API) for each partition. Keyed statements can be repeated, so a lost task is simply run again."""

    def run(rows):
        connection, held = connect(), []
        try:
            cursor = connection.cursor()
            for row in rows:
                held.append(tuple(row))
                if len(held) == batch:
                    cursor.executemany(statement, held)
                    connection.commit()
                    held = []
            if held:
                cursor.executemany(statement, held)
                connection.commit()
        finally:
            connection.close()

    df.foreachPartition(run)


def settle(sent: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Records that were SENT, with the verdict that came later: results (key, message) lists failures only."""
    bad = results.select(key, F.col("message").alias("_late")).dropDuplicates([key])
    return sent.join(bad, key, "left").withColumn("outcome", F.when(F.col("outcome") != "SENT", F.col("outcome")).when(F.col("_late").isNotNull(), "REJECTED").otherwise("WRITTEN")).withColumnRenamed("_late", "verdict")


def _last_writes(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def _written_over(target: DataFrame, last: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """target with the rows of last in place of those of the same keys; rows with other keys are added, unless mode is REPLACE."""
    columns = target.columns
    kept = target.join(last.select(*keys), keys, "left_anti").select(*columns)
    return kept.unionByName(last.join(target.select(*keys), keys, "left_semi").select(*columns) if mode == "REPLACE" else last)


def merge(target: DataFrame, batch: DataFrame, keys: list[str], mode: str, order: str) -> DataFrame:
    """target after a keyed write of batch: INSERT fails on keys that exist, UPSERT replaces or adds, IGNORE only adds, REPLACE only replaces. The last write of a key by `order` counts. A null key fails the job: it would put all such rows on one."""
    mode = mode.upper()
    if mode not in ("INSERT", "UPSERT", "IGNORE", "REPLACE"):
        raise ValueError(f"no write mode {mode!r}")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    columns = target.columns
    batch = batch.withColumn(keys[0], F.when(null, F.raise_error(F.lit("a record has no key"))).otherwise(F.col(keys[0])))
    last = _last_writes(batch, keys, order).select(*columns)
    if mode == "INSERT":
        clash = target.select(*keys).withColumn("_there", F.lit(True))
        checked = last.join(clash, keys, "left")
        return target.unionByName(checked.withColumn(keys[0], F.when(F.col("_there"), F.raise_error(F.lit("a key exists"))).otherwise(F.col(keys[0]))).select(*columns))
    if mode == "IGNORE":
        return target.unionByName(last.join(target.select(*keys), keys, "left_anti").select(*columns))
    return _written_over(target, last, keys, mode)


def staged_export(df: DataFrame, path: str, max_bytes: int, sep: str = "\n", delete: bool = False, order: list[str] | None = None) -> DataFrame:
    """Writes CSV files of max_bytes at most, header included, in the given order (or in that of the read), and returns their manifest: number, file (below path), rows, bytes; the rows of a file come before those of the next. A record that has more bytes than fit a file fails the job before anything is written. A job that deletes gets the column Id alone.

    Rows are placed by the bytes of all rows before them, so that files are filled in parallel: a file takes the rows that begin in its stretch, which is shorter than max_bytes by one row of the largest size.
    """
    df = df.select("Id", *(c for c in order or [] if c != "Id")) if delete else df
    columns = ["Id"] if delete else df.columns
    sized = df.withColumn("_export_bytes", (F.octet_length(F.to_csv(F.struct(*columns), {"nullValue": "", "emptyValue": ""})) + len(sep.encode())).cast("long"))
    stage = folder(df.sparkSession, "export")
    (sized.repartitionByRange(*order).sortWithinPartitions(*order) if order else sized).write.option("maxRecordsPerFile", 0).parquet(stage)
    held = df.sparkSession.read.schema(sized.schema).parquet(stage)
    held = held.select("*", F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("int").alias("_export_range"), F.col("_metadata.row_index").alias("_export_at"))
    head = len(",".join(columns).encode()) + len(sep.encode())
    largest = held.agg(F.max("_export_bytes")).first()[0] or 0
    stretch = max_bytes - head - largest + 1
    if stretch < 1:
        raise ValueError(f"a record takes {largest} bytes beside a header of {head}, and a file {max_bytes}")
    totals = held.groupBy("_export_range").agg(F.sum("_export_bytes").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(W.orderBy("_export_range")) - F.col("_n")).drop("_n")  # a row for each range
    inside = W.partitionBy("_export_range").orderBy("_export_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    begin = F.sum("_export_bytes").over(inside) - F.col("_export_bytes") + F.col("_before")
    placed = held.join(F.broadcast(before), "_export_range").withColumn("export_file", F.floor(begin / stretch))
    # all rows of a file are in one task, which writes it alone
    spread = placed.repartition("export_file").sortWithinPartitions("export_file", "_export_range", "_export_at").select(*columns, "export_file")
    spread.write.partitionBy("export_file").option("maxRecordsPerFile", 0).csv(path, header=True, lineSep=sep, nullValue="", emptyValue="")
    drop_folder(df.sparkSession, stage)
    schema = df.select(*columns).schema
    back = df.sparkSession.read.csv(path, header=True, schema=schema, nullValue="", lineSep=sep if len(sep) == 1 else None, multiLine=False)
    back = back.select(F.col("export_file").cast("long").alias("number"), F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return back.groupBy("number", "file", "bytes").agg(F.count("*").alias("rows"))


def run_splitter(df: DataFrame, fn: Callable[[pd.DataFrame], list], name: str = "_label") -> DataFrame:
    """df (`_chunk`, `_batch`) with the label that fn gives each record of a batch, in order; on an exception, on another number of labels or on a label that is neither text nor a number, the whole batch carries `_error`. A batch is as large as the delivery policy makes it."""
    kinds = [f"`{c}` {t}" for c, t in df.dtypes if c not in (name, "_error")]
    kept = [c for c in df.columns if c not in (name, "_error")]

    def call(own: pd.DataFrame) -> dict:
        n = len(own)
        made = list(fn(own))
        wrong = next((type(x).__name__ for x in made if x is not None and (isinstance(x, bool) or not isinstance(x, (str, int, float, np.integer, np.floating)))), None)
        if len(made) != n:
            raise ValueError(f"{n} records went in and {len(made)} labels came out")
        if wrong:
            raise ValueError(f"a label is a {wrong}")
        return {name: np.array([*(None if x is None else str(x) for x in made), None], object)[:-1]}

    return _by_group(df, ["_chunk", "_batch"], kept, call, ", ".join([*kinds, f"`{name}` string", "_error string"]))


def try_out(df: DataFrame, fn: Callable[[dict], object], schema: str, n: int = 10) -> DataFrame:
    """A record function on the first n records (between 1 and 100) of df (`_seq`): what came out, and a note on each record that was dropped, fanned out or refused."""
    sample = df.orderBy("_seq").limit(min(max(n, 1), 100))
    out = apply_record(sample, fn, schema)
    siblings = F.count("*").over(W.partitionBy("_seq"))
    note = F.when(F.col("_error").isNotNull(), F.concat(F.lit("threw: "), F.col("_error"))).when(F.col("_filtered"), "dropped").when(siblings > 1, F.concat(F.lit("fanned out into "), siblings.cast("string")))
    return out.withColumn("note", note)


def try_out_groups(df: DataFrame, fn: Callable, kind: str, schema: str = "", n: int = 10) -> DataFrame:
    """A batch function (BATCH) or a splitter (SPLIT) on the first n records (between 1 and 100) of df (`_seq`) as one batch: what it makes of each, `call` (the number of the request it would go out in, from 0; labels in the order of their first records), calls (how many there would be) and a note on what went wrong."""
    kind = kind.upper()
    if kind not in ("BATCH", "SPLIT"):
        raise ValueError(f"no kind of function {kind!r} over batches")
    sample = df.orderBy("_seq").limit(min(max(n, 1), 100)).withColumns({"_chunk": F.lit(0), "_batch": F.lit(0), "_group": F.lit(0)})
    if kind == "BATCH":
        out = apply_batches(sample, fn, schema, single_request=True).withColumn("call", F.lit(0))
    else:
        out = assign_groups(run_splitter(sample, fn), label=F.col("_label")).withColumn("call", F.col("_group"))
    calls = F.max(F.when(F.col("_error").isNull(), F.col("call"))).over(W.partitionBy("_chunk")) + 1  # of n records
    return out.withColumns({"calls": F.coalesce(calls, F.lit(0)), "note": F.when(F.col("_error").isNotNull(), F.concat(F.lit("threw: "), F.col("_error")))})


def to_messages(df: DataFrame, key: str | None = None, record_key: str = "_key") -> DataFrame:
    """key and value of a message for each record: the value is the record as JSON, the key one of its fields, or the record's own key where there is none."""
    fields = [c for c in df.columns if not c.startswith("_")]
    own = F.col(record_key).cast("string")
    return df.select((F.coalesce(F.col(key).cast("string"), own) if key else own).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def envelope_messages(df: DataFrame, body: str = "body", record_key: str = "_key") -> DataFrame:
    """key and value of a message for each delivery group of df (envelope()'s bodies beside the records): the value is the group's body, and the key that of its first record."""
    return df.groupBy("_chunk", "_batch", "_group").agg(F.min_by(F.col(record_key).cast("string"), F.struct(*places(df))).alias("key"), F.max(body).alias("value"))


def write_staged(df: DataFrame, connect: Callable[[], object], table: str, job: str, commit: str | None = None, batch: int = 1_000) -> int:
    """Writes the rows of df to a table so that they are there once, whatever tasks are repeated or run twice, for statements that can't be repeated. Returns the rows that were added: none if the job was committed before.

    Tasks write to `<table>_staged` under (job, partition, attempt). The driver learns which attempt of each partition has
    ended well, and one transaction of the server takes these rows over and notes the job in `<table>_jobs`; what other
    attempts have left is deleted. connect gives a connection (Python's DB-API with `?` marks); commit: the statement that takes
    the rows over, with {rows} for the chosen rows' query (an INSERT ... SELECT if not given; a MERGE or ON CONFLICT for upserts).
    """
    columns, staged, jobs, chosen = list(df.columns), f"{table}_staged", f"{table}_jobs", f"{table}_chosen"
    names = ", ".join(columns)
    connection = connect()
    try:
        cursor = connection.cursor()
        for made in (f"CREATE TABLE IF NOT EXISTS {staged} AS SELECT '' AS stage_job, 0 AS stage_part, 0 AS stage_attempt, {names} FROM {table} WHERE 1 = 0", f"CREATE TABLE IF NOT EXISTS {chosen} (job VARCHAR(64), part BIGINT, attempt BIGINT)", f"CREATE TABLE IF NOT EXISTS {jobs} (job VARCHAR(64) PRIMARY KEY, added BIGINT)"):
            cursor.execute(made)
        connection.commit()
        cursor.execute(f"SELECT added FROM {jobs} WHERE job = ?", (job,))
        if cursor.fetchone():
            return 0
    finally:
        connection.close()
    statement = f"INSERT INTO {staged} (stage_job, stage_part, stage_attempt, {names}) VALUES ({', '.join('?' * (len(columns) + 3))})"

    def run(batches):
        context = TaskContext.get()
        place = (job, context.partitionId(), context.taskAttemptId())
        own, n = connect(), 0
        try:
            cursor = own.cursor()
            for b in batches:
                rows = [(*place, *r.values()) for r in b.to_pylist()]
                for k in range(0, len(rows), batch):
                    cursor.executemany(statement, rows[k : k + batch])
                    own.commit()
                n += len(rows)
        finally:
            own.close()
        yield pa.RecordBatch.from_pydict({"part": [place[1]], "attempt": [place[2]], "rows": [n]}, pa.schema([("part", pa.int64()), ("attempt", pa.int64()), ("rows", pa.int64())]))

    ended = df.mapInArrow(run, "part long, attempt long, rows long").collect()  # a row for each partition
    connection = connect()
    try:
        cursor = connection.cursor()
        cursor.execute(f"DELETE FROM {chosen} WHERE job = ?", (job,))
        cursor.executemany(f"INSERT INTO {chosen} (job, part, attempt) VALUES (?, ?, ?)", [(job, r["part"], r["attempt"]) for r in ended])
        rows = f"SELECT {', '.join('s.' + c for c in columns)} FROM {staged} s JOIN {chosen} c ON s.stage_job = c.job AND s.stage_part = c.part AND s.stage_attempt = c.attempt WHERE c.job = '{job.replace(chr(39), chr(39) * 2)}'"
        cursor.execute((commit or f"INSERT INTO {table} ({names}) {{rows}}").format(rows=rows))
        added = sum(r["rows"] for r in ended)
        cursor.execute(f"INSERT INTO {jobs} (job, added) VALUES (?, ?)", (job, added))
        for t, c in ((staged, "stage_job"), (chosen, "job")):
            cursor.execute(f"DELETE FROM {t} WHERE {c} = ?", (job,))
        connection.commit()
        return added
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
