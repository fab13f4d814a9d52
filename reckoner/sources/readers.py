"""Reads: delimited files, databases, messages, page bodies, typed text, dead letters; and the matching writes."""

from __future__ import annotations

import glob
import math
import os
import tempfile
import zipfile
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckoner.operators.chunks import numbered, record_key
from reckoner.sources.scratch import drop_folder, folder

DELIMITERS = {"tab": "\t", "pipe": "|"}

#: Connection properties of Derby, the one database whose driver Spark brings along.
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def read_delimited(spark: SparkSession, path: str, pattern: str = "*.csv", delimiter: str = ",", quote: str = '"', charset: str = "UTF-8", header: bool = True, empty_is_null: bool = False, key: list[str] | None = None, rows: bool = False) -> DataFrame:
    """All fields as text, trimmed; blank lines are skipped, missing trailing fields are null, and columns without a header are column_1 and so on. `_file` is the chunk: files are split and read in parallel. With key, `_key` is the record's key; with rows, `_row` is its place in the file from 1, which takes a window over each file."""
    read = spark.read.option("pathGlobFilter", pattern).option("sep", DELIMITERS.get(delimiter, delimiter)).option("quote", quote).option("encoding", charset)
    read = read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("header", header).option("inferSchema", False)
    df = read.option("nullValue", "" if empty_is_null else "\0").option("emptyValue", "").csv(path)
    if not header:
        df = df.toDF(*(f"column_{k + 1}" for k in range(len(df.columns))))
    out = df.withColumns({"_file": F.col("_metadata.file_name"), "_from": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    if rows:
        out = out.withColumn("_row", F.row_number().over(W.partitionBy("_file").orderBy("_from", "_at")).cast("long"))
    return (out.withColumn("_key", record_key(out, key)) if key else out).drop("_from", "_at")


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, by: str | None = None) -> None:
    """Null as nothing, nested values as JSON; a repeated run overwrites the folder (or the partition of `by`) instead of appending."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    write = df.withColumns(nested).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    write = write.partitionBy(by) if by else write
    write.csv(path, sep=DELIMITERS.get(delimiter, delimiter), header=header, nullValue="", emptyValue="")


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, key: str | None = None, rows: int = 100_000, max_chunks: int = 1_000, **properties: str) -> DataFrame:
    """A table in key-range chunks, planned from the key's bounds under the filter; without a key in one chunk. Each chunk is one task with its rows in the order of the key, and a filter on the result is pushed into its query. Keys of any kind of number have ranges of whole numbers; a key of another kind makes one chunk."""
    source = f"(SELECT {', '.join(columns) if columns else '*'} FROM {table}{f' WHERE {where}' if where else ''}) q"
    if not key:
        return spark.read.jdbc(url, source, properties=properties)
    lo, hi = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {source}) b", properties=properties).first()
    name = key.strip('"`[]')
    if lo is None or isinstance(lo, bool) or not isinstance(lo, (int, float, Decimal)) or not math.isfinite(lo) or not math.isfinite(hi):
        return spark.read.jdbc(url, source, properties=properties).sortWithinPartitions(F.col(f"`{name}`"))
    lo, hi = math.floor(lo), math.floor(hi)
    step = max(rows, -(-(hi - lo + 1) // max_chunks))
    # the range of a key with a fraction is that of its whole part
    parts = [f"{key} >= {a} AND {key} < {min(a + step, hi + 1)}" for a in range(lo, hi + 1, step)]
    return spark.read.jdbc(url, source, predicates=parts, properties=properties).sortWithinPartitions(F.col(f"`{name}`"))


def read_documents(df: DataFrame, matching: Column | None = None, key: str = "_id", first=None, last=None, after=None) -> DataFrame:
    """A chunk of a collection: the documents that match, with keys from first to last (both included), after the last one that was accepted if the read goes on; in the order of the key, which is what makes that meaningful. `_key` is the key as text."""
    out = df if matching is None else df.where(matching)
    for bound, rule in ((first, lambda c, x: c >= x), (last, lambda c, x: c <= x), (after, lambda c, x: c > x)):
        if bound is not None:
            out = out.where(rule(F.col(f"`{key}`"), F.lit(bound)))
    return out.withColumn("_key", F.col(f"`{key}`").cast("string")).sortWithinPartitions(F.col(f"`{key}`"))


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 5_000, **properties: str) -> None:
    """Nested values go as JSON text; each task writes its rows in transactions of `batch`."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    df.withColumns(nested).write.mode(mode).option("batchsize", batch).jdbc(url, table, properties=properties)


def pack_derby(df: DataFrame, table: str, key: str) -> str:
    """df as a table of a new Derby database, with an index on the key (quoted as in SQL); the URL (with DERBY) under which all processes of the application read it. Derby is a library: a database that is written belongs to the one process that opened it, and what executors write into one of that name is another. One that is closed and packed into a file can be read by any number of processes.

    Tasks write the rows as files to the folder that driver and executors share, in ranges of the key. The driver makes the
    table and has Derby load file after file: a stream, of which it holds Derby's pages in cache (1,000) and no rows, but in
    one process; a table that has outgrown that belongs in a database on the network, which write_jdbc() fills from all
    tasks. Columns of numbers, text, booleans and dates.
    """
    odd = [f.name for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType))]
    if odd:
        raise ValueError(f"no columns of numbers, text, booleans or dates: {odd}")
    spark = df.sparkSession
    shared = folder(spark, "derby")
    where = spark._jvm.org.apache.hadoop.fs.Path(shared)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if where.getScheme() != "file":
        raise ValueError(f"Derby can't open files at {where.toString()}: it takes a file system that driver and executors have mounted, or a database on the network")
    path = where.getPath()
    name = key.strip('"')
    # texts in quotes, since Derby trims the others; nothing at all for null
    text = lambda f: F.concat(F.lit('"'), F.replace(F.col(f"`{f.name}`"), F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").cast("string")
    lines = df.repartitionByRange(F.col(f"`{name}`")).sortWithinPartitions(F.col(f"`{name}`")).select(F.concat_ws(",", *(F.coalesce(text(f), F.lit("")) for f in df.schema)))
    lines.write.option("maxRecordsPerFile", 0).text(f"{shared}/rows")
    with tempfile.TemporaryDirectory() as own:
        url = f"jdbc:derby:{own}/db"
        write_jdbc(df.where(F.lit(False)), f"{url};create=true", table, **DERBY)  # no task: the table alone
        connect = spark._jvm.java.sql.DriverManager.getConnection
        connection = connect(url)
        try:
            load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, ',', '\"', 'UTF-8', 0)")
            load.setString(1, table.upper())
            for file in sorted(glob.glob(f"{glob.escape(path)}/rows/part-*.txt")):
                load.setString(2, file)
                load.execute()
            connection.createStatement().execute(f"CREATE INDEX by_key ON {table} ({key})")
        finally:
            connection.close()
            try:
                connect(f"{url};shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # which says that it is closed
                    raise
        # stored as it is: pages are read by their place in the file
        with zipfile.ZipFile(f"{path}/db.jar", "w", zipfile.ZIP_STORED) as pack:
            for top, _, files in os.walk(f"{own}/db"):
                for file in files:
                    if not file.endswith(".lck"):
                        pack.write(os.path.join(top, file), os.path.relpath(os.path.join(top, file), own))
    drop_folder(spark, f"{shared}/rows")
    return f"jdbc:derby:jar:({path}/db.jar)db"


def keyed_statement(dialect: str, table: str, columns: list[str], keys: list[str], mode: str) -> str:
    """One parametrised statement that inserts, or updates or ignores where the key exists, in a database's own words."""
    mode, rest = mode.upper(), [c for c in columns if c not in keys]
    names, marks = ", ".join(columns), ", ".join("?" for _ in columns)
    plain = f"INSERT INTO {table} ({names}) VALUES ({marks})"
    if mode == "INSERT":
        return plain
    if mode not in ("UPSERT", "IGNORE") or not keys:
        raise ValueError(f"mode {mode!r} with keys {keys}")
    update = mode == "UPSERT" and rest
    if dialect == "postgresql":
        return f"{plain} ON CONFLICT ({', '.join(keys)}) DO " + ("UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in rest) if update else "NOTHING")
    if dialect == "mysql":
        return f"{plain} ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in rest) if update else plain.replace("INSERT", "INSERT IGNORE", 1)
    if dialect in ("sqlserver", "oracle"):
        source = ", ".join(f"? AS {c}" for c in columns)
        using = f"(SELECT {source} FROM dual) s" if dialect == "oracle" else f"(SELECT {source}) AS s"
        on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        matched = " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in rest) if update else ""
        return f"MERGE INTO {table} t USING {using} ON ({on}){matched} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join('s.' + c for c in columns)})" + (";" if dialect == "sqlserver" else "")
    raise ValueError(f"no dialect {dialect!r}")


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """df with payload: JSON objects and arrays as they are, other text as {"value": text}, a null value as {"value": null}; and tombstone."""
    raw = F.col(value).cast("string")
    json = F.trim(raw).rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(raw).isNotNull()
    wrapped = F.concat(F.lit('{"value":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(raw.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null")), F.lit("}"))
    return df.withColumns({"payload": F.when(raw.isNull(), '{"value":null}').when(json, raw).otherwise(wrapped), "tombstone": raw.isNull()})


def lineage(df: DataFrame) -> Column:
    """A message's topic, partition, offset and time as text headers, before its own headers with a prefix."""
    own = F.create_map(*(x for c in ("topic", "partition", "offset", "timestamp") for x in (F.lit(f"source.{c}"), F.col(c).cast("string"))))
    if "headers" not in df.columns:
        return own
    return F.map_concat(own, F.map_from_entries(F.transform("headers", lambda h: F.struct(F.concat(F.lit("header."), h["key"]), h["value"].cast("string")))))


def _json_path(pointer: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in pointer.strip("/").split("/") if p)


def page_records(pages: DataFrame, body: str, records: str, key: str, cursor: str | None = None) -> DataFrame:
    """One row for each record of captured page bodies: record (JSON), record_key, cursor (of the next page) and index; JSON pointers say where they are. A body whose records aren't an array fails the job."""
    found = F.get_json_object(body, _json_path(records)) if records.strip("/") else F.col(body)
    listed = F.try_variant_get(F.try_parse_json(found), "$", "array<variant>")
    checked = F.when(listed.isNull(), F.raise_error(F.lit("a page has no array of records"))).otherwise(listed)
    out = pages.withColumn("_list", checked).withColumn("cursor", F.get_json_object(body, _json_path(cursor)) if cursor else F.lit(None).cast("string"))
    out = out.select("*", F.posexplode("_list").alias("index", "_record")).withColumn("record", F.to_json("_record"))
    return out.withColumn("record_key", F.get_json_object("record", _json_path(key))).drop("_list", "_record")


def typed_text(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns with the declared types; what doesn't convert stays beside it as `<name>_raw`."""
    made = {}
    for c, kind in kinds.items():
        value = F.col(c).try_cast(kind) if not kind.lower().startswith(("array", "map", "struct")) else F.from_json(c, kind)
        made |= {c: value, f"{c}_raw": F.when(value.isNull(), F.col(c))}
    return df.withColumns(made)


def dead_letters(errors: DataFrame, run_id, per_window: int) -> DataFrame:
    """A run's dead letters in order of chunk and seq, with the window in which each is read again; windows are not capped."""
    own = numbered(errors.where(F.col("run_id") == run_id), ["chunk", "seq", "ordinal"])
    return own.withColumn("window", F.floor(F.col("_row") / per_window).cast("int")).withColumn("replay_of", F.col("run_id")).drop("_row")


def preview(df: DataFrame, n: int = 10) -> tuple[list, bool]:
    """The first rows (between 1 and 100) and whether there are more."""
    n = min(max(n, 1), 100)
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n
