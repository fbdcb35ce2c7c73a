"""Ledgers: what was read of a folder, what a run logged, and which chunks of a written table count.

* ``read_ledger``: a row for each file with its status; contents are opened only until enough files could be read.
* ``log``, ``latest``: an append-only table (run, key, value, step, at).
* ``write_chunk``, ``read_chunks``, ``deletable``, ``clean``: chunks are written under names of their own and count once a manifest row names
  them, so a write that fails half-way or is repeated leaves one consistent table.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- files -------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """path and length of the files below ``root`` with the suffix, empty ones included; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(root)
    every = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]  # names only, as any listing
    sizes = files.select("path", F.col("length").alias("_n"))  # a scan leaves out empty files
    return spark.createDataFrame(every, "path string").join(sizes, "path", "left").select("path", F.coalesce("_n", F.lit(0)).alias("length"))


def parquet_rows(content: bytes) -> int:
    """Rows of a Parquet file; raises if it can't be read to its end."""
    return sum(batch.num_rows for batch in pq.ParquetFile(io.BytesIO(content)).iter_batches())


def read_ledger(spark: SparkSession, root: str, suffix: str = ".parquet", enough: int | None = None, seed: int = 42, rows_of: Callable[[bytes], int] = parquet_rows, together: int = 64) -> DataFrame:
    """path, length, place (in the seeded order of paths), status ('ok', 'broken' or 'unread'), rows and error of each file.

    Files are opened in order, ``together`` at a time, until ``enough`` could be read (all, without it); those after the one that made it
    enough are 'unread'. ``rows_of`` reads a file's bytes.
    """
    ordered = listing(spark, root, suffix).withColumn("_md5", F.md5(F.concat("path", F.lit(str(seed))))).orderBy("_md5", "path")
    names = [(r["path"], r["length"]) for r in ordered.select("path", "length").collect()]  # names only, as any listing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found.append((path, rows_of(content.as_py()), None))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file belongs in the ledger
                    found.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "rows", "error"])

    seen: dict[str, tuple] = {}
    good = 0
    for at in range(0, len(names), together):
        if enough is not None and good >= enough:
            break
        some = [p for p, _ in names[at : at + together]]
        read = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(some).select("path", "content").mapInArrow(run, "path string, rows long, error string")
        results = {r["path"]: (r["rows"], r["error"]) for r in read.collect()}
        for p in some:
            if enough is not None and good >= enough:
                break
            rows, error = results.get(p, (None, "its content can't be had from the store"))
            seen[p] = ("broken" if error else "ok", rows, error)
            good += error is None
    out = [(p, n, i, *seen.get(p, ("unread", None, None))) for i, (p, n) in enumerate(names)]
    return spark.createDataFrame(out, "path string, length long, place int, status string, rows long, error string")


# ---- runs ----------------------------------------------------------------------------------------------------------


def log(spark: SparkSession, path: str, run: str, values: dict[str, object], step: int = 0) -> None:
    """Append a row for each value; values are kept as text."""
    rows = [(run, k, None if v is None else str(v), step) for k, v in values.items()]
    df = spark.createDataFrame(rows, "run string, key string, value string, step long").withColumn("at", F.current_timestamp())
    df.coalesce(1).write.mode("append").parquet(path)


def latest(entries: DataFrame, *order: str) -> DataFrame:
    """run, key, value and step of the last entry of each (run, key): of the largest step, then of the largest ``order`` (``at``, if there is one)."""
    order = order or (("at",) if "at" in entries.columns else ())
    last = F.max_by(F.struct("value", "step"), F.struct("step", *order))
    return entries.groupBy("run", "key").agg(last.alias("_l")).select("run", "key", "_l.value", "_l.step")


# ---- chunks --------------------------------------------------------------------------------------------------------


def write_chunk(df: DataFrame, root: str, chunk: str) -> str:
    """Write ``df`` as the chunk of this name and return the attempt's id; an earlier attempt counts until this one is complete."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    spark.createDataFrame([(chunk, attempt, "begun", None)], "chunk string, attempt string, status string, rows long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    df.write.parquet(f"{root}/data/{attempt}")
    rows = spark.read.schema(df.schema).parquet(f"{root}/data/{attempt}").count()
    spark.createDataFrame([(chunk, attempt, "done", rows)], "chunk string, attempt string, status string, rows long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return attempt


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """chunk, attempt, status ('begun', 'done'), rows and ``counts``: whether it is the chunk's last complete attempt."""
    rows = spark.read.parquet(f"{root}/manifest")
    last = rows.groupBy("chunk", "attempt").agg(F.max_by(F.struct("status", "rows", "at"), F.col("status") == "done").alias("l")).select("chunk", "attempt", "l.*")
    best = last.where("status = 'done'").groupBy("chunk").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("_best"))
    return last.join(best, "chunk", "left").select("chunk", "attempt", "status", "rows", F.coalesce(F.col("attempt") == F.col("_best"), F.lit(False)).alias("counts"))


def read_chunks(spark: SparkSession, root: str, schema, chunks: list[str] | None = None) -> DataFrame:
    """The rows of the attempts that count, of all chunks or of those named."""
    own = manifest(spark, root).where("counts")
    own = own.where(F.col("chunk").isin(chunks)) if chunks is not None else own
    paths = [f"{root}/data/{r['attempt']}" for r in own.orderBy("chunk").collect()]  # a name for each chunk
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def deletable(spark: SparkSession, root: str) -> DataFrame:
    """chunk and attempt of what no longer counts: replaced attempts, and those begun before their chunk's last complete one.

    An attempt that is begun and has no complete one after it may still be running, so it stays.
    """
    rows = manifest(spark, root)
    begun = spark.read.parquet(f"{root}/manifest").groupBy("attempt").agg(F.min("at").alias("at"))
    rows = rows.join(begun, "attempt")
    best = rows.where("counts").select(F.col("chunk").alias("_c"), F.col("at").alias("_at"))
    return rows.join(best, F.col("chunk") == F.col("_c")).where("not counts and (status = 'done' or at < _at)").select("chunk", "attempt")


def clean(spark: SparkSession, root: str) -> int:
    """Delete the files of ``deletable`` attempts; how many there were."""
    gone = [r["attempt"] for r in deletable(spark, root).collect()]  # names only
    deleted = 0
    for a in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{a}")
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return deleted
