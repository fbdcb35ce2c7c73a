"""Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage as a reliable checkpoint does, but is computed once and is read by column.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of texts that go to Python at once, in ``small_batches``. Spark's own bounds (10000 rows, 64 MB, twice that while a buffer
#: grows) take some hundred MB of a small executor beside its heap.
ROWS = 1024
BYTES = 4 << 20
#: Bytes of a row group of a written table.
GROUP = 16 << 20


def folder(spark: SparkSession) -> str:
    """The shared scratch folder. Where the session names none, a local one is set if driver and executors are one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-glint-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/glint-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    A task that writes or reads holds a row group, so these are GROUP bytes, whatever the size of a partition. Hashes and numbers are
    compressed at zstd's first level, which needs less memory beside the heap and makes them hardly larger.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    level = 3 if any(f.dataType.typeName() == "string" for f in df.schema) else 1
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside reads columns, and sends rows to Python, in batches of at most ROWS rows (to Python about BYTES bytes); the session's bounds are put back. Rows and results are the same."""
    rows, size, read = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {k: spark.conf.get(k, None) for k in (rows, size, read)}
    try:
        for k in (rows, read):
            if not 0 < int(spark.conf.get(k)) <= ROWS:
                spark.conf.set(k, ROWS)
        spark.conf.set(size, BYTES)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing will read it again (an executor that is lost later needs only what is still read)."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
