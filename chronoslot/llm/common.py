"""Shared helpers of the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; keeps a Python worker's memory flat when texts are long.
ARROW_ROWS = 1024
ARROW_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a temporary one, and that only in local mode: executors must see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chronoslot-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"


#: Work tables of this session that were not discarded.
saved: list[str] = []
#: Seconds between two collections of the driver's garbage.
GC_EVERY = 5.0
_collected = [0.0]


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table: lineage ends here."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    saved.append(path)
    # shuffle files of the steps that are written now go only when the driver collects what refers to them
    if time.monotonic() - _collected[0] > GC_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that save() returned, once nothing reads them any more."""
    for t in tables:
        release(t.sparkSession, [t._work_path])


def release(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        if p in saved:
            saved.remove(p)
            drop_path(spark, p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Hand memory that a Python worker has freed back to the system, at the end of a task: workers stay for the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def fresh(columns: list[str], name: str) -> str:
    """``name``, longer by underscores while a column has it; Spark does not tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str = "doc_id") -> F.Column:
    """True where crc32(id as text) mod 4 is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
