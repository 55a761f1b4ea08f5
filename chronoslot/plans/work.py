"""Written work tables: lineage ends in the folder that the session shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one, and that only in local mode: executors must see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="chronoslot-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_file(spark: SparkSession, name: str) -> str:
    """Path of a new file in the shared folder, for plain I/O on the driver and the executors; its folder is there."""
    root = shared_dir(spark)
    path = "/" + root[5:].lstrip("/") if root.startswith("file:") else root
    if re.match(r"[A-Za-z][\w+.-]+:", path):
        raise RuntimeError(f"trace files need a spark.checkpoint.dir that is mounted, not {root}")
    os.makedirs(f"{path}/work", exist_ok=True)
    return f"{path}/work/{uuid.uuid4().hex}-{name}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and return the reread table; an iterative plan then stays as small as one step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that save() returned, once nothing reads it any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._work_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
