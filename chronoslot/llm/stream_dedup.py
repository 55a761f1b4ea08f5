"""Exact deduplication by a stateful stream.

A Structured Streaming query keys disk-backed state (RocksDB) by the digest of
the normalised text. The state has no expiry; for each digest it holds the
smallest stable identifier, where that row's content lies (file and row), and
how many rows were seen. A second arrival of a digest is a hit: the state's locator
is followed to the content it names, and hits are checked against it byte for
byte. Of a digest with very many hits, each part of them meets a copy of that
content of its own, so no task has them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_path, save, work_path

#: Runs of these characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the filter that keeps texts without hits out of the byte check's shuffle: a fixed 1 MB. When full, it only stops helping.
FILTER_BITS = 1 << 23
#: A digest with more rows than this is checked in SALTS parts.
HOT_GROUP = 1_000
SALTS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text_col: str = "text") -> F.Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def _located(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(text_col)
    return df.select(
        F.col(id_col),
        F.sha2(norm, 256).alias("text_sha256"),
        norm.alias("_norm"),
        F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at"),
    )


def run_stream(spark: SparkSession, path: str, checkpoint: str, state_table: str, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int = 1000) -> None:
    """Process what is new under ``path`` since ``checkpoint`` and return.

    Each micro-batch writes the keys it changed to ``state_table``/batch=N; a
    batch that is run again overwrites its own folder, so restarts are exact.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    # preallocated files would take some MB for each partition of the state
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    try:
        # as a glob, since the stream takes a lone file only by a pattern
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
        state = _located(rows, id_col, text_col).groupBy("text_sha256").agg(F.min("_at").alias("keep"), F.count("*").alias("group_size"))

        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state_table}/batch={n}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def read_state(spark: SparkSession, state_table: str) -> DataFrame:
    """Latest state of each digest: text_sha256, keep (missing, id, file, row), group_size."""
    changes = spark.read.parquet(state_table)
    return changes.groupBy("text_sha256").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("text_sha256", "s.keep", "s.group_size")


def _bit(*cols: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))


def _filter_of(keys: DataFrame, bit: F.Column) -> DataFrame:
    """One row with the words of a fixed-size filter that has the bits of all ``keys`` set."""
    set_bits = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()  # at most FILTER_BITS / 64 rows
    words = [0] * (FILTER_BITS // 64)
    for r in set_bits:
        words[r["w"]] = r["v"]
    return keys.sparkSession.createDataFrame([(words,)], "words array<bigint>")


def _in_filter(bit: F.Column) -> F.Column:
    return F.getbit(F.col("words")[F.shiftright(bit, 6).cast("int")], F.pmod(bit, F.lit(64)).cast("int")) == 1


def unequal_hits(located: DataFrame, digests: DataFrame, state: DataFrame) -> DataFrame:
    """text_sha256 of hits whose bytes differ from those their state's locator names.

    Only rows of digests with hits are normalised again (rows outside a
    fixed-size filter are not), and a locator's content is shuffled once.
    """
    shared = state.where("group_size > 1").select("text_sha256", "keep", "group_size")
    place = lambda at: _bit(F.col(f"{at}.file"), F.col(f"{at}.row"))
    hit_rows = digests.join(shared.select("text_sha256"), "text_sha256").select("_at")
    touched = located.join(F.broadcast(_filter_of(hit_rows, place("_at"))), _in_filter(place("_at")), "left_semi")
    # the locator's content, one row for each digest with hits
    named = located.join(F.broadcast(_filter_of(shared, place("keep"))), _in_filter(place("_at")), "left_semi")
    kept = named.select(F.col("_at.file").alias("file"), F.col("_at.row").alias("row"), F.col("_norm").alias("_kept_norm")).join(shared.select("text_sha256", F.col("keep.file").alias("file"), F.col("keep.row").alias("row")), ["file", "row"])
    # hot by a filter over digests, so that both sides agree whatever else falls into it
    hot = _filter_of(shared.where(F.col("group_size") > HOT_GROUP), _bit(F.col("text_sha256")))
    marked = lambda rows: rows.join(F.broadcast(hot), _in_filter(_bit(F.col("text_sha256"))), "left").withColumn("hot", F.col("words").isNotNull())
    salted = marked(touched).select("text_sha256", "_norm", F.when(F.col("hot"), F.pmod(F.xxhash64("_at.file", "_at.row"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    copies = marked(kept).select("text_sha256", "_kept_norm", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(copies, ["text_sha256", "salt"]).where(F.col("_norm") != F.col("_kept_norm")).select("text_sha256")


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row under the Parquet ``path``: id_col, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and blank-free empty texts are equal. Of
    equal texts the row with the smallest id stays; among rows that repeat an id
    the first by file and row, and a null id stays only if no other is there.
    An empty table gives no rows. Texts of any length are digested and, on a
    hit, compared whole. Other columns are ignored, whatever their names.
    """
    work = work_path(spark, "stream-dedup")
    docs = spark.read.parquet(path)
    run_stream(spark, path, f"{work}/checkpoint", f"{work}/state", id_col, text_col)
    located = _located(docs, id_col, text_col)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{work}/state")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        state = located.limit(0).select("text_sha256", F.col("_at").alias("keep"), F.lit(0).cast("long").alias("group_size"))
    else:
        # written, so that joins with it have an exchange on both sides and large groups can be split
        state = save(read_state(spark, f"{work}/state"), "dedup-state")
    drop_path(spark, work)
    digests = save(located.drop("_norm"), "digests")
    rows = digests.join(state, "text_sha256")
    out_cols = [F.col(id_col), F.col("keep.id").alias("keep_id"), F.col("group_size"), (F.col("_at") == F.col("keep")).alias("kept"), F.col("text_sha256")]
    differ = save(unequal_hits(located, digests, state).distinct(), "unequal")
    if differ.isEmpty():
        discard(differ)
        return rows.select(*out_cols)
    # texts that share a digest but not their bytes: groups by the bytes
    apart = located.join(differ, "text_sha256")
    groups = apart.groupBy("text_sha256", "_norm").agg(F.min("_at").alias("keep"), F.count("*").alias("group_size"))
    return rows.join(differ, "text_sha256", "left_anti").select(*out_cols).unionByName(apart.join(groups, ["text_sha256", "_norm"]).select(*out_cols))
