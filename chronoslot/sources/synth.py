"""Synthetic traces generated by Spark, and logs written as trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.trace import Field, Trace
from .builder import CpuSchemaBuilder

#: Shares of the synthetic workload.
STALL, BRANCH, FLUSH_OF_BRANCH, DEPENDENCY = 0.10, 0.15, 0.01, 0.30
PER_INSTRUCTION = 64


def _u(salt: str, *cols: str) -> F.Column:
    """A number in [0, 1) that depends on the columns and the salt alone, whatever the partitions."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(salt)), F.lit(1_000_000)) / 1_000_000


def generate(spark: SparkSession, instructions: int = 1_000_000, counters: int = 100, stages: int = 8, width: int = 4, period_ps: int = 1000, seed: int = 42) -> Trace:
    """A statistical pipeline: ``width`` instructions are born each cycle, stay a cycle or more in each stage, then retire or are flushed.

    Rows depend on the seed and the instruction's number, so any partitioning gives the same trace.
    """
    names = [f"stage{i}" for i in range(stages)]
    b = CpuSchemaBuilder(entity_slots=1 << 30, period_ps=period_ps).pipeline_stages(*names)
    b.buffer("rob", 128).buffer("iq0", 16, [Field("ready", "bool")]).buffer("iq1", 16, [Field("ready", "bool")])
    for i in range(counters):
        b.counter("committed_insns" if i == 0 else f"counter_{i}")
    schema = b.build()
    i = spark.range(instructions).select(F.col("id").alias("entity_id"), F.floor(F.col("id") / width).cast("long").alias("born"))
    s = lambda salt: f"{seed}:{salt}"
    branch = _u(s("branch"), "entity_id") < BRANCH
    i = i.withColumn("flushed", branch & (_u(s("flush"), "entity_id") < FLUSH_OF_BRANCH))
    stay = [F.when(_u(s(f"stall{k}"), "entity_id") < STALL, 2 + F.floor(_u(s(f"long{k}"), "entity_id") * 8)).otherwise(1).cast("long") for k in range(stages)]
    starts = [F.col("born")]
    for k in range(stages - 1):
        starts.append(starts[-1] + stay[k])
    i = i.withColumn("starts", F.array(*starts)).withColumn("died", starts[-1] + stay[-1])
    rob, entities, committed = schema.storage("rob").storage_id, schema.entities.storage_id, schema.storage("committed_insns").storage_id if counters else -1
    dec = lambda c: c.cast("decimal(20,0)")

    def row(cycle: F.Column, at: int, storage: F.Column, slot: F.Column, index: F.Column, action: str, value: F.Column) -> F.Column:
        return F.struct(cycle.alias("cycle"), F.lit(at).alias("at"), storage.cast("int").alias("storage_id"), slot.cast("long").alias("slot"), index.cast("int").alias("field_index"), F.lit(action).alias("action"), dec(value).alias("value"))

    e, zero, none = F.col("entity_id"), F.lit(0), F.lit(None).cast("int")
    rows = [row(F.col("born"), k, F.lit(entities), e, F.lit(k), "set", v) for k, v in enumerate((e, F.lit(0x80000000) + 4 * e, F.lit(0x13)))]
    rows += [row(F.col("born"), 3, F.lit(rob), e % 128, zero, "set", e), row(F.col("died"), 40, F.lit(rob), e % 128, none, "clear", zero)]
    rows += [F.when(~F.col("flushed"), row(F.col("died"), 41, F.lit(entities), e, none, "clear", zero))]
    if counters:
        rows += [F.when(~F.col("flushed"), row(F.col("died"), 42, F.lit(committed), zero, zero, "add", F.lit(1)))]
    if counters > 1:
        which = 1 + F.pmod(F.xxhash64(e, F.lit(s("counter"))), F.lit(counters - 1))
        rows += [row(F.col("born"), 43, F.lit(committed) + which, zero, zero, "add", 1 + F.floor(_u(s("delta"), "entity_id") * 4))]
    alive = width * (stages * 9 + 2)  # no two instructions so far apart share a cycle
    seq = lambda cycle, at: (cycle * (alive * PER_INSTRUCTION) + (e % alive) * PER_INSTRUCTION + at).alias("seq")
    base = [F.lit("synthetic").alias("trace_id"), F.lit(0).alias("seg_id")]
    ops = i.select("entity_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("o")).select(*base, seq(F.col("o.cycle"), F.col("o.at")), (F.col("o.cycle") * period_ps).alias("time_ps"), "o.cycle", "o.storage_id", "o.slot", "o.field_index", "o.action", "o.value")
    staged = i.select("entity_id", F.posexplode("starts").alias("k", "cycle")).select(*base, seq(F.col("cycle"), F.col("k") + 10), (F.col("cycle") * period_ps).alias("time_ps"), "cycle", F.lit("stage_transition").alias("event"), "entity_id", F.col("k").cast("long").alias("arg"), F.lit(None).cast("long").alias("arg2"), F.lit(None).cast("string").alias("text"))
    point = lambda df, cycle, at, event, who, arg, arg2: df.select(*base, seq(cycle, F.lit(at)), (cycle * period_ps).alias("time_ps"), cycle.alias("cycle"), F.lit(event).alias("event"), who.alias("entity_id"), arg.cast("long").alias("arg"), arg2.cast("long").alias("arg2"), F.lit(None).cast("string").alias("text"))
    flushes = point(i.where("flushed"), F.col("died"), 39, "flush", e, zero, F.lit(None))
    deps = point(i.where((_u(s("dep"), "entity_id") < DEPENDENCY) & (e > 0)), F.col("born"), 30, "dependency", e - 1 - F.floor(_u(s("far"), "entity_id") * F.least(e, F.lit(8))).cast("long") % e, e, zero)
    return Trace(schema, ops, staged.unionByName(flushes).unionByName(deps), names, period_ps, dict(b.properties))


def as_json(df: DataFrame) -> DataFrame:
    """One column of JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
