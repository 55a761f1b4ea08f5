"""A user event log as a trace.

signup: birth of the user's entity. view, click: stage transitions 0 and 1.
purchase: the entity retires. error: it is flushed. Every event adds its value,
in cents, to the counter of its type. ``props.k`` is a slot of the buffer ``sessions``:
view, click and signup put the user there, purchase and error clear it; signup
moves the head pointer to k, purchase the tail pointer. The props of a view
annotate the user's entity. An event depends on the event before it on its k.
One cycle is a minute; time is in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.trace import EventType, Field, Property, Schema, Scope, Storage, Trace

EPOCH_US = 1704067200000000
CYCLE_US = 60_000_000
TYPES = ("click", "error", "purchase", "signup", "view")
STAGES = ["view", "click"]
ENTITIES, BUFFER = 0, 1
BUFFER_SLOTS = 1 << 20
#: Positions of the operations that one event makes, so that their seq is unique.
PER_EVENT = 8


def schema() -> Schema:
    counters = tuple(Storage(2 + i, t, 1, (Field("count", "u64"),), scope_id=1) for i, t in enumerate(TYPES))
    return Schema(
        storages=(
            Storage(ENTITIES, "entities", 1 << 40, (Field("entity_id", "u64"),), sparse=True, scope_id=1),
            Storage(BUFFER, "sessions", BUFFER_SLOTS, (Field("entity_id", "u64"),), sparse=True, buffer=True, scope_id=1, properties=(Property("head_ptr", "u32", "head", 0), Property("tail_ptr", "u32", "tail", 0))),
            *counters,
        ),
        scopes=(Scope(0, "root"), Scope(1, "log", 0, "cpu", 0)),
        clocks=(("minutes", CYCLE_US),),
        enums=(("pipeline_stage", dict(enumerate(STAGES))),),
        event_types=(EventType(0, "stage_transition"), EventType(1, "annotate"), EventType(2, "dependency"), EventType(3, "flush")),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, time_us, cycle, user_id, event_type, delta (cents), k, props."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        ts.alias("time_us"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {CYCLE_US}").alias("cycle"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("delta"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "props",
    )


def load(spark: SparkSession, sf_dir: str) -> Trace:
    ev = rows(spark, sf_dir)
    kind = F.col("event_type")
    i = F.lit(None).cast("int")

    def op(at: int, when: F.Column, storage: F.Column, slot: F.Column, field: F.Column, action: str, value: F.Column) -> F.Column:
        return F.when(when, F.struct(F.lit(at).alias("at"), storage.cast("int").alias("storage_id"), slot.cast("long").alias("slot"), field.cast("int").alias("field_index"), F.lit(action).alias("action"), value.cast("decimal(20,0)").alias("value")))

    counter = F.lit(None).cast("int")
    for n, t in enumerate(TYPES):
        counter = F.when(kind == t, F.lit(2 + n)).otherwise(counter)
    user, k, zero = F.col("user_id"), F.col("k"), F.lit(0)
    each = F.array(
        op(0, kind == "signup", F.lit(ENTITIES), user, zero, "set", user),
        op(1, kind == "purchase", F.lit(ENTITIES), user, i, "clear", zero),
        op(2, F.lit(True), counter, zero, zero, "add", F.col("delta")),
        op(3, kind.isin("view", "click", "signup"), F.lit(BUFFER), k, zero, "set", user),
        op(4, kind.isin("purchase", "error"), F.lit(BUFFER), k, i, "clear", zero),
        op(5, kind == "signup", F.lit(BUFFER), zero, zero, "prop_set", k),
        op(6, kind == "purchase", F.lit(BUFFER), zero, F.lit(1), "prop_set", k),
    )
    base = [F.lit("events").alias("trace_id"), F.lit(0).alias("seg_id")]
    ops = ev.select("seq", "time_us", "cycle", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("o")).select(*base, (F.col("seq") * PER_EVENT + F.col("o.at")).alias("seq"), F.col("time_us").alias("time_ps"), "cycle", "o.storage_id", "o.slot", "o.field_index", "o.action", "o.value")
    none = F.lit(None).cast("long")
    point = [*base, (F.col("seq") * PER_EVENT + 7).alias("seq"), F.col("time_us").alias("time_ps"), "cycle"]
    staged = ev.where(kind.isin("view", "click", "error")).select(*point, F.when(kind == "error", "flush").otherwise("stage_transition").alias("event"), user.alias("entity_id"), F.when(kind == "view", 0).when(kind == "click", 1).otherwise(0).cast("long").alias("arg"), none.alias("arg2"), F.lit(None).cast("string").alias("text"))
    notes = ev.where(kind == "view").select(*point, F.lit("annotate").alias("event"), user.alias("entity_id"), none.alias("arg"), none.alias("arg2"), F.col("props").alias("text"))
    before = F.lag("user_id").over(Window.partitionBy("k").orderBy("seq"))
    deps = ev.withColumn("producer", before).where("producer is not null").select(*point, F.lit("dependency").alias("event"), F.col("producer").alias("entity_id"), user.alias("arg"), F.lit(0).cast("long").alias("arg2"), F.lit(None).cast("string").alias("text"))
    return Trace(schema(), ops, staged.unionByName(notes).unionByName(deps), stages=STAGES, period_ps=CYCLE_US)
