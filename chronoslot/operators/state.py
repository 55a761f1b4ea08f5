"""State at a point in time, rebuilt from operations by aggregation.

Value of a field: its last SET after the slot's last CLEAR (0 where there is
none after a CLEAR, else the checkpoint's), plus the ADDs after both, modulo the
field's width. Every part is an aggregate of the operations of a slot, so replay
needs no order but ``seq`` and no row of another slot.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trace import ADD, CLEAR, PROP_SET, SET, Storage, Trace


def prune(trace: Trace, time_ps: int) -> DataFrame:
    """Operations up to a time, those at it included."""
    return trace.ops.where(F.col("time_ps") <= time_ps)


def seek(segments: DataFrame, time_ps: int) -> DataFrame:
    """The last segment that starts at or before a time; no row before the first."""
    return segments.where(F.col("time_start_ps") <= time_ps).orderBy(F.desc("time_start_ps"), F.desc("seg_id")).limit(1)


def overlapping(segments: DataFrame, start_ps: int, end_ps: int) -> DataFrame:
    """Segments with a start before the end and an end after the start; without length they never match."""
    return segments.where((F.col("time_start_ps") < end_ps) & (F.col("time_end_ps") > start_ps))


def fields_at(trace: Trace, storage: Storage, time_ps: int, checkpoint: DataFrame | None = None, from_seq: int | None = None) -> DataFrame:
    """trace_id, slot, field_index, value decimal(20,0), valid: every field that was touched.

    ``checkpoint`` (trace_id, storage_id, slot, field_index, value, valid) is the
    state before the operations from ``from_seq`` on. Fields of a dense storage are
    always valid. Field indexes outside the storage are ignored.
    """
    ops = prune(trace, time_ps).where((F.col("storage_id") == storage.storage_id) & F.col("slot").between(0, storage.num_slots - 1) & F.col("action").isin(SET, CLEAR, ADD))
    if from_seq is not None:
        ops = ops.where(F.col("seq") >= from_seq)
    ops = ops.where(F.col("field_index").isNull() | F.col("field_index").between(0, len(storage.fields) - 1)).select("trace_id", "slot", "field_index", "seq", "action", "value")
    if checkpoint is not None:
        base = checkpoint.where(F.col("storage_id") == storage.storage_id).select("trace_id", "slot", "field_index", F.lit(-1).cast("long").alias("seq"), F.when(F.col("valid"), SET).otherwise("base").alias("action"), F.col("value").cast("decimal(20,0)").alias("value"))
        ops = ops.unionByName(base)
    keys = ["trace_id", "slot", "field_index"]
    kind, wide = F.col("action"), F.col("value").cast("decimal(38,0)")
    # a clear goes to every field of its slot; all that follows are partial aggregates, so a busy slot is many tasks' work
    each = F.when(kind == CLEAR, F.array(*[F.lit(i) for i in range(len(storage.fields))])).otherwise(F.array("field_index"))
    rows = ops.withColumn("field_index", F.explode(each))
    reset = F.max(F.when(kind.isin(SET, CLEAR, "base"), F.struct("seq", F.when(kind == CLEAR, F.lit(0)).otherwise(wide).cast("decimal(38,0)").alias("value"))))
    cells = rows.groupBy(*keys).agg(reset.alias("reset"), F.max(F.when(kind == CLEAR, F.col("seq"))).alias("cleared"), F.max(F.when(kind.isin(SET, ADD), F.col("seq"))).alias("touched"), F.max(kind != CLEAR).alias("own"))
    since = cells.where("reset is not null").select(*keys, F.col("reset.seq").alias("reset_seq"))
    adds = rows.where(kind == ADD).join(since, keys, "left").where(F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))).groupBy(*keys).agg(F.sum(wide).alias("added"))
    width = F.lit(None).cast("decimal(38,0)")
    for i, f in enumerate(storage.fields):
        width = F.when(F.col("field_index") == i, F.lit(str(1 << (8 * max(1, f.width)))).cast("decimal(38,0)")).otherwise(width)
    valid = F.lit(True)
    if storage.keeps_validity:
        touched, cleared = (F.max(c).over(Window.partitionBy("trace_id", "slot")) for c in ("touched", "cleared"))  # a row for each field
        valid = F.coalesce(touched.isNotNull() & (cleared.isNull() | (touched > cleared)), F.lit(False))
    out = cells.withColumn("valid", valid).where("own").join(adds, keys, "left")
    v = (F.coalesce(F.col("reset.value"), F.lit(0)) + F.coalesce("added", F.lit(0))).cast("decimal(38,0)")
    return out.select(*keys, F.pmod(v, width).cast("decimal(20,0)").alias("value"), "valid")


def nearest_checkpoint(trace: Trace, time_ps: int) -> tuple[Trace, DataFrame] | None:
    """The operations from the segment that holds a time on, and the state at its start; None where a trace has no stored checkpoints.

    The first segment counts where all start later. Reads one segment a trace, whatever came before.
    """
    if trace.segments is None or trace.checkpoints is None:
        return None
    at = trace.segments.groupBy("trace_id").agg(F.coalesce(F.max(F.when(F.col("time_start_ps") <= time_ps, F.struct("time_start_ps", "seg_id")))["seg_id"], F.lit(0)).alias("seg_id")).collect()  # a row for each file
    if not at:
        return None
    here = None
    for n in {r["seg_id"] for r in at}:
        one = (F.col("seg_id") == n) & F.col("trace_id").isin([r["trace_id"] for r in at if r["seg_id"] == n])
        here = one if here is None else here | one
    return replace(trace, ops=trace.ops.where(here)), trace.checkpoints.where(here & ~F.col("is_prop"))


def state_at(trace: Trace, storage: Storage, time_ps: int, checkpoint: DataFrame | None = None, from_seq: int | None = None, treat_flush_as_clear: bool = False) -> DataFrame:
    """One row per valid slot with a typed column for each field; untouched fields are 0.

    With ``treat_flush_as_clear``, a flush event of an entity clears its slot in
    the entities storage. Otherwise a trace with stored checkpoints is replayed
    from the nearest one.
    """
    t = trace
    if checkpoint is None and from_seq is None and not treat_flush_as_clear and (near := nearest_checkpoint(trace, time_ps)) is not None:
        t, checkpoint = near
    if treat_flush_as_clear and storage == trace.schema.entities:
        flushed = trace.event("flush").select("trace_id", "seg_id", "seq", "time_ps", "cycle", F.lit(storage.storage_id).alias("storage_id"), F.col("entity_id").alias("slot"), F.lit(None).cast("int").alias("field_index"), F.lit(CLEAR).alias("action"), F.lit(0).cast("decimal(20,0)").alias("value"))
        t = Trace(trace.schema, trace.ops.unionByName(flushed), trace.events, trace.stages, trace.period_ps)
    cells = fields_at(t, storage, time_ps, checkpoint, from_seq).where("valid")
    cols = [typed(F.coalesce(F.max(F.when(F.col("field_index") == i, F.col("value"))), F.lit(0)), f.type).alias(f.name) for i, f in enumerate(storage.fields)]
    return cells.groupBy("trace_id", "slot").agg(*cols)


def typed(value: F.Column, kind: str) -> F.Column:
    """A raw unsigned value as its type: signed types are sign-extended, bool is not 0, 64-bit unsigned stays decimal."""
    bits = {"i8": 8, "i16": 16, "i32": 32, "i64": 64}.get(kind)
    if bits:
        v = value.cast("decimal(38,0)")
        signed = F.when(v >= F.lit(str(1 << (bits - 1))).cast("decimal(38,0)"), v - F.lit(str(1 << bits)).cast("decimal(38,0)")).otherwise(v)
        return signed.cast({8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits])
    if kind == "bool":
        return value != 0
    return value.cast({"u8": "smallint", "u16": "int", "u32": "bigint", "enum": "smallint", "string_ref": "bigint"}.get(kind, "decimal(20,0)"))


def properties_at(trace: Trace, storage: Storage, time_ps: int) -> DataFrame:
    """name, role, pair_id, value of each property: the last write up to a time, else 0. Unknown properties are ignored."""
    spark = trace.ops.sparkSession
    names = spark.createDataFrame([(i, p.name, p.role, p.pair_id) for i, p in enumerate(storage.properties)], "field_index int, name string, role string, pair_id int")
    written = prune(trace, time_ps).where((F.col("storage_id") == storage.storage_id) & (F.col("action") == PROP_SET)).groupBy("trace_id", "field_index").agg(F.max_by("value", "seq").alias("value"))
    traces = trace.ops.select("trace_id").distinct()
    return traces.crossJoin(F.broadcast(names)).join(written, ["trace_id", "field_index"], "left").select("trace_id", "name", "role", "pair_id", F.coalesce("value", F.lit(0)).cast("decimal(20,0)").alias("value"))


def counter_state(trace: Trace, time_ps: int) -> DataFrame:
    """counter, value decimal of every counter storage at a time."""
    names = {s.storage_id: s.name for s in trace.schema.counters}
    if not names:
        return trace.ops.limit(0).select("trace_id", F.lit("").alias("counter"), "value")
    # counters are alike but for their id, so all are replayed at once, each as a slot of one storage
    one = trace.schema.counters[0]
    slots = sorted(names)
    slot = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(slots) for x in (n, i)]), F.col("storage_id")).cast("long")
    ops = trace.ops.where(F.col("storage_id").isin(slots) & (F.col("slot") == 0)).withColumn("slot", slot).withColumn("storage_id", F.lit(one.storage_id))
    cells = fields_at(replace(trace, ops=ops), replace(one, num_slots=len(slots)), time_ps)
    name = F.element_at(F.array(*[F.lit(names[n]) for n in slots]), (F.col("slot") + 1).cast("int"))
    return cells.select("trace_id", name.alias("counter"), "value")


def validity_edges(trace: Trace, storage: Storage) -> DataFrame:
    """trace_id, slot, seq, cycle, step: +1 where a slot becomes valid, -1 where it stops being so."""
    w = Window.partitionBy("trace_id", "slot").orderBy("seq")
    ops = trace.on(storage, SET, ADD, CLEAR).withColumn("on", F.when(F.col("action") == CLEAR, 0).otherwise(1))
    ops = ops.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0)))
    return ops.where("on <> was").select("trace_id", "slot", "seq", "cycle", (F.col("on") - F.col("was")).alias("step"))


def occupancy_series(trace: Trace, storage: Storage) -> DataFrame:
    """cycle, occupied: valid slots at the end of each cycle in which the number could change."""
    from .lifecycle import running

    steps = validity_edges(trace, storage).groupBy("trace_id", "cycle").agg(F.sum("step").alias("step"))
    return running(steps, "step", "occupied").select("trace_id", "cycle", F.col("occupied").cast("long").alias("occupied"))


def occupancy_at(trace: Trace, storages: list[Storage], cycles: list[int]) -> DataFrame:
    """storage, at_cycle, occupied, capacity, fill_percent of several storages at several cycles, in one pass."""
    out = None
    for s in storages:
        e = validity_edges(trace, s)
        aggs = [F.coalesce(F.sum(F.when(F.col("cycle") <= c, F.col("step"))), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(cycles)]
        at = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("at_cycle"), F.col(f"c{i}").alias("occupied")) for i, c in enumerate(cycles)])).alias("x")
        part = e.groupBy("trace_id").agg(*aggs).select("trace_id", F.lit(s.name).alias("storage"), at).select("trace_id", "storage", "x.*", F.lit(s.num_slots).cast("long").alias("capacity"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = trace.ops.limit(0).select("trace_id", F.lit("").alias("storage"), *[F.lit(0).cast("long").alias(c) for c in ("at_cycle", "occupied", "capacity")])
    fill = F.when(F.col("capacity") > 0, F.col("occupied") * 100.0 / F.col("capacity")).otherwise(0.0)
    return out.withColumn("fill_percent", fill)


def events_in_range(trace: Trace, start_ps: int, end_ps: int) -> DataFrame:
    """Events from a time to another, both included."""
    return trace.events.where(F.col("time_ps").between(start_ps, end_ps))


def segment_replay(trace: Trace, seg_id: int) -> DataFrame:
    """Operations and events of one segment in replay order."""
    ops = trace.ops.where(F.col("seg_id") == seg_id).select("trace_id", "seq", "time_ps", F.lit("op").alias("kind"), "storage_id", "slot", "field_index", "action", "value", F.lit(None).cast("string").alias("event"), F.lit(None).cast("long").alias("entity_id"))
    ev = trace.events.where(F.col("seg_id") == seg_id).select("trace_id", "seq", "time_ps", F.lit("event").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("storage_id", "int"), ("slot", "long"), ("field_index", "int"), ("action", "string"), ("value", "decimal(20,0)"))], "event", "entity_id")
    return ops.unionByName(ev).orderBy("trace_id", "seq")
