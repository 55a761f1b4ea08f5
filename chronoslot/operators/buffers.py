"""Buffer contents joined with the entities that hold their slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.trace import Storage, Trace
from .state import occupancy_at, properties_at, state_at


def entity_fields(trace: Trace, time_ps: int) -> DataFrame:
    """entity_id and the other fields of the entities valid at a time; of slots with one id the last counts."""
    store = trace.schema.entities
    s = state_at(trace, store, time_ps)
    others = [f.name for f in store.fields if f.name not in ("entity_id", "pc")]
    return s.groupBy("trace_id", F.col("entity_id").cast("long").alias("entity_id")).agg(F.max("slot").alias("entity_slot"), *[F.max_by(n, "slot").alias(n) for n in others])


def buffer_state(trace: Trace, buffer: Storage, cycle: int, enrich: bool = True) -> DataFrame:
    """Occupied slots at a cycle with the buffer's fields and, by its first field, the entity's (left join)."""
    time_ps = cycle * trace.period_ps
    slots = state_at(trace, buffer, time_ps)
    first, rest = buffer.fields[0].name, [f.name for f in buffer.fields[1:]]
    slots = slots.select("trace_id", F.lit(buffer.name).alias("buffer"), "slot", F.col(first).cast("long").alias("entity_id"), *rest)
    if not enrich or trace.schema.entities is None:
        return slots
    ent = entity_fields(trace, time_ps)
    clash = [c for c in ent.columns if c in rest]
    for c in clash:
        ent = ent.withColumnRenamed(c, f"entity_{c}")
    return slots.join(ent, ["trace_id", "entity_id"], "left")


def all_buffers(trace: Trace, cycle: int, name: str | None = None) -> DataFrame:
    """buffer, occupied, capacity, fill_percent of every buffer, or of those with ``name`` in their names; none raises."""
    chosen = [b for b in trace.schema.buffers if name is None or name in b.name]
    if not chosen:
        raise LookupError(f"no buffer has {name!r} in its name")
    return occupancy_at(trace, chosen, [cycle]).withColumnRenamed("storage", "buffer")


def snapshots(trace: Trace, start: int, end: int) -> DataFrame:
    """Occupancy of every buffer at the start, the middle and the end of a range."""
    return occupancy_at(trace, trace.schema.buffers, [start, start + (end - start) // 2, end]).withColumnRenamed("storage", "buffer")


def pointer_pairs(trace: Trace, buffer: Storage, cycle: int) -> DataFrame:
    """pair_id, head, tail, distance around the buffer of pointers with a common pair id."""
    p = properties_at(trace, buffer, cycle * trace.period_ps)
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("value"))).cast("long")
    out = p.where(F.col("role").isin("head", "tail")).groupBy("trace_id", "pair_id").agg(role("head").alias("head"), role("tail").alias("tail")).where("head is not null and tail is not null")
    return out.withColumn("distance", F.pmod(F.col("tail") - F.col("head"), F.lit(buffer.num_slots)).cast("long"))
