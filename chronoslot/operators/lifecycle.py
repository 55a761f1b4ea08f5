"""Entity lifecycles: births, deaths, stages, attributes and annotations.

Everything is a window over the rows of one entity, so a trace is shuffled once
by slot and once by entity; no row is joined to a life it might belong to.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.resolve import code_name
from ..plans.trace import ADD, CLEAR, SET, Trace

RETIRED, FLUSHED, IN_FLIGHT = "Retired", "Flushed", "InFlight"
#: Attributes of an entity that are kept if its storage has them; the last write wins.
ATTRIBUTES = ("pc", "inst_bits", "rbid", "iq_id", "dq_id", "ready_time_ps")


def entity_rows(trace: Trace) -> DataFrame:
    """Births, attribute writes, deaths, stage transitions, flushes and annotations, each with its entity.

    Attribute writes and clears are resolved through their slot: the entity born
    there last, unless the slot was cleared since.
    """
    store = trace.schema.entities
    if store is None:
        raise ValueError("the trace has no entities storage")
    id_field = store.field_index("entity_id")
    fields = {i: f.name for i, f in enumerate(store.fields)}
    birth = (F.col("action") == SET) & (F.col("field_index") == id_field)
    by_slot = Window.partitionBy("trace_id", "slot").orderBy("seq")
    mark = F.when(birth, F.col("value").cast("long")).when(F.col("action") == CLEAR, F.lit(-1).cast("long"))
    held = F.last(mark, ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1))
    name = F.element_at(F.create_map(*[x for i, n in fields.items() for x in (F.lit(i), F.lit(n))]), F.col("field_index"))
    # values need a place of their own only for attributes; counters never come here
    own = trace.on(store, SET, CLEAR, ADD).select("trace_id", "seq", "cycle", "slot", "action", "field_index", "value").withColumn("kind", F.when(birth, "birth").when(F.col("action") == CLEAR, "retire").when(F.col("action") == SET, name))
    own = own.withColumn("entity_id", F.when(birth, F.col("value").cast("long")).otherwise(held)).where("kind is not null and entity_id >= 0")
    from_ops = own.select("trace_id", "seq", "cycle", "entity_id", "kind", F.col("value").alias("value"), F.lit(None).cast("string").alias("text"))
    kinds = {"stage_transition": "stage", "flush": "flush", "annotate": "annotate"}
    from_events = trace.events.where(F.col("event").isin(*kinds)).select("trace_id", "seq", "cycle", "entity_id", F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event")).alias("kind"), F.col("arg").cast("decimal(20,0)").alias("value"), "text")
    return from_ops.unionByName(from_events)


def lives(rows: DataFrame) -> DataFrame:
    """``rows`` with life, birth and death; orphans and rows after a death are gone.

    A life that another birth of its entity ends without a death is lost, as its
    record would be overwritten.
    """
    by_entity = Window.partitionBy("trace_id", "entity_id")
    by_life = Window.partitionBy("trace_id", "entity_id", "life")
    dies = F.when(F.col("kind").isin("retire", "flush"), F.struct("seq", "cycle", "kind"))
    out = rows.withColumn("life", F.count(F.when(F.col("kind") == "birth", 1)).over(by_entity.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).where("life > 0")
    out = out.withColumn("last_life", F.max("life").over(by_entity)).withColumn("death", F.min(dies).over(by_life))
    out = out.withColumn("birth", F.min(F.when(F.col("kind") == "birth", F.struct("seq", "cycle"))).over(by_life))
    return out.where("(death is null or seq <= death.seq) and (death is not null or life = last_life)")


def stage_spans(trace: Trace) -> DataFrame:
    """entity_id, birth_seq, stage, stage_name, start_cycle, end_cycle, lane, duration, status of each stage an entity was in.

    A transition ends the stage before it; death ends the last. The last stage
    of an entity in flight ends one cycle after the last known one.
    """
    by_life = Window.partitionBy("trace_id", "entity_id", "life").orderBy("seq")
    spans = lives(entity_rows(trace)).where("kind = 'stage'")
    spans = spans.withColumn("next", F.lead("cycle").over(by_life)).withColumn("first", F.lag("seq").over(by_life).isNull())
    known = F.when(F.col("first"), F.col("birth.cycle")).otherwise(F.greatest("birth.cycle", "cycle"))
    end = F.coalesce("next", "death.cycle", known + 1)
    # an unknown stage counts as the first
    stage = F.when(F.col("value").between(0, len(trace.stages) - 1), F.col("value").cast("int")).otherwise(0)
    names = F.array(*[F.lit(s) for s in trace.stages]) if trace.stages else F.array(F.lit("stage_0"))
    return spans.select("trace_id", "entity_id", F.col("birth.seq").alias("birth_seq"), F.col("birth.cycle").alias("birth_cycle"), "seq", stage.alias("stage"), names[stage].alias("stage_name"), F.col("cycle").alias("start_cycle"), end.alias("end_cycle"), F.lit(0).alias("lane"), F.greatest(F.lit(0).cast("long"), end - F.col("cycle")).alias("duration"), _status().alias("status"))


def _status() -> F.Column:
    return F.when(F.col("death").isNull(), IN_FLIGHT).when(F.col("death.kind") == "flush", FLUSHED).otherwise(RETIRED)


def instructions(trace: Trace, attributes: bool = True) -> DataFrame:
    """One row per life: first_cycle, last_cycle, latency, status, stages, attributes, disasm and tooltip.

    An annotation that begins with the hex digits of the entity's pc as known at
    that moment is its disassembly (the last one wins); others form the tooltip, a line each.
    """
    by_life = Window.partitionBy("trace_id", "entity_id", "life").orderBy("seq")
    rows = lives(entity_rows(trace))
    rows = rows.withColumn("pc_now", F.last(F.when(F.col("kind") == "pc", F.col("value")), ignorenulls=True).over(by_life.rowsBetween(Window.unboundedPreceding, 0)))
    digits = F.lower(F.regexp_extract(F.col("text"), r"^(?:0[xX])?([0-9A-Fa-f]+)", 1))
    is_pc = (F.length(digits) >= 4) & (F.col("pc_now") != 0) & (F.length(digits) <= 16) & (F.conv(digits, 16, 10).cast("decimal(20,0)") == F.col("pc_now"))
    note = F.col("kind") == "annotate"
    rows = rows.withColumn("is_pc", F.coalesce(note & is_pc, F.lit(False)))
    stage = F.col("kind") == "stage"
    texts = lambda which: F.array_sort(F.collect_list(F.when(which, F.struct("seq", "text"))))
    aggs = [
        F.first("birth").alias("birth"), F.first("death").alias("death"),
        F.max(F.when(stage, F.col("cycle"))).alias("opened"), F.count(F.when(stage, 1)).alias("stages"),
        F.max_by("text", F.when(F.col("is_pc"), F.col("seq"))).alias("disasm"),
        F.array_join(F.transform(texts(note & ~F.col("is_pc")), lambda x: x["text"]), "\n").alias("tooltip"),
    ]
    store = trace.schema.entities
    known = [a for a in ATTRIBUTES if attributes and store.field_index(a) is not None]
    aggs += [F.max_by("value", F.when(F.col("kind") == a, F.col("seq"))).alias(a) for a in known]
    out = rows.groupBy("trace_id", "entity_id", "life").agg(*aggs)
    open_end = F.when(F.col("stages") > 1, F.greatest("birth.cycle", "opened")).otherwise(F.col("birth.cycle")) + 1
    end = F.when(F.col("stages") > 0, F.coalesce("death.cycle", open_end))
    closed = F.when(F.col("stages") > 1, F.col("opened"))  # each transition closes the stage before it
    last = F.greatest("birth.cycle", closed, end)
    out = out.select("trace_id", "entity_id", F.col("birth.seq").alias("birth_seq"), F.col("birth.cycle").alias("first_cycle"), last.alias("last_cycle"), (last - F.col("birth.cycle")).alias("latency"), _status().alias("status"), "stages", "disasm", F.when(F.col("tooltip") != "", F.col("tooltip")).alias("tooltip"), *known)
    if "ready_time_ps" in known:
        out = out.withColumn("ready_cycle", F.expr(f"cast(ready_time_ps as long) div {trace.period_ps}"))
    return out


def ordered(instr: DataFrame) -> DataFrame:
    """In output order: by first cycle, then by birth."""
    return instr.orderBy("first_cycle", "birth_seq")


def timeline(trace: Trace, entity_id: int) -> DataFrame:
    """Stages of one entity with their durations; an entity that never lived raises."""
    spans = stage_spans(only(trace, entity_id)).select("entity_id", "birth_seq", "stage_name", "start_cycle", "end_cycle", "duration", "status")
    if instructions(only(trace, entity_id), attributes=False).isEmpty():
        raise LookupError(f"no entity {entity_id}")
    return spans


def only(trace: Trace, entity_id: int) -> Trace:
    """The rows that can matter for one entity; slots are resolved before, so all operations of slots it was born in stay."""
    store = trace.schema.entities
    slots = trace.on(store, SET).where((F.col("field_index") == store.field_index("entity_id")) & (F.col("value") == entity_id)).select("trace_id", "slot").distinct()
    ops = trace.on(store).join(slots, ["trace_id", "slot"], "left_semi").select(*trace.ops.columns)
    return Trace(trace.schema, ops, trace.events.where(F.col("entity_id") == entity_id), trace.stages, trace.period_ps)


def dependencies(trace: Trace) -> DataFrame:
    """producer, consumer, dep_type and label, kind (Memory for type 3, else Data), whatever the lifetimes."""
    labels = trace.schema.enum("dep_type") or {0: "raw", 1: "war", 2: "waw", 3: "structural"}
    label = F.lit(None).cast("string")
    for code, text in labels.items():
        label = F.when(F.col("arg2") == code, text).otherwise(label)
    return trace.event("dependency").select("trace_id", "seq", "cycle", F.col("entity_id").alias("producer"), F.col("arg").alias("consumer"), F.col("arg2").alias("dep_type"), label.alias("label"), F.when(F.col("arg2") == 3, "Memory").otherwise("Data").alias("kind"))


def stalls(trace: Trace) -> DataFrame:
    """Stall events with the cycle of the next one: bands of a reason."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    return trace.event("stall").select("trace_id", "seq", "cycle", F.col("arg").alias("reason")).withColumn("until", F.lead("cycle").over(w))


def gantt(trace: Trace, start: int, end: int) -> DataFrame:
    """Stage spans that overlap [start, end), cut to it."""
    s = stage_spans(trace).where((F.col("start_cycle") < end) & ((F.col("end_cycle") > start) | (F.col("end_cycle") == F.col("start_cycle")) & (F.col("start_cycle") >= start)))
    return s.withColumn("shown_from", F.greatest("start_cycle", F.lit(start).cast("long"))).withColumn("shown_to", F.least("end_cycle", F.lit(end).cast("long")))


def of_segments(trace: Trace, seg_ids: list[int]) -> Trace:
    """The trace of chosen segments alone, replayed from an empty state: what a viewer opens of a large file."""
    here = F.col("seg_id").isin([int(i) for i in seg_ids])
    return replace(trace, ops=trace.ops.where(here), events=trace.events.where(here), checkpoints=None)


def gantt_marks(trace: Trace, start: int, end: int) -> DataFrame:
    """kind, cycle, until, entity_id, other, label of what is drawn over the spans of [start, end): arrow, flush, stall.

    An arrow goes from a producer to its consumer; a stall band lasts until the next stall.
    """
    none = F.lit(None).cast("long")
    reasons = code_name(trace.schema.enum("flush_reason"), F.col("arg"))
    arrows = dependencies(trace).select(F.lit("arrow").alias("kind"), "cycle", none.alias("until"), F.col("producer").alias("entity_id"), F.col("consumer").alias("other"), "label")
    flushes = trace.event("flush").select(F.lit("flush").alias("kind"), "cycle", none.alias("until"), "entity_id", none.alias("other"), reasons.alias("label"))
    bands = stalls(trace).select(F.lit("stall").alias("kind"), "cycle", "until", none.alias("entity_id"), none.alias("other"), code_name(trace.schema.enum("stall_reason"), F.col("reason")).alias("label"))
    return arrows.unionByName(flushes).unionByName(bands).where((F.col("cycle") < end) & (F.coalesce("until", F.col("cycle") + 1) > start))


def in_flight_series(trace: Trace) -> DataFrame:
    """cycle, in_flight after the births and deaths of that cycle. Deaths count at their cycle.

    Running sums are two-level: sums by block of cycles, then within the block.
    """
    i = instructions(trace, attributes=False)
    steps = i.select("trace_id", F.col("first_cycle").alias("cycle"), F.lit(1).alias("step")).unionByName(i.where(F.col("status") != IN_FLIGHT).select("trace_id", F.col("last_cycle").alias("cycle"), F.lit(-1).alias("step")))
    return running(steps.groupBy("trace_id", "cycle").agg(F.sum("step").alias("step")), "step", "in_flight")


def running(df: DataFrame, value: str, name: str, block: int = 1 << 16, keys: tuple[str, ...] = ("trace_id",), at: str = "cycle") -> DataFrame:
    """``df`` (one row per keys and ``at``) with the running sum of ``value``; no window holds more than ``block`` values of ``at``."""
    df = df.withColumn("_block", F.expr(f"{at} div {block}"))
    sums = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_block", before.alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(w)).join(sums, [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")
