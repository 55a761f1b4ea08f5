"""Writing traces: rows as binary trace files, facts and summaries as tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import mipmap
from ..plans import work
from ..plans.trace import ADD, SET, Schema, Trace
from . import codec as C
from .builder import TraceWriter


#: Texts of annotations up to so many bytes go to all executors at once.
BROADCAST_BYTES = 8 << 20
SEGMENTS = "seg long, start_ps long, end_ps long, packed binary, raw_size long, frames long, active long, net binary"


def write_file(trace: Trace, path: str, interval_ps: int = 10_000, summary: bool = True, finish: bool = True) -> None:
    """One trace as one binary file on the driver's disk, in order of time, of one time in order of ``seq``, as frames only go forward.

    Executors encode segments, each with what its operations come to; the driver
    adds those up to checkpoints and appends one segment after the other. A
    segment is one task's work, as it is when it is read, and all texts are held
    by the driver, as the file has them in one section.

    A file is one ordered log; several traces are several files. A column
    ``event_type_id`` of the events tells event types of one name in several
    scopes apart. Without ``finish`` the file is left as a writer that was
    stopped leaves it: committed segments, no sections. Folders that are
    missing are made, as Spark's writers do.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    w = TraceWriter(path, trace.schema, trace.properties, interval_ps)
    rows, texts = _rows(trace, interval_ps)
    w.strings = {t: i for i, t in enumerate(texts)}
    segments = work.save(rows.mapInArrow(_encoder(trace.schema, interval_ps), SEGMENTS), "segments")
    last = None
    for r in segments.orderBy("seg").toLocalIterator():
        if last is not None:
            _append(w, last)
        last = r
    if last is not None:
        w.now = last["end_ps"]
        if finish:
            _append(w, last)
    work.discard(segments)
    if finish:
        w.close(build_summary(trace) if summary else None)
    else:
        w.file.close()


def _append(w: TraceWriter, r: Row) -> None:
    C.Net.replay(r["net"], w.state)
    w.append(r["start_ps"], r["end_ps"], bytes(r["packed"]), r["raw_size"], r["frames"], r["active"])


def _rows(trace: Trace, interval_ps: int) -> tuple[DataFrame, list[str]]:
    """Operations and events by segment, in order within it, and the annotations' texts in order of their first use."""
    spark = trace.ops.sparkSession
    ids = {e.name: e.event_type_id for e in trace.schema.event_types}
    notes = [e.event_type_id for e in trace.schema.event_types if e.name == "annotate"]
    # unsigned values as the long of the same bits
    value = F.col("value").cast("decimal(20,0)")
    bits = F.when(value >= F.lit(Decimal(1 << 63)), value - F.lit(Decimal(1 << 64))).otherwise(value).cast("long")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    ops = trace.ops.select("time_ps", "seq", "action", "storage_id", "slot", F.coalesce("field_index", F.lit(0)).alias("field_index"), F.coalesce(bits, F.lit(0)).alias("value"), *none("int", "type_id"), *none("long", "entity_id", "arg", "arg2"), *none("array<decimal(20,0)>", "fields"), *none("long", "text_id"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), F.col("event")) if ids else F.lit(None).cast("int")
    if "event_type_id" in trace.events.columns:
        kind = F.coalesce(F.col("event_type_id").cast("int"), kind)
    fields = F.col("fields").cast("array<decimal(20,0)>").alias("fields") if "fields" in trace.events.columns else none("array<decimal(20,0)>", "fields")[0]
    ev = trace.events.select("time_ps", "seq", kind.alias("type_id"), "entity_id", "arg", "arg2", fields, F.when(kind.isin(notes), F.coalesce("text", F.lit(""))).alias("text"))
    texts = []
    if notes:
        texts = [r["text"] for r in ev.where("text is not null").groupBy("text").agg(F.min(F.struct("time_ps", "seq")).alias("first")).orderBy("first").select("text").collect()]
    if texts:
        known = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
        ev = ev.join(F.broadcast(known) if sum(map(len, texts)) <= BROADCAST_BYTES else known, "text", "left").drop("text")
    else:
        ev = ev.drop("text").withColumn("text_id", F.lit(None).cast("long"))
    rows = ops.unionByName(ev, allowMissingColumns=True).withColumn("seg", F.expr(f"time_ps div {interval_ps}"))
    ordered = rows.repartition("seg").sortWithinPartitions("seg", "time_ps", "seq")
    return ordered.select("seg", "time_ps", "action", "storage_id", "slot", "field_index", "value", "type_id", "entity_id", "arg", "arg2", "fields", "text_id"), texts


class _Segment:
    """The bytes of a segment, frame by frame."""

    def __init__(self, seg: int, interval_ps: int):
        self.seg, self.start, self.time = seg, seg * interval_ps, None
        self.raw, self.items, self.net = bytearray(), [], C.Net()
        self.at, self.frames, self.active = self.start, 0, 0

    def frame(self, time_ps: int | None) -> None:
        """End the open frame and open one at a time."""
        if self.time is not None:
            self.raw += C.write_frame(self.time - self.at, self.items)
            self.at, self.frames, self.active = self.time, self.frames + 1, self.active + bool(self.items)
        self.time, self.items = time_ps, []

    def row(self) -> pa.RecordBatch:
        self.frame(None)
        raw = bytes(self.raw)
        row = (self.seg, self.start, self.at, C.compress(raw), len(raw), self.frames, self.active, self.net.pack())
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_pydict({n: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for n, v in zip(names, row, strict=True)})


def _encoder(schema: Schema, interval_ps: int) -> Callable:
    """Rows of whole segments, in order, to a row for each segment; the bytes of one and the items of a frame are held at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {e.event_type_id: e for e in schema.event_types}
        out = None
        for batch in batches:
            for seg, time_ps, action, sid, slot, index, value, kind, entity, arg, arg2, fields, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or seg != out.seg:
                    if out is not None:
                        yield out.row()
                    out = _Segment(seg, interval_ps)
                if time_ps != out.time:
                    out.frame(time_ps)
                if action is not None:
                    value &= C.MASK64
                    out.items.append((0, 0, time_ps, "op", action, sid, slot, index, value, None, None))
                    out.net.apply(action, sid, slot, index, value)
                elif (e := kinds.get(kind)) is not None:
                    if e.name == "annotate":
                        values = [entity, text]
                    elif fields is not None:
                        values = [int(v or 0) for v in fields]
                    elif e.name == "stall":
                        values = [arg]
                    else:
                        values = [entity, arg, arg2]
                    payload = C.pack_fields([v or 0 for v in values[: len(e.fields)]], e.fields)
                    out.items.append((0, 0, time_ps, "event", None, None, None, None, None, kind, payload))
        if out is not None:
            yield out.row()

    return encode


def build_summary(trace: Trace) -> C.Summary | None:
    """The multi-resolution summary of a trace for its file; its size follows the extent in buckets."""
    # both pyramids read the operations several times; a file is decoded once
    store = [trace.schema.entities.storage_id] if trace.schema.entities else []
    needed = F.col("storage_id").isin([s.storage_id for s in trace.schema.counters] + store) & F.col("action").isin(ADD, SET)
    ops = work.save(trace.ops.where(needed), "summary")
    trace = replace(trace, ops=ops)
    density: dict[int, dict[int, int]] = {}
    for r in mipmap.density_pyramid(trace).collect():
        density.setdefault(r["level"], {})[r["bucket"]] = r["births"]
    counters: dict[str, dict[int, dict[int, tuple]]] = {}
    if trace.schema.counters:
        for r in mipmap.counter_pyramid(trace).collect():
            counters.setdefault(r["counter"], {}).setdefault(r["level"], {})[r["bucket"]] = (r["lo"], r["hi"], r["total"])
    work.discard(ops)
    if not density and not counters:
        return None
    ordered = lambda levels: [[levels[k][b] for b in sorted(levels[k])] for k in sorted(levels)]
    rows = ordered(density)
    ids = {s.name: s.storage_id for s in trace.schema.counters}
    return C.Summary(mipmap.BASE, mipmap.FAN_OUT, sum(rows[0]) if rows else 0, rows, [(n, ids[n], ordered(v)) for n, v in sorted(counters.items())])


def write_tables(trace: Trace, path: str, interval_ps: int = 10_000_000) -> None:
    """Facts as Parquet, partitioned by trace and by interval so that time filters prune folders, and both pyramids."""
    part = F.expr(f"time_ps div {interval_ps}").alias("interval")
    for name, df in (("ops", trace.ops), ("events", trace.events)):
        df.select("*", part).repartition("trace_id", "interval").sortWithinPartitions("seq").write.mode("overwrite").partitionBy("trace_id", "interval").parquet(f"{path}/{name}")
    write_summary_tables(trace, path)


def write_summary_tables(trace: Trace, path: str) -> None:
    """Both pyramids; writing again gives the same tables."""
    mipmap.density_pyramid(trace).write.mode("overwrite").parquet(f"{path}/density_mipmap")
    if trace.schema.counters:
        mipmap.counter_pyramid(trace).write.mode("overwrite").parquet(f"{path}/counter_mipmap")
