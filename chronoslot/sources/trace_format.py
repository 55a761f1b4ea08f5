"""Trace files as a Spark data source: batch and streaming.

The driver reads headers and segment headers alone; an input partition is one
segment, decoded where it is read. Filters on segment and time drop segments
before they are read. Files are opened through ``fsspec``-free plain I/O, so the
path must be mounted on every executor.

    spark.dataSource.register(TraceSource)
    spark.read.format("chronoslot").option("table", "items").load(path)

Tables: items (default), segments, checkpoints, strings, counter_mipmap, density_mipmap.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..plans.trace import DEFAULT_PERIOD_PS, Schema, Trace
from . import codec as C

SCHEMAS = {
    "items": "trace_id string, seg_id int, frame_no int, item_no int, seq long, time_ps long, kind string, action string, storage_id int, slot long, field_index int, value decimal(20,0), event_type_id int, payload binary",
    "segments": "trace_id string, seg_id int, offset long, time_start_ps long, time_end_ps long, n_frames long, n_active long, raw_bytes long, comp_bytes long",
    "checkpoints": "trace_id string, seg_id int, storage_id int, slot long, field_index int, value decimal(20,0), valid boolean, is_prop boolean",
    "strings": "trace_id string, idx long, text string",
    "counter_mipmap": "trace_id string, counter string, level int, bucket long, lo decimal(20,0), hi decimal(20,0), total decimal(20,0)",
    "density_mipmap": "trace_id string, level int, bucket long, births long",
}
#: seq: 23 bits of segment, 24 of frame, 16 of item.
SEGMENT_BITS, FRAME_BITS, ITEM_BITS = 23, 24, 16


def sequence(seg: int, frame: int, item: int) -> int:
    if seg >> SEGMENT_BITS or frame >> FRAME_BITS or item >> ITEM_BITS:
        raise C.TraceFormatError(f"segment {seg}, frame {frame}, item {item} is out of range")
    return seg << (FRAME_BITS + ITEM_BITS) | frame << ITEM_BITS | item


class TraceFile:
    """Metadata of one file; nothing of a segment but its header is read."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.header = C.Header.read(f.read(C.HEADER.size))
            f.seek(0)
            self.chunks = C.read_chunks(f.read(self.header.preamble_end))
        self.schema, pool = C.read_schema(self.chunks[C.CHUNK_SCHEMA])
        self.properties = C.read_properties(self.chunks[C.CHUNK_DUT], pool)
        self.interval_ps = struct.unpack_from("<Q", self.chunks[C.CHUNK_CONFIG])[0]

    def sections(self) -> dict[int, tuple[int, int]]:
        """Offset and size by section type; none while the file is being written."""
        out: dict[int, tuple[int, int]] = {}
        if not self.header.flags & C.F_COMPLETE or not self.header.section_table:
            return out
        with open(self.path, "rb") as f:
            f.seek(self.header.section_table)
            while len(raw := f.read(C.SECTION.size)) == C.SECTION.size:
                kind, _, _, at, size = C.SECTION.unpack(raw)
                if kind == C.SECTION_END:
                    break
                out.setdefault(kind, (at, size))
        return out

    def section(self, kind: int) -> bytes:
        at, size = self.sections().get(kind, (0, 0))
        with open(self.path, "rb") as f:
            f.seek(at)
            return f.read(size)

    def segments(self, after: int = 0) -> list[C.Segment]:
        """Segments in order, from the table of a complete file or else by the chain from the tail back to ``after``."""
        out: list[C.Segment] = []
        with open(self.path, "rb") as f:

            def at(offset: int) -> C.Segment:
                f.seek(offset)
                return C.Segment.read(f.read(C.SEGMENT.size), offset)

            where = self.sections().get(C.SECTION_SEGMENTS)
            if where and not after:
                raw = self.section(C.SECTION_SEGMENTS)
                return [at(C.SEGMENT_ENTRY.unpack_from(raw, i)[0]) for i in range(0, len(raw), C.SEGMENT_ENTRY.size)]
            offset = self.header.tail
            while offset and offset != after:
                out.append(at(offset))
                offset = out[-1].prev
        return out[::-1]

    def strings(self) -> list[str]:
        raw = self.section(C.SECTION_STRINGS)
        return C.read_strings(raw) if raw else []

    def summary(self) -> C.Summary | None:
        raw = self.section(C.SECTION_COUNTER_SUMMARY)
        return C.read_summary(raw) if raw else None


@dataclass
class SegmentPart(InputPartition):
    path: str
    seg_id: int
    offset: int
    until_ps: int | None = None

    def __post_init__(self):
        super().__init__((self.path, self.seg_id, self.offset))


#: Strings of all files together go to all executors up to so many bytes.
BROADCAST_BYTES = 8 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 8192
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}


def arrow(rows: Iterator[tuple], table: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, which Spark takes many times faster than single rows. Decimals are unsigned 64-bit numbers here."""
    names, kinds = zip(*(c.split(" ") for c in SCHEMAS[table].split(", ")), strict=True)
    while chunk := list(islice(rows, BATCH_ROWS)):
        columns = [pa.array(c, pa.uint64()).cast(ARROW[k]) if k.startswith("decimal") else pa.array(c, ARROW[k]) for c, k in zip(zip(*chunk, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=list(names))


def decode(part: SegmentPart, table: str) -> Iterator[tuple]:
    f = TraceFile(part.path)
    with open(part.path, "rb") as raw:
        raw.seek(part.offset)
        seg = C.Segment.read(raw.read(C.SEGMENT.size), part.offset)
        if table == "segments":
            yield part.path, part.seg_id, seg.offset, seg.start_ps, seg.end_ps, seg.frames, seg.active, seg.raw_size, seg.packed_size
            return
        if table == "checkpoints":
            for sid, slot, index, value, valid, prop in C.read_checkpoint(raw.read(seg.checkpoint_size), f.schema):
                yield part.path, part.seg_id, sid, slot, index, value, valid, prop
            return
        raw.seek(seg.checkpoint_size, os.SEEK_CUR)
        body = raw.read(seg.packed_size)
    if f.header.flags & C.F_COMPRESSED:
        body = C.decompress(body)
    known = {s.storage_id for s in f.schema.storages}
    flags = f.header.flags
    for frame, item, time_ps, kind, action, sid, slot, index, value, event, payload in C.read_frames(body, seg.start_ps, bool(flags & C.F_INTERLEAVED), bool(flags & C.F_COMPACT_DELTAS), part.until_ps):
        if kind == "op" and sid not in known:
            continue
        index = None if action == "clear" else index
        yield part.path, part.seg_id, frame, item, sequence(part.seg_id, frame, item), time_ps, kind, action, sid, slot, index, value, event, payload


def paths_of(options: dict[str, str]) -> list[str]:
    path = options.get("path", "")
    if os.path.isdir(path):
        path = os.path.join(path, "*")
    found = sorted(p for p in glob.glob(path) if os.path.isfile(p))
    if not found:
        raise FileNotFoundError(path)
    return found


class TraceReader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.options, self.table = options, table
        self.low_ps = self.high_ps = self.seg_id = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on time and segment choose segments; Spark applies all filters again."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "time_ps" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low_ps = max(value, self.low_ps or value)
            if name == "time_ps" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high_ps = min(value, self.high_ps or value)
            if name == "seg_id" and isinstance(f, EqualTo):
                self.seg_id = value
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.table not in ("items", "segments", "checkpoints"):
            return [SegmentPart(p, -1, 0) for p in paths_of(self.options)]
        out = []
        for path in paths_of(self.options):
            for i, s in enumerate(TraceFile(path).segments()):
                timed = self.table == "items" and (self.low_ps is not None and s.end_ps < self.low_ps or self.high_ps is not None and s.start_ps > self.high_ps)
                if not timed and self.seg_id in (None, i):
                    out.append(SegmentPart(path, i, s.offset, self.high_ps if self.table == "items" else None))
        return out

    def read(self, part: SegmentPart) -> Iterator[pa.RecordBatch]:
        yield from arrow(decode(part, self.table) if part.seg_id >= 0 else self.sections(part), self.table)

    def sections(self, part: SegmentPart) -> Iterator[tuple]:
        f = TraceFile(part.path)
        if self.table == "strings":
            yield from ((part.path, i, s) for i, s in enumerate(f.strings()))
        summary = f.summary() if self.table.endswith("mipmap") else None
        if summary and self.table == "density_mipmap":
            yield from ((part.path, k, i, n) for k, level in enumerate(summary.density) for i, n in enumerate(level))
        if summary and self.table == "counter_mipmap":
            yield from ((part.path, name, k, i, *e) for name, _, levels in summary.counters for k, level in enumerate(levels) for i, e in enumerate(level))


class TraceStreamReader(DataSourceStreamReader):
    """Tails files that are being written. The offset of a file is its tail offset: the writer's commit point."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: TraceFile(p).header.tail for p in paths_of(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, tail in end.items():
            done = start.get(path, 0)
            if tail == done:
                continue
            chain = []
            with open(path, "rb") as f:
                offset = tail
                while offset:
                    f.seek(offset)
                    s = C.Segment.read(f.read(C.SEGMENT.size), offset)
                    chain.append(s.offset)
                    offset = s.prev
            chain.reverse()
            out += [SegmentPart(path, i, o) for i, o in enumerate(chain) if o > done]
        return out

    def read(self, part: SegmentPart) -> Iterator[tuple]:
        for *head, value, event, payload in decode(part, "items"):
            yield *head, None if value is None else Decimal(value), event, payload


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronoslot"

    def _table(self) -> str:
        table = self.options.get("table", "items")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table!r}; there are {sorted(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(dict(self.options), self._table())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TraceStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def little(payload: F.Column, at: int, width: int) -> F.Column:
    """An unsigned little-endian number of a binary column."""
    return F.conv(F.concat(*[F.hex(F.substring(payload, at + i + 1, 1)) for i in reversed(range(width))]), 16, 10).cast("decimal(20,0)")


def typed_events(items: DataFrame, schema: Schema, strings: DataFrame | None = None, period_ps: int = DEFAULT_PERIOD_PS, broadcast: bool = False) -> DataFrame:
    """Event items with entity_id, arg, arg2 and text, and all values of the payload as ``fields``. Payloads that are too short are left out.

    One pass over the items, whatever the number of event types. With ``broadcast`` all strings go to every executor.
    """
    if not schema.event_types:
        return items.limit(0).select("trace_id", "seg_id", "seq", "time_ps", F.lit(0).cast("long").alias("cycle"), F.lit("").alias("event"), *[F.lit(None).cast("long").alias(c) for c in ("entity_id", "arg", "arg2")], F.lit(None).cast("array<decimal(20,0)>").alias("fields"), F.lit(None).cast("string").alias("text"))
    name, fields, width = F.lit(None).cast("string"), F.lit(None).cast("array<decimal(20,0)>"), F.lit(None).cast("int")
    for e in schema.event_types:
        values, at = [], 0
        for f in e.fields:
            values.append(little(F.col("payload"), at, f.width))
            at += f.width
        this = F.col("event_type_id") == e.event_type_id
        name = F.when(this, e.name).otherwise(name)
        width = F.when(this, C.slot_size(e.fields)).otherwise(width)
        fields = F.when(this, F.array(*values).cast("array<decimal(20,0)>")).otherwise(fields)
    out = items.where((F.col("kind") == "event") & F.col("event_type_id").isin([e.event_type_id for e in schema.event_types]) & (F.length("payload") >= width))
    out = out.select("trace_id", "seg_id", "seq", "time_ps", F.expr(f"time_ps div {period_ps}").alias("cycle"), name.alias("event"), fields.alias("fields"))
    # the first value of a stall is its argument
    value = lambda i: F.when(F.col("event") == "stall", F.get("fields", F.lit(i - 1))).otherwise(F.get("fields", F.lit(i))).cast("long")
    out = out.select("trace_id", "seg_id", "seq", "time_ps", "cycle", "event", *[value(i).alias(n) for i, n in enumerate(("entity_id", "arg", "arg2"))], "fields")
    if strings is None:
        return out.withColumn("text", F.lit(None).cast("string"))
    texts = strings.select("trace_id", F.col("idx").alias("_i"), "text")
    # events without a text get numbers that no text has, so they are not one key
    ref = F.when(F.col("event") == "annotate", F.col("arg")).otherwise(-1 - F.pmod("seq", F.lit(1 << 16)))
    return out.withColumn("_i", ref).join(F.broadcast(texts) if broadcast else texts, ["trace_id", "_i"], "left").drop("_i")


def load(spark: SparkSession, path: str, core: str | None = None, whole: bool = False, through: Callable[[DataFrame, Schema], DataFrame] | None = None) -> Trace:
    """A file, or several of one schema, as a trace of one core: the first CPU scope, or the one named.

    Storages and events of other scopes are no part of it, unless the ``whole``
    file is asked for. A file without a core is taken whole, by its first clock.
    ``through`` (items, schema) gives the items that operations and events are made of.
    """
    from ..plans.resolve import bound, clock_period, cores, stage_names

    register(spark)
    first = TraceFile(paths_of({"path": path})[0])
    # an interconnect's trace need not have a core
    has_core = core is not None or bool(cores(first.schema))
    period = clock_period(first.schema, core) if has_core else next((p for _, p in first.schema.clocks), DEFAULT_PERIOD_PS)
    stages = stage_names(first.schema, first.properties) if has_core or first.schema.enum("pipeline_stage") is not None else []
    schema = bound(first.schema, core) if has_core and not whole else first.schema
    read = lambda t: spark.read.format("chronoslot").option("table", t).load(path)
    items = through(read("items"), schema) if through else read("items")
    cycle = F.expr(f"time_ps div {period}")
    known = [s.storage_id for s in schema.storages]
    ops = items.where("kind = 'op'").where(F.col("storage_id").isin(known)).select("trace_id", "seg_id", "seq", "time_ps", cycle.alias("cycle"), "storage_id", "slot", "field_index", "action", "value")
    h = first.header
    info = {"version": f"{h.version[0]}.{h.version[1]}", "flags": h.flags, "total_time_ps": h.total_time_ps, "segments": h.num_segments, "checkpoint_interval_ps": first.interval_ps, "complete": bool(h.flags & C.F_COMPLETE)}
    few = sum(TraceFile(p).sections().get(C.SECTION_STRINGS, (0, 0))[1] for p in paths_of({"path": path})) <= BROADCAST_BYTES
    return Trace(schema, ops, typed_events(items, schema, read("strings"), period, few), stages, period, first.properties, read("segments"), read("strings"), read("checkpoints"), info)
