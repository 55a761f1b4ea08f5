"""Building schemas and traces: a schema builder, the CPU protocol, and a file encoder."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

from ..plans.trace import INHERIT_CLOCK, EventType, Field, Property, Schema, Scope, Storage
from . import codec as C

DEFAULT_STALLS = ("rob_full", "iq_full", "lq_full", "sq_full", "fetch_miss", "dcache_miss", "frontend_stall")
DEPENDENCY_TYPES = ("raw", "war", "waw", "structural")
FLUSH_REASONS = ("mispredict", "exception", "interrupt", "pipeline_clear")


class SchemaBuilder:
    """Collects definitions; ids are dense from 0 in the order of the calls."""

    def __init__(self) -> None:
        self.parts: dict[str, list] = {k: [] for k in ("clocks", "scopes", "enums", "storages", "events", "summary")}

    def clock_domain(self, name: str, period_ps: int) -> int:
        self.parts["clocks"].append((name, period_ps))
        return len(self.parts["clocks"]) - 1

    def scope(self, name: str, parent: int = 0xFFFF, protocol: str | None = None, clock_id: int = INHERIT_CLOCK) -> int:
        i = len(self.parts["scopes"])
        self.parts["scopes"].append(Scope(i, name, parent, protocol, clock_id))
        return i

    def enum_type(self, name: str, labels: list[str] | tuple[str, ...]) -> int:
        if len(labels) > 255:
            raise ValueError("an enum has at most 255 values")
        self.parts["enums"].append((name, dict(enumerate(labels))))
        return len(self.parts["enums"]) - 1

    def storage(self, name: str, slots: int, fields: list[Field], sparse: bool = False, buffer: bool = False, scope_id: int = 0, properties: list[Property] | None = None) -> int:
        i = len(self.parts["storages"])
        self.parts["storages"].append(Storage(i, name, slots, tuple(fields), sparse, buffer, scope_id, tuple(properties or ())))
        return i

    def event(self, name: str, fields: list[Field], scope_id: int = 0) -> int:
        i = len(self.parts["events"])
        self.parts["events"].append(EventType(i, name, tuple(fields), scope_id))
        return i

    def summary_field(self, name: str, kind: str = "u64", scope_id: int = 0) -> None:
        self.parts["summary"].append((name, kind, scope_id))

    def build(self) -> Schema:
        p = self.parts
        return Schema(tuple(p["storages"]), tuple(p["scopes"]), tuple(p["clocks"]), tuple(p["enums"]), tuple(p["events"]), tuple(p["summary"]))


@dataclass
class CpuSchemaBuilder:
    """Schema of one core: entities, buffers, counters, stages and the five event types."""

    core: str = "core0"
    stages: list[str] = field(default_factory=list)
    entity_slots: int = 512
    period_ps: int = 1000
    stalls: tuple[str, ...] = DEFAULT_STALLS
    properties: dict[str, str] = field(default_factory=lambda: {"cpu.protocol_version": "0.1"})
    buffers: list[tuple[str, int, list[Field], list[Property]]] = field(default_factory=list)
    counters: list[str] = field(default_factory=list)

    def pipeline_stages(self, *names: str) -> "CpuSchemaBuilder":
        self.stages = list(names)
        self.properties["cpu.pipeline_stages"] = ",".join(names)
        return self

    def isa(self, name: str) -> "CpuSchemaBuilder":
        return self._property("cpu.isa", name)

    def fetch_width(self, n: int) -> "CpuSchemaBuilder":
        return self._property("cpu.fetch_width", n)

    def commit_width(self, n: int) -> "CpuSchemaBuilder":
        return self._property("cpu.commit_width", n)

    def elf_path(self, path: str) -> "CpuSchemaBuilder":
        return self._property("cpu.elf_path", path)

    def vendor(self, name: str) -> "CpuSchemaBuilder":
        return self._property("vendor", name)

    def _property(self, key: str, value: object) -> "CpuSchemaBuilder":
        self.properties[key] = str(value)
        return self

    def buffer(self, name: str, slots: int, fields: list[Field] | None = None, properties: list[Property] | None = None) -> "CpuSchemaBuilder":
        self.buffers.append((name, slots, fields or [], properties or []))
        return self

    def counter(self, name: str) -> "CpuSchemaBuilder":
        self.counters.append(name)
        return self

    def build(self) -> Schema:
        b = SchemaBuilder()
        clock = b.clock_domain("core_clk", self.period_ps)
        root = b.scope("root")
        core = b.scope(self.core, root, "cpu", clock)
        stage = b.enum_type("pipeline_stage", self.stages)
        dep = b.enum_type("dep_type", DEPENDENCY_TYPES)
        flush = b.enum_type("flush_reason", FLUSH_REASONS)
        stall = b.enum_type("stall_reason", self.stalls)
        entity = Field("entity_id", "u32")
        b.storage("entities", self.entity_slots, [entity, Field("pc", "u64"), Field("inst_bits", "u32")], sparse=True, scope_id=core)
        for name, slots, fields, properties in self.buffers:
            b.storage(name, slots, [entity, *fields], sparse=True, buffer=True, scope_id=core, properties=properties)
        for name in self.counters:
            b.storage(name, 1, [Field("count", "u64")], scope_id=core)
        b.event("stage_transition", [entity, Field("stage", "enum", stage)], core)
        b.event("annotate", [entity, Field("text", "string_ref")], core)
        b.event("dependency", [Field("src_id", "u32"), Field("dst_id", "u32"), Field("dep_type", "enum", dep)], core)
        b.event("flush", [entity, Field("reason", "enum", flush)], core)
        b.event("stall", [Field("reason", "enum", stall)], core)
        return b.build()


class TraceWriter:
    """Encodes one trace file, segment by segment.

    Checkpoints hold the state at the start of their segment. The segment is
    written first, then the header's tail offset: the point from which a live
    reader sees it.
    """

    def __init__(self, path: str, schema: Schema, properties: dict[str, str] | None = None, interval_ps: int = 10_000, compress: bool = True):
        self.schema, self.interval, self.compress = schema, interval_ps, compress
        pool = C.StringPool()
        dut = b"".join(struct.pack("<HH", pool.add(k), pool.add(v)) for k, v in (properties or {}).items())
        preamble = C.chunk(C.CHUNK_DUT, struct.pack("<HH", len(properties or {}), 0) + dut) + C.chunk(C.CHUNK_SCHEMA, C.write_schema(schema, pool)) + C.chunk(C.CHUNK_CONFIG, struct.pack("<Q", interval_ps)) + C.chunk(C.CHUNK_END)
        self.header = C.Header(flags=C.F_INTERLEAVED | C.F_COMPRESSED * compress, preamble_end=C.HEADER.size + len(preamble))
        self.file = open(path, "wb")
        self.file.write(self.header.pack() + preamble)
        self.file.flush()
        self.state = C.State(schema)
        self.start_state = self.state.checkpoint()
        self.frames: list[tuple[int, list]] = []
        self.items: list | None = None
        self.now = self.last = self.start = 0
        self.segments: list[tuple[int, int, int]] = []
        self.strings: dict[str, int] = {}

    def begin_cycle(self, time_ps: int) -> None:
        if self.items is not None:
            raise ValueError("a cycle is open")
        if time_ps < self.now:
            raise ValueError(f"time goes back from {self.now} to {time_ps}")
        while time_ps >= self.start + self.interval and self.frames:
            self.flush(self.frames[-1][0])
            self.start = time_ps - time_ps % self.interval
        if not self.frames:
            self.start = min(time_ps, max(self.start, time_ps - time_ps % self.interval))
        self.now, self.items = time_ps, []

    def end_cycle(self) -> None:
        if self.items is None:
            raise ValueError("no cycle is open")
        self.frames.append((self.now, self.items))
        self.items = None

    def _op(self, action: str, storage_id: int, slot: int, index: int, value: int) -> None:
        if self.items is None:
            raise ValueError("no cycle is open")
        self.items.append((0, 0, self.now, "op", action, storage_id, slot, index, value, None, None))
        self.state.apply(action, storage_id, slot, index, value)

    def slot_set(self, storage_id: int, slot: int, index: int, value: int) -> None:
        self._op("set", storage_id, slot, index, value)

    def slot_add(self, storage_id: int, slot: int, index: int, value: int) -> None:
        self._op("add", storage_id, slot, index, value)

    def slot_clear(self, storage_id: int, slot: int) -> None:
        self._op("clear", storage_id, slot, 0, 0)

    def prop_set(self, storage_id: int, index: int, value: int) -> None:
        self._op("prop_set", storage_id, 0, index, value)

    def event(self, event_type_id: int, *values: int) -> None:
        kind = self.schema.event_types[event_type_id]
        if self.items is None:
            raise ValueError("no cycle is open")
        self.items.append((0, 0, self.now, "event", None, None, None, None, None, event_type_id, C.pack_fields(list(values), kind.fields)))

    def string(self, text: str) -> int:
        return self.strings.setdefault(text, len(self.strings))

    def flush(self, end_ps: int) -> None:
        if not self.frames:
            return
        raw, at = bytearray(), self.start
        for time_ps, items in self.frames:
            raw += C.write_frame(time_ps - at, items)
            at = time_ps
        packed = C.compress(bytes(raw)) if self.compress else bytes(raw)
        self.append(self.start, end_ps, packed, len(raw), len(self.frames), sum(bool(i) for _, i in self.frames))
        self.frames = []

    def append(self, start_ps: int, end_ps: int, packed: bytes, raw_size: int, frames: int, active: int) -> None:
        """A segment whose frames are encoded, after the last one; the state is already the one at its end."""
        offset = self.file.seek(0, os.SEEK_END)
        seg = C.Segment(offset, start_ps, end_ps, self.header.tail, len(self.start_state), len(packed), raw_size, frames, active)
        self.file.write(seg.pack() + self.start_state + packed)
        self.file.flush()
        self.segments.append((offset, start_ps, end_ps))
        self.header.tail, self.header.num_segments = offset, len(self.segments)
        self._header()
        self.start_state = self.state.checkpoint()

    def _header(self) -> None:
        self.file.seek(0)
        self.file.write(self.header.pack())
        self.file.flush()

    def close(self, summary: C.Summary | None = None) -> None:
        """Finish the file: strings, segments, the summary if given, section table."""
        self.flush(self.now)
        at = self.file.seek(0, os.SEEK_END)
        blobs = []
        if self.strings:
            blobs.append((C.SECTION_STRINGS, C.write_strings(list(self.strings))))
        blobs.append((C.SECTION_SEGMENTS, b"".join(C.SEGMENT_ENTRY.pack(*s) for s in self.segments)))
        if summary and (summary.counters or summary.total):
            blobs.append((C.SECTION_COUNTER_SUMMARY, C.write_summary(summary)))
        table = bytearray()
        for kind, blob in blobs:
            self.file.write(blob)
            table += C.SECTION.pack(kind, 0, 0, at, len(blob))
            at += len(blob)
        self.file.write(bytes(table) + C.SECTION.pack(C.SECTION_END, 0, 0, 0, 0))
        self.header.section_table, self.header.total_time_ps = at, self.now
        self.header.flags |= C.F_COMPLETE | C.F_HAS_STRINGS * bool(self.strings)
        self._header()
        self.file.close()


def embed_summary(path: str, summary: C.Summary | None) -> bool:
    """Give a finished file a summary section, in place of one it may have. Without counters and births nothing changes.

    The section and a new section table replace what stands behind the last
    segment's strings, so doing it again gives the same bytes.
    """
    if summary is None or not summary.counters and not summary.total:
        return False
    with open(path, "r+b") as f:
        header = C.Header.read(f.read(C.HEADER.size))
        if not header.flags & C.F_COMPLETE or not header.section_table:
            raise C.TraceFormatError("only a finished file can take a summary")
        f.seek(header.section_table)
        kept = []
        while len(raw := f.read(C.SECTION.size)) == C.SECTION.size:
            kind, _, _, at, size = C.SECTION.unpack(raw)
            if kind == C.SECTION_END:
                break
            if kind != C.SECTION_COUNTER_SUMMARY:
                kept.append((kind, at, size))
        blob = C.write_summary(summary)
        at = max((a + n for _, a, n in kept), default=header.section_table)
        f.seek(at)
        f.truncate()
        rows = [*kept, (C.SECTION_COUNTER_SUMMARY, at, len(blob))]
        f.write(blob + b"".join(C.SECTION.pack(k, 0, 0, a, n) for k, a, n in rows) + C.SECTION.pack(C.SECTION_END, 0, 0, 0, 0))
        header.section_table = at + len(blob)
        f.seek(0)
        f.write(header.pack())
    return True


class CpuWriter:
    """The CPU protocol's calls on a :class:`TraceWriter`. Unknown names raise."""

    def __init__(self, writer: TraceWriter):
        self.w, self.s = writer, writer.schema
        self.ids = {e.name: e.event_type_id for e in self.s.event_types}
        self.entities = self.s.storage("entities")

    def slot(self, entity_id: int) -> int:
        return entity_id & 0xFFFF

    def fetch(self, entity_id: int, pc: int, inst_bits: int) -> None:
        for i, v in enumerate((entity_id, pc, inst_bits)):
            self.w.slot_set(self.entities.storage_id, self.slot(entity_id), i, v)

    def stage_transition(self, entity_id: int, stage: int) -> None:
        self.w.event(self.ids["stage_transition"], entity_id, stage)

    def retire(self, entity_id: int) -> None:
        self.w.slot_clear(self.entities.storage_id, self.slot(entity_id))

    def flush(self, entity_id: int, reason: int = 0) -> None:
        self.w.event(self.ids["flush"], entity_id, reason)

    def annotate(self, entity_id: int, text: str) -> None:
        self.w.event(self.ids["annotate"], entity_id, self.w.string(text))

    def dependency(self, src: int, dst: int, kind: int = 0) -> None:
        self.w.event(self.ids["dependency"], src, dst, kind)

    def stall(self, reason: int) -> None:
        self.w.event(self.ids["stall"], reason)

    def counter_add(self, name: str, delta: int) -> None:
        self.w.slot_add(self.s.storage(name).storage_id, 0, 0, delta)

    def buffer_set(self, name: str, slot: int, entity_id: int) -> None:
        self.w.slot_set(self.s.storage(name).storage_id, slot, 0, entity_id)

    def buffer_set_field(self, name: str, slot: int, field_name: str, value: int) -> None:
        s = self.s.storage(name)
        index = s.field_index(field_name)
        if index is None:
            raise KeyError(f"{name} has no field {field_name!r}")
        self.w.slot_set(s.storage_id, slot, index, value)

    def buffer_set_property(self, name: str, prop: str, value: int) -> None:
        s = self.s.storage(name)
        index = next((i for i, p in enumerate(s.properties) if p.name == prop), None)
        if index is None:
            raise KeyError(f"{name} has no property {prop!r}")
        self.w.prop_set(s.storage_id, index, value)

    def buffer_clear(self, name: str, slot: int) -> None:
        self.w.slot_clear(self.s.storage(name).storage_id, slot)
