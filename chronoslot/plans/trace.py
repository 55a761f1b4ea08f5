"""The trace model: small dimensions on the driver, operations and events as tables.

``ops`` has a row for each storage operation, ``events`` one for each event; both
carry ``seq``, a long that is unique within a trace and increases in replay order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_PARENT = 0xFFFF
NO_PROTOCOL = 0xFFFF
INHERIT_CLOCK = 0xFF
DEFAULT_PERIOD_PS = 1000

SET, CLEAR, ADD, PROP_SET = "set", "clear", "add", "prop_set"
OPS_SCHEMA = "trace_id string, seg_id int, seq long, time_ps long, cycle long, storage_id int, slot long, field_index int, action string, value decimal(20,0)"
EVENTS_SCHEMA = "trace_id string, seg_id int, seq long, time_ps long, cycle long, event string, entity_id long, arg long, arg2 long, text string"

#: Bytes of each field type; the codes are in the binary codec.
TYPE_WIDTH = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "bool": 1, "string_ref": 4, "enum": 1}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "u64"
    enum_id: int | None = None

    @property
    def width(self) -> int:
        return TYPE_WIDTH.get(self.type, 0)


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "u32"
    role: str = "plain"
    pair_id: int = 0

    @property
    def width(self) -> int:
        return TYPE_WIDTH.get(self.type, 0)


@dataclass(frozen=True)
class Storage:
    storage_id: int
    name: str
    num_slots: int
    fields: tuple[Field, ...]
    sparse: bool = False
    buffer: bool = False
    scope_id: int = 0
    properties: tuple[Property, ...] = ()

    def field_index(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    @property
    def keeps_validity(self) -> bool:
        """Buffers count as sparse even where only the buffer flag is set."""
        return self.sparse or self.buffer


@dataclass(frozen=True)
class Scope:
    scope_id: int
    name: str
    parent: int = NO_PARENT
    protocol: str | None = None
    clock_id: int = INHERIT_CLOCK


@dataclass(frozen=True)
class EventType:
    event_type_id: int
    name: str
    fields: tuple[Field, ...] = ()
    scope_id: int = 0


@dataclass(frozen=True)
class Schema:
    storages: tuple[Storage, ...] = ()
    scopes: tuple[Scope, ...] = ()
    clocks: tuple[tuple[str, int], ...] = ()
    enums: tuple[tuple[str, dict[int, str]], ...] = ()
    event_types: tuple[EventType, ...] = ()
    summary_fields: tuple[tuple[str, str, int], ...] = ()

    def storage(self, name: str) -> Storage:
        for s in self.storages:
            if s.name == name:
                return s
        raise KeyError(f"no storage {name!r}; there are {[s.name for s in self.storages]}")

    def enum(self, name: str) -> dict[int, str] | None:
        return next((v for n, v in self.enums if n == name), None)

    def is_counter(self, s: Storage) -> bool:
        """One slot, neither sparse nor a buffer, a single u64 field."""
        return s.num_slots == 1 and not s.sparse and not s.buffer and len(s.fields) == 1 and s.fields[0].type == "u64"

    @property
    def counters(self) -> list[Storage]:
        return [s for s in self.storages if self.is_counter(s)]

    @property
    def buffers(self) -> list[Storage]:
        return [s for s in self.storages if s.buffer]

    @property
    def entities(self) -> Storage | None:
        """The first sparse storage, no buffer, with an entity_id field."""
        return next((s for s in self.storages if s.sparse and not s.buffer and s.field_index("entity_id") is not None), None)

    def scope_path(self, scope_id: int) -> str:
        by_id = {s.scope_id: s for s in self.scopes}
        names, seen = [], set()
        while scope_id in by_id and scope_id not in seen:
            seen.add(scope_id)
            names.append(by_id[scope_id].name)
            scope_id = by_id[scope_id].parent
        return "/".join(reversed(names))

    def clock_of(self, scope_id: int) -> int | None:
        """Clock of a scope, inherited from its ancestors."""
        by_id = {s.scope_id: s for s in self.scopes}
        seen: set[int] = set()
        while scope_id in by_id and scope_id not in seen:
            seen.add(scope_id)
            s = by_id[scope_id]
            if s.clock_id != INHERIT_CLOCK:
                return s.clock_id
            scope_id = s.parent
        return None


@dataclass
class Trace:
    """A trace or several of one schema: dimensions, and the two fact tables."""

    schema: Schema
    ops: DataFrame
    events: DataFrame
    stages: list[str] = field(default_factory=list)
    period_ps: int = DEFAULT_PERIOD_PS
    properties: dict[str, str] = field(default_factory=dict)
    segments: DataFrame | None = None
    strings: DataFrame | None = None
    checkpoints: DataFrame | None = None
    header: dict = field(default_factory=dict)

    def on(self, storage: Storage, *actions: str) -> DataFrame:
        """Operations on one storage, of the given actions or all. Slots outside the storage are no part of its state."""
        rows = self.ops.where((F.col("storage_id") == storage.storage_id) & F.col("slot").between(0, storage.num_slots - 1))
        return rows.where(F.col("action").isin(*actions)) if actions else rows

    def event(self, name: str) -> DataFrame:
        return self.events.where(F.col("event") == name)

    def dut_property(self, key: str) -> str | None:
        return self.properties.get(key)
