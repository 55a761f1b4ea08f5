"""Binary trace files: layouts, readers of each part, and the encoder.

All integers are little-endian. A file is a header, preamble chunks, segments
that link backwards, and, once it is complete, a section table that names
strings, segments and the summary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from ..plans.trace import INHERIT_CLOCK, NO_PARENT, NO_PROTOCOL, EventType, Field, Property, Schema, Scope, Storage

# fixed values of the format
FILE_MAGIC, SEGMENT_MAGIC = b"uSCP", b"uSEG"
F_COMPLETE, F_COMPRESSED, F_HAS_STRINGS, F_COMPACT_DELTAS, F_INTERLEAVED = 1, 2, 4, 64, 128
COMP_SHIFT, COMP_MASK, COMP_LZ4 = 3, 7, 0
CHUNK_END, CHUNK_DUT, CHUNK_SCHEMA, CHUNK_CONFIG = 0, 1, 2, 3
SECTION_END, SECTION_SUMMARY, SECTION_STRINGS, SECTION_SEGMENTS, SECTION_COUNTER_SUMMARY = 0, 1, 2, 3, 16
SF_SPARSE, SF_BUFFER = 1, 2
TYPE_CODES = {"u8": 1, "u16": 2, "u32": 3, "u64": 4, "i8": 5, "i16": 6, "i32": 7, "i64": 8, "bool": 9, "string_ref": 10, "enum": 11}
ROLES = {"plain": 0, "head": 1, "tail": 2}
ACTIONS = {"set": 1, "clear": 2, "add": 3, "prop_set": 4}
TAG_WIDE, TAG_COMPACT, TAG_EVENT = 1, 2, 3
HEADER, CHUNK, SEGMENT = struct.Struct("<4sHHQQIIQQ"), struct.Struct("<HHI"), struct.Struct("<4sIQQQIIIIII")
SECTION, SEGMENT_ENTRY, SCHEMA_HEADER, FIELD = struct.Struct("<HHIQQ"), struct.Struct("<QQQ"), struct.Struct("<BBHHHHH"), struct.Struct("<HBBBB2x")
_SHORT = struct.Struct("<BBBHHH")
POOL_LIMIT = 1 << 16
FRAME_ITEMS = 0xFFFF
MASK64 = (1 << 64) - 1

NAME_OF_TYPE = {v: k for k, v in TYPE_CODES.items()}
NAME_OF_ROLE = {v: k for k, v in ROLES.items()}
NAME_OF_ACTION = {v: k for k, v in ACTIONS.items()}


class TraceFormatError(ValueError):
    """The bytes are no valid trace."""


# --- LEB128 ---
def leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 0x7F
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


def read_leb128(buf: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next position). Bytes that end too early, or more than 64 bits, raise."""
    value = shift = 0
    while True:
        if at >= len(buf):
            raise TraceFormatError("LEB128: incomplete")
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if not b & 0x80:
            if value > MASK64:
                raise TraceFormatError("LEB128: overflow")
            return value, at
        shift += 7
        if shift >= 70:
            raise TraceFormatError("LEB128: overflow")


# --- strings ---
class StringPool:
    """Null-terminated names of a schema, each stored once; offsets have 16 bits."""

    def __init__(self, data: bytes = b""):
        self.data = bytearray(data)
        self.known: dict[str, int] = {}

    def add(self, text: str) -> int:
        if text not in self.known:
            raw = text.encode() + b"\0"
            if len(self.data) + len(raw) > POOL_LIMIT - 1:
                raise TraceFormatError("string pool is full")
            self.known[text] = len(self.data)
            self.data += raw
        return self.known[text]

    def get(self, offset: int) -> str | None:
        if not 0 <= offset < len(self.data):
            return None
        end = self.data.find(b"\0", offset)
        return self.data[offset : end if end >= 0 else len(self.data)].decode("utf-8", "replace")


def read_strings(buf: bytes) -> list[str]:
    n = struct.unpack_from("<I", buf)[0]
    base = 8 + 8 * n
    out = []
    for i in range(n):
        at, size = struct.unpack_from("<II", buf, 8 + 8 * i)
        out.append(buf[base + at : base + at + size].decode("utf-8", "replace"))
    return out


def write_strings(strings: list[str]) -> bytes:
    index, data = bytearray(), bytearray()
    for s in strings:
        raw = s.encode()
        index += struct.pack("<II", len(data), len(raw))
        data += raw + b"\0"
    return struct.pack("<II", len(strings), 0) + bytes(index) + bytes(data)


# --- header, chunks, schema ---
@dataclass
class Header:
    flags: int = F_COMPRESSED | F_INTERLEAVED
    total_time_ps: int = 0
    num_segments: int = 0
    preamble_end: int = 0
    section_table: int = 0
    tail: int = 0
    version: tuple[int, int] = (0, 2)

    def pack(self) -> bytes:
        return HEADER.pack(FILE_MAGIC, *self.version, self.flags, self.total_time_ps, self.num_segments, self.preamble_end, self.section_table, self.tail)

    @classmethod
    def read(cls, buf: bytes) -> "Header":
        if len(buf) < HEADER.size:
            raise TraceFormatError("header is cut off")
        magic, major, minor, flags, total, n, end, sections, tail = HEADER.unpack_from(buf)
        if magic != FILE_MAGIC:
            raise TraceFormatError(f"wrong magic {magic!r}")
        if major != 0:
            raise TraceFormatError(f"unknown version {major}.{minor}")
        if flags & F_COMPRESSED and flags >> COMP_SHIFT & COMP_MASK != COMP_LZ4:
            raise TraceFormatError("unknown compression method")
        return cls(flags, total, n, end, sections, tail, (major, minor))


def chunk(kind: int, payload: bytes = b"") -> bytes:
    return CHUNK.pack(kind, 0, len(payload)) + payload + bytes(-len(payload) % 8)


def read_chunks(buf: bytes, at: int = HEADER.size) -> dict[int, bytes]:
    """Payloads by chunk type up to the end chunk. The three mandatory ones must be there; unknown ones are skipped by their users."""
    out: dict[int, bytes] = {}
    while True:
        if at + CHUNK.size > len(buf):
            raise TraceFormatError("preamble is cut off")
        kind, _, size = CHUNK.unpack_from(buf, at)
        if kind == CHUNK_END:
            break
        out.setdefault(kind, buf[at + 8 : at + 8 + size])
        at += 8 + size + -size % 8
    for kind, name in ((CHUNK_DUT, "DUT"), (CHUNK_SCHEMA, "schema"), (CHUNK_CONFIG, "config")):
        if kind not in out:
            raise TraceFormatError(f"no {name} chunk")
    return out


def write_schema(s: Schema, pool: StringPool) -> bytes:
    def fields(fs: tuple) -> bytes:
        return b"".join(FIELD.pack(pool.add(f.name), TYPE_CODES[f.type], getattr(f, "enum_id", None) or 0, ROLES[getattr(f, "role", "plain")], getattr(f, "pair_id", 0)) for f in fs)

    body = bytearray()
    for i, (name, period) in enumerate(s.clocks):
        body += struct.pack("<HHI", pool.add(name), i, period)
    for x in s.scopes:
        body += struct.pack("<HHHHB3x", pool.add(x.name), x.scope_id, x.parent, NO_PROTOCOL if x.protocol is None else pool.add(x.protocol), x.clock_id)
    for name, values in s.enums:
        body += struct.pack("<HBB", pool.add(name), len(values), 0) + b"".join(struct.pack("<BBH", v, 0, pool.add(label)) for v, label in values.items())
    for x in s.storages:
        flags = SF_SPARSE * x.sparse | SF_BUFFER * x.buffer
        body += struct.pack("<HHHHHHHH", pool.add(x.name), x.storage_id, x.num_slots, len(x.fields), flags, x.scope_id, len(x.properties), 0) + fields(x.fields) + fields(x.properties)
    for x in s.event_types:
        body += struct.pack("<HHHH", pool.add(x.name), x.event_type_id, len(x.fields), x.scope_id) + fields(x.fields)
    for name, kind, scope in s.summary_fields:
        body += struct.pack("<HBBHH", pool.add(name), TYPE_CODES[kind], 0, scope, 0)
    head = SCHEMA_HEADER.pack(len(s.enums), len(s.clocks), len(s.scopes), len(s.storages), len(s.event_types), len(s.summary_fields), SCHEMA_HEADER.size + len(body))
    return head + bytes(body) + bytes(pool.data)


def read_schema(buf: bytes) -> tuple[Schema, StringPool]:
    n_enums, n_clocks, n_scopes, n_storages, n_events, n_summary, pool_at = SCHEMA_HEADER.unpack_from(buf)
    pool, at = StringPool(buf[pool_at:]), SCHEMA_HEADER.size

    def take(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, buf, at)
        at += struct.calcsize(fmt)
        return out

    def fields(n: int, properties: bool = False) -> tuple:
        out = []
        for _ in range(n):
            name, kind, enum_id, role, pair = take("<HBBBB2x")
            kind = NAME_OF_TYPE.get(kind, "u8")
            out.append(Property(pool.get(name) or "", kind, NAME_OF_ROLE.get(role, "plain"), pair) if properties else Field(pool.get(name) or "", kind, enum_id if kind == "enum" else None))
        return tuple(out)

    clocks = [(pool.get(n) or "", period) for n, _, period in (take("<HHI") for _ in range(n_clocks))]
    scopes = [Scope(i, pool.get(n) or "", parent, None if proto == NO_PROTOCOL else pool.get(proto), clock) for n, i, parent, proto, clock in (take("<HHHHB3x") for _ in range(n_scopes))]
    enums = []
    for _ in range(n_enums):
        name, n, _ = take("<HBB")
        enums.append((pool.get(name) or "", {v: pool.get(label) or "" for v, _, label in (take("<BBH") for _ in range(n))}))
    storages = []
    for _ in range(n_storages):
        name, i, slots, nf, flags, scope, np_, _ = take("<HHHHHHHH")
        storages.append(Storage(i, pool.get(name) or "", slots, fields(nf), bool(flags & SF_SPARSE), bool(flags & SF_BUFFER), scope, fields(np_, True)))
    events = []
    for _ in range(n_events):
        name, i, nf, scope = take("<HHHH")
        events.append(EventType(i, pool.get(name) or "", fields(nf), scope))
    summary = [(pool.get(n) or "", NAME_OF_TYPE.get(k, "u8"), scope) for n, k, _, scope, _ in (take("<HBBHH") for _ in range(n_summary))]
    return Schema(tuple(storages), tuple(scopes), tuple(clocks), tuple(enums), tuple(events), tuple(summary)), pool


def read_properties(buf: bytes, pool: StringPool) -> dict[str, str]:
    n = struct.unpack_from("<H", buf)[0]
    out: dict[str, str] = {}
    for i in range(n):
        k, v = struct.unpack_from("<HH", buf, 4 + 4 * i)
        out.setdefault(pool.get(k) or "", pool.get(v) or "")
    return out


# --- segments ---
@dataclass
class Segment:
    offset: int
    start_ps: int
    end_ps: int
    prev: int = 0
    checkpoint_size: int = 0
    packed_size: int = 0
    raw_size: int = 0
    frames: int = 0
    active: int = 0

    @classmethod
    def read(cls, buf: bytes, offset: int) -> "Segment":
        if len(buf) < SEGMENT.size:
            raise TraceFormatError("segment header is cut off")
        magic, _, start, end, prev, ck, packed, raw, frames, active, _ = SEGMENT.unpack_from(buf)
        if magic != SEGMENT_MAGIC:
            raise TraceFormatError("wrong segment magic")
        return cls(offset, start, end, prev, ck, packed, raw, frames, active)

    def pack(self) -> bytes:
        return SEGMENT.pack(SEGMENT_MAGIC, 0, self.start_ps, self.end_ps, self.prev, self.checkpoint_size, self.packed_size, self.raw_size, self.frames, self.active, 0)


def compress(raw: bytes) -> bytes:
    """LZ4 block after its raw size."""
    return struct.pack("<I", len(raw)) + pa.Codec("lz4_raw").compress(raw, asbytes=True) if raw else struct.pack("<I", 0)


def decompress(buf: bytes) -> bytes:
    size = struct.unpack_from("<I", buf)[0]
    return pa.Codec("lz4_raw").decompress(buf[4:], decompressed_size=size, asbytes=True) if size else b""


def slot_size(fields: tuple) -> int:
    return sum(f.width for f in fields)


def unpack_fields(buf: bytes, at: int, fields: tuple) -> list[int]:
    out = []
    for f in fields:
        out.append(int.from_bytes(buf[at : at + f.width], "little"))
        at += f.width
    return out


def pack_fields(values: list[int], fields: tuple) -> bytes:
    return b"".join((v & ((1 << 8 * f.width) - 1)).to_bytes(f.width, "little") for v, f in zip(values, fields, strict=True))


def read_checkpoint(buf: bytes, schema: Schema) -> Iterator[tuple[int, int, int, int, bool, bool]]:
    """(storage_id, slot, field_index, value, valid, is_property) of each stored cell; blocks stand in schema order."""
    at = 0
    for s in schema.storages:
        if at + 8 > len(buf):
            return
        size = struct.unpack_from("<HHI", buf, at)[2]
        block, at = buf[at + 8 : at + 8 + size], at + 8 + size
        width, pos, slots = slot_size(s.fields), 0, range(s.num_slots)
        if s.sparse:
            pos = -(-s.num_slots // 8)
            slots = [i for i in range(s.num_slots) if block[i >> 3] >> (i & 7) & 1]
        for i in slots:
            for k, v in enumerate(unpack_fields(block, pos, s.fields)):
                yield s.storage_id, i, k, v, True, False
            pos += width
        rest = block[pos : pos + slot_size(s.properties)]
        for k, v in enumerate(unpack_fields(rest + bytes(slot_size(s.properties) - len(rest)), 0, s.properties)):
            yield s.storage_id, 0, k, v, True, True


class State:
    """Storage contents in plain Python: the encoder's shadow state, and the tests' sequential replay."""

    def __init__(self, schema: Schema):
        self.schema = schema
        self.by_id = {s.storage_id: s for s in schema.storages}
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.valid: set[tuple[int, int]] = set()
        self.props = {s.storage_id: [0] * len(s.properties) for s in schema.storages}

    def apply(self, action: str, storage_id: int, slot: int, index: int, value: int) -> None:
        s = self.by_id.get(storage_id)
        if s is None:
            return
        if action == "prop_set":
            if index < len(s.properties):
                self.props[storage_id][index] = value & ((1 << 8 * s.properties[index].width) - 1)
            return
        if not 0 <= slot < s.num_slots:
            return
        key = (storage_id, slot)
        if action == "clear":
            self.valid.discard(key)
            self.cells.pop(key, None)
        elif action in ("set", "add") and 0 <= index < len(s.fields):
            row = self.cells.setdefault(key, [0] * len(s.fields))
            row[index] = (value + (row[index] if action == "add" else 0)) & ((1 << 8 * s.fields[index].width) - 1)
            self.valid.add(key)

    def get(self, storage_id: int, slot: int, index: int) -> int:
        row = self.cells.get((storage_id, slot))
        return row[index] if row and 0 <= index < len(row) else 0

    def is_valid(self, storage_id: int, slot: int) -> bool:
        s = self.by_id.get(storage_id)
        return s is not None and 0 <= slot < s.num_slots and (not s.keeps_validity or (storage_id, slot) in self.valid)

    def checkpoint(self) -> bytes:
        out = bytearray()
        for s in self.schema.storages:
            block = bytearray()
            slots = range(s.num_slots)
            if s.sparse:
                slots = sorted(i for sid, i in self.valid if sid == s.storage_id)
                mask = bytearray(-(-s.num_slots // 8))
                for i in slots:
                    mask[i >> 3] |= 1 << (i & 7)
                block += mask
            for i in slots:
                block += pack_fields(self.cells.get((s.storage_id, i), [0] * len(s.fields)), s.fields)
            block += pack_fields(self.props[s.storage_id], s.properties)
            out += struct.pack("<HHI", s.storage_id, 0, len(block)) + block
        return bytes(out)


class Net:
    """What operations come to, whatever the state before them: for each slot its clear, then a SET or ADD for each field. Fed to :class:`State`, it has the same effect."""

    ROW = struct.Struct("<BHHHQ")

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], dict[int, tuple[str, int]]] = {}
        self.cleared: set[tuple[int, int]] = set()
        self.props: dict[tuple[int, int], int] = {}

    def apply(self, action: str, storage_id: int, slot: int, index: int, value: int) -> None:
        key = (storage_id, slot)
        if action == "prop_set":
            self.props[storage_id, index] = value
        elif action == "clear":
            self.cleared.add(key)
            self.cells.pop(key, None)
        elif action == "set":
            self.cells.setdefault(key, {})[index] = (action, value)
        elif action == "add":
            cell = self.cells.setdefault(key, {})
            before, sum_ = cell.get(index, (action, 0))
            cell[index] = (before, sum_ + value & MASK64)

    def pack(self) -> bytes:
        rows = [("clear", *key, 0, 0) for key in self.cleared]
        rows += [(action, *key, index, value) for key, cell in self.cells.items() for index, (action, value) in cell.items()]
        rows += [("prop_set", sid, 0, index, value) for (sid, index), value in self.props.items()]
        return b"".join(self.ROW.pack(ACTIONS[a], sid, slot, index, value & MASK64) for a, sid, slot, index, value in rows)

    @classmethod
    def replay(cls, packed: bytes, state: State) -> None:
        for action, sid, slot, index, value in cls.ROW.iter_unpack(packed):
            state.apply(NAME_OF_ACTION[action], sid, slot, index, value)


# (frame, item, time_ps, kind, action, storage_id, slot, field_index, value, event_type_id, payload)
Item = tuple[int, int, int, str, str | None, int | None, int | None, int | None, int | None, int | None, bytes | None]


def read_frames(raw: bytes, start_ps: int, interleaved: bool, compact_allowed: bool = False, until_ps: int | None = None) -> Iterator[Item]:
    """Items in order. Decoding stops at the first frame after ``until_ps``."""
    at, time_ps, frame = 0, start_ps, 0
    while at < len(raw):
        delta, at = read_leb128(raw, at)
        time_ps += delta
        if until_ps is not None and time_ps > until_ps:
            return
        item = 0
        if interleaved:
            n = struct.unpack_from("<H", raw, at)[0]
            at += 2
            for item in range(n):
                tag = raw[at]
                if tag == TAG_WIDE:
                    _, action, sid, slot, index, value = struct.unpack_from("<BBHHHQ", raw, at)
                    at += 16
                elif tag == TAG_COMPACT:
                    _, action, sid, slot, index, value = _SHORT.unpack_from(raw, at)
                    at += 9
                elif tag == TAG_EVENT:
                    _, _, kind, size = struct.unpack_from("<BBHI", raw, at)
                    yield frame, item, time_ps, "event", None, None, None, None, None, kind, raw[at + 8 : at + 8 + size]
                    at += 8 + size
                    continue
                else:
                    raise TraceFormatError(f"unknown item tag {tag}")
                yield frame, item, time_ps, "op", NAME_OF_ACTION.get(action, f"action_{action}"), sid, slot, index, value, None, None
        else:
            compact = raw[at] == 1 and compact_allowed
            n_ops, n_events = struct.unpack_from("<HH", raw, at + 2)
            at += 6
            for item in range(n_ops):
                if compact:
                    action, sid, slot, index, value = struct.unpack_from("<BBHHH", raw, at)
                    at += 8
                else:
                    action, _, sid, slot, index, value = struct.unpack_from("<BBHHHQ", raw, at)
                    at += 16
                yield frame, item, time_ps, "op", NAME_OF_ACTION.get(action, f"action_{action}"), sid, slot, index, value, None, None
            for item in range(n_ops, n_ops + n_events):
                kind, _, size = struct.unpack_from("<HHI", raw, at)
                yield frame, item, time_ps, "event", None, None, None, None, None, kind, raw[at + 8 : at + 8 + size]
                at += 8 + size
        frame += 1


def compact(items: list[Item]) -> bool:
    """Whether every operation of a frame fits the short form."""
    return all(x[3] != "op" or x[5] <= 0xFF and (x[8] or 0) <= 0xFFFF for x in items)


def write_frame(delta_ps: int, items: list[Item]) -> bytes:
    """An interleaved frame; more items than a frame can count raise."""
    if len(items) > FRAME_ITEMS:
        raise TraceFormatError(f"{len(items)} items in a frame")
    short, out = compact(items), bytearray(leb128(delta_ps) + struct.pack("<H", len(items)))
    for _, _, _, kind, action, sid, slot, index, value, event, payload in items:
        if kind == "event":
            out += struct.pack("<BBHI", TAG_EVENT, 0, event, len(payload)) + payload
        elif short:
            out += _SHORT.pack(TAG_COMPACT, ACTIONS[action], sid, slot, index or 0, value or 0)
        else:
            out += struct.pack("<BBHHHQ", TAG_WIDE, ACTIONS[action], sid, slot, index or 0, (value or 0) & MASK64)
    return bytes(out)


# --- summaries ---
@dataclass
class Summary:
    base: int = 1024
    fan_out: int = 4
    total: int = 0
    density: list[list[int]] = field(default_factory=list)
    #: name, storage_id, levels of (min, max, sum)
    counters: list[tuple[str, int, list[list[tuple[int, int, int]]]]] = field(default_factory=list)


def write_summary(s: Summary) -> bytes:
    out = bytearray(b"TSUM" + struct.pack("<IIQI", s.base, s.fan_out, s.total, len(s.density)))
    for level in s.density:
        out += struct.pack(f"<I{len(level)}I", len(level), *level)
    out += struct.pack("<I", len(s.counters))
    for name, sid, levels in s.counters:
        raw = name.encode()
        out += struct.pack("<I", len(raw)) + raw + struct.pack("<HI", sid, len(levels))
        for level in levels:
            out += struct.pack("<I", len(level)) + b"".join(struct.pack("<QQQ", *e) for e in level)
    return bytes(out)


def read_summary(buf: bytes) -> Summary:
    """Summary with or without density (the older form has none, and a total of 0)."""
    magic, at = buf[:4], 4

    def take(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, buf, at)
        at += struct.calcsize(fmt)
        return out

    if magic not in (b"TSUM", b"CSUM"):
        raise TraceFormatError(f"wrong summary magic {magic!r}")
    s = Summary(*take("<II"))
    if magic == b"TSUM":
        s.total, n = take("<QI")
        s.density = [list(take(f"<{take('<I')[0]}I")) for _ in range(n)]
    for _ in range(take("<I")[0]):
        size = take("<I")[0]
        name, at = buf[at : at + size].decode("utf-8", "replace"), at + size
        sid, levels = take("<HI")
        s.counters.append((name, sid, [[take("<QQQ") for _ in range(take("<I")[0])] for _ in range(levels)]))
    return s


# --- level directory of the older summary section ---
LEVELS, LEVEL = struct.Struct("<IIIIQ"), struct.Struct("<QI4x")


def write_levels(fan_out: int, entry_size: int, base_interval_ps: int, levels: list[tuple[int, int]]) -> bytes:
    """Header and (offset, entries) of each level."""
    return LEVELS.pack(len(levels), fan_out, entry_size, 0, base_interval_ps) + b"".join(LEVEL.pack(*x) for x in levels)


def read_levels(buf: bytes) -> dict:
    n, fan_out, entry_size, _, base = LEVELS.unpack_from(buf)
    return {"fan_out": fan_out, "entry_size": entry_size, "base_interval_ps": base, "levels": [LEVEL.unpack_from(buf, LEVELS.size + i * LEVEL.size) for i in range(n)]}
