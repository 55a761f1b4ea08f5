import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoslot.plans.trace import EventType, Field, Property, Schema, Scope, Storage
from chronoslot.sources import codec as C
from chronoslot.sources.builder import SchemaBuilder


@pytest.mark.parametrize("v", [0, 127, 128, 1000, 65535, 10**6, 2**64 - 1])
def test_leb128(v):
    raw = C.leb128(v)
    assert C.read_leb128(raw) == (v, len(raw))


def test_leb128_errors():
    with pytest.raises(C.TraceFormatError, match="incomplete"):
        C.read_leb128(b"\x80")
    with pytest.raises(C.TraceFormatError, match="overflow"):
        C.read_leb128(b"\x80" * 11)


def test_pool():
    p = C.StringPool()
    a = p.add("x")
    assert p.add("x") == a and p.get(a) == "x" and p.get(10_000) is None
    with pytest.raises(C.TraceFormatError):
        p.add("y" * 70_000)


def test_header_and_chunks():
    h = C.Header(total_time_ps=5, num_segments=2, preamble_end=99, tail=7)
    assert C.Header.read(h.pack()) == h and len(h.pack()) == 48
    with pytest.raises(C.TraceFormatError, match="magic"):
        C.Header.read(b"XXXX" + h.pack()[4:])
    with pytest.raises(C.TraceFormatError, match="compression"):
        C.Header.read(C.Header(flags=C.F_COMPRESSED | 1 << 3).pack())
    body = b"".join(C.chunk(k, bytes([k]) * k) for k in (1, 99, 2, 3)) + C.chunk(0)
    assert C.read_chunks(body, 0)[2] == b"\2\2"
    with pytest.raises(C.TraceFormatError, match="schema"):
        C.read_chunks(C.chunk(1) + C.chunk(3) + C.chunk(0), 0)


SCHEMA = Schema(
    storages=(
        Storage(0, "sparse", 4, (Field("a", "u32"), Field("b", "u64")), sparse=True, properties=(Property("p", "u16", "head", 1), Property("q", "u32", "tail", 1))),
        Storage(1, "dense", 2, (Field("x", "u8"), Field("e", "enum", 0))),
    ),
    scopes=(Scope(0, "root"), Scope(1, "core", 0, "cpu", 0)),
    clocks=(("clk", 500),),
    enums=(("kind", {0: "zero", 7: "seven"}),),
    event_types=(EventType(0, "ev", (Field("id", "u32"), Field("t", "string_ref")), 1),),
    summary_fields=(("committed", "u64", 1),),
)


def test_schema():
    again, _ = C.read_schema(C.write_schema(SCHEMA, C.StringPool()))
    assert again == SCHEMA
    assert again.scope_path(1) == "root/core" and again.clock_of(1) == 0


def test_state():
    s = C.State(SCHEMA)
    s.apply("set", 0, 1, 0, 42)
    s.apply("set", 0, 1, 1, 0xDEADBEEFCAFE)
    s.apply("set", 0, 3, 0, 100)
    s.apply("add", 0, 3, 0, 50)
    s.apply("add", 1, 0, 0, 300)
    s.apply("prop_set", 0, 0, 0, 5)
    s.apply("prop_set", 0, 0, 1, 99)
    assert s.get(0, 3, 0) == 150 and s.get(1, 0, 0) == 300 - 256
    cells = list(C.read_checkpoint(s.checkpoint(), SCHEMA))
    assert {(x[1], x[2]): x[3] for x in cells if x[0] == 0 and not x[5]} == {(1, 0): 42, (1, 1): 0xDEADBEEFCAFE, (3, 0): 150, (3, 1): 0}
    assert [x[3] for x in cells if x[5]] == [5, 99]
    s.apply("clear", 0, 1, 0, 0)
    assert not s.is_valid(0, 1) and s.get(0, 1, 1) == 0 and s.is_valid(1, 1) and not s.is_valid(0, 9)


ITEM = st.one_of(
    st.tuples(st.sampled_from(["set", "add", "clear", "prop_set"]), st.integers(0, 400), st.integers(0, 65535), st.integers(0, 9), st.integers(0, 2**64 - 1)),
    st.tuples(st.integers(0, 9), st.binary(max_size=20)),
)


@given(st.lists(st.tuples(st.integers(0, 10**6), st.lists(ITEM, max_size=6)), max_size=6))
def test_frames(frames):
    raw, want, now = b"", [], 1000
    for n, (delta, items) in enumerate(frames):
        now += delta
        rows = [(0, 0, now, "op", *x, None, None) if len(x) == 5 else (0, 0, now, "event", None, None, None, None, None, *x) for x in items]
        raw += C.write_frame(delta, rows)
        want += [(n, i, *r[2:]) for i, r in enumerate(rows)]
    assert list(C.read_frames(raw, 1000, True)) == want
    assert C.decompress(C.compress(raw)) == raw


def test_compact_limits():
    op = lambda sid, v: (0, 0, 0, "op", "set", sid, 0, 0, v, None, None)
    assert C.compact([op(255, 65535)]) and not C.compact([op(300, 1)]) and not C.compact([op(1, 70_000)])
    with pytest.raises(C.TraceFormatError):
        C.write_frame(0, [op(1, 1)] * 65_536)


def test_old_frames():
    wide = C.leb128(1000) + struct.pack("<BBHH", 0, 0, 1, 1) + struct.pack("<BBHHHQ", 1, 0, 0, 2, 0, 42) + struct.pack("<HHI", 3, 0, 2) + b"ab"
    rows = list(C.read_frames(wide, 0, False))
    assert rows[0][:9] == (0, 0, 1000, "op", "set", 0, 2, 0, 42) and rows[1][9:] == (3, b"ab")
    short = C.leb128(5) + struct.pack("<BBHH", 1, 0, 1, 0) + struct.pack("<BBHHH", 3, 1, 0, 0, 7)
    assert list(C.read_frames(short, 0, False, True))[0][4:9] == ("add", 1, 0, 0, 7)
    with pytest.raises(C.TraceFormatError, match="tag"):
        list(C.read_frames(C.leb128(0) + struct.pack("<HB", 1, 9), 0, True))


def test_summary():
    s = C.Summary(1024, 4, 150, [[100, 50], [150]], [("ops", 2, [[(1, 5, 100)], [(1, 5, 100)]])])
    assert C.read_summary(C.write_summary(s)) == s
    old = b"CSUM" + struct.pack("<III", 1024, 4, 1) + struct.pack("<I", 3) + b"ops" + struct.pack("<HI", 2, 1) + struct.pack("<I", 1) + struct.pack("<QQQ", 1, 5, 100)
    back = C.read_summary(old)
    assert back.total == 0 and back.density == [] and back.counters == [("ops", 2, [[(1, 5, 100)]])]
    with pytest.raises(C.TraceFormatError, match="magic"):
        C.read_summary(b"BADM....")


def test_strings():
    assert C.read_strings(C.write_strings(["a", "", "é"])) == ["a", "", "é"]


def test_level_directory():
    raw = C.write_levels(4, 24, 1000, [(100, 8), (292, 2)])
    assert len(raw) == 24 + 2 * 16
    assert C.read_levels(raw) == {"fan_out": 4, "entry_size": 24, "base_interval_ps": 1000, "levels": [(100, 8), (292, 2)]}


def test_net_effect_of_operations():
    """A part's net effect does to any state what its operations do, one after the other."""
    b = SchemaBuilder()
    b.scope("root")
    b.storage("sparse", 3, [Field("a", "u8"), Field("b", "u64")], sparse=True, properties=[Property("p", "u16")])
    b.storage("dense", 2, [Field("a", "u32")])
    schema, rng = b.build(), random.Random(7)
    for _ in range(200):
        one, other = C.State(schema), C.State(schema)
        for _ in range(4):
            net = C.Net()
            for _ in range(rng.randrange(12)):
                op = (rng.choice(["set", "add", "clear", "prop_set"]), rng.randrange(3), rng.randrange(4), rng.randrange(3), rng.choice([1, 255, (1 << 64) - 1]))
                one.apply(*op)
                net.apply(*op)
            C.Net.replay(net.pack(), other)
            assert other.checkpoint() == one.checkpoint() and other.valid == one.valid
