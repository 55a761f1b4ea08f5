"""Operators against known answers, and every registered query against its SQL at the smallest scale."""

import math
import os
from decimal import Decimal

import pytest

from chronoslot.operators import counters, mipmap, noc, report, state
from chronoslot.plans import file_queries, queries  # noqa: F401  (both register queries)
from chronoslot.plans.trace import EVENTS_SCHEMA, OPS_SCHEMA, EventType, Field, Schema, Scope, Storage, Trace

SF = "/root/testdata/sf0.001"
ENT = Storage(0, "entities", 64, (Field("entity_id", "u32"), Field("pc", "u64")), sparse=True)
OPS = Storage(1, "ops", 1, (Field("count", "u64"),))
NARROW = Storage(2, "narrow", 4, (Field("a", "u8"), Field("s", "i8"), Field("b", "bool")))


def make(spark, ops, events=()):
    """ops: (cycle, storage, slot, field, action, value); events: (cycle, name, entity, arg)."""
    rows = [("t", 0, i, c * 1000, c, sid, slot, f, a, Decimal(v)) for i, (c, sid, slot, f, a, v) in enumerate(ops)]
    ev = [("t", 0, 10_000 + i, c * 1000, c, n, e, a, None, None) for i, (c, n, e, a) in enumerate(events)]
    return Trace(Schema((ENT, OPS, NARROW), (Scope(0, "root"),), (("clk", 1000),), (), (EventType(0, "flush"),)), spark.createDataFrame(rows, OPS_SCHEMA), spark.createDataFrame(ev, EVENTS_SCHEMA), ["a"], 1000)


def add(cycle, v):
    return (cycle, 1, 0, 0, "add", v)


def test_state_rules(spark):
    t = make(spark, [(0, 0, 1, 0, "set", 42), (0, 0, 1, 1, "set", 7), (1, 0, 1, None, "clear", 0), (2, 0, 1, 1, "add", 5), (2, 2, 0, 0, "set", 250), (3, 2, 0, 0, "add", 10), (3, 2, 0, 1, "set", 255), (3, 2, 0, 2, "set", 2), (3, 0, 99, 0, "set", 1)])
    assert [(r["slot"], int(r["entity_id"]), int(r["pc"])) for r in state.state_at(t, ENT, 0).collect()] == [(1, 42, 7)]
    assert state.state_at(t, ENT, 1000).isEmpty()
    assert [(r["slot"], int(r["entity_id"]), int(r["pc"])) for r in state.state_at(t, ENT, 5000).collect()] == [(1, 0, 5)]
    r = state.state_at(t, NARROW, 5000).first()
    assert (r["a"], r["s"], r["b"]) == (4, -1, True)


def test_wrapping_sum(spark):
    t = make(spark, [add(0, 2**63), add(1, 2**63 - 1), add(2, 6)])
    assert int(state.counter_state(t, 9000).first()["value"]) == 5


def test_counter_values(spark):
    t = make(spark, [add(0, 0), add(2, 5), add(4, 3)])
    assert [counters.value_at(t, c).first()["value"] for c in (0, 1, 2, 3, 4, 100)] == [0, 0, 5, 5, 8, 8]
    t = make(spark, [add(0, 0), add(2, 4), add(4, 4)])
    assert counters.rate_at(t, 4, 2).first()["rate"] == 2.0 and counters.rate_at(t, 0, 2).first()["rate"] == 0.0
    s = spark.createDataFrame([("c", 0, 0), ("c", 2, 4), ("c", 4, 10)], "counter string, cycle long, cum long")
    assert [counters.sparse_delta_at(s, c).first()["delta"] for c in (0, 1, 3, 9)] == [0, 2, 3, 0]
    assert [r["cum"] for r in counters.with_terminal(t, 9).orderBy("cycle").collect()] == [0, 4, 8, 8]


def test_counter_downsample(spark):
    t = make(spark, [add(0, 0), add(5, 5), add(10, 15)])
    hi = [r["hi"] for r in counters.downsample(t, 0, 10, 2).orderBy("bucket").collect()]
    assert hi[1] == 1_000_000 and abs(hi[0] * 3 - hi[1]) <= 3
    assert counters.downsample(t, 5, 5, 2).isEmpty() and counters.downsample(t, 0, 10, 0).isEmpty()


def test_block_sums_equal_plain_sums(spark, monkeypatch):
    ops = [add(c, c % 7) for c in range(300)]
    want = [r["cum"] for r in counters.samples(make(spark, ops)).orderBy("seq").collect()]
    monkeypatch.setattr(counters, "BLOCK", 16)
    assert [r["cum"] for r in counters.samples(make(spark, ops)).orderBy("seq").collect()] == want


def test_mipmap(spark):
    t = make(spark, [add(c, 1) for c in range(1024)] + [add(c, 3) for c in range(1024, 2048, 2)])
    assert [(r["lo"], r["hi"], r["total"]) for r in mipmap.counter_level0(t).orderBy("bucket").collect()] == [(1, 1, 1024), (3, 3, 1536)]
    t = make(spark, [add(c, 1) for c in range(0, 8192)])
    levels = {}
    for r in mipmap.counter_pyramid(t).collect():
        levels.setdefault(r["level"], []).append((r["bucket"], r["lo"], r["hi"], r["total"]))
    assert [len(levels[k]) for k in sorted(levels)] == [8, 2, 1] and sorted(levels[1])[0] == (0, 1, 1, 4096)


def test_density(spark):
    births = [(c, 0, c % 64, 0, "set", c) for c in range(100)] + [(1024 + c, 0, c % 64, 0, "set", 1000 + c) for c in range(50)]
    t = make(spark, births)
    d = mipmap.density_level0(t)
    assert [r["births"] for r in d.orderBy("bucket").collect()] == [100, 50]
    rows = spark.createDataFrame([(r,) for r in (0, 99, 100, 149, 150)], "row long")
    assert {r["row"]: r["cycle"] for r in mipmap.row_to_cycle(d, rows).collect()} == {0: 0, 99: 0, 100: 1024, 149: 1024, 150: 2048}
    cycles = spark.createDataFrame([(c,) for c in (0, 512, 1024, 5000)], "cycle long")
    assert {r["cycle"]: r["row"] for r in mipmap.cycle_to_row(d, cycles).collect()} == {0: 0, 512: 50, 1024: 100, 5000: 150}


def test_sampled_rows(spark):
    df = spark.range(0, 1003, 1, 5).selectExpr("(id * 37) % 1003 AS k", "id")
    kept = sorted(r["k"] for r in report.sampled(df, ["k"], 100).collect())
    assert kept == sorted({*range(0, 1003, 10), 1002})
    assert report.sampled(df.limit(0), ["k"]).columns == ["k", "id"] and report.sampled(df.limit(0), ["k"]).isEmpty()
    assert sorted(r["k"] for r in report.sampled(df.where("k < 3"), ["k"]).collect()) == [0, 1, 2]


def test_handoffs_and_meshes(spark):
    lives = spark.createDataFrame([(i, 10 * i) for i in range(1, 8)], "life long, latency long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "src long, dst long")
    got = sorted((r["first_life"], r["last_life"], r["hops"], r["latency"]) for r in noc.handoff_chains(links, lives).collect())
    assert got == [(1, 4, 3, 100), (5, 5, 0, 50), (6, 7, 1, 130)]
    s = Schema(scopes=(Scope(0, "root"), Scope(1, "mesh", 0, "noc"), Scope(2, "r0", 1, "noc.router")))
    assert noc.catalog_scope(s, 2).name == "mesh" and noc.catalog_scope(s, 0) is None


def test_handoff_chain_of_a_busy_user(spark, tmp_path):
    """More lives of one user than any test table has are still one chain."""
    rows = [(2 * i + d, 2 * i + d, 1, ("signup", "purchase")[d], 1.0, '{"k": 3}') for i in range(45) for d in (0, 1)]
    df = spark.createDataFrame(rows, "event_id long, minute long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "timestamp_seconds(1704067200 + 60 * minute) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in queries.QUERIES["handoff_chain"](spark, str(tmp_path)).select("first_life", "last_life", "hops").collect()]
    assert got == [(0, 88, 44)]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, Decimal):
        return str(int(v)) if v == int(v) else str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    res = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
