import dataclasses
import shutil
from pathlib import Path

import pytest
from fixtures import three_instructions
from pyspark.sql import functions as F

from chronoslot.operators import buffers, lifecycle, noc, report, state
from chronoslot.operators.counters import samples
from chronoslot.plans import file_queries, queries, resolve, work
from chronoslot.plans.trace import Field
from chronoslot.sources import codec, sink, trace_format
from chronoslot.sources.builder import SchemaBuilder, TraceWriter


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "a.trace"
    three_instructions(path, 2000)
    return trace_format.load(spark, str(path))


def test_state_in_time(trace):
    at = {r["slot"]: r for r in state.state_at(trace, trace.schema.entities, 1500).collect()}
    assert set(at) == {0, 1} and at[0]["pc"] == 0x80000000 and at[1]["pc"] == 0x80000004
    assert state.state_at(trace, trace.schema.entities, 5000).isEmpty()
    assert trace.header["total_time_ps"] == 5000 and trace.header["complete"]


def test_events(trace):
    n = {r["event"]: r["count"] for r in trace.events.groupBy("event").count().collect()}
    assert n == {"stage_transition": 12, "annotate": 3, "dependency": 1}


def test_lifecycle(trace):
    rows = {r["entity_id"]: r for r in lifecycle.instructions(trace).collect()}
    assert [rows[i]["status"] for i in range(3)] == ["Retired"] * 3
    assert [(rows[i]["first_cycle"], rows[i]["last_cycle"]) for i in range(3)] == [(0, 3), (1, 4), (2, 5)]
    assert rows[1]["pc"] == 0x80000004 and rows[2]["tooltip"] == "nop #2"
    spans = sorted((r["start_cycle"], r["end_cycle"], r["stage_name"]) for r in lifecycle.stage_spans(trace).where("entity_id = 0").collect())
    assert spans == [(0, 1, "fetch"), (1, 2, "decode"), (2, 3, "execute"), (3, 3, "writeback")]
    assert lifecycle.timeline(trace, 1).count() == 4
    with pytest.raises(LookupError):
        lifecycle.timeline(trace, 9)


def test_counter(trace):
    assert sorted((r["cycle"], r["cum"]) for r in samples(trace).collect()) == [(3, 1), (4, 2), (5, 3)]


def test_buffers(trace):
    rob = trace.schema.storage("rob")
    got = {r["slot"]: r for r in buffers.buffer_state(trace, rob, 2).collect()}
    assert {k: v["entity_id"] for k, v in got.items()} == {0: 0, 1: 1, 2: 2} and got[1]["inst_bits"] == 0x13
    pair = buffers.pointer_pairs(trace, rob, 4).first()
    assert (pair["head"], pair["tail"], pair["distance"]) == (2, 3, 1)
    assert [r["occupied"] for r in buffers.all_buffers(trace, 3).collect()] == [2]
    with pytest.raises(LookupError):
        buffers.all_buffers(trace, 3, "none")


def test_reports(trace):
    s = report.summary(trace, 0, 6).first()
    assert (s["total"], s["retired"], s["ipc"]) == (3, 3, 0.5)
    assert report.performance(trace, 0, 6).count() > 10
    assert report.file_info(trace).where("section = 'pipeline'").count() == 4
    with pytest.raises(ValueError):
        report.summary(trace, 5, 5)


@pytest.mark.parametrize("interval", [1000, 3000, 100_000])
def test_state_does_not_depend_on_segments(spark, tmp_path, interval):
    """Replay of all operations, and the checkpoint of a segment with its own operations, give the same state."""
    path = tmp_path / "b.trace"
    three_instructions(path, interval)
    t = trace_format.load(spark, str(path))
    ck = spark.read.format("chronoslot").option("table", "checkpoints").load(str(path)).where("not is_prop")
    for time_ps in (0, 1500, 2000, 3999, 5000):
        whole = sorted(map(tuple, state.state_at(t, t.schema.entities, time_ps).collect()))
        seg = state.seek(t.segments, time_ps).first()["seg_id"]
        part = state.state_at(t, t.schema.entities, time_ps, ck.where(f"seg_id = {seg}"), trace_format.sequence(seg, 0, 0))
        assert sorted(map(tuple, part.collect())) == whole


def test_replay_matches_plain_python(spark, tmp_path):
    path = tmp_path / "c.trace"
    three_instructions(path, 2000)
    t = trace_format.load(spark, str(path))
    s = codec.State(t.schema)
    for r in t.ops.orderBy("seq").collect():
        if r["time_ps"] <= 2500:
            s.apply(r["action"], r["storage_id"], r["slot"], r["field_index"] or 0, int(r["value"]))
    ent = t.schema.entities
    got = {(r["slot"], r["field_index"]): int(r["value"]) for r in state.fields_at(t, ent, 2500).where("valid").collect()}
    assert got == {(slot, i): s.get(ent.storage_id, slot, i) for sid, slot in s.valid if sid == ent.storage_id for i in range(3)}


def test_pruning(spark, tmp_path):
    path = tmp_path / "d.trace"
    three_instructions(path, 1000)
    trace_format.register(spark)
    items = spark.read.format("chronoslot").load(str(path))
    assert items.rdd.getNumPartitions() > 2
    assert items.where("time_ps <= 900").rdd.getNumPartitions() < items.rdd.getNumPartitions()
    assert {r["time_ps"] for r in items.where("time_ps >= 4000").collect()} == {4000, 5000}


def test_live_tail(spark, tmp_path):
    path = tmp_path / "e.trace"
    w = three_instructions(path, 1000, finish=False)
    seen = trace_format.TraceStreamReader({"path": str(path)})
    first = seen.latestOffset()
    n = sum(len(list(seen.read(p))) for p in seen.partitions(seen.initialOffset(), first))
    assert n > 0 and seen.partitions(first, first) == []
    w.close()
    second = seen.latestOffset()
    n += sum(len(list(seen.read(p))) for p in seen.partitions(first, second))
    trace_format.register(spark)
    assert n == spark.read.format("chronoslot").load(str(path)).count()
    out = spark.readStream.format("chronoslot").load(str(path)).writeStream.format("memory").queryName("tail").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    out.awaitTermination()
    assert spark.table("tail").count() == n


def test_unfinished_file(spark, tmp_path):
    path = tmp_path / "f.trace"
    w = three_instructions(path, 1000, finish=False)
    f = trace_format.TraceFile(str(path))
    assert f.sections() == {} and len(f.segments()) == f.header.num_segments > 0 and f.strings() == []
    w.close()
    assert trace_format.TraceFile(str(path)).strings() == ["nop #0", "nop #1", "nop #2"]


def test_handoffs_of_a_file(spark, tmp_path):
    """Four fields of an event come back from a file and a copy of it; an id that is reused is the life before the event."""
    b = SchemaBuilder()
    b.clock_domain("clk", 1000)
    root = b.scope("root", clock_id=0)
    scopes = [b.scope(n, root, "noc") for n in ("a", "b")]
    stores = [b.storage("transactions", 64, [Field("txn_id", "u32")], sparse=True, scope_id=s) for s in scopes]
    handoff = b.event("txn_handoff", [Field("src_scope", "u16"), Field("src_txn_id", "u32"), Field("dst_scope", "u16"), Field("dst_txn_id", "u32")], root)
    path, copy = str(tmp_path / "h.trace"), str(tmp_path / "copy.trace")
    w = TraceWriter(path, b.build())
    for k in range(2):  # txn 42 of a, then 7 of b, both used twice
        for cycle in range(3):
            w.begin_cycle((10 * k + cycle * (k + 1)) * 1000)
            if cycle == 0:
                w.slot_set(stores[0], 5, 0, 42)
            if cycle == 1:
                w.slot_clear(stores[0], 5)
                w.slot_set(stores[1], 6, 0, 7)
                w.event(handoff, scopes[0], 42, scopes[1], 7)
            if cycle == 2:
                w.slot_clear(stores[1], 6)
            w.end_cycle()
    w.close()
    sink.write_file(trace_format.load(spark, path), copy, summary=False)
    for p in (path, copy):
        t = trace_format.load(spark, p)
        assert [[int(v) for v in r["fields"]] for r in t.event("txn_handoff").collect()] == [[scopes[0], 42, scopes[1], 7]] * 2
        chains = noc.handoff_chains(noc.handoff_links(t), noc.handoff_lives(t)).collect()
        assert sorted((r["hops"], r["latency"]) for r in chains) == [(1, 2), (1, 4)]


def test_resolution(trace):
    s = trace.schema
    assert resolve.core_scope(s).name == "core0" and resolve.clock_period(s) == 1000
    assert [x.name for x in resolve.counters(s)] == ["committed_insns"] and [x.name for x in resolve.buffers(s)] == ["rob"]
    assert resolve.event_ids(s)["flush"] is not None
    with pytest.raises(resolve.ProtocolError):
        resolve.core_scope(s, "core9")
    assert resolve.stage_names(s, {}) == ["fetch", "decode", "execute", "writeback"]


def test_payloads_and_properties_of_scopes(spark, tmp_path):
    """Typed fields of an interconnect's events, and properties that name their scope."""
    b = SchemaBuilder()
    b.clock_domain("clk", 1000)
    root = b.scope("root", clock_id=0)
    mesh = b.scope("mesh", root, "noc")
    beat = b.event("beat", [Field("txn_id", "u32"), Field("seq", "u16"), Field("delta", "i8"), Field("last", "bool")], mesh)
    b.storage("transactions", 4, [Field("txn_id", "u32")], sparse=True, scope_id=mesh)
    path = str(tmp_path / "n.trace")
    w = TraceWriter(path, b.build(), {"noc.root.mesh.dim_x": "4", "noc.topology": "mesh", "vendor": "x"})
    w.begin_cycle(3000)
    w.event(beat, 7, 65535, -2, 1)
    w.end_cycle()
    w.close()
    t = trace_format.load(spark, path)
    assert [tuple(r)[2:] for r in noc.payloads(t, "beat").collect()] == [(3, 7, 65535, -2, True)]
    with pytest.raises(LookupError):
        noc.payloads(t, "retry")
    assert sorted(map(tuple, noc.scope_properties(t).collect())) == [("root/mesh", "dim_x", "4"), ("root/mesh", "topology", "mesh")]


def test_handoffs_in_a_circle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(noc, "MAX_ROUNDS", 4)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    with pytest.raises(ValueError):
        noc.handoff_chains(links, spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "life long, latency long"))


def test_traces_without_counters_or_buffers(spark):
    from chronoslot.plans.trace import EVENTS_SCHEMA, OPS_SCHEMA, Schema, Trace

    t = Trace(Schema(), spark.createDataFrame([], OPS_SCHEMA), spark.createDataFrame([], EVENTS_SCHEMA))
    assert state.counter_state(t, 5).isEmpty() and state.occupancy_at(t, [], [1]).isEmpty()


NEW_FOLDER = [
    "file_ops",
    "file_segments",
    "file_strings",
    "file_events",
    "core_occupancy",
    "summary_embedded_again",
    "unfinished_file",
    "stream_counter_buckets",
    "stream_event_counts",
    "stream_lives",
    "counter_value_dispatch",
    "chosen_segments",
    "core_stage_spans",
    "file_time_range",
    "file_checkpoints",
    "stored_density_mipmap",
    "stored_counter_mipmap",
    "file_segment_cycles",
    "file_metadata",
    "file_counter_state",
    "core_counters",
    "core_instructions",
    "file_state_at",
]


@pytest.fixture
def new_folder(tmp_path, monkeypatch):
    """A shared folder as a URL, in which nothing has been written."""
    monkeypatch.setattr(work, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    monkeypatch.setattr(file_queries, "shared_dir", work.shared_dir)
    monkeypatch.setattr(file_queries, "_files", {})
    return f"{tmp_path}/shared"


@pytest.mark.parametrize("name", NEW_FOLDER)
def test_query_on_a_new_shared_folder(spark, new_folder, name):
    assert not queries.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
    assert list(Path(new_folder, "work").glob("*.trace"))


def test_file_is_written_again_once_it_is_gone(spark, new_folder):
    first = file_queries.written(spark, "/root/testdata/sf0.001")
    assert file_queries.written(spark, "/root/testdata/sf0.001") == first
    shutil.rmtree(new_folder)
    again = file_queries.written(spark, "/root/testdata/sf0.001")
    assert again != first and trace_format.TraceFile(again).segments()


def test_shared_folder_that_is_not_mounted(spark, new_folder, monkeypatch):
    monkeypatch.setattr(work, "shared_dir", lambda spark: "hdfs://store/shared")
    with pytest.raises(RuntimeError, match="mounted"):
        file_queries.written(spark, "/root/testdata/sf0.001")


def test_missing_folders_of_a_file_are_made(trace, tmp_path):
    sink.write_file(trace, str(tmp_path / "a/b/c.trace"), 2000, summary=False)
    assert trace_format.TraceFile(str(tmp_path / "a/b/c.trace")).strings() == ["nop #0", "nop #1", "nop #2"]


def test_rows_that_are_numbered_against_time(spark, trace, tmp_path):
    """A log put together from parts has later numbers at earlier times; its file is in order of time."""
    path = str(tmp_path / "parts.trace")
    ops = trace.ops.withColumn("seq", F.expr("seq - 1000000000000 * (time_ps div 3000)"))
    sink.write_file(dataclasses.replace(trace, ops=ops), path, 2000, summary=False)
    cols = ("time_ps", "storage_id", "slot", "field_index", "action", "value")
    got = trace_format.load(spark, path).ops.select(*cols)
    assert not got.isEmpty() and got.exceptAll(trace.ops.select(*cols)).isEmpty() and trace.ops.select(*cols).exceptAll(got).isEmpty()


def test_executors_encode_what_the_writer_would(spark, tmp_path, monkeypatch):
    """Byte for byte the file that TraceWriter makes call by call; no row passes through the driver's writer."""
    first, copy = tmp_path / "a.trace", tmp_path / "b.trace"
    three_instructions(first, 2000)
    t = trace_format.load(spark, str(first), whole=True)

    def by_row(*args):
        raise AssertionError("a row on the driver")

    monkeypatch.setattr(TraceWriter, "begin_cycle", by_row)
    sink.write_file(t, str(copy), 2000, summary=False)
    assert trace_format.TraceFile(str(copy)).header.num_segments == 3 and copy.read_bytes() == first.read_bytes()
    sink.write_file(t, str(copy), 2000, summary=False, finish=False)
    assert len(trace_format.TraceFile(str(copy)).segments()) == 2


def test_buffer_of_a_log_that_is_numbered_against_time(spark, tmp_path):
    """Two copies of a log at the same times, the second with higher numbers: its last operations count, as in the SQL."""
    import duckdb

    from chronoslot.plans import file_queries as Q

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n, users = ev.agg(F.max("event_id") + 1, F.max("user_id") + 1).first()
    ev.unionByName(ev.withColumns({"event_id": F.col("event_id") + n, "user_id": F.col("user_id") + users})).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, queries.QUERIES["core_occupancy"](spark, str(tmp_path)).collect())) == sorted(con.execute(Q.ORACLE_SQL["core_occupancy"]).fetchall())


@pytest.fixture(scope="module")
def log_of_parts(spark, tmp_path_factory):
    """Two copies of a log, of the same users at the same times: by the log's numbers, the second follows all of the first.

    Each begins with a user's first signup, so no life goes on from the end of one to the start of the other.
    """
    out = tmp_path_factory.mktemp("parts")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    first = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("first"))
    ev = ev.join(first, "user_id").where("event_id >= first").select(*ev.columns)
    n = ev.agg(F.max("event_id") + 1).first()[0]
    ev.unionByName(ev.withColumn("event_id", F.col("event_id") + n)).coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["core_instructions", "core_stage_spans", "stream_lives", "file_counter_state"])
def test_log_of_parts_equals_its_sql(spark, log_of_parts, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{log_of_parts}/events.parquet/*.parquet'")
    assert sorted(map(tuple, queries.QUERIES[name](spark, log_of_parts).collect())) == sorted(con.execute(file_queries.ORACLE_SQL[name]).fetchall())


def test_numbers_are_taken_over_batches():
    """A number stands behind an event's operations and before its other items, also where a batch ends between them."""
    import pyarrow as pa

    none = None
    rows = [(10, none, True), (11, none, True), (12, 7, False), (13, none, False), (14, none, True), (15, 3, False), (16, none, False)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_()))], names=["seq", "_number", "_ahead"])
    expected = [118, 119, 120, 121, 55, 56, 57]
    for size in (1, 2, 3, 5, 7):
        parts = [batch.slice(i, size) for i in range(0, len(rows), size)]
        assert [x for b in file_queries._renumber(iter(parts)) for x in b["seq"].to_pylist()] == expected


def test_items_are_read_once(spark):
    """Readings of the file do not follow the number of event types and counters; before, four for events and fifteen for counters."""
    t = trace_format.load(spark, file_queries.written(spark, "/root/testdata/sf0.001"), "core0")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BatchScan chronoslot")
    assert len(t.schema.event_types) == 4 and scans(t.events) == 2  # the second has the strings
    assert len(t.schema.counters) == 5 and scans(state.counter_state(t, 3000)) <= 3
