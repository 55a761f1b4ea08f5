import gzip
import io
import json

import pytest
from fixtures import three_instructions

from chronoslot.functions import isa
from chronoslot.operators import lifecycle, mipmap
from chronoslot.operators.counters import samples
from chronoslot.plans.service import Service, parse_range
from chronoslot.sources import konata, sink, synth, trace_format
from chronoslot.streaming import live

LOG = """Kanata\t0004
C=\t0
I\t0\t0\t0
L\t0\t0\t80000000: addi x0, x0, 0\textra
S\t0\t0\tFetch
C\t1
S\t0\t0\tDecode
I\t1\t1\t0
L\t1\t0\t80000004: addi x1, x0, 1
S\t1\t0\tFetch
S\t1\t1\tDmiss
W\t1\t0\t0
# a note
X\tbad
S\tmalformed
C\t1
E\t0\t0\tDecode
S\t0\t0\tExecute
S\t1\t0\tDecode
C\t1
R\t0\t0\t0
S\t1\t0\tExecute
C\t1
R\t1\t1\t1
"""


def test_pipeline_log(spark, tmp_path):
    path = tmp_path / "log.gz"
    path.write_bytes(gzip.compress(LOG.encode()))
    t = konata.load(spark, str(path))
    assert t.stages == ["Fetch", "Decode", "Execute"]
    rows = {r["entity_id"]: r for r in lifecycle.instructions(t).collect()}
    assert (rows[0]["status"], rows[0]["first_cycle"], rows[0]["last_cycle"]) == ("Retired", 0, 3)
    assert (rows[1]["status"], rows[1]["first_cycle"], rows[1]["last_cycle"]) == ("Flushed", 1, 4)
    assert rows[0]["pc"] == 0x80000000 and rows[0]["disasm"].startswith("80000000: addi") and rows[1]["tooltip"] == "stall:Dmiss"
    dep = lifecycle.dependencies(t).first()
    assert (dep["producer"], dep["consumer"], dep["kind"]) == (0, 1, "Data")
    scan = konata.scan(konata.with_cycles(konata.parse(konata.read(spark, str(path))))).first()
    assert (scan["instructions"], scan["last_cycle"], scan["max_in_flight"]) == (2, 4, 2)
    assert [konata.slots_for(n) for n in (0, 2, 16, 17, 100)] == [16, 16, 16, 32, 128]
    assert samples(t).count() == 1


@pytest.mark.parametrize(
    "bits,text",
    [
        (0x13, "addi zero, zero, 0"), (0xFE010113, "addi sp, sp, -32"), (0x00008067, "jalr zero, 0(ra)"), (0xFE0718E3, "bne a4, zero, -16"), (0x0080006F, "jal zero, 8"),
        (0x00053503, "ld a0, 0(a0)"), (0x40B50533, "sub a0, a0, a1"), (0x4020D093, "srai ra, ra, 2"), (0x02B50533, "mul a0, a0, a1"), (0x0000000F, "fence 0, 0"), (0x0FF0000F, "fence iorw, iorw"),
        (0x100522AF, "lr.w t0, (a0)"), (0x0C55232F, "amoswap.w.aq t1, t0, (a0)"), (0x00B57553, "fadd.s fa0, fa0, fa1, dyn"), (0x02B57553, "fadd.d fa0, fa0, fa1, dyn"), (0xE0050553, "fmv.x.w a0, fa0"),
        (0x30002573, "csrrs a0, mstatus, zero"), (0x0000100F, "fence.i"), (0x00000073, "ecall"), (0x8082, "c.jr ra"), (0x1141, "c.addi sp, -16"), (0xE406, "c.sdsp ra, 0x8(sp)"), (0x852E, "c.mv a0, a1"),
        (0x0, "0x00000000"), (0xFFFFFFFF, "0xffffffff"),
    ],
)
def test_disassembly(bits, text):
    assert isa.disassemble(bits) == text


def test_decode_table(spark):
    rows = {r["inst_bits"]: r["disasm"] for r in isa.decode(spark.createDataFrame([(0x13,), (0x13,), (None,)], "inst_bits long")).collect()}
    assert rows == {0x13: "addi zero, zero, 0", None: None}
    assert len(isa.table()) > 180 and len({x.name for x in isa.table()}) == len(isa.table())
    out = isa.label(spark.createDataFrame([(None, 16, 0x13), ("note", 16, 0x13), (None, 0, 0x13), (None, 16, 0)], "annotation string, pc long, inst_bits long"))
    assert [r["disasm_label"] for r in out.orderBy("annotation", "pc", "inst_bits").collect()] == ["addi zero, zero, 0", "0x00000010", "0x00000010 addi zero, zero, 0", "note"]


def test_synthetic(spark):
    t = synth.generate(spark, 2000, counters=3, stages=4)
    i = lifecycle.instructions(t, attributes=False)
    n = {r["status"]: r["count"] for r in i.groupBy("status").count().collect()}
    assert sum(n.values()) == 2000 and n["Retired"] > 1900
    assert t.ops.select("seq").distinct().count() == t.ops.count()
    assert mipmap.total_births(t).first()["total_instructions"] == 2000


def test_write_and_read_again(spark, tmp_path):
    t = synth.generate(spark, 200, counters=2, stages=3)
    t.schema = type(t.schema)(tuple(s if s.num_slots < 65536 else type(s)(s.storage_id, s.name, 1024, s.fields, s.sparse, s.buffer, s.scope_id, s.properties) for s in t.schema.storages), t.schema.scopes, t.schema.clocks, t.schema.enums, t.schema.event_types)
    path = str(tmp_path / "s.trace")
    sink.write_file(t, path)
    again = trace_format.load(spark, path)
    key = lambda x: sorted((r["entity_id"], r["first_cycle"], r["last_cycle"], r["status"]) for r in lifecycle.instructions(x, attributes=False).collect())
    assert key(again) == key(t)
    stored = spark.read.format("chronoslot").option("table", "counter_mipmap").load(path)
    want = mipmap.counter_pyramid(t)
    pick = lambda df: sorted((r["counter"], r["level"], r["bucket"], int(r["total"])) for r in df.collect())
    assert pick(stored) == pick(want)
    sink.write_tables(t, str(tmp_path / "tables"))
    sink.write_summary_tables(t, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/ops")).count() == t.ops.count()


def test_service(spark, tmp_path):
    path = str(tmp_path / "a.trace")
    three_instructions(path)
    s = Service(spark)
    ask = lambda method, **p: s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p}))
    assert ask("initialize")["result"]["serverInfo"]["name"] == "chronoslot"
    assert ask("notifications/initialized") is None
    assert len(ask("tools/list")["result"]["tools"]) == 8
    tool = lambda tool_name, **a: ask("tools/call", name=tool_name, arguments={"path": path, **a})["result"]
    rows = json.loads(tool("trace_instruction", entity_id=1)["content"][0]["text"])
    assert [r["stage_name"] for r in rows] and len(rows) == 4
    assert json.loads(tool("counter_values", name="committed")["content"][0]["text"])[0]["value"] == 3
    assert not tool("analyze_performance", range="0:6")["isError"]
    assert not tool("buffer_occupancy", cycle=2)["isError"]
    assert tool("counter_values", name="absent")["isError"] and tool("nothing")["isError"]
    assert s.handle("{")["error"]["code"] == -32700
    assert s.handle("{}")["error"]["code"] == -32600
    assert ask("other")["error"]["code"] == -32601
    out = io.StringIO()
    s.serve(io.StringIO('{"id": 2, "method": "initialize"}\n\n'), out)
    assert json.loads(out.getvalue())["id"] == 2
    assert parse_range("3:9") == (3, 9)
    with pytest.raises(ValueError):
        parse_range("3-9")


def test_streams(spark, tmp_path):
    path = str(tmp_path / "a.trace")
    three_instructions(path, 1000)
    f = trace_format.TraceFile(path)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(live.counter_buckets(live.items(spark, path), f.schema, 1000, base=4), "buckets", "complete")
    assert sorted((r["bucket"], r["total"]) for r in got) == [(0, 1), (1, 2)]
    got = run(live.lives(live.items(spark, path), f.schema, 1000), "lives", "append")
    assert sorted((r["entity_id"], r["born_cycle"], r["died_cycle"]) for r in got) == [(0, 0, 3), (1, 1, 4), (2, 2, 5)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from chronoslot.__main__ import main, show

    path = str(tmp_path / "a.trace")
    three_instructions(path)
    assert main([]) == 2
    assert main(["trace_instruction", path, "entity_id=0", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out.strip().splitlines()[-1])) == 4
    assert main(["trace_instruction", path, "entity_id=77"]) == 1
    text = show([{"a": i} for i in range(1001)]).splitlines()
    assert len(text) < 260 and text[-1] == "1000"
