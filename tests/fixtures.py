"""Small traces with known answers."""

from chronoslot.plans.trace import Field, Property
from chronoslot.sources.builder import CpuSchemaBuilder, CpuWriter, TraceWriter


def three_instructions(path, interval_ps=5000, finish=True):
    """Three instructions through fetch, decode, execute and writeback; each retires in writeback."""
    b = CpuSchemaBuilder(entity_slots=16).pipeline_stages("fetch", "decode", "execute", "writeback").isa("RV64GC").fetch_width(2).commit_width(2)
    b.counter("committed_insns").buffer("rob", 8, [Field("ready", "bool")], [Property("head", "u16", "head", 0), Property("tail", "u16", "tail", 0)])
    w = TraceWriter(str(path), b.build(), b.properties, interval_ps)
    c = CpuWriter(w)
    for cycle in range(6):
        w.begin_cycle(cycle * 1000)
        for i in range(3):
            age = cycle - i
            if age == 0:
                c.fetch(i, 0x80000000 + 4 * i, 0x13)
                c.buffer_set("rob", i, i)
                c.buffer_set_property("rob", "tail", i + 1)
            if 0 <= age < 4:
                c.stage_transition(i, age)
            if age == 0:
                c.annotate(i, f"nop #{i}")
                if i == 1:
                    c.dependency(0, 1, 0)
            if age == 3:
                c.retire(i)
                c.counter_add("committed_insns", 1)
                c.buffer_clear("rob", i)
                c.buffer_set_property("rob", "head", i + 1)
        w.end_cycle()
    if finish:
        w.close()
    return w
