"""Pipeline text logs (tab-separated commands) as traces.

Commands: ``C=`` sets the cycle, ``C`` advances it; ``I`` begins an instruction,
``L`` labels it, ``S`` and ``E`` begin and end a stage, ``R`` retires (0) or
flushes it, ``W`` is a dependency. Lines of other commands, comments, blank and
malformed lines are skipped. gzip is read by suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.trace import EventType, Field, Schema, Scope, Storage, Trace

#: Fields that a command needs after its name.
ARITY = {"C=": 1, "C": 1, "I": 3, "L": 3, "S": 3, "E": 3, "R": 3, "W": 3}
#: Lines of a block of the two-level sums.
BLOCK = 1 << 16
PER_LINE = 8
MIN_SLOTS = 16


def read(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a log. A line's number is made of its file's place and its own, so it increases within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """line_no, cmd, a, b, c; the last keeps the rest of the line, tabs included."""
    p = F.split(F.rtrim("value"), "\t", 4)
    get = lambda i: F.get(p, F.lit(i))
    cmd = F.trim(get(0))
    need = F.element_at(F.create_map(*[F.lit(x) for kv in ARITY.items() for x in kv]), cmd)
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("line_no", cmd.alias("cmd"), get(1).alias("a"), get(2).alias("b"), get(3).alias("c"), need.alias("_need"), F.size(p).alias("_n"))
    number = lambda c: F.col(c).rlike(r"^\s*-?\d{1,18}\s*$")
    whole = number("a") & ((F.col("_need") < 2) | number("b") | F.col("cmd").isin("L")) & (F.col("cmd") != "R") | (F.col("cmd") == "R") & number("a") & F.regexp_replace("c", "[^0-9-]", "").rlike(r"^-?\d+$")
    return rows.where(F.col("_need").isNotNull() & (F.col("_n") > F.col("_need")) & whole).drop("_need", "_n")


def with_cycles(rows: DataFrame) -> DataFrame:
    """``rows`` with the cycle at each line: the last ``C=`` before it and the ``C`` since. Sums are two-level by blocks of lines."""
    a = F.col("a").cast("long")
    rows = rows.withColumn("_set", F.when(F.col("cmd") == "C=", a)).withColumn("_step", F.when(F.col("cmd") == "C", a).otherwise(0)).withColumn("_block", F.expr(f"line_no div {BLOCK}"))
    inside = Window.partitionBy("_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_step").over(inside)).withColumn("_base", F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_sum")), ignorenulls=True).over(inside))
    ends = rows.groupBy("_block").agg(F.sum("_step").alias("t"), F.max_by("_base", "line_no").alias("base"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lines
    ends = ends.withColumn("upto", F.sum("t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("mark", F.when(F.col("base").isNotNull(), F.struct(F.col("base._set").alias("s"), (F.col("upto") - F.col("t") + F.col("base._sum")).alias("at"))))
    ends = ends.select("_block", (F.col("upto") - F.col("t")).alias("_before"), F.last("mark", ignorenulls=True).over(before).alias("_mark"))
    out = rows.join(ends, "_block")
    carried = F.coalesce(F.col("_mark.s"), F.lit(0)) + F.col("_before") + F.col("_sum") - F.coalesce(F.col("_mark.at"), F.lit(0))
    cycle = F.when(F.col("_base").isNotNull(), F.col("_base._set") + F.col("_sum") - F.col("_base._sum")).otherwise(carried)
    return out.withColumn("cycle", cycle).drop("_set", "_step", "_block", "_sum", "_base", "_before", "_mark")


def pc_of(text: F.Column) -> F.Column:
    """The address that begins a label: its first word without ``0x`` and ``:``, four hex digits or more; else 0."""
    word = F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9A-Fa-f]{4,16}):?(?:\s|$)", 1)
    return F.when(word != "", F.conv(word, 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def stage_names(rows: DataFrame) -> list[str]:
    """Stages of lane 0 in the order in which they are first seen; as many as the log has names for."""
    s = rows.where("cmd = 'S' and trim(b) = '0'").groupBy(F.trim("c").alias("stage")).agg(F.min("line_no").alias("first"))
    return [r["stage"] for r in s.orderBy("first").collect()]


def scan(rows: DataFrame) -> DataFrame:
    """instructions, threads, last_cycle, max_in_flight of parsed rows with cycles."""
    steps = rows.where("cmd in ('I', 'R')").groupBy(F.col("line_no")).agg(F.max(F.when(F.col("cmd") == "I", 1).otherwise(-1)).alias("step"), F.lit("").alias("trace_id"))
    from ..operators.lifecycle import running

    flight = running(steps, "step", "n", at="line_no").agg(F.max("n").alias("max_in_flight"))
    whole = rows.agg(F.count(F.when(F.col("cmd") == "I", 1)).alias("instructions"), F.countDistinct(F.when(F.col("cmd") == "I", F.trim("c"))).alias("threads"), F.max("cycle").alias("last_cycle"))
    return whole.crossJoin(flight)


def slots_for(max_in_flight: int) -> int:
    """The next power of two, 16 at least."""
    return max(MIN_SLOTS, 1 << max(0, int(max_in_flight) - 1).bit_length())


def to_trace(rows: DataFrame, period_ps: int = 1000, trace_id: str = "log") -> Trace:
    """Parsed rows with cycles as a trace. Ids do not wrap: an instruction's slot is its id."""
    stages = stage_names(rows)
    schema = Schema(
        storages=(
            Storage(0, "entities", 1 << 40, (Field("entity_id", "u32"), Field("pc", "u64"), Field("inst_bits", "u32")), sparse=True, scope_id=1),
            Storage(1, "committed_insns", 1, (Field("count", "u64"),), scope_id=1),
        ),
        scopes=(Scope(0, "root"), Scope(1, "core0", 0, "cpu", 0)),
        clocks=(("core_clk", period_ps),),
        enums=(("pipeline_stage", dict(enumerate(stages))),),
        event_types=tuple(EventType(i, n) for i, n in enumerate(("stage_transition", "annotate", "dependency", "flush", "stall"))),
    )
    cmd, ident = F.col("cmd"), F.col("a").cast("long")
    zero = F.lit(0).cast("decimal(20,0)")
    base = [F.lit(trace_id).alias("trace_id"), F.lit(0).alias("seg_id")]

    def op(at: int, storage: int, slot: F.Column, field: F.Column, action: str, value: F.Column) -> F.Column:
        return F.struct(F.lit(at).alias("at"), F.lit(storage).alias("storage_id"), slot.cast("long").alias("slot"), field.cast("int").alias("field_index"), F.lit(action).alias("action"), value.cast("decimal(20,0)").alias("value"))

    none = F.lit(None).cast("int")
    retired = (cmd == "R") & (F.trim("c") == "0")
    pc = pc_of(F.col("c"))
    ops = F.when(cmd == "I", F.array(op(0, 0, ident, F.lit(0), "set", ident), op(1, 0, ident, F.lit(1), "set", zero), op(2, 0, ident, F.lit(2), "set", zero)))
    ops = ops.when((cmd == "L") & (F.trim("b") == "0") & (pc != 0), F.array(op(0, 0, ident, F.lit(1), "set", pc)))
    ops = ops.when(retired, F.array(op(1, 0, ident, none, "clear", zero), op(2, 1, F.lit(0), F.lit(0), "add", F.lit(1))))
    at = lambda k: (F.col("line_no") * PER_LINE + k).alias("seq")
    when = [(F.col("cycle") * period_ps).alias("time_ps"), F.col("cycle")]
    op_rows = rows.select("*", F.explode(ops).alias("o")).select(*base, at(F.col("o.at")), *when, "o.storage_id", "o.slot", "o.field_index", "o.action", "o.value")
    code = F.lit(None).cast("long")
    for i, n in enumerate(stages):
        code = F.when(F.trim("c") == n, F.lit(i).cast("long")).otherwise(code)
    lane0 = F.trim("b") == "0"
    event = F.when(cmd == "L", "annotate").when((cmd == "S") & lane0, "stage_transition").when(cmd == "S", "annotate").when((cmd == "R") & ~retired, "flush").when(cmd == "W", "dependency")
    text = F.when(cmd == "L", F.col("c")).when((cmd == "S") & ~lane0, F.concat(F.lit("stall:"), F.trim("c")))
    arg = F.when((cmd == "S") & lane0, code).when(cmd == "W", ident).when(cmd == "R", F.lit(0).cast("long"))
    # W names the consumer first
    who = F.when(cmd == "W", F.col("b").cast("long")).otherwise(ident)
    ev = rows.where(event.isNotNull()).select(*base, at(F.lit(4)), *when, event.alias("event"), who.alias("entity_id"), arg.alias("arg"), F.when(cmd == "W", F.lit(0).cast("long")).alias("arg2"), text.alias("text"))
    return Trace(schema, op_rows, ev, stages=stages, period_ps=period_ps, properties={"cpu.pipeline_stages": ",".join(stages)})


def load(spark: SparkSession, path: str, period_ps: int = 1000) -> Trace:
    return to_trace(with_cycles(parse(read(spark, path))), period_ps, path)
