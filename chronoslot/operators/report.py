"""Windowed performance reports over lifecycles and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trace import Trace
from ..plans.work import save
from .buffers import snapshots
from .counters import range_summary
from .lifecycle import FLUSHED, IN_FLIGHT, RETIRED, instructions, stage_spans


def _window(start: int, end: int) -> None:
    if start >= end:
        raise ValueError(f"empty window [{start}, {end})")


def born_in(rows: DataFrame, start: int, end: int) -> DataFrame:
    return rows.where((F.col("first_cycle") >= start) & (F.col("first_cycle") < end))


def summary(trace: Trace, start: int, end: int) -> DataFrame:
    """total, retired, flushed, in_flight, ipc, flush_rate of entities born in [start, end)."""
    _window(start, end)
    i = born_in(instructions(trace, attributes=False), start, end)
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = i.agg(F.count("*").alias("total"), count(RETIRED).alias("retired"), count(FLUSHED).alias("flushed"), count(IN_FLIGHT).alias("in_flight"))
    rate = F.when(F.col("total") > 0, F.col("flushed") / F.col("total")).otherwise(0.0)
    return out.select("*", (F.col("retired") / F.lit(float(end - start))).alias("ipc"), rate.alias("flush_rate"))


def stage_latency(trace: Trace, start: int, end: int) -> DataFrame:
    """stage_name, total_cycles, n, avg_cycles of entities born in the window; slowest first, then by name."""
    _window(start, end)
    s = stage_spans(trace).where((F.col("birth_cycle") >= start) & (F.col("birth_cycle") < end))
    return s.groupBy("stage_name").agg(F.sum("duration").alias("total_cycles"), F.count("*").alias("n"), F.avg("duration").alias("avg_cycles")).orderBy(F.desc("avg_cycles"), "stage_name")


def performance(trace: Trace, start: int, end: int) -> DataFrame:
    """section, name, metric, value: the whole report as one long table."""
    _window(start, end)
    parts = []

    def add(df: DataFrame, section: str, name: str | None, metrics: list[str]) -> None:
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
        parts.append(df.select(F.lit(section).alias("section"), (F.col(name) if name else F.lit("")).alias("name"), cells).select("section", "name", "x.metric", "x.value"))

    add(summary(trace, start, end), "summary", None, ["total", "retired", "flushed", "in_flight", "ipc", "flush_rate"])
    add(stage_latency(trace, start, end), "stage", "stage_name", ["total_cycles", "n", "avg_cycles"])
    add(range_summary(trace, start, end), "counter", "counter", ["start_value", "end_value", "delta", "rate"])
    if trace.schema.buffers:
        snap = snapshots(trace, start, end).withColumn("name", F.concat_ws("@", "buffer", "at_cycle"))
        add(snap, "buffer", "name", ["occupied", "capacity"])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_info(trace: Trace) -> DataFrame:
    """section, key, value rows on the header, properties, clocks, scopes, storages, enums and events."""
    s, rows = trace.schema, []
    rows += [("header", k, str(v)) for k, v in sorted(trace.header.items())]
    rows += [("property", k, v) for k, v in sorted(trace.properties.items())]
    rows += [("clock", name, f"{1_000_000 / period:.1f} MHz" if period else "unknown") for name, period in s.clocks]
    rows += [("scope", s.scope_path(x.scope_id), x.protocol or "") for x in s.scopes]
    rows += [("pipeline", str(i), n) for i, n in enumerate(trace.stages)]
    for x in s.storages:
        kind = "buffer" if x.buffer else "counter" if s.is_counter(x) else "sparse" if x.sparse else "dense"
        rows.append(("storage", x.name, f"{kind}, {x.num_slots} slots: " + ", ".join(f"{f.name} {f.type}" for f in x.fields)))
        rows += [("storage_property", f"{x.name}.{p.name}", f"{p.type} {p.role} pair {p.pair_id}") for p in x.properties]
    rows += [("enum", f"{n}.{v}", label) for n, values in s.enums for v, label in sorted(values.items())]
    rows += [("event", e.name, ", ".join(f"{f.name} {f.type}" for f in e.fields)) for e in s.event_types]
    return trace.ops.sparkSession.createDataFrame(rows or [("", "", "")], "section string, key string, value string").where("section <> ''")


def sampled(df: DataFrame, order: list[str], rows: int = 200) -> DataFrame:
    """Every n-th row in order and the last, so that about ``rows`` are shown.

    Rows are dealt by ranges of ``order`` and numbered within them; only the counts of the ranges meet in one task.
    """
    placed = save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "sampled")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    n = placed.count()
    step = max(1, n // rows)
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = placed.withColumn("_n", at).join(F.broadcast(starts), "_range").withColumn("_n", F.col("_n") + F.col("_before"))
    return numbered.where((F.col("_n") % step == 0) | (F.col("_n") == n - 1)).select(*df.columns)
