"""Multi-resolution summaries: buckets of 1024 cycles, and levels that join four buckets each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trace import SET, Trace
from .counters import SCALE, adds

BASE = 1024
FAN_OUT = 4


def births(trace: Trace) -> DataFrame:
    store = trace.schema.entities
    if store is None:
        return trace.ops.limit(0).select("trace_id", "cycle")
    return trace.on(store, SET).where(F.col("field_index") == store.field_index("entity_id")).select("trace_id", "cycle")


def extent(trace: Trace, base: int = BASE) -> DataFrame:
    """trace_id, buckets: 1 + the bucket of the last counter operation or birth; at least 1."""
    both = adds(trace).select("trace_id", "cycle").unionByName(births(trace))
    return both.groupBy("trace_id").agg((F.expr(f"max(cycle) div {base}") + 1).alias("buckets"))


def _dense(found: DataFrame, keys: list[str], ext: DataFrame, zeros: list[str]) -> DataFrame:
    every = found.select("trace_id", *keys).distinct().join(ext, "trace_id") if keys else ext
    every = every.select("trace_id", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    out = every.join(found, ["trace_id", *keys, "bucket"], "left")
    return out.select("trace_id", *keys, "bucket", *[F.coalesce(z, F.lit(0)).cast("long").alias(z) for z in zeros])


def counter_level0(trace: Trace, base: int = BASE, per_cycle: bool = False) -> DataFrame:
    """counter, bucket, lo, hi, total over single ADDs; empty buckets are zeros up to the trace's extent.

    With ``per_cycle`` the ADDs of a cycle count together and cycles that add 0 are skipped.
    """
    a = adds(trace)
    if per_cycle:
        a = a.groupBy("trace_id", "counter", "cycle").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    found = a.groupBy("trace_id", "counter", F.expr(f"cycle div {base}").alias("bucket")).agg(F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.sum("delta").alias("total"))
    return _dense(found, ["counter"], extent(trace, base), ["lo", "hi", "total"])


def density_level0(trace: Trace, base: int = BASE) -> DataFrame:
    """bucket, births: entities born in each bucket."""
    found = births(trace).groupBy("trace_id", F.expr(f"cycle div {base}").alias("bucket")).agg(F.count("*").alias("births"))
    return _dense(found, [], extent(trace, base), ["births"])


def levels_above(buckets: int, fan_out: int = FAN_OUT) -> int:
    n = 0
    while buckets > 1:
        buckets, n = -(-buckets // fan_out), n + 1
    return n


def pyramid(level0: DataFrame, keys: list[str], aggs: dict[str, str], fan_out: int = FAN_OUT) -> DataFrame:
    """``level0`` and every level above it, with column level, until a level has one bucket.

    All levels come from one grouping over an exploded level number: a bucket of
    level n holds fan_out ** n of level 0, and the extremes of extremes are the
    extremes. The number of levels grows with the logarithm of the extent.
    """
    top = level0.agg(F.max("bucket")).first()[0]
    n = levels_above((top or 0) + 1, fan_out)
    level = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("level")
    powers = F.array(*[F.lit(fan_out**i).cast("long") for i in range(n + 1)])
    spread = level0.select("*", level).withColumn("bucket", F.floor(F.col("bucket") / powers[F.col("level")]).cast("long"))
    return spread.groupBy("trace_id", *keys, "level", "bucket").agg(*[getattr(F, f)(c).alias(c) for c, f in aggs.items()])


def counter_pyramid(trace: Trace, base: int = BASE) -> DataFrame:
    return pyramid(counter_level0(trace, base), ["counter"], {"lo": "min", "hi": "max", "total": "sum"})


def density_pyramid(trace: Trace, base: int = BASE) -> DataFrame:
    return pyramid(density_level0(trace, base), [], {"births": "sum"})


def total_births(trace: Trace) -> DataFrame:
    return births(trace).groupBy("trace_id").agg(F.count("*").alias("total_instructions"))


def _prefix(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    from .lifecycle import running

    return running(df, value, "upto", keys=("trace_id", *keys), at="bucket").withColumn("before", F.col("upto") - F.col(value))


def row_to_cycle(density: DataFrame, rows: DataFrame, base: int = BASE) -> DataFrame:
    """row, cycle: start of the first bucket in which more rows than ``row`` have been born; past the end, the end.

    ``rows`` is a table of asked rows; each meets only the one bucket that holds it.
    """
    p = _prefix(density, "births")
    ends = density.groupBy("trace_id").agg((F.max("bucket") + 1).alias("n"))
    asked = rows.select(F.col("row").cast("long").alias("row")).distinct().crossJoin(F.broadcast(ends))
    marks = p.where("births > 0").select("trace_id", F.col("before").alias("at"), F.lit(0).alias("is_row"), "bucket", "upto").unionByName(asked.select("trace_id", F.col("row").alias("at"), F.lit(1).alias("is_row"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("upto")))
    w = Window.partitionBy("trace_id").orderBy("at", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("b", F.last(F.when(F.col("is_row") == 0, F.struct("bucket", "upto")), ignorenulls=True).over(w)).where("is_row = 1")
    out = held.join(F.broadcast(ends), "trace_id")
    return out.select("trace_id", F.col("at").alias("row"), (F.when(F.col("b.upto") > F.col("at"), F.col("b.bucket")).otherwise(F.col("n")) * base).alias("cycle"))


def cycle_to_row(density: DataFrame, cycles: DataFrame, base: int = BASE) -> DataFrame:
    """cycle, row: births before the cycle's bucket plus its share of the bucket's, cut to a whole number; past the end, all."""
    p = _prefix(density, "births")
    total = density.groupBy("trace_id").agg(F.sum("births").alias("total"))
    asked = cycles.select(F.col("cycle").cast("long").alias("cycle")).distinct().withColumn("bucket", F.expr(f"cycle div {base}"))
    out = asked.crossJoin(F.broadcast(total)).join(p.select("trace_id", "bucket", "before", "births"), ["trace_id", "bucket"], "left")
    return out.select("trace_id", "cycle", F.coalesce(F.col("before") + F.expr(f"births * (cycle % {base}) div {base}"), "total").cast("long").alias("row"))


def value_interpolated(level0: DataFrame, cycles: DataFrame, base: int = BASE) -> DataFrame:
    """counter, cycle, value: sum of the buckets before, and the share of the cycle's own, cut to a whole number."""
    p = _prefix(level0, "total", ("counter",))
    totals = level0.groupBy("trace_id", "counter").agg(F.sum("total").alias("all"))
    asked = cycles.select(F.col("cycle").cast("long").alias("cycle")).distinct().withColumn("bucket", F.expr(f"cycle div {base}"))
    out = asked.crossJoin(F.broadcast(totals)).join(p.select("trace_id", "counter", "bucket", "before", "total"), ["trace_id", "counter", "bucket"], "left")
    return out.select("trace_id", "counter", "cycle", F.coalesce(F.col("before") + F.expr(f"total * (cycle % {base}) div {base}"), "all").cast("long").alias("value"))


def downsample(trace: Trace, start: int, end: int, buckets: int, base: int = BASE) -> DataFrame:
    """counter, bucket, lo, hi from the coarsest level whose interval is no wider than a bucket: overlap-weighted rate times the interval; lo = hi.

    Buckets beyond the data are 0, as is everything where the range is empty.
    """
    names = adds(trace).select("trace_id", "counter").distinct()
    spark = trace.ops.sparkSession
    if buckets <= 0 or end <= start:
        return names.limit(0).select("trace_id", "counter", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    width = (end - start) / buckets
    level = max(0, int(math.log(max(width, 1) / base, FAN_OUT) + 1e-9)) if width >= base else 0
    interval = base * FAN_OUT**level
    rows = counter_level0(trace, base).groupBy("trace_id", "counter", F.expr(f"bucket div {FAN_OUT**level}").alias("b")).agg(F.sum("total").alias("total"))
    rows = rows.withColumn("s", F.col("b") * interval).withColumn("e", F.col("s") + interval).where((F.col("s") < end) & (F.col("e") > start))
    guess = lambda c: F.floor((c - F.lit(start)) / F.lit(width)).cast("int")
    listed = rows.select("*", F.explode(F.sequence(F.greatest(guess(F.col("s")), F.lit(0)), F.least(guess(F.col("e")), F.lit(buckets - 1)))).alias("bucket"))
    lo, hi = F.lit(start) + F.col("bucket") * F.lit(width), F.lit(start) + (F.col("bucket") + 1) * F.lit(width)
    overlap = F.least(hi, F.col("e").cast("double")) - F.greatest(lo, F.col("s").cast("double"))
    found = listed.withColumn("o", overlap).where("o > 0").groupBy("trace_id", "counter", "bucket").agg((F.sum(F.col("total") * F.col("o")) / F.sum("o")).alias("v"))
    every = names.crossJoin(F.broadcast(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))))
    v = F.floor(F.round(F.coalesce("v", F.lit(0.0)), 6)).cast("long")
    return every.join(found, ["trace_id", "counter", "bucket"], "left").select("trace_id", "counter", "bucket", v.alias("lo"), v.alias("hi"))


def metrics(trace: Trace, base: int = BASE) -> DataFrame:
    """Summary metrics by bucket: committed, flushes, and the valid slots of each buffer at the bucket's end."""
    from .lifecycle import FLUSHED, IN_FLIGHT, RETIRED, instructions
    from .state import occupancy_series

    i = instructions(trace, attributes=False).where(F.col("status") != IN_FLIGHT)
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    ended = i.groupBy("trace_id", F.expr(f"last_cycle div {base}").alias("bucket")).agg(count(RETIRED).alias("committed"), count(FLUSHED).alias("flushes"))
    out = ended.select("trace_id", "bucket", F.explode(F.array(F.struct(F.lit("committed").alias("metric"), F.col("committed").alias("value")), F.struct(F.lit("flushes").alias("metric"), F.col("flushes").alias("value")))).alias("x")).select("trace_id", "bucket", "x.metric", F.col("x.value").cast("long").alias("value"))
    for b in trace.schema.buffers:
        occ = occupancy_series(trace, b).groupBy("trace_id", F.expr(f"cycle div {base}").alias("bucket")).agg(F.max_by("occupied", "cycle").alias("value"))
        out = out.unionByName(occ.select("trace_id", "bucket", F.lit(f"{b.name}_occ").alias("metric"), "value"))
    return out


__all__ = ["BASE", "FAN_OUT", "SCALE", "counter_level0", "counter_pyramid", "density_level0", "density_pyramid"]
