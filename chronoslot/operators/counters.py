"""Counters as time series: samples, as-of values, rates, deltas, downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trace import ADD, Trace

#: Blocks of the two-level prefix sum: a counter with many samples is no single task's.
BLOCK = 1 << 16
WRAP = 1 << 64
#: The largest downsampled rate.
SCALE = 1_000_000
#: Points of a sampled series.
SERIES_POINTS = 1000


def adds(trace: Trace) -> DataFrame:
    """trace_id, counter, seq, cycle, delta of every ADD on a counter."""
    names = {s.storage_id: s.name for s in trace.schema.counters}
    if not names:
        return trace.ops.limit(0).select("trace_id", F.lit("").alias("counter"), "seq", "cycle", F.lit(0).cast("long").alias("delta"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("storage_id"))
    return trace.ops.where((F.col("action") == ADD) & F.col("storage_id").isin(*names) & (F.col("slot") == 0)).select("trace_id", label.alias("counter"), "seq", "cycle", F.col("value").cast("long").alias("delta"))


def samples(trace: Trace, wrap: bool = False) -> DataFrame:
    """trace_id, counter, seq, cycle, delta, cum: the running sum after each ADD, over the whole trace.

    With ``wrap`` the sum is a decimal modulo 2**64; without, a long that must stay below 2**63.
    """
    a = adds(trace).withColumn("_block", F.expr(f"seq div {BLOCK}"))
    sums = a.groupBy("trace_id", "counter", "_block").agg(F.sum("delta").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("trace_id", "counter").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("trace_id", "counter", "_block", before.alias("_before"))
    w = Window.partitionBy("trace_id", "counter", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = a.withColumn("_in", F.sum("delta").over(w)).join(sums, ["trace_id", "counter", "_block"])
    cum = F.pmod(F.col("_before").cast("decimal(38,0)") + F.col("_in").cast("decimal(38,0)"), F.lit(str(WRAP)).cast("decimal(38,0)")).cast("decimal(20,0)") if wrap else F.col("_before") + F.col("_in")
    return out.select("trace_id", "counter", "seq", "cycle", "delta", cum.alias("cum"))


def with_terminal(trace: Trace, max_cycle: int) -> DataFrame:
    """Samples and, for a counter whose last sample is before ``max_cycle``, one that repeats its total there."""
    s = samples(trace)
    last = s.groupBy("trace_id", "counter").agg(F.max("cycle").alias("c"), F.max_by("cum", "seq").alias("cum"), F.max("seq").alias("seq")).where(F.col("c") < max_cycle)
    return s.unionByName(last.select("trace_id", "counter", "seq", F.lit(max_cycle).cast("long").alias("cycle"), F.lit(0).cast("long").alias("delta"), "cum"))


def value_at(trace: Trace, cycle: int) -> DataFrame:
    """counter, value: the sum of what was added up to a cycle; 0 before the first ADD. A filter and a partial sum, no sort."""
    return adds(trace).groupBy("trace_id", "counter").agg(F.coalesce(F.sum(F.when(F.col("cycle") <= cycle, F.col("delta"))), F.lit(0)).cast("long").alias("value"))


def value_at_many(trace: Trace, points: DataFrame, at: str = "cycle") -> DataFrame:
    """As-of join: counter and value at each of ``points``, by a union and a two-level running sum."""
    a = adds(trace).groupBy("trace_id", "counter", "cycle").agg(F.sum("delta").alias("step"))
    names = a.select("trace_id", "counter").distinct()  # a row for each counter
    asked = points.select(F.col(at).cast("long").alias("cycle")).distinct().crossJoin(F.broadcast(names)).select("trace_id", "counter", "cycle", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked"))
    both = a.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("trace_id", "counter", "cycle").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    from .lifecycle import running

    return running(both, "step", "value", BLOCK, ("trace_id", "counter")).where("asked").select("trace_id", "counter", "cycle", "value")


def rate_at(trace: Trace, cycle: int, window: int) -> DataFrame:
    """(v(c) - v(c - w)) / min(w, c); 0.0 for an empty window."""
    span = min(window, cycle)
    inside = (F.col("cycle") <= cycle) & (F.col("cycle") > cycle - span)
    total = F.coalesce(F.sum(F.when(inside, F.col("delta"))), F.lit(0))
    rate = total / F.lit(float(span)) if span > 0 else F.lit(0.0)
    return adds(trace).groupBy("trace_id", "counter").agg(rate.cast("double").alias("rate"))


def rates(trace: Trace, window: int) -> DataFrame:
    """Trailing rate at each cycle with an ADD: what was added in the last ``window`` cycles over min(window, cycle)."""
    per = adds(trace).groupBy("trace_id", "counter", "cycle").agg(F.sum("delta").alias("step"))
    w = Window.partitionBy("trace_id", "counter").orderBy("cycle").rangeBetween(-(window - 1), 0)
    span = F.least(F.lit(window), F.col("cycle"))
    return per.withColumn("rate", F.when(span > 0, F.sum("step").over(w) / span).otherwise(0.0)).select("trace_id", "counter", "cycle", "rate")


TOTAL, RATE, DELTA = "total", "rate", "delta"


def stored_value_at(mipmap: DataFrame, cycle: int, base: int = 1024) -> DataFrame:
    """trace_id, counter, value from a stored summary (trace_id, counter, level, bucket, total): buckets before, and the share of the cycle's own."""
    part = F.when(F.col("bucket") < cycle // base, F.col("total")).when(F.col("bucket") == cycle // base, F.floor(F.col("total") * (cycle % base) / base)).otherwise(0)
    return mipmap.where("level = 0").groupBy("trace_id", "counter").agg(F.sum(part).cast("long").alias("value"))


def best_value_at(trace: Trace, cycle: int, mipmap: DataFrame | None = None, base: int = 1024) -> DataFrame:
    """counter, value, source: from the samples where a counter has any, else from a stored summary, else 0."""
    own = value_at(trace, cycle).withColumn("rank", F.lit(0)).withColumn("source", F.lit("samples"))
    every = trace.ops.sparkSession.createDataFrame([(s.name,) for s in trace.schema.counters], "counter string")
    if mipmap is not None:
        own = own.unionByName(stored_value_at(mipmap, cycle, base).withColumn("rank", F.lit(1)).withColumn("source", F.lit("summary")))
    first = own.groupBy("counter").agg(F.min(F.struct("rank", "source", "value")).alias("v"))
    return every.join(first, "counter", "left").select("counter", F.coalesce("v.value", F.lit(0)).alias("value"), F.coalesce("v.source", F.lit("none")).alias("source"))


def shown(trace: Trace, cycle: int, mode: str = TOTAL, window: int = 1000) -> DataFrame:
    """counter, mode, value double at a cycle: the total, the rate over the last ``window`` cycles, or the cycle's own change."""
    if mode not in (TOTAL, RATE, DELTA):
        raise ValueError(f"no display mode {mode!r}")
    df = value_at(trace, cycle) if mode == TOTAL else rate_at(trace, cycle, window).withColumnRenamed("rate", "value") if mode == RATE else delta_at(trace, cycle).withColumnRenamed("delta", "value")
    return df.select("counter", F.lit(mode).alias("mode"), F.col("value").cast("double").alias("value"))


def delta_at(trace: Trace, cycle: int) -> DataFrame:
    """v(c) - v(c - 1); at cycle 0 the value itself: what was added in the cycle."""
    return adds(trace).groupBy("trace_id", "counter").agg(F.coalesce(F.sum(F.when(F.col("cycle") == cycle, F.col("delta"))), F.lit(0)).cast("long").alias("delta"))


def sparse_delta(trace: Trace) -> DataFrame:
    """counter, from_cycle, to_cycle, per_cycle: average growth between neighbouring sampled cycles, by integer division.

    The first interval starts at cycle 0; it and the last value after it are what
    a delta query between samples reads.
    """
    per = adds(trace).groupBy("trace_id", "counter", "cycle").agg(F.sum("delta").alias("step"))
    before = F.coalesce(F.lag("cycle").over(Window.partitionBy("trace_id", "counter").orderBy("cycle")), F.lit(0))
    out = per.withColumn("from_cycle", before)
    return out.select("trace_id", "counter", "from_cycle", F.col("cycle").alias("to_cycle"), F.when(F.col("cycle") > F.col("from_cycle"), F.expr("step div (cycle - from_cycle)")).otherwise(F.col("step")).alias("per_cycle"))


def sparse_delta_at(samples_: DataFrame, cycle: int) -> DataFrame:
    """Sparse delta of (counter, cycle, cum) samples at one cycle: growth of the interval that holds it, a cycle; 0 after the last."""
    w = Window.partitionBy("counter").orderBy("cycle")
    pairs = samples_.withColumn("p_cycle", F.lag("cycle").over(w)).withColumn("p_cum", F.lag("cum").over(w))
    hit = (F.col("cycle") >= cycle) & (F.col("p_cycle").isNull() | (F.col("p_cycle") < cycle))
    own = F.when(F.col("p_cycle").isNull(), F.when(F.col("cycle") > 0, F.expr("cum div nullif(cycle, 0)")).otherwise(F.col("cum"))).otherwise(F.expr("(cum - p_cum) div nullif(cycle - p_cycle, 0)"))
    return pairs.groupBy("counter").agg(F.coalesce(F.max(F.when(hit, own)), F.lit(0)).alias("delta"))


def range_summary(trace: Trace, start: int, end: int) -> DataFrame:
    """counter, start_value, end_value, delta, rate over [start, end]."""
    upto = lambda c: F.coalesce(F.sum(F.when(F.col("cycle") <= c, F.col("delta"))), F.lit(0)).cast("long")
    out = adds(trace).groupBy("trace_id", "counter").agg(upto(start).alias("start_value"), upto(end).alias("end_value"))
    delta = F.col("end_value") - F.col("start_value")
    rate = delta / F.lit(float(end - start)) if end > start else F.lit(0.0)
    return out.select("trace_id", "counter", "start_value", "end_value", delta.alias("delta"), rate.cast("double").alias("rate"))


def latest(trace: Trace) -> DataFrame:
    return adds(trace).groupBy("trace_id", "counter").agg(F.sum("delta").alias("value"))


def named(df: DataFrame, part: str) -> DataFrame:
    """Counters whose name contains ``part``, case-sensitive; none raises."""
    out = df.where(F.col("counter").contains(part))
    if out.isEmpty():
        raise LookupError(f"no counter has {part!r} in its name")
    return out


def series(trace: Trace, start: int, end: int, step: int | None = None) -> DataFrame:
    """Values from ``start`` to ``end``. Without ``step`` every cycle, or about SERIES_POINTS of them; the end is always one."""
    if end < start:
        raise ValueError("end is before start")
    step = step or max(1, (end - start) // SERIES_POINTS)
    spark = trace.ops.sparkSession
    points = spark.range(start, end + 1, step).select(F.col("id").alias("cycle")).unionByName(spark.range(end, end + 1).select(F.col("id").alias("cycle")))
    return value_at_many(trace, points)


def downsample(trace: Trace, start: int, end: int, buckets: int) -> DataFrame:
    """counter, bucket, lo, hi: smallest and largest rate among the intervals that overlap each bucket, scaled to a global maximum of SCALE.

    Intervals join neighbouring samples; before the first sample the rate is 0,
    after the last there is nothing. Two samples in one cycle make an interval
    without width and with rate 0, which belongs to the bucket that holds it inside.
    Bucket edges are whole cycles. Each interval is listed under the buckets it
    overlaps, so no pair of interval and bucket is tried in vain.
    """
    spark = trace.ops.sparkSession
    names = adds(trace).select("trace_id", "counter").distinct()
    if buckets <= 0 or end <= start:
        return names.limit(0).select("trace_id", "counter", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    w = Window.partitionBy("trace_id", "counter").orderBy("seq")
    s = samples(trace).withColumn("from_cycle", F.coalesce(F.lag("cycle").over(w), F.lit(0))).withColumn("first", F.lag("seq").over(w).isNull())
    width = F.col("cycle") - F.col("from_cycle")
    rate = F.when(F.col("first") | (width == 0), 0.0).otherwise(F.col("delta") / width)
    spans = s.withColumn("rate", rate).where((F.col("from_cycle") < end) & (F.col("cycle") > start))
    edge = lambda b: F.floor(F.lit(start) + b * F.lit((end - start) / buckets)).cast("long")
    guess = lambda c: F.floor((c - F.lit(start)) / F.lit((end - start) / buckets)).cast("int")
    b = F.explode(F.sequence(F.greatest(guess(F.col("from_cycle")) - 1, F.lit(0)), F.least(guess(F.col("cycle")) + 1, F.lit(buckets - 1)))).alias("bucket")
    listed = spans.select("trace_id", "counter", "from_cycle", "cycle", "rate", b).where((F.col("from_cycle") < edge(F.col("bucket") + 1)) & (F.col("cycle") > edge(F.col("bucket"))))
    found = listed.groupBy("trace_id", "counter", "bucket").agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    every = names.crossJoin(F.broadcast(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))))
    top = F.max("hi").over(Window.partitionBy("trace_id", "counter"))
    scaled = lambda c: F.when(top > 0, F.floor(F.coalesce(F.col(c), F.lit(0.0)) / top * SCALE)).otherwise(0).cast("long")
    full = every.join(found, ["trace_id", "counter", "bucket"], "left")
    return full.select("trace_id", "counter", "bucket", scaled("lo").alias("lo"), scaled("hi").alias("hi"))
