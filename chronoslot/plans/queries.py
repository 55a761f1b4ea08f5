"""Registered queries: every trace operator on the event log, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import isa
from ..operators import buffers as B
from ..operators import counters as K
from ..operators import lifecycle as L
from ..operators import mipmap as M
from ..operators import noc as N
from ..operators import report as A
from ..operators import state as S
from ..sources import eventlog, konata
from .trace import PROP_SET, Trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A moment and a window that the registered queries ask for, in cycles.
AT, START, END = 20_000, 10_000, 30_000
CYCLE = eventlog.CYCLE_US

_EV = f"""WITH RECURSIVE ev AS (
    SELECT event_id AS seq, epoch_us(ts) - {eventlog.EPOCH_US} AS t, (epoch_us(ts) - {eventlog.EPOCH_US}) // {CYCLE} AS cycle, user_id, event_type,
           CAST(round(value * 100) AS BIGINT) AS delta, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events)"""
_LIVES = (
    _EV
    + """, lv AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY seq) AS life FROM ev),
  lf AS (SELECT user_id, life, min(seq) AS birth_seq, min(cycle) AS birth_cycle, min(CASE WHEN event_type IN ('purchase', 'error') THEN seq END) AS death_seq,
           life = max(life) OVER (PARTITION BY user_id) AS newest FROM lv WHERE life > 0 GROUP BY user_id, life),
  lives AS (SELECT f.*, e.cycle AS death_cycle, CASE WHEN e.seq IS NULL THEN 'InFlight' WHEN e.event_type = 'error' THEN 'Flushed' ELSE 'Retired' END AS status
           FROM lf f LEFT JOIN ev e ON e.seq = f.death_seq WHERE f.death_seq IS NOT NULL OR f.newest),
  st AS (SELECT l.*, e.seq, e.cycle, e.event_type, lead(e.cycle) OVER w AS next_cycle, lag(e.seq) OVER w IS NULL AS is_first
           FROM lives l JOIN lv e ON e.user_id = l.user_id AND e.life = l.life AND e.event_type IN ('view', 'click') AND (l.death_seq IS NULL OR e.seq < l.death_seq)
           WINDOW w AS (PARTITION BY l.user_id, l.life ORDER BY e.seq)),
  spans AS (SELECT *, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS stage,
           coalesce(next_cycle, death_cycle, CASE WHEN is_first THEN birth_cycle ELSE greatest(birth_cycle, cycle) END + 1) AS end_cycle FROM st),
  instr AS (SELECT l.user_id, l.life, l.birth_seq, l.birth_cycle, l.status, greatest(l.birth_cycle, coalesce(max(s.end_cycle), l.birth_cycle)) AS last_cycle, count(s.seq) AS stages
           FROM lives l LEFT JOIN spans s ON s.user_id = l.user_id AND s.life = l.life GROUP BY l.user_id, l.life, l.birth_seq, l.birth_cycle, l.status)"""
)
_EDGES = (
    _EV
    + """, bo AS (SELECT seq, cycle, k, user_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS is_on FROM ev),
  edges AS (SELECT seq, cycle, k, is_on - coalesce(was, 0) AS step FROM (SELECT *, lag(is_on) OVER (PARTITION BY k ORDER BY seq) AS was FROM bo) WHERE is_on <> coalesce(was, 0))"""
)
_L0 = (
    _EV
    + f""", ext AS (SELECT max(cycle) // {M.BASE} + 1 AS n FROM ev),
  c0 AS (SELECT event_type AS counter, cycle // {M.BASE} AS bucket, min(delta) AS lo, max(delta) AS hi, sum(delta) AS total FROM ev GROUP BY ALL),
  l0 AS (SELECT x.counter, b.bucket, CAST(coalesce(lo, 0) AS BIGINT) AS lo, CAST(coalesce(hi, 0) AS BIGINT) AS hi, CAST(coalesce(total, 0) AS BIGINT) AS total
         FROM (SELECT DISTINCT event_type AS counter FROM ev) x CROSS JOIN (SELECT unnest(range(n)) AS bucket FROM ext) b LEFT JOIN c0 ON c0.counter = x.counter AND c0.bucket = b.bucket),
  d0 AS (SELECT b.bucket, CAST(coalesce(n.births, 0) AS BIGINT) AS births FROM (SELECT unnest(range(n)) AS bucket FROM ext) b
         LEFT JOIN (SELECT cycle // {M.BASE} AS bucket, count(*) AS births FROM ev WHERE event_type = 'signup' GROUP BY 1) n ON n.bucket = b.bucket),
  dp AS (SELECT *, CAST(sum(births) OVER (ORDER BY bucket) AS BIGINT) AS upto FROM d0)"""
)


def query(sql: str | None):
    """Register a query on the event-log trace under its own name."""

    def wrap(f: Callable[[Trace], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(eventlog.load(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _event(c: str = "seq") -> F.Column:
    """The log's event number of an operation."""
    return F.expr(f"{c} div {eventlog.PER_EVENT}")


def _buffer(t: Trace):
    return t.schema.storage("sessions")


# --- selections ---
@query(_EV + f" SELECT seq, cycle, user_id AS entity_id FROM ev WHERE event_type IN ('view', 'click') AND t BETWEEN {START * CYCLE} AND {END * CYCLE}")
def events_in_range(t: Trace) -> DataFrame:
    return S.events_in_range(t, START * CYCLE, END * CYCLE).where("event = 'stage_transition'").select(_event().alias("seq"), "cycle", "entity_id")


@query(_EV + f", s AS (SELECT seq // 1000 AS seg_id, min(t) AS time_start_ps, max(t) AS time_end_ps FROM ev GROUP BY 1) SELECT seg_id, time_start_ps, time_end_ps FROM s WHERE time_start_ps < {END * CYCLE} AND time_end_ps > {START * CYCLE}")
def segment_prune(t: Trace) -> DataFrame:
    return S.overlapping(_segments(t), START * CYCLE, END * CYCLE)


@query(_EV + f", s AS (SELECT seq // 1000 AS seg_id, min(t) AS time_start_ps, max(t) AS time_end_ps FROM ev GROUP BY 1) SELECT seg_id FROM s WHERE time_start_ps <= {AT * CYCLE} ORDER BY time_start_ps DESC LIMIT 1")
def segment_seek(t: Trace) -> DataFrame:
    return S.seek(_segments(t), AT * CYCLE).select("seg_id")


def _segments(t: Trace) -> DataFrame:
    return t.ops.groupBy(F.expr(f"seq div {1000 * eventlog.PER_EVENT}").alias("seg_id")).agg(F.min("time_ps").alias("time_start_ps"), F.max("time_ps").alias("time_end_ps"))


@query(_EV + " SELECT seq, t AS time_ps, cycle FROM ev")
def cycle_convert(t: Trace) -> DataFrame:
    return K.adds(t).join(t.ops.where("action = 'add'").select("seq", "time_ps"), "seq").select(_event().alias("seq"), "time_ps", F.expr(f"time_ps div {t.period_ps}").alias("cycle"))


# --- state ---
@query(_EV + f", o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM ev WHERE event_type IN ('signup', 'purchase') AND t <= {AT * CYCLE}) SELECT user_id AS slot, user_id AS entity_id FROM o WHERE r = 1 AND event_type = 'signup'")
def state_at_entities(t: Trace) -> DataFrame:
    return S.state_at(t, t.schema.entities, AT * CYCLE).select("slot", F.col("entity_id").cast("long").alias("entity_id"))


@query(_EV + f", o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM ev WHERE event_type IN ('signup', 'purchase', 'error') AND t <= {AT * CYCLE}) SELECT user_id AS slot FROM o WHERE r = 1 AND event_type = 'signup'")
def state_at_flush_clears(t: Trace) -> DataFrame:
    return S.state_at(t, t.schema.entities, AT * CYCLE, treat_flush_as_clear=True).select("slot")


@query(_EV + f", o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM ev WHERE t <= {AT * CYCLE}) SELECT CAST(k AS BIGINT) AS slot, user_id AS entity_id FROM o WHERE r = 1 AND event_type IN ('view', 'click', 'signup')")
def state_at_buffer(t: Trace) -> DataFrame:
    return S.state_at(t, _buffer(t), AT * CYCLE).select("slot", F.col("entity_id").cast("long").alias("entity_id"))


@query(
    _EV
    + f" SELECT 'head_ptr' AS name, 'head' AS role, CAST(coalesce(max_by(k, seq), 0) AS BIGINT) AS value FROM ev WHERE event_type = 'signup' AND t <= {AT * CYCLE} UNION ALL SELECT 'tail_ptr', 'tail', CAST(coalesce(max_by(k, seq), 0) AS BIGINT) FROM ev WHERE event_type = 'purchase' AND t <= {AT * CYCLE}"
)
def prop_last_write(t: Trace) -> DataFrame:
    return S.properties_at(t, _buffer(t), AT * CYCLE).select("name", "role", F.col("value").cast("long").alias("value"))


@query(_EV + f" SELECT event_type AS counter, CAST(sum(delta) AS BIGINT) AS value FROM ev WHERE t <= {AT * CYCLE} GROUP BY 1")
def counter_state_at(t: Trace) -> DataFrame:
    return S.counter_state(t, AT * CYCLE).select("counter", F.col("value").cast("long").alias("value"))


@query(_EDGES + f", c AS (SELECT unnest([{START}, {AT}, {END}]) AS at_cycle) SELECT CAST(at_cycle AS BIGINT) AS at_cycle, CAST(coalesce((SELECT sum(step) FROM edges WHERE cycle <= at_cycle), 0) AS BIGINT) AS occupied FROM c")
def occupancy_at(t: Trace) -> DataFrame:
    return S.occupancy_at(t, [_buffer(t)], [START, AT, END]).select("at_cycle", "occupied")


@query(_EDGES + ", s AS (SELECT cycle, sum(step) AS step FROM edges GROUP BY 1) SELECT cycle, CAST(sum(step) OVER (ORDER BY cycle) AS BIGINT) AS occupied FROM s")
def occupancy_series(t: Trace) -> DataFrame:
    return S.occupancy_series(t, _buffer(t)).select("cycle", "occupied")


# --- lifecycle ---
@query(_LIVES + " SELECT user_id AS entity_id, birth_seq, birth_cycle AS first_cycle, last_cycle, status, stages FROM instr")
def instructions(t: Trace) -> DataFrame:
    return L.instructions(t).select("entity_id", _event("birth_seq").alias("birth_seq"), "first_cycle", "last_cycle", "status", "stages")


@query(_LIVES + " SELECT user_id AS entity_id, birth_seq, seq, CAST(stage AS INTEGER) AS stage, event_type AS stage_name, cycle AS start_cycle, end_cycle, greatest(0, end_cycle - cycle) AS duration, status FROM spans")
def stage_spans(t: Trace) -> DataFrame:
    return L.stage_spans(t).select("entity_id", _event("birth_seq").alias("birth_seq"), _event().alias("seq"), "stage", "stage_name", "start_cycle", "end_cycle", "duration", "status")


@query(_LIVES + " SELECT status, count(*) AS n FROM instr GROUP BY 1")
def retire_flush_status(t: Trace) -> DataFrame:
    return L.instructions(t, attributes=False).groupBy("status").agg(F.count("*").alias("n"))


@query(_LIVES + " SELECT user_id AS entity_id, birth_cycle AS first_cycle FROM instr WHERE status = 'InFlight'")
def in_flight(t: Trace) -> DataFrame:
    return L.instructions(t, attributes=False).where(F.col("status") == L.IN_FLIGHT).select("entity_id", "first_cycle")


@query(_LIVES + " SELECT user_id AS entity_id, birth_seq, event_type AS stage_name, cycle AS start_cycle, end_cycle, greatest(0, end_cycle - cycle) AS duration, status FROM spans WHERE user_id = 7")
def entity_timeline(t: Trace) -> DataFrame:
    return L.stage_spans(L.only(t, 7)).select("entity_id", _event("birth_seq").alias("birth_seq"), "stage_name", "start_cycle", "end_cycle", "duration", "status")


@query(_LIVES + " SELECT user_id AS entity_id, birth_seq, last_cycle - birth_cycle AS latency FROM instr")
def total_latency(t: Trace) -> DataFrame:
    return L.instructions(t, attributes=False).select("entity_id", _event("birth_seq").alias("birth_seq"), "latency")


@query(
    _LIVES
    + " SELECT l.user_id AS entity_id, l.birth_seq, string_agg(e.props, chr(10) ORDER BY e.seq) AS tooltip FROM lives l JOIN lv e ON e.user_id = l.user_id AND e.life = l.life AND e.event_type = 'view' AND (l.death_seq IS NULL OR e.seq < l.death_seq) GROUP BY ALL"
)
def annotations_joined(t: Trace) -> DataFrame:
    return L.instructions(t).where("tooltip is not null").select("entity_id", _event("birth_seq").alias("birth_seq"), "tooltip")


@query(_EV + ", d AS (SELECT seq, cycle, lag(user_id) OVER (PARTITION BY k ORDER BY seq) AS producer, user_id AS consumer FROM ev) SELECT seq, cycle, producer, consumer, 'raw' AS label, 'Data' AS kind FROM d WHERE producer IS NOT NULL")
def dependencies(t: Trace) -> DataFrame:
    return L.dependencies(t).select(_event().alias("seq"), "cycle", "producer", "consumer", "label", "kind")


@query(
    _LIVES
    + ", steps AS (SELECT cycle, sum(step) AS step FROM (SELECT birth_cycle AS cycle, 1 AS step FROM instr UNION ALL SELECT last_cycle, -1 FROM instr WHERE status <> 'InFlight') GROUP BY 1) SELECT CAST(max(n) AS BIGINT) AS max_in_flight FROM (SELECT sum(step) OVER (ORDER BY cycle) AS n FROM steps)"
)
def max_in_flight(t: Trace) -> DataFrame:
    return L.in_flight_series(t).agg(F.max("in_flight").cast("long").alias("max_in_flight"))


@query(
    _LIVES
    + f" SELECT user_id AS entity_id, seq, event_type AS stage_name, greatest(cycle, {AT}) AS shown_from, least(end_cycle, {AT + 600}) AS shown_to FROM spans WHERE cycle < {AT + 600} AND (end_cycle > {AT} OR end_cycle = cycle AND cycle >= {AT})"
)
def gantt_window(t: Trace) -> DataFrame:
    return L.gantt(t, AT, AT + 600).select("entity_id", _event().alias("seq"), "stage_name", "shown_from", "shown_to")


# --- counters ---
@query(_EV + " SELECT event_type AS counter, seq, cycle, CAST(sum(delta) OVER (PARTITION BY event_type ORDER BY seq) AS BIGINT) AS cum FROM ev")
def counter_samples(t: Trace) -> DataFrame:
    return K.samples(t).select("counter", _event().alias("seq"), "cycle", "cum")


@query(_EV + f" SELECT event_type AS counter, CAST(coalesce(sum(delta) FILTER (cycle <= {AT}), 0) AS BIGINT) AS value FROM ev GROUP BY 1")
def counter_value_at(t: Trace) -> DataFrame:
    return K.value_at(t, AT).select("counter", "value")


@query(
    _EV
    + f", p AS (SELECT unnest(range(0, 43201, 720)) AS cycle), c AS (SELECT DISTINCT event_type AS counter FROM ev) SELECT c.counter, p.cycle, CAST(coalesce((SELECT sum(delta) FROM ev e WHERE e.event_type = c.counter AND e.cycle <= p.cycle), 0) AS BIGINT) AS value FROM p CROSS JOIN c"
)
def counter_value_at_many(t: Trace) -> DataFrame:
    return K.value_at_many(t, t.ops.sparkSession.range(0, 43201, 720).select(F.col("id").alias("cycle"))).select("counter", "cycle", "value")


@query(_EV + f" SELECT event_type AS counter, round(coalesce(sum(delta) FILTER (cycle <= {AT} AND cycle > {AT - 600}), 0) / 600.0, 6) AS rate FROM ev GROUP BY 1")
def counter_rate(t: Trace) -> DataFrame:
    return K.rate_at(t, AT, 600).select("counter", F.round("rate", 6).alias("rate"))


@query(
    _EV
    + ", p AS (SELECT event_type AS counter, cycle, sum(delta) AS step FROM ev GROUP BY 1, 2) SELECT counter, cycle, round(CASE WHEN least(600, cycle) > 0 THEN CAST(sum(step) OVER (PARTITION BY counter ORDER BY cycle RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS DOUBLE) / least(600, cycle) ELSE 0 END, 6) AS rate FROM p"
)
def counter_sliding_rate(t: Trace) -> DataFrame:
    return K.rates(t, 600).select("counter", "cycle", F.round("rate", 6).alias("rate"))


@query(_EV + ", c AS (SELECT cycle FROM ev WHERE event_type = 'view' ORDER BY seq LIMIT 1) SELECT event_type AS counter, CAST(coalesce(sum(delta) FILTER (cycle = (SELECT cycle FROM c)), 0) AS BIGINT) AS delta FROM ev GROUP BY 1")
def counter_delta(t: Trace) -> DataFrame:
    first = K.adds(t).where("counter = 'view'").agg(F.min_by("cycle", "seq")).first()[0]
    return K.delta_at(t, first or 0).select("counter", "delta")


@query(
    _EV
    + ", p AS (SELECT event_type AS counter, cycle, CAST(sum(delta) AS BIGINT) AS step FROM ev GROUP BY 1, 2), q AS (SELECT *, coalesce(lag(cycle) OVER (PARTITION BY counter ORDER BY cycle), 0) AS from_cycle FROM p) SELECT counter, from_cycle, cycle AS to_cycle, CASE WHEN cycle > from_cycle THEN step // (cycle - from_cycle) ELSE step END AS per_cycle FROM q"
)
def counter_sparse_delta(t: Trace) -> DataFrame:
    return K.sparse_delta(t).select("counter", "from_cycle", "to_cycle", "per_cycle")


@query(
    _EV
    + f", v AS (SELECT event_type AS counter, CAST(coalesce(sum(delta) FILTER (cycle <= {START}), 0) AS BIGINT) AS start_value, CAST(coalesce(sum(delta) FILTER (cycle <= {END}), 0) AS BIGINT) AS end_value FROM ev GROUP BY 1) SELECT *, end_value - start_value AS delta, round((end_value - start_value) / {float(END - START)}, 6) AS rate FROM v"
)
def counter_range_summary(t: Trace) -> DataFrame:
    return K.range_summary(t, START, END).select("counter", "start_value", "end_value", "delta", F.round("rate", 6).alias("rate"))


@query(_EV + " SELECT event_type AS counter, CAST(sum(delta) AS BIGINT) AS value FROM ev GROUP BY 1")
def counter_latest(t: Trace) -> DataFrame:
    return K.latest(t).select("counter", "value")


@query(
    _EV
    + f", p AS (SELECT DISTINCT cycle FROM (SELECT unnest(range({AT}, {AT + 1201}, 1)) AS cycle)), c AS (SELECT DISTINCT event_type AS counter FROM ev) SELECT c.counter, p.cycle, CAST(coalesce((SELECT sum(delta) FROM ev e WHERE e.event_type = c.counter AND e.cycle <= p.cycle), 0) AS BIGINT) AS value FROM p CROSS JOIN c"
)
def counter_series(t: Trace) -> DataFrame:
    return K.series(t, AT, AT + 1200).select("counter", "cycle", "value")


@query(
    _EV
    + f""", s AS (SELECT event_type AS counter, cycle, delta, coalesce(lag(cycle) OVER w, 0) AS from_cycle, lag(seq) OVER w IS NULL AS is_first FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY seq)),
    i AS (SELECT *, CASE WHEN is_first OR cycle = from_cycle THEN 0.0::DOUBLE ELSE CAST(delta AS DOUBLE) / (cycle - from_cycle) END AS rate FROM s),
    b AS (SELECT unnest(range(50)) AS bucket), e AS (SELECT bucket, {START} + bucket * {(END - START) // 50} AS blo, {START} + (bucket + 1) * {(END - START) // 50} AS bhi FROM b),
    f AS (SELECT counter, bucket, min(rate) AS lo, max(rate) AS hi FROM i JOIN e ON from_cycle < bhi AND cycle > blo GROUP BY 1, 2),
    g AS (SELECT c.counter, e.bucket, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM (SELECT DISTINCT event_type AS counter FROM ev) c CROSS JOIN e LEFT JOIN f USING (counter, bucket)),
    h AS (SELECT *, max(hi) OVER (PARTITION BY counter) AS top FROM g)
    SELECT counter, CAST(bucket AS INTEGER) AS bucket, CAST(CASE WHEN top > 0 THEN floor(lo / top * 1000000) ELSE 0 END AS BIGINT) AS lo, CAST(CASE WHEN top > 0 THEN floor(hi / top * 1000000) ELSE 0 END AS BIGINT) AS hi FROM h"""
)
def counter_downsample(t: Trace) -> DataFrame:
    return K.downsample(t, START, END, 50).select("counter", "bucket", "lo", "hi")


# --- summaries ---
@query(_L0 + " SELECT counter, bucket, lo, hi, total FROM l0")
def mipmap_l0(t: Trace) -> DataFrame:
    return M.counter_level0(t).select("counter", "bucket", "lo", "hi", "total")


@query(
    _EV
    + f", a AS (SELECT event_type AS counter, cycle, CAST(sum(delta) AS BIGINT) AS delta FROM ev GROUP BY 1, 2), x AS (SELECT counter, cycle // {M.BASE} AS bucket, min(delta) AS lo, max(delta) AS hi, CAST(sum(delta) AS BIGINT) AS total FROM a WHERE delta <> 0 GROUP BY 1, 2) SELECT * FROM x"
)
def mipmap_l0_per_cycle(t: Trace) -> DataFrame:
    return M.counter_level0(t, per_cycle=True).where("total <> 0").select("counter", "bucket", "lo", "hi", "total")


_LEVELS = ", lev AS (SELECT unnest(range(0, 30)) AS level), top AS (SELECT min(level) AS n FROM lev, ext WHERE 4::HUGEINT ** level >= n)"


@query(_L0 + _LEVELS + " SELECT counter, CAST(level AS INTEGER) AS level, CAST(bucket // CAST(pow(4, level) AS BIGINT) AS BIGINT) AS bucket, min(lo) AS lo, max(hi) AS hi, CAST(sum(total) AS BIGINT) AS total FROM l0, lev, top WHERE level <= top.n GROUP BY 1, 2, 3")
def mipmap_levels(t: Trace) -> DataFrame:
    return M.counter_pyramid(t).select("counter", "level", "bucket", "lo", "hi", "total")


@query(_L0 + " SELECT bucket, births FROM d0")
def density_l0(t: Trace) -> DataFrame:
    return M.density_level0(t).select("bucket", "births")


@query(_L0 + _LEVELS + " SELECT CAST(level AS INTEGER) AS level, CAST(bucket // CAST(pow(4, level) AS BIGINT) AS BIGINT) AS bucket, CAST(sum(births) AS BIGINT) AS births FROM d0, lev, top WHERE level <= top.n GROUP BY 1, 2")
def density_levels(t: Trace) -> DataFrame:
    return M.density_pyramid(t).select("level", "bucket", "births")


@query(_EV + " SELECT count(*) AS total_instructions FROM ev WHERE event_type = 'signup'")
def total_instructions(t: Trace) -> DataFrame:
    return M.total_births(t).select("total_instructions")


@query(_L0 + f", r AS (SELECT unnest(range(0, 2500, 50)) AS row) SELECT r.row, coalesce((SELECT min(bucket) FROM dp WHERE upto > r.row), (SELECT n FROM ext)) * {M.BASE} AS cycle FROM r")
def row_to_cycle(t: Trace) -> DataFrame:
    return M.row_to_cycle(M.density_level0(t), t.ops.sparkSession.range(0, 2500, 50).select(F.col("id").alias("row"))).select("row", "cycle")


@query(_L0 + f", c AS (SELECT unnest(range(0, 50000, 777)) AS cycle) SELECT c.cycle, CAST(coalesce((SELECT upto - births + births * (c.cycle % {M.BASE}) // {M.BASE} FROM dp WHERE bucket = c.cycle // {M.BASE}), (SELECT sum(births) FROM d0)) AS BIGINT) AS row FROM c")
def cycle_to_row(t: Trace) -> DataFrame:
    return M.cycle_to_row(M.density_level0(t), t.ops.sparkSession.range(0, 50000, 777).select(F.col("id").alias("cycle"))).select("cycle", "row")


@query(
    _L0
    + f", lp AS (SELECT *, sum(total) OVER (PARTITION BY counter ORDER BY bucket) - total AS before FROM l0), c AS (SELECT unnest(range(0, 50000, 777)) AS cycle), n AS (SELECT counter, sum(total) AS total FROM l0 GROUP BY 1) SELECT n.counter, c.cycle, CAST(coalesce((SELECT before + lp.total * (c.cycle % {M.BASE}) // {M.BASE} FROM lp WHERE lp.counter = n.counter AND lp.bucket = c.cycle // {M.BASE}), n.total) AS BIGINT) AS value FROM c CROSS JOIN n"
)
def mipmap_value_interpolated(t: Trace) -> DataFrame:
    return M.value_interpolated(M.counter_level0(t), t.ops.sparkSession.range(0, 50000, 777).select(F.col("id").alias("cycle"))).select("counter", "cycle", "value")


@query(
    _L0
    + f""", l1 AS (SELECT counter, bucket // 4 AS b, sum(total) AS total FROM l0 GROUP BY 1, 2), e AS (SELECT unnest(range(8)) AS bucket),
    o AS (SELECT counter, e.bucket, total, least({(START + 5000.0)} * 0 + (e.bucket + 1) * 5000.0, (b + 1) * 4096.0) - greatest(e.bucket * 5000.0, b * 4096.0) AS o FROM l1, e),
    v AS (SELECT counter, bucket, sum(total * o) / sum(o) AS v FROM o WHERE o > 0 GROUP BY 1, 2)
    SELECT c.counter, CAST(e.bucket AS INTEGER) AS bucket, CAST(floor(round(coalesce(v, 0), 6)) AS BIGINT) AS lo, CAST(floor(round(coalesce(v, 0), 6)) AS BIGINT) AS hi FROM (SELECT DISTINCT counter FROM l0) c CROSS JOIN e LEFT JOIN v ON v.counter = c.counter AND v.bucket = e.bucket"""
)
def mipmap_weighted_downsample(t: Trace) -> DataFrame:
    return M.downsample(t, 0, 40_000, 8).select("counter", "bucket", "lo", "hi")


@query(
    _LIVES
    + f" SELECT last_cycle // {M.BASE} AS bucket, count(*) FILTER (status = 'Retired') AS committed, count(*) FILTER (status = 'Flushed') AS flushes FROM instr WHERE status <> 'InFlight' GROUP BY 1"
)
def summary_fields(t: Trace) -> DataFrame:
    m = M.metrics(t)
    pick = lambda n: F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n)
    return m.where("metric in ('committed', 'flushes')").groupBy("bucket").agg(pick("committed"), pick("flushes"))


# --- buffers ---
@query(
    _EV
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM ev WHERE t <= {AT * CYCLE}),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM ev WHERE event_type IN ('signup', 'purchase') AND t <= {AT * CYCLE})
    SELECT CAST(o.k AS BIGINT) AS slot, o.user_id AS entity_id, n.user_id AS entity_slot FROM o LEFT JOIN n ON n.user_id = o.user_id AND n.r = 1 AND n.event_type = 'signup' WHERE o.r = 1 AND o.event_type IN ('view', 'click', 'signup')"""
)
def buffer_join_entities(t: Trace) -> DataFrame:
    return B.buffer_state(t, _buffer(t), AT).select("slot", "entity_id", "entity_slot")


@query(
    _EV
    + f", p AS (SELECT coalesce(max_by(k, seq) FILTER (event_type = 'signup'), 0) AS head, coalesce(max_by(k, seq) FILTER (event_type = 'purchase'), 0) AS tail FROM ev WHERE t <= {AT * CYCLE}) SELECT CAST(head AS BIGINT) AS head, CAST(tail AS BIGINT) AS tail, CAST((tail - head + {eventlog.BUFFER_SLOTS}) % {eventlog.BUFFER_SLOTS} AS BIGINT) AS distance FROM p"
)
def pointer_pairs(t: Trace) -> DataFrame:
    return B.pointer_pairs(t, _buffer(t), AT).select("head", "tail", "distance")


@query(_EDGES + f" SELECT 'sessions' AS buffer, CAST(coalesce(sum(step), 0) AS BIGINT) AS occupied, round(coalesce(sum(step), 0) * 100.0 / {eventlog.BUFFER_SLOTS}, 6) AS fill_percent FROM edges WHERE cycle <= {AT}")
def fill_percent(t: Trace) -> DataFrame:
    return B.all_buffers(t, AT, "sess").select("buffer", "occupied", F.round("fill_percent", 6).alias("fill_percent"))


@query(_EDGES + f", c AS (SELECT unnest([{START}, {START + (END - START) // 2}, {END}]) AS at_cycle) SELECT CAST(at_cycle AS BIGINT) AS at_cycle, CAST(coalesce((SELECT sum(step) FROM edges WHERE cycle <= at_cycle), 0) AS BIGINT) AS occupied FROM c")
def buffer_snapshots(t: Trace) -> DataFrame:
    return B.snapshots(t, START, END).select("at_cycle", "occupied")


# --- reports ---
_WIN = f", w AS (SELECT * FROM instr WHERE birth_cycle >= {START} AND birth_cycle < {END})"


@query(_LIVES + _WIN + ", x AS (SELECT s.* FROM spans s SEMI JOIN w ON s.user_id = w.user_id AND s.life = w.life) SELECT event_type AS stage_name, CAST(sum(greatest(0, end_cycle - cycle)) AS BIGINT) AS total_cycles, count(*) AS n, round(avg(greatest(0, end_cycle - cycle)), 6) AS avg_cycles FROM x GROUP BY 1")
def stage_latency_report(t: Trace) -> DataFrame:
    return A.stage_latency(t, START, END).select("stage_name", "total_cycles", "n", F.round("avg_cycles", 6).alias("avg_cycles"))


@query(_LIVES + _WIN + f" SELECT count(*) AS total, count(*) FILTER (status = 'Retired') AS retired, count(*) FILTER (status = 'Flushed') AS flushed, count(*) FILTER (status = 'InFlight') AS in_flight, round(count(*) FILTER (status = 'Retired') / {float(END - START)}, 9) AS ipc FROM w")
def perf_summary(t: Trace) -> DataFrame:
    return A.summary(t, START, END).select("total", "retired", "flushed", "in_flight", F.round("ipc", 9).alias("ipc"))


@query(_LIVES + _WIN + " SELECT round(CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'Flushed') / CAST(count(*) AS DOUBLE) ELSE 0 END, 6) AS flush_rate FROM w")
def flush_rate(t: Trace) -> DataFrame:
    return A.summary(t, START, END).select(F.round("flush_rate", 6).alias("flush_rate"))


@query(
    _LIVES
    + _WIN
    + f""", x AS (SELECT s.event_type AS name, sum(greatest(0, end_cycle - cycle)) AS total, count(*) AS n FROM spans s SEMI JOIN w ON s.user_id = w.user_id AND s.life = w.life GROUP BY 1),
    c AS (SELECT event_type AS name, sum(delta) FILTER (cycle <= {START}) AS a, sum(delta) FILTER (cycle <= {END}) AS b FROM ev GROUP BY 1),
    y AS (SELECT count(*) AS total, count(*) FILTER (status = 'Retired') AS retired, count(*) FILTER (status = 'Flushed') AS flushed, count(*) FILTER (status = 'InFlight') AS in_flight FROM w),
    bo AS (SELECT seq, cycle, k, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS is_on FROM ev),
    edges AS (SELECT cycle, is_on - coalesce(was, 0) AS step FROM (SELECT *, lag(is_on) OVER (PARTITION BY k ORDER BY seq) AS was FROM bo) WHERE is_on <> coalesce(was, 0)),
    p AS (SELECT unnest([{START}, {START + (END - START) // 2}, {END}]) AS at_cycle)
    SELECT section, name, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
      SELECT 'summary' AS section, '' AS name, unnest(['total', 'retired', 'flushed', 'in_flight', 'ipc', 'flush_rate']) AS metric, unnest([total, retired, flushed, in_flight, retired / {float(END - START)}, CASE WHEN total > 0 THEN flushed / CAST(total AS DOUBLE) ELSE 0 END]::DOUBLE[]) AS value FROM y
      UNION ALL SELECT 'stage', name, unnest(['total_cycles', 'n', 'avg_cycles']), unnest([total, n, total / CAST(n AS DOUBLE)]::DOUBLE[]) FROM x
      UNION ALL SELECT 'counter', name, unnest(['start_value', 'end_value', 'delta', 'rate']), unnest([coalesce(a, 0), coalesce(b, 0), coalesce(b, 0) - coalesce(a, 0), (coalesce(b, 0) - coalesce(a, 0)) / {float(END - START)}]::DOUBLE[]) FROM c
      UNION ALL SELECT 'buffer', 'sessions@' || at_cycle, unnest(['occupied', 'capacity']), unnest([(SELECT coalesce(sum(step), 0) FROM edges WHERE cycle <= at_cycle), {eventlog.BUFFER_SLOTS}]::DOUBLE[]) FROM p)"""
)
def perf_report(t: Trace) -> DataFrame:
    return A.performance(t, START, END).withColumn("value", F.round("value", 6))


# --- interconnect ---
@query(_LIVES + " SELECT status, (last_cycle - birth_cycle) // 500 * 500 AS latency_from, count(*) AS n FROM instr WHERE status <> 'InFlight' GROUP BY 1, 2")
def latency_histogram(t: Trace) -> DataFrame:
    return N.latency_histogram(L.instructions(t, attributes=False), 500, ["status"]).select("status", "latency_from", "n")


@query(_EV + " SELECT k AS port, seq, CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS level FROM ev WHERE event_type IN ('view', 'click')")
def credit_level(t: Trace) -> DataFrame:
    slot = t.on(_buffer(t), "set").select("seq", F.col("slot").cast("int").alias("port"))
    point = t.event("stage_transition").select(_event().alias("seq"), F.when(F.col("arg") == 0, 1).otherwise(-1).alias("step"))
    return N.credit_level(slot.withColumn("seq", _event()).join(point, "seq"))


@query(
    _LIVES
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY birth_seq) AS n FROM instr) SELECT min(birth_seq) AS first_life, max(birth_seq) AS last_life, count(*) - 1 AS hops, CAST(sum(last_cycle - birth_cycle) AS BIGINT) AS latency FROM r GROUP BY user_id, (n - 1) // 20"
)
def handoff_chain(t: Trace) -> DataFrame:
    i = L.instructions(t, attributes=False).select("entity_id", _event("birth_seq").alias("life"), "latency")
    w = Window.partitionBy("entity_id").orderBy("life")
    links = i.withColumn("src", F.lag("life").over(w)).where("src is not null").select("src", F.col("life").alias("dst"))
    return N.handoff_chains(links, i.select("life", "latency")).select("first_life", "last_life", "hops", "latency")


@query(_EV + " SELECT CASE event_type WHEN 'error' THEN 'flush' ELSE 'stage_transition' END AS event, cycle // 1024 AS bucket, count(*) AS n FROM ev WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2")
def event_counts(t: Trace) -> DataFrame:
    return N.event_counts(t, 1024).where("event in ('flush', 'stage_transition')")


@query(_EV + " SELECT k AS port, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y, cycle // 1024 AS bucket, CAST(sum(delta) AS BIGINT) AS bytes, round(sum(delta) / 16384.0, 6) AS utilization FROM ev GROUP BY ALL")
def link_utilization(t: Trace) -> DataFrame:
    port = t.ops.where(F.col("storage_id") == eventlog.BUFFER).where(F.col("action") != PROP_SET).select(_event().alias("e"), F.col("slot").cast("int").alias("port"))
    beats = K.adds(t).select(_event().alias("e"), "cycle", F.col("delta").alias("bytes")).join(port, "e")
    u = N.link_utilization(beats, 16, 1024, "port", "bytes").withColumnRenamed("link", "port")
    return N.positions(u, 8).select("port", "x", "y", "bucket", "bytes", F.round("utilization", 6).alias("utilization"))


@query(_LIVES + " SELECT last_cycle // 1024 AS bucket, count(*) FILTER (status <> 'Flushed') AS txn_completed, round(avg(last_cycle - birth_cycle), 6) AS avg_latency FROM instr WHERE status <> 'InFlight' GROUP BY 1")
def noc_summary(t: Trace) -> DataFrame:
    return N.summary(t, 1024).select("bucket", "txn_completed", F.round("avg_latency", 6).alias("avg_latency"))


# --- text and instruction decoding on inline rows ---
def _inline(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


_LABELS = ["80000000: addi x0, x0, 0", "0x80000004 nop", "12: short", "main: not hex", "ffffffffffffffff: top", ""]


@_inline("pc_extract", "SELECT label, CAST(pc AS DECIMAL(20,0)) AS pc FROM (VALUES " + ", ".join(f"('{s}', {v})" for s, v in zip(_LABELS, ["2147483648::BIGINT::DECIMAL(20,0)", "2147483652", "0", "0", "18446744073709551615", "0"], strict=True)) + ") AS t(label, pc)")
def _pc_extract(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _LABELS], "label string").select("label", konata.pc_of(F.col("label")).alias("pc"))


_LOG = ["Kanata\t0004", "C=\t0", "I\t0\t0\t0", "L\t0\t0\t80000000: nop", "S\t0\t0\tF", "C\t1", "S\t0\t0\tX", "I\t1\t1\t0", "W\t1\t0\t0", "C\t1", "R\t0\t0\t0", "# note", ""]


@_inline("konata_parse", "SELECT * FROM (VALUES (2, 'C=', 0), (3, 'I', 0), (4, 'L', 0), (5, 'S', 0), (6, 'C', 1), (7, 'S', 1), (8, 'I', 1), (9, 'W', 1), (10, 'C', 2), (11, 'R', 2)) AS t(line_no, cmd, cycle)")
def _konata_parse(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([(i + 1, s) for i, s in enumerate(_LOG)], "line_no long, value string")
    return konata.with_cycles(konata.parse(lines)).select(F.col("line_no").cast("int").alias("line_no"), "cmd", F.col("cycle").cast("int").alias("cycle"))


_WORDS = [(0x00000013, "addi zero, zero, 0"), (0x003100B3, "add ra, sp, gp"), (0x02A5D5B3, "divu a1, a1, a0"), (0x00A12023, "sw a0, 0(sp)"), (0x30529073, "csrrw zero, mtvec, t0"), (0x00000001, "c.nop"), (0xFFFFFFFF, "0xffffffff")]


@_inline("isa_decode", "SELECT * FROM (VALUES " + ", ".join(f"({b}::BIGINT, '{s}')" for b, s in _WORDS) + ") AS t(inst_bits, disasm)")
def _isa_decode(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(b,) for b, _ in _WORDS], "inst_bits long")
    return isa.decode(rows).select("inst_bits", "disasm")
