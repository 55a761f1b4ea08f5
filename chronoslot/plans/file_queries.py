"""Registered queries over trace files that are written from the event log, with DuckDB SQL for the same rows.

The file has two cores of one clock: users of even number are entities of core0,
the others of core1; both number them from 0, so ids, storages and events of the
two have the same names. Readers, codec, writer, resolution and streams all take part.
A file is in order of time, so the log's number of each event stands in it too, for
logs whose numbers disagree with time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counters as K
from ..operators import lifecycle as L
from ..operators import mipmap as M
from ..operators import report as A
from ..operators import state as S
from ..sources import codec, eventlog, sink, synth, trace_format
from ..sources.builder import FLUSH_REASONS, SchemaBuilder, embed_summary
from ..streaming import live
from . import resolve
from .queries import _EDGES, _EV, _L0, _LEVELS, _LIVES, AT, CYCLE, END, ORACLE_SQL, QUERIES, START
from .trace import Field, Property, Schema, Trace
from .work import shared_dir, shared_file

#: A segment is so many cycles.
SEGMENT_CYCLES = 1000
INTERVAL = SEGMENT_CYCLES * CYCLE
PER_EVENT = 16
SLOTS, BUFFER_SLOTS = 0xFFFF, 128
#: Event that holds the log's number, right behind the buffer operation that each of the log's events makes.
NUMBER = "log_number"
_files: dict[tuple, str] = {}


def file_schema() -> Schema:
    b = SchemaBuilder()
    clock = b.clock_domain("minutes", CYCLE)
    root = b.scope("root")
    cores = [b.scope(f"core{i}", root, "cpu", clock) for i in range(2)]
    stage, reason = b.enum_type("pipeline_stage", eventlog.STAGES), b.enum_type("flush_reason", FLUSH_REASONS)
    entity = Field("entity_id", "u32")
    for core in cores:
        b.storage("entities", SLOTS, [entity, Field("pc", "u64")], sparse=True, scope_id=core)
        b.storage("sessions", BUFFER_SLOTS, [entity], sparse=True, buffer=True, scope_id=core, properties=[Property("head_ptr", "u32", "head"), Property("tail_ptr", "u32", "tail")])
        for t in eventlog.TYPES:
            b.storage(t, 1, [Field("count", "u64")], scope_id=core)
    for core in cores:
        b.event("stage_transition", [entity, Field("stage", "enum", stage)], core)
        b.event("annotate", [entity, Field("text", "string_ref")], core)
        b.event("flush", [entity, Field("reason", "enum", reason)], core)
        b.event(NUMBER, [Field("number", "u64")], core)
    return b.build()


def two_cores(spark: SparkSession, sf_dir: str) -> Trace:
    """The event log as the trace of two cores, ready to be written."""
    ev = eventlog.rows(spark, sf_dir).withColumn("core", F.pmod("user_id", F.lit(2)).cast("int")).withColumn("entity", F.floor(F.col("user_id") / 2).cast("long"))
    kind, k, entity = F.col("event_type"), F.col("k"), F.col("entity")
    n_storages, n_events = 2 + len(eventlog.TYPES), 4
    counter = F.array_position(F.array(*[F.lit(t) for t in eventlog.TYPES]), kind).cast("int") + 1
    zero, none = F.lit(0), F.lit(None).cast("int")

    def op(at: int, when: F.Column, storage: F.Column, slot: F.Column, field: F.Column, action: str, value: F.Column) -> F.Column:
        return F.when(when, F.struct(F.lit(at).alias("at"), (storage + F.col("core") * n_storages).cast("int").alias("storage_id"), slot.cast("long").alias("slot"), field.cast("int").alias("field_index"), F.lit(action).alias("action"), value.cast("decimal(20,0)").alias("value")))

    each = F.array(
        op(0, kind == "signup", zero, entity, zero, "set", entity),
        op(1, kind == "signup", zero, entity, F.lit(1), "set", F.lit(0x80000000) + 4 * F.col("seq")),
        op(2, kind == "purchase", zero, entity, none, "clear", zero),
        op(3, F.lit(True), counter, zero, zero, "add", F.col("delta")),
        op(4, kind.isin("view", "click", "signup"), F.lit(1), k, zero, "set", entity),
        op(5, kind.isin("purchase", "error"), F.lit(1), k, none, "clear", zero),
        op(7, kind == "signup", F.lit(1), zero, zero, "prop_set", k),
        op(8, kind == "purchase", F.lit(1), zero, F.lit(1), "prop_set", k),
    )
    base = [F.lit("events").alias("trace_id"), F.lit(0).alias("seg_id")]
    ops = ev.select("seq", "time_us", "cycle", F.explode(each).alias("o")).where("o is not null").select(*base, (F.col("seq") * PER_EVENT + F.col("o.at")).alias("seq"), F.col("time_us").alias("time_ps"), "cycle", "o.storage_id", "o.slot", "o.field_index", "o.action", "o.value")

    def event(at: int, when: F.Column, name: str, number: int, arg: F.Column, text: F.Column, first: F.Column = entity) -> DataFrame:
        return ev.where(when).select(*base, (F.col("seq") * PER_EVENT + at).alias("seq"), F.col("time_us").alias("time_ps"), "cycle", F.lit(name).alias("event"), (F.lit(number) + F.col("core") * n_events).alias("event_type_id"), first.alias("entity_id"), arg.cast("long").alias("arg"), F.lit(None).cast("long").alias("arg2"), text.alias("text"))

    no_text = F.lit(None).cast("string")
    events = event(9, kind.isin("view", "click"), "stage_transition", 0, F.when(kind == "view", 0).otherwise(1), no_text)
    events = events.unionByName(event(10, kind == "view", "annotate", 1, zero, F.col("props"))).unionByName(event(11, kind == "error", "flush", 2, zero, no_text))
    events = events.unionByName(event(6, F.lit(True), NUMBER, 3, zero, no_text, F.col("seq")))
    return Trace(file_schema(), ops, events, eventlog.STAGES, CYCLE, {"cpu.pipeline_stages": ",".join(eventlog.STAGES), "vendor": "tests"})


def written(spark: SparkSession, sf_dir: str, finish: bool = True) -> str:
    """Path of the file, written once a session; finished files have a summary of core0."""
    key = (spark.sparkContext.applicationId, sf_dir, finish)
    if not os.path.isfile(_files.get(key, "")):  # the shared folder may be emptied between queries
        path = shared_file(spark, f"{'whole' if finish else 'open'}.trace")
        sink.write_file(two_cores(spark, sf_dir), path, INTERVAL, summary=False, finish=finish)
        if finish:
            embed_summary(path, sink.build_summary(trace_format.load(spark, path, "core0")))
        _files[key] = path
    return _files[key]


def of_core(n: int, sql: str) -> str:
    """SQL over the log with the events of one core alone, and its entity numbers."""
    return sql.replace("user_id, event_type,", "user_id // 2 AS user_id, event_type,", 1).replace("AS k, props FROM events)", f"AS k, props FROM events WHERE user_id % 2 = {n})", 1)


def query(sql: str):
    """Register f(spark, path of the file)."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, written(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    trace_format.register(spark)
    return spark.read.format("chronoslot").option("table", name).load(path)


def by_number(items: DataFrame, schema: Schema) -> DataFrame:
    """Items of one core with a ``seq`` in order of the log's numbers, in a batch or a stream.

    The items of an event of the log stand together around its NUMBER: sets, adds
    and clears before it, the others behind. A segment's items come in order to
    one task, so each takes the number from the next or the last one there.
    """
    number = next(e.event_type_id for e in schema.event_types if e.name == NUMBER)
    own = F.col("storage_id").isin([s.storage_id for s in schema.storages]) | F.col("event_type_id").isin([e.event_type_id for e in schema.event_types])
    marked = F.when(F.col("event_type_id") == number, trace_format.little(F.col("payload"), 0, 8).cast("long"))
    ahead = (F.col("kind") == "op") & (F.col("action") != "prop_set")
    return items.where(own).select("*", marked.alias("_number"), ahead.alias("_ahead")).mapInArrow(_renumber, items.schema)


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows wait for the number behind them, which can be in the next batch."""
    rest, last = None, [None, None]
    for batch in chain(batches, [None]):
        rows = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
        if rows is None or not rows.num_rows:
            continue
        known = pc.indices_nonzero(pc.is_valid(rows["_number"]))
        cut = rows.num_rows if batch is None else known[-1].as_py() + 1 if len(known) else 0
        rest, rows = rows.slice(cut), rows.slice(0, cut)
        if not cut:
            continue
        seq, filled = rows["seq"], []
        for i, x in enumerate((rows["_number"], pc.if_else(pc.is_valid(rows["_number"]), seq, None))):
            behind = pc.fill_null_forward(pa.concat_arrays([pa.array([last[i]], pa.int64()), x])).slice(1)
            filled.append(pc.if_else(rows["_ahead"], pc.fill_null_backward(x), behind))
            last[i] = behind[-1].as_py()
        # an event has fewer than PER_EVENT / 2 items on either side
        seq = pc.add(pc.multiply(filled[0], PER_EVENT), pc.add(pc.subtract(seq, filled[1]), PER_EVENT // 2))
        out = rows.set_column(rows.schema.get_field_index("seq"), "seq", seq)
        yield out.select([n for n in out.schema.names if n not in ("_number", "_ahead")])


# --- reading ---
@query(
    of_core(
        1,
        _EV
        + """, o AS (
        SELECT 'entities' AS storage, t, user_id AS slot, 0 AS field_index, 'set' AS action, user_id AS value FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT 'entities', t, user_id, 1, 'set', 2147483648 + 4 * seq FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT 'entities', t, user_id, NULL, 'clear', 0 FROM ev WHERE event_type = 'purchase'
        UNION ALL SELECT event_type, t, 0, 0, 'add', delta FROM ev
        UNION ALL SELECT 'sessions', t, k, 0, 'set', user_id FROM ev WHERE event_type IN ('view', 'click', 'signup')
        UNION ALL SELECT 'sessions', t, k, NULL, 'clear', 0 FROM ev WHERE event_type IN ('purchase', 'error')
        UNION ALL SELECT 'sessions', t, 0, 0, 'prop_set', k FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT 'sessions', t, 0, 1, 'prop_set', k FROM ev WHERE event_type = 'purchase')
        SELECT storage, t AS time_ps, CAST(slot AS BIGINT) AS slot, CAST(field_index AS INTEGER) AS field_index, action, CAST(value AS BIGINT) AS value FROM o""",
    )
)
def file_ops(spark: SparkSession, path: str) -> DataFrame:
    """Header, chunks, schema, segments, compression, frames, short and long operations: all of one core's, as they were written."""
    t = trace_format.load(spark, path, "core1")
    name = F.element_at(F.create_map(*[F.lit(x) for s in t.schema.storages for x in (s.storage_id, s.name)]), F.col("storage_id"))
    return t.ops.select(name.alias("storage"), "time_ps", "slot", "field_index", "action", F.col("value").cast("long").alias("value"))


@query(
    of_core(
        0,
        _EV
        + """ SELECT t AS time_ps, 'stage_transition' AS event, user_id AS entity_id, CASE event_type WHEN 'view' THEN 'view' ELSE 'click' END AS label FROM ev WHERE event_type IN ('view', 'click')
        UNION ALL SELECT t, 'annotate', user_id, props FROM ev WHERE event_type = 'view'
        UNION ALL SELECT t, 'flush', user_id, 'mispredict' FROM ev WHERE event_type = 'error'""",
    )
)
def file_events(spark: SparkSession, path: str) -> DataFrame:
    """Event records, payloads, strings and the names of codes."""
    t = trace_format.load(spark, path, "core0")
    label = F.when(F.col("event") == "annotate", F.col("text")).when(F.col("event") == "flush", resolve.code_name(t.schema.enum("flush_reason"), F.col("arg"))).otherwise(resolve.code_name(t.stages, F.col("arg"), "stage_%d"))
    return t.events.where(F.col("event") != NUMBER).select("time_ps", "event", "entity_id", label.alias("label"))


_SEGMENTS = f", seg AS (SELECT CAST(row_number() OVER (ORDER BY t // {INTERVAL}) - 1 AS INTEGER) AS seg_id, t // {INTERVAL} * {INTERVAL} AS time_start_ps, max(t) AS time_end_ps, count(DISTINCT t) AS n_frames FROM ev GROUP BY t // {INTERVAL})"


@query(_EV + _SEGMENTS + " SELECT seg_id, time_start_ps, time_end_ps, n_frames FROM seg")
def file_segments(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "segments").select("seg_id", "time_start_ps", "time_end_ps", "n_frames")


@query(_EV + _SEGMENTS + f" SELECT seg_id, time_start_ps // {CYCLE} AS start_cycle, time_end_ps // {CYCLE} AS end_cycle FROM seg")
def file_segment_cycles(spark: SparkSession, path: str) -> DataFrame:
    t = trace_format.load(spark, path)
    return resolve.segment_cycles(t.segments, t.period_ps).select("seg_id", "start_cycle", "end_cycle")


@query(_EV + " SELECT DISTINCT props AS text FROM ev WHERE event_type = 'view'")
def file_strings(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "strings").select("text")


@query(of_core(0, _EV).replace("WITH RECURSIVE ev AS", "WITH RECURSIVE al AS (SELECT epoch_us(ts) - %d AS t FROM events), ev AS" % eventlog.EPOCH_US) + _SEGMENTS.replace("FROM ev GROUP", "FROM al GROUP") + """, o AS (SELECT s.seg_id, e.user_id, e.event_type, row_number() OVER (PARTITION BY s.seg_id, e.user_id ORDER BY e.seq DESC) AS r FROM seg s JOIN ev e ON e.t < s.time_start_ps AND e.event_type IN ('signup', 'purchase'))
    SELECT seg_id, user_id AS slot, user_id AS entity_id FROM o WHERE r = 1 AND event_type = 'signup'""")
def file_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """State at the start of every segment, as the checkpoints hold it."""
    t = trace_format.load(spark, path, "core0")
    return t.checkpoints.where((F.col("storage_id") == t.schema.entities.storage_id) & (F.col("field_index") == 0) & ~F.col("is_prop")).select("seg_id", "slot", F.col("value").cast("long").alias("entity_id"))


@query(of_core(0, _EV) + f", o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM ev WHERE event_type IN ('signup', 'purchase') AND t <= {AT * CYCLE}) SELECT user_id AS slot, user_id AS entity_id, CAST(2147483648 + 4 * seq AS BIGINT) AS pc FROM o WHERE r = 1 AND event_type = 'signup'")
def file_state_at(spark: SparkSession, path: str) -> DataFrame:
    """State from the nearest checkpoint and the operations of its segment."""
    t = trace_format.load(spark, path, "core0")
    return S.state_at(t, t.schema.entities, AT * CYCLE).select("slot", F.col("entity_id").cast("long").alias("entity_id"), F.col("pc").cast("long").alias("pc"))


@query(of_core(1, _EV) + f" SELECT event_type AS counter, CAST(sum(delta) AS BIGINT) AS value FROM ev WHERE t <= {AT * CYCLE} GROUP BY 1")
def file_counter_state(spark: SparkSession, path: str) -> DataFrame:
    t = trace_format.load(spark, path, "core1")
    return S.counter_state(t, AT * CYCLE).select("counter", F.col("value").cast("long").alias("value"))


@query(of_core(0, _EV) + f" SELECT t AS time_ps, user_id AS entity_id FROM ev WHERE event_type = 'error' AND t BETWEEN {START * CYCLE} AND {END * CYCLE}")
def file_time_range(spark: SparkSession, path: str) -> DataFrame:
    """A range of time, which drops segments before they are read."""
    t = trace_format.load(spark, path, "core0")
    return S.events_in_range(t, START * CYCLE, END * CYCLE).where("event = 'flush'").select("time_ps", "entity_id")


@query("SELECT * FROM (VALUES ('clock', 'minutes', '0.0 MHz'), ('pipeline', '0', 'view'), ('pipeline', '1', 'click'), ('property', 'cpu.pipeline_stages', 'view,click'), ('property', 'vendor', 'tests'), ('scope', 'root', ''), ('scope', 'root/core0', 'cpu'), ('scope', 'root/core1', 'cpu'), ('storage', 'entities', 'sparse, 65535 slots: entity_id u32, pc u64'), ('storage', 'sessions', 'buffer, 128 slots: entity_id u32')) AS v(section, key, value)")
def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    info = A.file_info(trace_format.load(spark, path, "core1"))
    return info.where("section in ('clock', 'pipeline', 'property', 'scope') or section = 'storage' and key in ('entities', 'sessions')")


# --- cores ---
@query(of_core(1, _LIVES) + " SELECT user_id AS entity_id, birth_cycle AS first_cycle, last_cycle, status, stages FROM instr")
def core_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Lives of one core only, though the other has entities and events of the same names."""
    return L.instructions(trace_format.load(spark, path, "core1", through=by_number)).select("entity_id", "first_cycle", "last_cycle", "status", "stages")


@query(of_core(0, _LIVES) + " SELECT user_id AS entity_id, event_type AS stage_name, cycle AS start_cycle, end_cycle FROM spans")
def core_stage_spans(spark: SparkSession, path: str) -> DataFrame:
    return L.stage_spans(trace_format.load(spark, path, "core0", through=by_number)).select("entity_id", "stage_name", "start_cycle", "end_cycle")


@query(of_core(1, _EV) + f" SELECT event_type AS counter, CAST(coalesce(sum(delta) FILTER (cycle <= {AT}), 0) AS BIGINT) AS value FROM ev GROUP BY 1")
def core_counters(spark: SparkSession, path: str) -> DataFrame:
    return K.value_at(trace_format.load(spark, path, "core1"), AT).select("counter", "value")


@query(of_core(1, _EDGES) + f", c AS (SELECT unnest([{START}, {AT}, {END}]) AS at_cycle) SELECT CAST(at_cycle AS BIGINT) AS at_cycle, CAST(coalesce((SELECT sum(step) FROM edges WHERE cycle <= at_cycle), 0) AS BIGINT) AS occupied FROM c")
def core_occupancy(spark: SparkSession, path: str) -> DataFrame:
    """Buffer operations in order of the log's numbers, which a log of several parts has not in order of time."""
    t = trace_format.load(spark, path, "core1")
    numbers = trace_format.typed_events(_table(spark, path, "items"), t.schema).where(F.col("event") == NUMBER)
    numbers = numbers.select("trace_id", (F.col("seq") - 1).alias("seq"), F.col("entity_id").alias("number"))
    ops = t.ops.where(F.col("storage_id").isin([s.storage_id for s in t.schema.buffers]))
    t.ops = ops.join(numbers, ["trace_id", "seq"]).withColumn("seq", F.col("number")).drop("number")
    return S.occupancy_at(t, t.schema.buffers, [START, AT, END]).select("at_cycle", "occupied")


@query(of_core(0, _LIVES).replace("WHERE user_id % 2 = 0)", f"WHERE user_id % 2 = 0 AND (epoch_us(ts) - {eventlog.EPOCH_US}) // {INTERVAL} IN (SELECT DISTINCT (epoch_us(ts) - {eventlog.EPOCH_US}) // {INTERVAL} AS i FROM events ORDER BY i LIMIT 2 OFFSET 3))", 1) + " SELECT user_id AS entity_id, birth_cycle AS first_cycle, last_cycle, status, stages FROM instr")
def chosen_segments(spark: SparkSession, path: str) -> DataFrame:
    """Lives of two segments alone, from an empty state."""
    t = L.of_segments(trace_format.load(spark, path, "core0"), [3, 4])
    return L.instructions(t).select("entity_id", "first_cycle", "last_cycle", "status", "stages")


# --- stored summaries ---
@query(of_core(0, _L0) + _LEVELS + " SELECT counter, CAST(level AS INTEGER) AS level, CAST(bucket // CAST(pow(4, level) AS BIGINT) AS BIGINT) AS bucket, min(lo) AS lo, max(hi) AS hi, CAST(sum(total) AS BIGINT) AS total FROM l0, lev, top WHERE level <= top.n GROUP BY 1, 2, 3")
def stored_counter_mipmap(spark: SparkSession, path: str) -> DataFrame:
    cols = [F.col(c).cast("long").alias(c) for c in ("lo", "hi", "total")]
    return _table(spark, path, "counter_mipmap").select("counter", "level", "bucket", *cols)


@query(of_core(0, _L0) + _LEVELS + " SELECT CAST(level AS INTEGER) AS level, CAST(bucket // CAST(pow(4, level) AS BIGINT) AS BIGINT) AS bucket, CAST(sum(births) AS BIGINT) AS births FROM d0, lev, top WHERE level <= top.n GROUP BY 1, 2")
def stored_density_mipmap(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "density_mipmap").select("level", "bucket", "births")


@query(
    of_core(0, _L0)
    + f""" SELECT event_type AS counter, CAST(sum(delta) FILTER (cycle <= {AT}) AS BIGINT) AS value, 'samples' AS source FROM ev WHERE event_type <> 'view' GROUP BY 1
    UNION ALL SELECT 'view', CAST(sum(CASE WHEN bucket < {AT // M.BASE} THEN total WHEN bucket = {AT // M.BASE} THEN total * {AT % M.BASE} // {M.BASE} ELSE 0 END) AS BIGINT), 'summary' FROM l0 WHERE counter = 'view'"""
)
def counter_value_dispatch(spark: SparkSession, path: str) -> DataFrame:
    """Samples where there are any; the counter without samples is read from the file's summary."""
    t = trace_format.load(spark, path, "core0")
    t.ops = t.ops.where(F.col("storage_id") != t.schema.storage("view").storage_id)
    return K.best_value_at(t, AT, _table(spark, path, "counter_mipmap")).select("counter", "value", "source")


@query("SELECT TRUE AS same, TRUE AS done, FALSE AS empty")
def summary_embedded_again(spark: SparkSession, path: str) -> DataFrame:
    """A summary that is embedded a second time leaves the same bytes; an empty one changes nothing."""
    with open(path, "rb") as f:
        before = f.read()
    done = embed_summary(path, sink.build_summary(trace_format.load(spark, path, "core0")))
    empty = embed_summary(path, codec.Summary())
    with open(path, "rb") as f:
        same = f.read() == before
    return spark.createDataFrame([(same, done, empty)], "same boolean, done boolean, empty boolean")


# --- files that are being written ---
_ITEMS = f", i AS (SELECT t // {INTERVAL} AS seg, sum(CASE event_type WHEN 'signup' THEN 5 WHEN 'purchase' THEN 4 WHEN 'view' THEN 4 ELSE 3 END) AS items FROM ev GROUP BY 1)"


def _open_query(f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, written(spark, sf_dir, finish=False))
    ORACLE_SQL[f.__name__] = sql


def unfinished_file(spark: SparkSession, path: str) -> DataFrame:
    """Items of the committed segments but the log's numbers, found by the chain from the tail; what was not committed is not there."""
    numbers = [e.event_type_id for e in file_schema().event_types if e.name == NUMBER]
    return _table(spark, path, "items").where(F.col("event_type_id").isNull() | ~F.col("event_type_id").isin(numbers)).groupBy("seg_id").agg(F.count("*").alias("items"))


_open_query(unfinished_file, _EV + _ITEMS + " SELECT CAST(row_number() OVER (ORDER BY seg) - 1 AS INTEGER) AS seg_id, CAST(items AS BIGINT) AS items FROM i WHERE seg < (SELECT max(seg) FROM i)")


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a stream has given once all that is there was read."""
    root = f"{shared_dir(spark)}/work/stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else out.drop("batch")


@query(of_core(0, _EV) + f" SELECT event_type AS counter, cycle // {M.BASE} AS bucket, CAST(min(delta) AS BIGINT) AS lo, CAST(max(delta) AS BIGINT) AS hi, CAST(sum(delta) AS BIGINT) AS total FROM ev GROUP BY 1, 2")
def stream_counter_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Tumbling buckets of a tailed file."""
    t = trace_format.load(spark, path, "core0")
    out = _streamed(spark, live.counter_buckets(live.items(spark, path), t.schema, t.period_ps), "complete")
    return out.select("counter", "bucket", *[F.col(c).cast("long").alias(c) for c in ("lo", "hi", "total")])


@query(of_core(1, _EV) + f" SELECT CASE event_type WHEN 'error' THEN 'flush' ELSE 'stage_transition' END AS event, cycle // {M.BASE} AS bucket, count(*) AS n FROM ev WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, path: str) -> DataFrame:
    t = trace_format.load(spark, path, "core1")
    return _streamed(spark, live.event_counts(live.items(spark, path), t.schema, t.period_ps), "complete").where("event in ('flush', 'stage_transition')").select("event", "bucket", "n")


@query(of_core(0, _EV) + ", o AS (SELECT *, lag(event_type) OVER w AS before, lag(cycle) OVER w AS born FROM ev WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id AS entity_id, born AS born_cycle, cycle AS died_cycle FROM o WHERE event_type = 'purchase' AND before = 'signup'")
def stream_lives(spark: SparkSession, path: str) -> DataFrame:
    """Lives of a tailed file, with a row of state for each occupied slot; in order of the log's numbers within what a batch brings."""
    t = trace_format.load(spark, path, "core0")
    return _streamed(spark, live.lives(by_number(live.items(spark, path), t.schema), t.schema, t.period_ps), "append").select("entity_id", "born_cycle", "died_cycle")


# --- on the log itself ---
def _log_query(sql: str):
    def wrap(f: Callable[[Trace], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(eventlog.load(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


@_log_query(
    _EV
    + f""", d AS (SELECT seq, cycle, lag(user_id) OVER (PARTITION BY k ORDER BY seq) AS producer, user_id AS consumer FROM ev)
    SELECT 'arrow' AS kind, cycle, producer AS entity_id, consumer AS other, 'raw' AS label FROM d WHERE producer IS NOT NULL AND cycle >= {AT} AND cycle < {AT + 600}
    UNION ALL SELECT 'flush', cycle, user_id, NULL, 'unknown(0x0)' FROM ev WHERE event_type = 'error' AND cycle >= {AT} AND cycle < {AT + 600}"""
)
def gantt_marks(t: Trace) -> DataFrame:
    return L.gantt_marks(t, AT, AT + 600).select("kind", "cycle", "entity_id", "other", "label")


@_log_query(
    _EV
    + f""", c AS (SELECT event_type AS counter, coalesce(sum(delta) FILTER (cycle <= {AT}), 0) AS total, coalesce(sum(delta) FILTER (cycle <= {AT} AND cycle > {AT - 600}), 0) / 600.0 AS rate, coalesce(sum(delta) FILTER (cycle = {AT}), 0) AS step FROM ev GROUP BY 1)
    SELECT counter, unnest(['total', 'rate', 'delta']) AS mode, round(unnest([total, rate, step]::DOUBLE[]), 6) AS value FROM c"""
)
def counter_display(t: Trace) -> DataFrame:
    parts = [K.shown(t, AT, mode, 600) for mode in (K.TOTAL, K.RATE, K.DELTA)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("value", F.round("value", 6))


@_log_query(
    _EV
    + ", p AS (SELECT unnest(range(0, 43201, 43)) AS cycle UNION SELECT 43200), c AS (SELECT DISTINCT event_type AS counter FROM ev) SELECT c.counter, CAST(p.cycle AS BIGINT) AS cycle, CAST(coalesce((SELECT sum(delta) FROM ev e WHERE e.event_type = c.counter AND e.cycle <= p.cycle), 0) AS BIGINT) AS value FROM p CROSS JOIN c"
)
def counter_series_sampled(t: Trace) -> DataFrame:
    """About a thousand points of a long range, the end always one."""
    return K.series(t, 0, 43_200).select("counter", "cycle", "value")


@_log_query(_EV + ", s AS (SELECT event_type AS counter, max(cycle) AS c, CAST(sum(delta) AS BIGINT) AS cum FROM ev GROUP BY 1) SELECT counter, CAST(100000 AS BIGINT) AS cycle, cum FROM s WHERE c < 100000")
def counter_terminal(t: Trace) -> DataFrame:
    return K.with_terminal(t, 100_000).where("cycle = 100000").select("counter", "cycle", "cum")


def _inline(name: str, f: Callable[[SparkSession], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(spark)
    ORACLE_SQL[name] = sql


def _leb128(spark: SparkSession) -> DataFrame:
    values = [(1 << k) - 1 for k in range(63)] + [1 << k for k in range(63)]
    rows = [(v, len(b := codec.leb128(v)), codec.read_leb128(b)[0]) for v in values]
    return spark.createDataFrame(rows, "value long, bytes int, back long").distinct()


_inline("leb128_round_trip", _leb128, "WITH v AS (SELECT CAST(power(2::HUGEINT, k) AS HUGEINT) - 1 AS value FROM range(63) t(k) UNION SELECT CAST(1 AS HUGEINT) << CAST(k AS INTEGER) FROM range(63) t(k)) SELECT CAST(value AS BIGINT) AS value, CAST(greatest(1, ceil(length(ltrim(bin(CAST(value AS BIGINT)), '0')) / 7.0)) AS INTEGER) AS bytes, CAST(value AS BIGINT) AS back FROM v")
_inline("synthetic_births", lambda spark: L.instructions(synth.generate(spark, 2000, counters=3), attributes=True).select("entity_id", "first_cycle", F.col("pc").cast("long").alias("pc")), "SELECT CAST(i AS BIGINT) AS entity_id, CAST(i // 4 AS BIGINT) AS first_cycle, CAST(2147483648 + 4 * i AS BIGINT) AS pc FROM range(2000) t(i)")
