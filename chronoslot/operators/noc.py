"""Interconnect transactions: latency, credits, handoffs between scopes, links, congestion.

A transaction is an entity; births, stages and deaths are those of
:mod:`chronoslot.operators.lifecycle` with ``txn_id`` in place of ``entity_id``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trace import CLEAR, SET, Field, Schema, Scope, Trace
from ..plans.work import save
from .lifecycle import FLUSHED, IN_FLIGHT, instructions, running

#: Rounds of pointer doubling: chains of up to 2 ** MAX_ROUNDS hops.
MAX_ROUNDS = 40


def transactions(trace: Trace) -> Trace:
    """The trace with txn_id fields read as entity_id, so that every lifecycle and buffer operator applies."""
    as_entity = lambda f: Field("entity_id", f.type, f.enum_id) if f.name == "txn_id" else f
    storages = tuple(replace(s, fields=tuple(map(as_entity, s.fields))) for s in trace.schema.storages)
    return replace(trace, schema=replace(trace.schema, storages=storages))


def latency_histogram(lives: DataFrame, width: int, by: list[str] | None = None) -> DataFrame:
    """Finished lives by latency bucket (start of the bucket) and the given columns."""
    done = lives.where(F.col("status") != IN_FLIGHT)
    return done.groupBy(*(by or []), (F.expr(f"latency div {width}") * width).alias("latency_from")).agg(F.count("*").alias("n"))


def credit_level(events: DataFrame, port: str = "port", seq: str = "seq", step: str = "step") -> DataFrame:
    """port, seq, level after each grant (step > 0) or consume (step < 0)."""
    e = events.select(F.col(port).alias("port"), F.col(seq).alias("seq"), F.col(step).alias("step"))
    return running(e, "step", "level", keys=("port",), at="seq").select("port", "seq", F.col("level").cast("long").alias("level"))


def handoff_chains(handoffs: DataFrame, lives: DataFrame) -> DataFrame:
    """first_life, last_life, hops, latency: lives joined end to end.

    ``handoffs`` has (src, dst) life ids, ``lives`` (life, latency). A life has
    at most one predecessor. Chains are resolved by pointer doubling: each round
    joins every life with the one its pointer names, so a chain of n hops takes
    log2 n rounds. Ids are of lives and not of entities, since entities are reused.
    """
    at = lives.select("life", "latency").join(handoffs.select(F.col("dst").alias("life"), F.col("src").alias("prev")), "life", "left")
    at = at.select("life", F.coalesce("prev", "life").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("prev").isNull(), F.lit(0)).otherwise(F.col("latency")).cast("long").alias("sum"))
    at, lives = save(at, "chains"), save(lives.select("life", "latency"), "lives")
    for _ in range(MAX_ROUNDS):
        up = at.select(F.col("life").alias("head"), F.col("head").alias("head2"), F.col("hops").alias("hops2"), F.col("sum").alias("sum2"))
        at = at.join(up, "head").select("life", F.col("head2").alias("head"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("hops2") > 0).alias("moved"))
        at = save(at, "chains")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    else:
        raise ValueError("handoffs go round in a circle")
    first = lives.select(F.col("life").alias("head"), F.col("latency").alias("head_latency"))
    full = at.join(first, "head").withColumn("latency", F.col("sum") + F.col("head_latency"))
    ends = full.join(handoffs.select(F.col("src").alias("life")).distinct(), "life", "left_anti")
    return ends.select(F.col("head").alias("first_life"), F.col("life").alias("last_life"), "hops", F.col("latency").cast("long").alias("latency"))


def _births(trace: Trace) -> DataFrame:
    """trace_id, scope, txn, seq, cycle, death of each life in every catalog; ``life`` is its trace and the seq of its birth."""
    by_slot = Window.partitionBy("trace_id", "storage_id", "slot").orderBy("seq")
    out = None
    for s in trace.schema.storages:
        at = next((i for n in ("txn_id", "entity_id") if (i := s.field_index(n)) is not None), None)
        if at is None or not s.sparse or s.buffer:
            continue
        born = (F.col("action") == SET) & (F.col("field_index") == at)
        rows = trace.on(s, SET, CLEAR).where(born | (F.col("action") == CLEAR))
        rows = rows.withColumn("death", F.when(F.lead("action").over(by_slot) == CLEAR, F.lead("cycle").over(by_slot))).where(born)
        part = rows.select("trace_id", F.lit(s.scope_id).cast("long").alias("scope"), F.col("value").cast("long").alias("txn"), "seq", "cycle", "death", F.struct("trace_id", "seq").alias("life"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the trace has no catalog of transactions")
    return out


def handoff_lives(trace: Trace) -> DataFrame:
    """life, latency of the transactions of all scopes, for :func:`handoff_chains`; 0 for lives in flight."""
    return _births(trace).select("life", F.coalesce(F.col("death") - F.col("cycle"), F.lit(0)).alias("latency"))


def handoff_links(trace: Trace) -> DataFrame:
    """src, dst lives of each ``txn_handoff`` event: of the ids it names, those born last before it, since ids are reused."""
    born = _births(trace).select("trace_id", "scope", "txn", "seq", "life", F.lit(None).cast("string").alias("side"))
    field = lambda i: F.col("fields")[i].cast("long")
    events = trace.event("txn_handoff").select("trace_id", "seq", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), field(i).alias("scope"), field(i + 1).alias("txn")) for side, i in (("src", 0), ("dst", 2))])).alias("e"))
    ends = events.select("trace_id", "e.scope", "e.txn", "seq", F.lit(None).cast(born.schema["life"].dataType).alias("life"), "e.side")
    before = Window.partitionBy("trace_id", "scope", "txn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = born.unionByName(ends).withColumn("life", F.last("life", ignorenulls=True).over(before)).where("side is not null")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("life"))).alias(s)
    return named.groupBy("trace_id", "seq").agg(side("src"), side("dst")).where("src is not null and dst is not null").select("src", "dst").distinct()


def catalog_scope(schema: Schema, scope_id: int, protocol: str = "noc") -> Scope | None:
    """The nearest scope of ``protocol`` from a scope upwards: the catalog of a router's transactions."""
    by_id = {s.scope_id: s for s in schema.scopes}
    seen: set[int] = set()
    while scope_id in by_id and scope_id not in seen:
        if by_id[scope_id].protocol == protocol:
            return by_id[scope_id]
        seen.add(scope_id)
        scope_id = by_id[scope_id].parent
    return None


def positions(ports: DataFrame, dim_x: int, port: str = "port") -> DataFrame:
    """``ports`` with x and y in a mesh of ``dim_x`` columns."""
    return ports.withColumn("x", F.pmod(F.col(port), F.lit(dim_x)).cast("int")).withColumn("y", F.floor(F.col(port) / dim_x).cast("int"))


def link_utilization(beats: DataFrame, link_bytes: int, bucket: int, link: str = "link", size: str = "bytes") -> DataFrame:
    """link, bucket, bytes, utilization: bytes moved over what the link could move in the bucket's cycles."""
    g = beats.groupBy(F.col(link).alias("link"), F.expr(f"cycle div {bucket}").alias("bucket")).agg(F.sum(size).alias("bytes"))
    return g.withColumn("utilization", F.col("bytes") / F.lit(float(link_bytes * bucket)))


def congestion(decisions: DataFrame, bucket: int) -> DataFrame:
    """router, bucket, decisions, contenders: arbitration decisions and how many contended, on average."""
    return decisions.groupBy("router", F.expr(f"cycle div {bucket}").alias("bucket")).agg(F.count("*").alias("decisions"), F.avg("contenders").alias("contenders"))


def payloads(trace: Trace, event: str) -> DataFrame:
    """trace_id, seq, cycle and a typed column for each field of an event type (beat, retry, timeout, link_credit, arb_decision)."""
    from .state import typed

    kind = next((e for e in trace.schema.event_types if e.name == event), None)
    if kind is None:
        raise LookupError(f"no event {event!r}")
    return trace.event(event).select("trace_id", "seq", "cycle", *[typed(F.col("fields")[i], f.type).alias(f.name) for i, f in enumerate(kind.fields)])


def scope_properties(trace: Trace, prefix: str = "noc.") -> DataFrame:
    """scope, key, value: the trace's properties named ``noc.<scope path>.<key>``, or ``noc.<key>`` for all scopes of the protocol.

    The file format has properties of the whole trace only, so a scope's are told by their names.
    """
    paths = {trace.schema.scope_path(s.scope_id).replace("/", "."): trace.schema.scope_path(s.scope_id) for s in trace.schema.scopes}
    rows = []
    for name, value in trace.properties.items():
        if name.startswith(prefix):
            rest = name.removeprefix(prefix)
            own = max((p for p in paths if rest.startswith(p + ".")), key=len, default=None)
            scopes = [paths[own]] if own else [trace.schema.scope_path(s.scope_id) for s in trace.schema.scopes if (s.protocol or "").startswith("noc")]
            rows += [(s, rest.removeprefix(own + ".") if own else rest, value) for s in scopes]
    return trace.ops.sparkSession.createDataFrame(rows, "scope string, key string, value string")


def event_counts(trace: Trace, bucket: int) -> DataFrame:
    """event, bucket, n: beats, retries, timeouts, credits and decisions over time."""
    return trace.events.groupBy("event", F.expr(f"cycle div {bucket}").alias("bucket")).agg(F.count("*").alias("n"))


def summary(trace: Trace, bucket: int) -> DataFrame:
    """bucket, txn_completed, avg_latency, retries by the cycle in which transactions end."""
    i = instructions(trace, attributes=False).where(F.col("status") != IN_FLIGHT)
    done = i.groupBy("trace_id", F.expr(f"last_cycle div {bucket}").alias("bucket")).agg(F.count(F.when(F.col("status") != FLUSHED, 1)).alias("txn_completed"), F.avg("latency").alias("avg_latency"))
    retries = trace.event("retry").groupBy("trace_id", F.expr(f"cycle div {bucket}").alias("bucket")).agg(F.count("*").alias("retries"))
    return done.join(retries, ["trace_id", "bucket"], "full").na.fill({"txn_completed": 0, "retries": 0})


def occupancy_wait(lives: DataFrame, by: str = "entity_id") -> DataFrame:
    """Cycles between the end of a life and the next birth of the same entity."""
    w = Window.partitionBy("trace_id", by).orderBy("birth_seq")
    return lives.withColumn("idle", F.lead("first_cycle").over(w) - F.col("last_cycle"))
