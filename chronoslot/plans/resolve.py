"""What a schema means: cores, clocks, stages, counters, buffers."""

from __future__ import annotations

from dataclasses import replace

from .trace import DEFAULT_PERIOD_PS, Schema, Scope, Storage

REQUIRED_EVENTS = ("stage_transition",)


class ProtocolError(ValueError):
    """The schema lacks what the protocol needs."""


def cores(schema: Schema) -> list[Scope]:
    """All scopes of the cpu protocol."""
    return [s for s in schema.scopes if s.protocol == "cpu"]


def core_scope(schema: Schema, name: str | None = None) -> Scope:
    for s in cores(schema):
        if name is None or s.name == name:
            return s
    raise ProtocolError("no cpu scope" + (f" named {name!r}" if name else ""))


def clock_period(schema: Schema, core: str | None = None) -> int:
    """Period of the core's clock, inherited from its ancestors; an unknown one counts as the default."""
    clock = schema.clock_of(core_scope(schema, core).scope_id)
    if clock is None or clock >= len(schema.clocks):
        return DEFAULT_PERIOD_PS
    return schema.clocks[clock][1] or DEFAULT_PERIOD_PS


def entities(schema: Schema, core: str | None = None) -> Storage:
    scope = core_scope(schema, core)
    for s in schema.storages:
        if s.name == "entities" and s.scope_id == scope.scope_id:
            for f in ("entity_id", "pc"):
                if s.field_index(f) is None:
                    raise ProtocolError(f"entities has no field {f}")
            return s
    raise ProtocolError(f"no entities storage in {scope.name}")


def event_ids(schema: Schema, core: str | None = None) -> dict[str, int | None]:
    """Ids of the protocol's events; all but stage transitions may be missing."""
    scope = core_scope(schema, core)
    found = {e.name: e.event_type_id for e in schema.event_types if e.scope_id == scope.scope_id}
    for name in REQUIRED_EVENTS:
        if name not in found:
            raise ProtocolError(f"no event {name}")
    return {n: found.get(n) for n in ("stage_transition", "annotate", "dependency", "flush", "stall")}


def stage_names(schema: Schema, properties: dict[str, str]) -> list[str]:
    """From the property, else from the enum of that name."""
    text = properties.get("cpu.pipeline_stages")
    if text:
        return [s.strip() for s in text.split(",")]
    values = schema.enum("pipeline_stage")
    if values is None:
        raise ProtocolError("no pipeline stages")
    return [values[k] for k in sorted(values)]


def counters(schema: Schema, core: str | None = None) -> list[Storage]:
    scope = core_scope(schema, core)
    return [s for s in schema.counters if s.scope_id == scope.scope_id]


def buffers(schema: Schema, core: str | None = None) -> list[Storage]:
    scope = core_scope(schema, core)
    return [s for s in schema.buffers if s.scope_id == scope.scope_id]


def bound(schema: Schema, core: str | None = None) -> Schema:
    """The part of a schema that belongs to a core: its storages and event types. Ids stay; scopes, clocks and enums are all there.

    Two cores may have storages and events of the same names and entities of the same ids.
    """
    scope = core_scope(schema, core)
    return replace(schema, storages=tuple(s for s in schema.storages if s.scope_id == scope.scope_id), event_types=tuple(e for e in schema.event_types if e.scope_id == scope.scope_id))


def code_name(labels: dict[int, str] | list[str] | None, code, unknown: str = "unknown(0x%x)"):
    """Column: the label of a code, else ``unknown`` with the code in it (``stage_%d`` for stages)."""
    from pyspark.sql import functions as F

    pairs = labels.items() if isinstance(labels, dict) else enumerate(labels or [])
    out = F.format_string(unknown, code.cast("long"))
    for k, v in pairs:
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return F.when(code.isNotNull(), out)


def segment_cycles(segments, period_ps: int):
    """The segment table in cycles."""
    from pyspark.sql import functions as F

    return segments.select("trace_id", "seg_id", F.expr(f"time_start_ps div {period_ps}").alias("start_cycle"), F.expr(f"time_end_ps div {period_ps}").alias("end_cycle"))
