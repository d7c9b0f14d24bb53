"""Decides once, before any row, how each source column is represented in its target column.

Plans are driver-side values; ``compile_plan`` turns them into column expressions, so Catalyst sees
one projection and rows never meet a lookup.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import convert, digest
from .manifest import CHARSET_TO, LEVELS, RISKS, Capability, manifest_digest
from .types import FieldDefinition


@dataclass(frozen=True)
class Plan:
    lineage: str
    target: str
    status: str
    code: str
    rule: str | None = None
    capability: str | None = None
    level: str = "UNSUPPORTED"
    risk: str = "CRITICAL"
    parameters: dict = field(default_factory=dict)
    loss: dict = field(default_factory=dict)
    input_digest: str = ""
    manifest_digest: str = ""
    digest: str = ""


def loss(level: str, key_like: bool) -> dict:
    """What a level may lose: value, comparison, ordering, constraints."""
    full = level == "UNSUPPORTED"
    explicit = level == "EXPLICIT_CONVERSION"
    return {"value": full or explicit, "comparison": full or (explicit and key_like), "ordering": full or (explicit and key_like), "constraints": full or explicit}


def contains(source: FieldDefinition, target: FieldDefinition) -> bool:
    """Whether every value of the source type is one of the target type."""
    s, t = source.type, target.type
    if s.family == "integer" and t.family == "integer":
        a, b = convert.integer_bounds(s.bits, bool(s.signed)), convert.integer_bounds(t.bits, bool(t.signed))
        return b[0] <= a[0] and a[1] <= b[1]
    if s.family == "decimal" and t.family == "decimal":
        return t.scale >= s.scale and t.precision - t.scale >= s.precision - s.scale
    if s.family == "float":
        return t.bits >= s.bits
    if s.family == "text":
        fits = t.length is None or (s.length is not None and s.length * (4 if s.unit == "characters" and t.unit == "bytes" else 1) <= t.length)
        return t.charset in CHARSET_TO.get(s.charset, ()) and fits
    if s.family in ("binary", "bit_string"):
        return t.length is None or (s.length is not None and s.length <= t.length and (s.profile == t.profile or t.profile == "variable"))
    if s.family in ("enum", "set"):
        return s.members == t.members
    if s.family in ("instant", "local_datetime", "duration", "local_time", "offset_time"):
        return (t.precision or 0) >= (s.precision or 0)
    return s.profile == t.profile or s.profile is None or t.profile is None


def _qualifies(c: Capability, s: FieldDefinition, t: FieldDefinition) -> bool:
    if c.source != s.type.family or c.target != t.type.family:
        return False
    if any(op not in c.operations for op in s.operations) and c.operations or any(p not in c.presences for p in s.presences) and c.presences:
        return False
    if c.widen == "contains":
        return contains(s, t)
    if c.widen == "uuid_text":
        return (t.type.length or 36) >= 36
    if c.widen == "unsigned64":
        return s.type.signed is False and s.type.bits == 64 and t.type.precision - (t.type.scale or 0) >= 20
    return True


def _gates(s: FieldDefinition, t: FieldDefinition) -> str | None:
    if (s.key_ordinal is None) != (t.key_ordinal is None) or s.key_ordinal != t.key_ordinal:
        return "target_capability.primary_key_mismatch"
    if s.key_ordinal is not None and s.collation and t.collation and s.collation != t.collation:
        return "target_capability.key_collation_mismatch"
    if s.generated != t.generated:
        return "compatibility.invalid_field_definition"
    if s.nullable and not t.nullable:
        return "compatibility.invalid_field_definition"
    return None


def _options(c: Capability, given: dict) -> tuple[dict, str | None]:
    out = {}
    for o in c.options:
        v = given.get(o.name, o.default)
        if v is None and o.required:
            return {}, "target_capability.missing_parameters"
        if v is not None and o.allowed and v not in o.allowed:
            return {}, "target_capability.invalid_parameters"
        if v is not None:
            out[o.name] = v
    return out, None


def _parameters(c: Capability, s: FieldDefinition, t: FieldDefinition, options: dict) -> dict:
    p = dict(options)
    if c.rule == "integer_range":
        p |= {"bits": t.type.bits, "signed": bool(t.type.signed)}
    elif c.rule == "decimal_range":
        p |= {"precision": t.type.precision, "scale": t.type.scale}
    elif c.rule == "text":
        p |= {"charset": {"UTF8": "utf8mb4"}.get(t.type.charset, t.type.charset), "length": t.type.length, "unit": t.type.unit or "characters"}
    elif c.rule == "binary_pad":
        p |= {"length": t.type.length}
    elif c.rule == "local_to_instant":
        sign, hours, minutes = options["offset"][0], *map(int, options["offset"][1:].split(":"))
        seconds = (hours * 3600 + minutes * 60) * (-1 if sign == "-" else 1)
        p |= {"offset_seconds": seconds if s.type.family == "local_datetime" else -seconds, "precision": 6 if t.type.precision is None else t.type.precision}
    elif c.rule == "json_text":
        p |= {"charset": {"UTF8": "utf8mb4"}.get(t.type.charset, t.type.charset or "utf8mb4"), "length": t.type.length, "unit": t.type.unit or "characters"}
    elif c.carrier:
        p |= {"length": t.type.length}
    return p


def plan_field(source: FieldDefinition, target: FieldDefinition, manifest: list[Capability], options: dict | None = None, choice: str | None = None, confirmed: set[str] = frozenset()) -> Plan:
    """Ranks what qualifies by level, risk and code and makes the plan. A capability is taken if it
    alone is exact and no carrier, if it alone is left, or if ``choice`` names it. ``confirmed``
    holds digests of plans whose risk was accepted."""
    inputs = digest.stable({"source": asdict(source), "target": asdict(target), "options": options or {}})
    base = Plan(source.lineage or source.name, target.name, "UNSUPPORTED", "target_capability.no_qualified_representation", input_digest=inputs, manifest_digest=manifest_digest(manifest))
    base = replace(base, loss=loss("UNSUPPORTED", source.key_ordinal is not None))
    if gate := _gates(source, target):
        return replace(base, status="BLOCKED", code=gate)
    found = sorted((c for c in manifest if _qualifies(c, source, target)), key=lambda c: (LEVELS.index(c.level), RISKS.index(c.risk), c.code))
    if source.key_ordinal is not None:
        lossy = [c for c in found if not c.allows_key]
        found = [c for c in found if c.allows_key]
        if lossy and not found:
            return replace(base, status="BLOCKED", code="target_capability.lossy_key_conversion")
    if not found:
        return base
    exact = [c for c in found if c.level == "EXACT" and not c.carrier]
    if choice:
        picked = next((c for c in found if c.code == choice), None)
        if picked is None:
            return base
    elif len(exact) == 1:
        picked = exact[0]
    elif all(c.carrier for c in found):
        return replace(base, status="NEEDS_CONFIGURATION", code="target_capability.explicit_carrier_selection_required")
    elif len(found) == 1 or LEVELS.index(found[0].level) < LEVELS.index(found[1].level):
        picked = found[0]
    else:
        return replace(base, status="NEEDS_CONFIGURATION", code="target_capability.multiple_candidates")
    given, wrong = _options(picked, options or {})
    if wrong:
        return replace(base, status="NEEDS_CONFIGURATION", code=wrong, capability=picked.code, rule=picked.rule)
    plan = replace(base, rule=picked.rule, capability=picked.code, level=picked.level, risk=picked.risk, parameters=_parameters(picked, source, target, given), loss=loss(picked.level, source.key_ordinal is not None))
    plan = replace(plan, digest=plan_digest(plan))
    if picked.confirm and plan.digest not in confirmed:
        return replace(plan, status="NEEDS_CONFIRMATION", code="target_capability.confirmation_required")
    return replace(plan, status="COMPATIBLE", code="target_capability.qualified")


def plan_digest(plan: Plan) -> str:
    return digest.stable({k: v for k, v in asdict(plan).items() if k not in ("digest", "status", "code")})


def plan_table(sources: list[FieldDefinition], targets: list[FieldDefinition], manifest: list[Capability], options: dict[str, dict] | None = None, confirmed: set[str] = frozenset()) -> list[Plan]:
    """The plans of a table's columns; a source column without a target is unsupported."""
    if not any(s.key_ordinal is not None for s in sources):
        raise ValueError("target_capability.primary_key_required")
    by_name = {t.name: t for t in targets}
    out = []
    for s in sources:
        if s.name in by_name:
            out.append(plan_field(s, by_name[s.name], manifest, (options or {}).get(s.name), None, confirmed))
        else:
            out.append(Plan(s.lineage or s.name, "", "UNSUPPORTED", "compatibility.field_not_in_transaction"))
    return out


def plan_transaction(transactions: DataFrame, sources: list[FieldDefinition], targets: list[FieldDefinition], manifest: list[Capability], options: dict[str, dict] | None = None) -> list[Plan]:
    """plan_table for the operations and presences that transactions show for each column."""
    rows = transactions.select(F.explode("changes").alias("c"))
    data = rows.select("c.operation", F.explode(F.concat(*(F.coalesce(F.col(f"c.{n}"), F.expr("array()").cast(transactions.schema["changes"].dataType.elementType["after"].dataType)) for n in ("before", "after")))).alias("d"))
    seen = {r["name"]: r for r in data.groupBy("d.name").agg(F.sort_array(F.collect_set("operation")).alias("ops"), F.sort_array(F.collect_set("d.presence")).alias("there")).collect()}
    used = [replace(s, operations=tuple(seen[s.name]["ops"]), presences=tuple(seen[s.name]["there"])) for s in sources if s.name in seen]
    return plan_table(used, targets, manifest, options)


def stale(plan: Plan, source: FieldDefinition, target: FieldDefinition, manifest: list[Capability], options: dict | None = None) -> str | None:
    """Why a saved plan no longer holds, or None."""
    if plan_digest(plan) != plan.digest:
        return "compatibility.plan_digest_mismatch"
    if plan.manifest_digest != manifest_digest(manifest):
        return "compatibility.target_probe_changed"
    if digest.stable({"source": asdict(source), "target": asdict(target), "options": options or {}}) != plan.input_digest:
        return "compatibility.plan_inputs_changed"
    return None


def uncovered(columns: DataFrame, plans: DataFrame, on: list[str]) -> DataFrame:
    """Columns without a plan."""
    return columns.join(plans, on, "left_anti").withColumn("rule_code", F.lit("target_capability.plan_missing_for_column"))


def best_candidates(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate of each field by level, risk and code; levels and risks are ranks."""
    w = Window.partitionBy(*by).orderBy("qualification_rank", "risk_rank", "code")
    return candidates.withColumn("choice", F.row_number().over(w)).filter("choice = 1").drop("choice")


def compile_plan(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    """rows with each planned column converted, and ``conversion_failures``: array of struct<column, code>."""
    values, failures = {}, []
    for p in plans:
        if p.status != "COMPATIBLE":
            raise ValueError(f"target_capability.unsupported_plan: {p.lineage}")
        if p.rule not in convert.RULES:
            raise ValueError("target_capability.unknown_conversion_rule")
        got = convert.RULES[p.rule](F.col(p.lineage), p.parameters)
        values[p.target] = got["value"]
        failures.append(F.when(got["code"].isNotNull(), F.struct(F.lit(p.lineage).alias("column"), got["code"].alias("code"))))
    return rows.withColumns({"conversion_failures": F.array_compact(F.array(*failures)), **values})


def reject_failures(rows: DataFrame) -> DataFrame:
    """rows without ``conversion_failures``, failing on the first that has one."""
    first = F.concat_ws(": ", F.lit("target_apply.conversion_failed"), F.col("conversion_failures")[0]["column"], F.col("conversion_failures")[0]["code"])
    return rows.filter(F.when(F.size("conversion_failures") > 0, F.raise_error(first).isNull()).otherwise(True)).drop("conversion_failures")
