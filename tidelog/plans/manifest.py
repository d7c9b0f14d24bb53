"""Release-owned capabilities: which source types a target may hold, and by which rule."""

from __future__ import annotations

from collections import Counter
from dataclasses import asdict, dataclass

from ..functions import digest

LEVELS = ("EXACT", "RANGE_CHECKED", "EXPLICIT_CONVERSION", "UNSUPPORTED")
RISKS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Option:
    name: str
    allowed: tuple[str, ...] = ()
    default: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Capability:
    """A source family, a target family and the rule between them. ``widen`` names how parameters
    must relate for the rule to qualify; empty operations and presences mean any."""

    code: str
    source: str
    target: str
    rule: str
    level: str
    risk: str
    widen: str = "any"
    allows_key: bool = True
    carrier: bool = False
    confirm: bool = False
    options: tuple[Option, ...] = ()
    operations: tuple[str, ...] = ()
    presences: tuple[str, ...] = ()


#: Charset lattice: what each set's texts may be written to without loss; fixed values.
CHARSET_TO = {"ascii": ("ascii", "latin1", "utf8", "utf8mb4", "UTF8"), "latin1": ("latin1",), "utf8": ("utf8", "utf8mb4", "UTF8"), "utf8mb4": ("utf8mb4", "UTF8"), "UTF8": ("UTF8", "utf8mb4")}

_TEXT = (Option("target_charset", required=True), Option("target_length", required=True), Option("target_length_unit", ("characters", "bytes"), required=True), Option("target_collation", required=True), Option("policy", ("strict",), "strict"))
_TIME = (Option("strategy", ("fixed_offset",), required=True), Option("offset", required=True), Option("precision_policy", ("reject",), "reject"))
#: What each target family holds exactly: source families by themselves, or (source, target); fixed values.
_EXACT = {
    "mysql": (("boolean", "integer"), "integer", "decimal", "float", "text", "binary", "bit_string", "date", "local_datetime", "instant", "duration", "year", "json", "enum", "set", "spatial"),
    "postgresql": ("boolean", "integer", "decimal", "float", "text", "binary", "bit_string", "date", "local_datetime", "instant", "calendar_interval", "uuid", "json", "enum", "struct", "array_with_metadata", "range", "multi_range", "map", "domain", "xml", "network", "spatial"),
}


def build(connector: str) -> list[Capability]:
    """The capabilities of a target family: exact representations, their range-checked forms for
    targets that are narrower, explicit conversions, and carriers."""
    out = []
    for pair in _EXACT[connector]:
        source, target = (pair, pair) if isinstance(pair, str) else pair
        out.append(Capability(f"{connector}.exact.{source}", source, target, "exact", "EXACT", "NONE", "contains"))
    if connector == "mysql":
        out.append(Capability("mysql.exact.uuid", "uuid", "text", "exact", "EXACT", "LOW", "uuid_text", allows_key=False))
    else:
        out.append(Capability("postgresql.exact.unsigned64", "integer", "decimal", "exact", "EXACT", "LOW", "unsigned64"))
    for family, rule in (("integer", "integer_range"), ("decimal", "decimal_range"), ("float", "float_narrow"), ("text", "text"), ("binary", "binary_pad")):
        out.append(Capability(f"{connector}.range.{family}", family, family, rule, "RANGE_CHECKED", "MEDIUM", allows_key=False, confirm=True))
    out.append(Capability(f"{connector}.explicit.text", "text", "text", "text", "EXPLICIT_CONVERSION", "HIGH", allows_key=False, confirm=True, options=_TEXT))
    out.append(Capability(f"{connector}.explicit.json_text", "json", "text", "json_text", "EXPLICIT_CONVERSION", "HIGH", allows_key=False, confirm=True, options=_TEXT))
    for a, b in (("local_datetime", "instant"), ("instant", "local_datetime")):
        out.append(Capability(f"{connector}.explicit.{a}_{b}", a, b, "local_to_instant", "EXPLICIT_CONVERSION", "HIGH", allows_key=False, confirm=True, options=_TIME))
    for family in ("array_with_metadata", "struct", "map", "range", "multi_range", "domain", "network", "xml"):
        out.append(Capability(f"{connector}.carrier.value.{family}", family, "text", "logical_value_carrier", "EXPLICIT_CONVERSION", "HIGH", allows_key=False, carrier=True, confirm=True))
    out.append(Capability(f"{connector}.carrier.source", "raw", "binary", "source_representation_carrier", "EXPLICIT_CONVERSION", "CRITICAL", allows_key=False, carrier=True, confirm=True))
    return out


def manifest_digest(entries: list[Capability]) -> str:
    return digest.stable([asdict(e) for e in sorted(entries, key=lambda e: e.code)])


def problems(entries: list[Capability]) -> list[str]:
    """What is wrong with a manifest: codes used twice, unknown levels or risks."""
    out = [f"duplicate:{c}" for c, n in Counter(e.code for e in entries).items() if n > 1]
    out += [f"level:{e.code}" for e in entries if e.level not in LEVELS]
    return out + [f"risk:{e.code}" for e in entries if e.risk not in RISKS]
