"""Logical types from native declarations, and the predicates they make."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert
from ..storage import settle

CHARSETS = ("utf8mb4", "utf8", "latin1", "ascii")
_DECL = re.compile(r"\s*([a-z][a-z0-9_ ]*?)\s*(?:\((.*)\))?\s*((?:unsigned|zerofill|signed|\s)*)\s*$", re.I | re.S)
#: Bits of integer types; fixed values.
MYSQL_INT = {"tinyint": 8, "bool": 8, "boolean": 8, "smallint": 16, "mediumint": 24, "int": 32, "integer": 32, "bigint": 64}
PG_INT = {"smallint": 16, "int2": 16, "integer": 32, "int4": 32, "bigint": 64, "int8": 64}
TEXT_BYTES = {"tinytext": 255, "text": 65_535, "mediumtext": 16_777_215, "longtext": 4_294_967_295}
BLOB_BYTES = {"tinyblob": 255, "blob": 65_535, "mediumblob": 16_777_215, "longblob": 4_294_967_295}
SPATIAL = ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection", "geomcollection")


@dataclass(frozen=True)
class LogicalType:
    """A family and its parameters; absent ones are None."""

    family: str
    bits: int | None = None
    signed: bool | None = None
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    unit: str | None = None
    charset: str | None = None
    members: tuple[str, ...] | None = None
    profile: str | None = None
    element: LogicalType | None = None

    def lean(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def members(text: str) -> tuple[str, ...]:
    """The quoted members of an ENUM or SET declaration; '' is a quote."""
    out, at = [], 0
    for m in re.finditer(r"\s*'((?:[^'\\]|''|\\.)*)'\s*(,|$)", text, re.S):
        if m.start() != at:
            raise ValueError("source_contract.type_mapping_mismatch")
        out.append(re.sub(r"\\(.)", r"\1", m[1].replace("''", "'")))
        at = m.end()
    if at != len(text) or not out:
        raise ValueError("source_contract.type_mapping_mismatch")
    return tuple(out)


def mysql_type(declaration: str, charset: str | None = None, version: str = "8.0") -> LogicalType:
    """The logical type of a MySQL column declaration."""
    m = _DECL.match(declaration)
    if not m:
        raise ValueError("source_contract.type_mapping_mismatch")
    name, args, rest = m[1].lower().strip(), m[2], m[3].lower()
    for word in ("unsigned", "zerofill", "signed"):
        if name.endswith(" " + word):
            name, rest = name[: -len(word) - 1].strip(), rest + " " + word
    unsigned = "unsigned" in rest or "zerofill" in rest
    if name in ("enum", "set"):
        return LogicalType(name, members=members(args or ""))
    n = [int(x) for x in args.split(",")] if args else []
    if name in MYSQL_INT:
        return LogicalType("integer", bits=MYSQL_INT[name], signed=not unsigned)
    if name in ("decimal", "numeric", "dec", "fixed"):
        p, s = (n + [0])[:2] if n else (10, 0)
        if not (1 <= p <= 65 and 0 <= s <= min(30, p)):
            raise ValueError("source_contract.type_mapping_mismatch")
        return LogicalType("decimal", precision=p, scale=s)
    if name in ("float", "double", "real", "double precision"):
        single = name == "float" and (len(n) != 1 or n[0] <= (24 if version.startswith("8.0") else 23))
        return LogicalType("float", bits=32 if single else 64)
    if name in ("char", "varchar"):
        if charset is None:
            raise ValueError("source_contract.type_mapping_mismatch")
        return LogicalType("text", length=n[0] if n else 1, unit="characters", charset=charset)
    if name in TEXT_BYTES:
        if charset is None:
            raise ValueError("source_contract.type_mapping_mismatch")
        return LogicalType("text", length=TEXT_BYTES[name], unit="bytes", charset=charset)
    if name in ("binary", "varbinary"):
        return LogicalType("binary", length=n[0] if n else 1, profile="fixed" if name == "binary" else "variable")
    if name in BLOB_BYTES:
        return LogicalType("binary", length=BLOB_BYTES[name], profile="variable")
    if name == "bit":
        return LogicalType("bit_string", length=n[0] if n else 1, profile="lsb")
    simple = {"date": "date", "datetime": "local_datetime", "timestamp": "instant", "time": "duration", "year": "year", "json": "json"}
    if name in simple:
        timed = name in ("datetime", "timestamp", "time")
        return LogicalType(simple[name], precision=(n[0] if n else 0) if timed else None, profile="jsonb" if name == "json" else None)
    if name in SPATIAL:
        return LogicalType("spatial", profile=name)
    raise ValueError("source_contract.type_mapping_mismatch")


def pg_type(declaration: str, catalog: dict[str, dict] | None = None, depth: int = 0) -> LogicalType:
    """The logical type of a PostgreSQL type name; ``catalog`` maps user types to
    {kind, of | labels | base | subtype}. Unknown base types are raw."""
    if depth > 64:
        raise ValueError("source_contract.type_mapping_mismatch")
    text = declaration.strip().lower()
    if text.endswith("[]"):
        return LogicalType("array_with_metadata", element=pg_type(text[:-2], catalog, depth + 1))
    m = re.fullmatch(r"([a-z_][a-z0-9_. ]*?)\s*(?:\(([-\d, ]+)\))?\s*(with(?:out)? time zone|varying)?(?:\s*\((\d+)\))?", text)
    if not m:
        raise ValueError("source_contract.type_mapping_mismatch")
    name, zone = m[1], m[3]
    n = [int(x) for x in (m[2] or m[4] or "").split(",") if x.strip()]
    if name.endswith(" varying"):
        name, zone = name[:-8], "varying"
    for z in ("with time zone", "without time zone"):
        if name.endswith(" " + z):
            name, zone = name[: -len(z) - 1], z
    if name in PG_INT:
        return LogicalType("integer", bits=PG_INT[name], signed=True)
    if name in ("oid", "xid", "cid", "xid8"):
        return LogicalType("integer", bits=64 if name == "xid8" else 32, signed=False)
    if name in ("numeric", "decimal"):
        return LogicalType("decimal", precision=n[0], scale=n[1] if len(n) > 1 else 0) if n else LogicalType("decimal_unbounded")
    if name in ("real", "float4", "double precision", "float8", "double"):
        return LogicalType("float", bits=32 if name in ("real", "float4") else 64)
    if name in ("text", "name", "varchar", "character", "char", "bpchar"):
        return LogicalType("text", length=n[0] if n else None, unit="characters", charset="UTF8")
    if name in ("bit", "varbit"):
        return LogicalType("bit_string", length=n[0] if n else 1, profile="variable" if zone == "varying" or name == "varbit" else "msb")
    if name in ("timestamp", "timestamptz"):
        return LogicalType("instant" if zone == "with time zone" or name == "timestamptz" else "local_datetime", precision=n[0] if n else 6)
    if name in ("time", "timetz"):
        return LogicalType("offset_time" if zone == "with time zone" or name == "timetz" else "local_time", precision=n[0] if n else 6)
    plain = {"boolean": "boolean", "bool": "boolean", "bytea": "binary", "uuid": "uuid", "xml": "xml", "date": "date", "interval": "calendar_interval", "hstore": "map", "geometry": "spatial", "geography": "spatial", "inet": "network", "cidr": "network", "macaddr": "network", "macaddr8": "network"}
    if name in plain:
        return LogicalType(plain[name], profile=name if plain[name] in ("network", "spatial") else None)
    if name in ("json", "jsonb"):
        return LogicalType("json", profile=name)
    known = (catalog or {}).get(name)
    if known:
        kind = known["kind"]
        if kind == "enum":
            return LogicalType("enum", members=tuple(known["labels"]))
        if kind in ("domain", "range", "multirange"):
            return LogicalType({"multirange": "multi_range"}.get(kind, kind), element=pg_type(known["of"], catalog, depth + 1))
        if kind == "composite":
            return LogicalType("struct", members=tuple(f"{f}:{t}" for f, t in known["fields"]))
    return LogicalType("raw", profile=name)


def type_closure(types: DataFrame, roots: DataFrame, child: str = "type_name", parent: str = "uses") -> DataFrame:
    """All types that the roots use, directly or not: a frontier joined to the catalog until it
    is empty. The catalog is small; the frontier is checked for new names at each turn."""
    found = frontier = settle(roots.select(F.col(child), F.lit(0).alias("depth")))
    for depth in range(1, 65):
        step = types.join(frontier.select(F.col(child)), child).select(F.col(parent).alias(child)).filter(F.col(child).isNotNull()).distinct()
        frontier = settle(step.join(found.select(child), child, "left_anti").select(child, F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def holds(t: LogicalType, x: Column) -> Column:
    """Whether a typed column's values belong to a logical type."""
    if t.family == "integer":
        return convert.integer_fits(x, t.bits, bool(t.signed))
    if t.family == "decimal":
        return convert.decimal_fits(x, min(t.precision, 38), t.scale)
    if t.family == "text":
        charset = {"UTF8": "utf8mb4"}.get(t.charset, t.charset)
        return convert.text_fits(x, charset, t.length, t.unit or "characters")
    if t.family == "binary":
        return F.octet_length(x) <= t.length if t.length else F.lit(True)
    if t.family == "enum":
        return convert.enum_fits(x, list(t.members))
    if t.family == "set":
        return convert.set_fits(x, list(t.members))
    if t.family in ("instant", "local_datetime") and t.precision is not None and t.precision < 6:
        return convert.precision_fits(F.unix_micros(x.cast("timestamp")), t.precision)
    return F.lit(True)


@dataclass
class FieldDefinition:
    """One column as the planner sees it."""

    name: str
    ordinal: int
    native_type: str
    type: LogicalType
    nullable: bool = True
    key_ordinal: int | None = None
    generated: bool = False
    collation: str | None = None
    lineage: str = ""
    operations: tuple[str, ...] = ("insert", "update", "delete")
    presences: tuple[str, ...] = field(default_factory=tuple)
