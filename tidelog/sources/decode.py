"""Protocol decoding: texts and events of MySQL and PostgreSQL into logical values and records.

Decoders are state machines over one event at a time; ``Decoder.dump`` and ``load`` carry their state
across batches of a stream.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.types import LogicalType, mysql_type, pg_type

MAX_NESTING = 64


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decimal(text: str) -> dict:
    if text in ("NaN", "Infinity", "-Infinity"):
        return {"type": "decimal", "unscaled": text, "scale": 0}
    m = re.fullmatch(r"([+-]?)(\d*)\.?(\d*)", text)
    if not m or not (m[2] or m[3]):
        raise ValueError("logical_value.decimal")
    digits = (m[2] + m[3]).lstrip("0") or "0"
    return {"type": "decimal", "unscaled": ("-" if m[1] == "-" and digits != "0" else "") + digits, "scale": len(m[3])}


def float_bits(x: float, bits: int) -> dict:
    return {"type": "float", "bits": bits, "ieee754_hex": struct.pack(">d" if bits == 64 else ">f", x).hex()}


def _clock(text: str) -> dict:
    m = re.fullmatch(r"(\d{2,}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?", text)
    if not m:
        raise ValueError("logical_value.time")
    return {"hour": int(m[1]), "minute": int(m[2]), "second": int(m[3]), "microsecond": int((m[4] or "").ljust(6, "0"))}


def _days(text: str) -> dict:
    m = re.fullmatch(r"(\d{4,})-(\d{2})-(\d{2})", text)
    if not m:
        raise ValueError("logical_value.date")
    return {"year": int(m[1]), "month": int(m[2]), "day": int(m[3])}


def mysql_value(declaration: str, wire: object, charset: str | None = None, version: str = "8.0") -> dict:
    """The logical value of a column of a rows event, by its declaration."""
    t = mysql_type(declaration, charset, version)
    if wire is None:
        return {"type": "null"}
    if t.family == "integer":
        return {"type": "integer", "signed": t.signed, "bits": t.bits, "value": str(int(wire))}
    if t.family == "decimal":
        return decimal(str(wire))
    if t.family == "float":
        return float_bits(float(wire), t.bits)
    if t.family == "text":
        return {"type": "text", "charset": charset, "bytes": _b64(wire if isinstance(wire, bytes) else str(wire).encode())}
    if t.family == "binary":
        return {"type": "binary", "value": _b64(wire if isinstance(wire, bytes) else str(wire).encode())}
    if t.family == "bit_string":
        return {"type": "bit_string", "bit_length": t.length, "bytes": _b64(int(wire).to_bytes(-(-t.length // 8), "little")), "bit_order": "lsb"}
    if t.family == "enum":
        i = int(wire)
        if not 0 < i <= len(t.members):
            raise ValueError("logical_value.enum")
        return {"type": "enum", "value": t.members[i - 1]}
    if t.family == "set":
        mask = int(wire)
        if mask >> len(t.members):
            raise ValueError("logical_value.set")
        return {"type": "set", "value": [m for i, m in enumerate(t.members) if mask >> i & 1]}
    if t.family == "year":
        return {"type": "year", "value": int(wire)}
    if t.family == "json":
        return {"type": "json", "value": json_value(json.loads(wire, parse_float=lambda s: ("decimal", s), parse_int=lambda s: ("integer", s)))}
    if t.family == "spatial":
        raw = wire if isinstance(wire, bytes) else bytes.fromhex(wire)
        return {"type": "spatial", "format": "wkb", "srid": int.from_bytes(raw[:4], "little"), "bytes": _b64(raw[4:])}
    text = str(wire)
    try:
        if t.family == "date":
            return {"type": "date", **_real_date(_days(text))}
        if t.family == "local_datetime":
            day, _, clock = text.partition(" ")
            return {"type": "local_datetime", **_real_date(_days(day)), **_clock(clock)}
    except ValueError:
        return {"type": "invalid_temporal", "kind": t.family, "raw": text}
    if t.family == "instant":
        seconds, _, fraction = text.partition(".")
        return {"type": "instant", "seconds": int(seconds), "nanoseconds": int(fraction.ljust(9, "0") or 0)}
    sign, text = (-1, text[1:]) if text.startswith("-") else (1, text)
    c = _clock(text)
    return {"type": "duration", "negative": sign < 0, "hours": c["hour"], "minutes": c["minute"], "seconds": c["second"], "microseconds": c["microsecond"]}


def _real_date(d: dict) -> dict:
    from ..functions.values import Invalid, check

    try:
        check({"type": "date", **d})
    except Invalid as e:
        raise ValueError(str(e)) from None
    return d


def json_value(x: object) -> dict:
    """A JSON document as tagged values; numbers keep their kind and text."""
    if isinstance(x, tuple):
        return {"type": "integer", "value": x[1]} if x[0] == "integer" else {"type": "decimal", **{k: v for k, v in decimal(x[1]).items() if k != "type"}} if "e" not in x[1].lower() else {"type": "double", "value": x[1]}
    if isinstance(x, dict):
        return {"type": "object", "value": [{"name": k, "value": json_value(v)} for k, v in x.items()]}
    if isinstance(x, list):
        return {"type": "array", "value": [json_value(v) for v in x]}
    return {"type": "null"} if x is None else {"type": "boolean", "value": x} if isinstance(x, bool) else {"type": "string", "value": x}


def _split(body: str, quote: str = '"') -> list[tuple[str, bool]]:
    """The items of a comma-separated list at depth 0, and whether each was quoted."""
    out, item, quoted, at, depth, inside = [], [], False, 0, 0, False
    while at < len(body):
        c = body[at]
        if inside:
            if c == "\\":
                at += 1
                item.append(body[at])
            elif c == quote:
                if body[at + 1 : at + 2] == quote:
                    at += 1
                    item.append(quote)
                else:
                    inside = False
            else:
                item.append(c)
        elif c == quote and depth == 0:
            inside = quoted = True
        elif c == "," and depth == 0:
            out.append(("".join(item), quoted))
            item, quoted = [], False
        else:
            depth += (c in "{[(") - (c in "}])")
            item.append(body[at])
        at += 1
    out.append(("".join(item), quoted))
    return out


def pg_value(name: str, text: str | None, catalog: dict | None = None, depth: int = 0) -> dict:
    """The logical value of a column's text by its type, recursively."""
    if depth > MAX_NESTING:
        raise ValueError("logical_value.depth")
    if text is None:
        return {"type": "null"}
    t: LogicalType = pg_type(name, catalog)
    again = lambda n, s: pg_value(n, s, catalog, depth + 1)
    known = (catalog or {}).get(name.strip().lower(), {})
    if name.strip().endswith("[]"):
        return _pg_array(name.strip()[:-2], text, again)
    if t.family == "boolean":
        return {"type": "boolean", "value": text == "t"}
    if t.family == "integer":
        return {"type": "integer", "signed": t.signed, "bits": t.bits, "value": text}
    if t.family in ("decimal", "decimal_unbounded"):
        return decimal(text)
    if t.family == "float":
        return float_bits(float(text), t.bits)
    if t.family == "text":
        return {"type": "text", "charset": "UTF8", "bytes": _b64(text.encode())}
    if t.family == "binary":
        return {"type": "binary", "value": _b64(bytes.fromhex(text[2:]))}
    if t.family == "bit_string":
        padded = text.ljust(-(-len(text) // 8) * 8, "0")
        return {"type": "bit_string", "bit_length": len(text), "bytes": _b64(int(padded, 2).to_bytes(len(padded) // 8, "big")), "bit_order": "msb"}
    if t.family in ("date", "local_datetime", "instant") and text in ("infinity", "-infinity"):
        return {"type": "temporal_infinity", "kind": t.family, "negative": text[0] == "-"}
    if t.family in ("date", "local_datetime"):
        body, bc = (text[:-3], True) if text.endswith(" BC") else (text, False)
        day, _, clock = body.partition(" ")
        d = _days(day)
        d["year"] = 1 - d["year"] if bc else d["year"]
        return {"type": t.family, **d, **(_clock(clock) if t.family == "local_datetime" else {})}
    if t.family == "instant":
        return _pg_instant(text)
    if t.family in ("local_time", "offset_time"):
        m = re.fullmatch(r"([\d:.]+)([+-]\d{2}(?::\d{2}){0,2})?", text)
        return {"type": t.family, **_clock(m[1]), **({"offset_seconds": _offset(m[2])} if m[2] else {})}
    if t.family == "uuid":
        return {"type": "uuid", "value": text}
    if t.family == "json":
        return {"type": "json", "value": json_value(json.loads(text, parse_float=lambda s: ("decimal", s), parse_int=lambda s: ("integer", s)))}
    if t.family == "network":
        address, _, prefix = text.partition("/")
        return {"type": "network", "family": "ipv6" if ":" in address else "ipv4", "address": address, "prefix_length": int(prefix or (128 if ":" in address else 32))}
    if t.family == "enum":
        if text not in known["labels"]:
            raise ValueError("logical_value.enum")
        return {"type": "enum", "value": text}
    if t.family == "domain":
        return {"type": "domain", "name": name, "value": again(known["of"], text)}
    if t.family == "struct":
        items = _split(text[1:-1])
        return {"type": "struct", "value": [{"name": n, "value": again(ft, None if s == "" and not q else s)} for (n, ft), (s, q) in zip(known["fields"], items, strict=True)]}
    if t.family == "range":
        return _pg_range(known["of"], text, again)
    if t.family == "multi_range":
        return {"type": "multi_range", "value": [_pg_range(known["of"], r, again) for r in re.findall(r"[\[(][^\])]*[\])]", text)]}
    if t.family == "map":
        pair = re.findall(r'"((?:[^"\\]|\\.)*)"=>(?:"((?:[^"\\]|\\.)*)"|NULL)', text)
        raw = lambda s: {"type": "text", "charset": "UTF8", "bytes": _b64(re.sub(r"\\(.)", r"\1", s).encode())}
        return {"type": "map", "value": [{"key": raw(k), "value": raw(v)} for k, v in pair]}
    if t.family == "calendar_interval":
        return {"type": "calendar_interval", **_interval(text)}
    return {"type": "raw", "native_type": name, "payload": _b64(text.encode())}


def _offset(text: str) -> int:
    parts = [int(x) for x in text[1:].split(":")] + [0, 0]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * (-1 if text[0] == "-" else 1)


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic calendar, for any year."""
    import datetime

    cycles, y = divmod(year, 400)
    return cycles * 146_097 + datetime.date(y + 400, month, day).toordinal() - datetime.date(400, 1, 1).toordinal() + (-719_528)


def _pg_instant(text: str) -> dict:
    m = re.fullmatch(r"(\d{4,}-\d{2}-\d{2}) ([\d:.]+?)([+-]\d{2}(?::\d{2}){0,2})( BC)?", text)
    if not m:
        raise ValueError("logical_value.instant")
    d, c = _days(m[1]), _clock(m[2])
    year = 1 - d["year"] if m[4] else d["year"]
    seconds = days_from_civil(year, d["month"], d["day"]) * 86_400 + c["hour"] * 3600 + c["minute"] * 60 + c["second"] - _offset(m[3])
    return {"type": "instant", "seconds": seconds, "nanoseconds": c["microsecond"] * 1000}


def _interval(text: str) -> dict:
    n = lambda unit, part: sum(int(x) for x in re.findall(rf"(-?\d+){unit}", part))
    date, _, time = text[1:].partition("T")
    seconds = re.search(r"(-?)(\d+)(?:\.(\d{1,6}))?S", time)
    micros = 0 if not seconds else (int(seconds[2]) * 1_000_000 + int((seconds[3] or "").ljust(6, "0"))) * (-1 if seconds[1] else 1)
    return {"months": n("Y", date) * 12 + n("M", date), "days": n("D", date) + 7 * n("W", date), "microseconds": n("H", time) * 3_600_000_000 + n("M", time) * 60_000_000 + micros}


def _pg_array(of: str, text: str, again) -> dict:
    bounds: list[int] = []
    if text.startswith("["):
        shape, text = text.split("=", 1)
        bounds = [int(b) for b in re.findall(r"\[(-?\d+):", shape)]
    flat, lengths = [], []

    def walk(body: str, level: int) -> None:
        items = _split(body[1:-1]) if body != "{}" else []
        if len(lengths) <= level:
            lengths.append(len(items))
        if len(items) != lengths[level]:
            raise ValueError("logical_value.array_shape")
        for s, quoted in items:
            if s.startswith("{") and not quoted:
                walk(s, level + 1)
            else:
                flat.append(again(of, None if s == "NULL" and not quoted else s))

    walk(text, 0)
    lengths = [] if text == "{}" else lengths
    return {"type": "array_with_metadata", "elements": flat, "dimensions": len(lengths), "lower_bounds": bounds or [1] * len(lengths), "dimension_lengths": lengths}


def _pg_range(of: str, text: str, again) -> dict:
    if text == "empty":
        return {"type": "range", "empty": True, "lower": None, "upper": None}
    (low, ql), (high, qh) = _split(text[1:-1])
    end = lambda s, q: None if s == "" and not q else again(of, s)
    return {"type": "range", "empty": False, "lower": end(low, ql), "upper": end(high, qh), "lower_inc": text[0] == "[", "upper_inc": text[-1] == "]"}


class Decoder:
    """Events of one source to whole transactions; ``feed`` returns those an event completes."""

    def __init__(self) -> None:
        self.state: dict = {"tables": {}, "tx": None, "at": None}

    def dump(self) -> str:
        return json.dumps(self.state)

    def load(self, text: str) -> None:
        self.state = json.loads(text)

    def _begin(self, tx_id: str, cursor) -> None:
        if self.state["tx"] is not None:
            raise ValueError("source_contract.invalid: nested transaction")
        self.state["tx"] = {"id": tx_id, "begin": cursor, "changes": []}

    def _row(self, operation: str, table: dict, before, after, cursor) -> None:
        if self.state["tx"] is None:
            raise ValueError("source_contract.invalid: row outside a transaction")
        self.state["tx"]["changes"].append({"operation": operation, "schema": table["schema"], "table": table["name"], "before": before, "after": after, "cursor": cursor})

    def _end(self, cursor) -> list[dict]:
        tx, self.state["tx"] = self.state["tx"], None
        if tx is None:
            raise ValueError("source_contract.invalid: commit without begin")
        return [tx | {"commit": cursor}]


#: Statements that set up the control schema itself; nothing may follow them.
_CONTROL = re.compile(r"CREATE DATABASE IF NOT EXISTS `CDC`(\s+DEFAULT)?(\s+CHARACTER SET \w+)?(\s+COLLATE \w+)?;?|CREATE TABLE IF NOT EXISTS `CDC`\.`log_info`\s*\([^;]*\)[^;()]*;?", re.S)


class Binlog(Decoder):
    """ROTATE clears the table map; GTID opens, QUERY BEGIN is its echo, XID or COMMIT closes.
    Row images must be full."""

    def __init__(self, version: str = "8.0") -> None:
        super().__init__()
        self.version = version

    def feed(self, e: dict) -> list[dict]:
        kind, at = e["kind"], e.get("pos")
        if kind == "ROTATE":
            self.state["tables"], self.state["at"] = {}, e["file"]
        elif kind in ("GTID", "ANONYMOUS_GTID"):
            self._begin(e.get("gtid") or f"{self.state['at']}:{at}", [self.state["at"], at])
        elif kind == "QUERY" and e["sql"] not in ("BEGIN", "COMMIT"):
            if not _CONTROL.fullmatch(e["sql"].strip()):
                raise ValueError("source_contract.invalid: statement in a row-based log")
            self.state["tx"] = None
        elif kind == "TABLE_MAP":
            self.state["tables"][str(e["table_id"])] = {"schema": e["schema"], "name": e["table"], "columns": e["columns"]}
        elif kind in ("WRITE_ROWS", "UPDATE_ROWS", "DELETE_ROWS"):
            table = self.state["tables"].get(str(e["table_id"]))
            if table is None:
                raise ValueError("source_contract.invalid: rows of an unknown table")
            for row in e["rows"]:
                before, after = row.get("before"), row.get("after")
                for image in (before, after):
                    if image is not None and len(image) != len(table["columns"]):
                        raise ValueError("source_contract.invalid: partial row image")
                self._row({"W": "insert", "U": "update", "D": "delete"}[kind[0]], table, self._image(table, before), self._image(table, after), [self.state["at"], at])
        elif kind == "XID" or (kind == "QUERY" and e["sql"] == "COMMIT"):
            return self._end([self.state["at"], at])
        return []

    def _image(self, table: dict, row: list | None) -> list[dict] | None:
        if row is None:
            return None
        out = []
        for i, (c, v) in enumerate(zip(table["columns"], row, strict=True)):
            value = mysql_value(c["type"], v, c.get("charset"), self.version)
            null = value["type"] == "null"
            out.append({"ordinal": i, "name": c["name"], "native_type": c["type"], "primary_key_ordinal": c.get("key"), "generated": c.get("generated", False), "presence": "null" if null else "value", "value": None if null else value})
        return out


class PgOutput(Decoder):
    """Relation messages define tables; rows take the cursor of their commit."""

    def __init__(self, catalog: dict | None = None) -> None:
        super().__init__()
        self.catalog = catalog

    def feed(self, e: dict) -> list[dict]:
        kind = e["kind"]
        if kind == "Begin":
            if self.state["at"] is not None and e["lsn"] <= self.state["at"]:
                raise ValueError("source_contract.invalid: transaction out of order")
            self._begin(f"pg:{e['xid']}:{e['lsn'] >> 32:X}/{e['lsn'] & 0xFFFFFFFF:X}", e["lsn"])
        elif kind == "Relation":
            if not any(c.get("key") is not None for c in e["columns"]):
                raise ValueError("source_contract.invalid: relation without key")
            self.state["tables"][str(e["id"])] = {"schema": e["schema"], "name": e["name"], "columns": e["columns"]}
        elif kind in ("Insert", "Update", "Delete"):
            table = self.state["tables"].get(str(e["relation"]))
            if table is None:
                raise ValueError("source_contract.invalid: rows of an unknown relation")
            after = self._image(table, e["new"]) if "new" in e else None
            before = self._image(table, e["old"]) if e.get("old") else None
            if kind == "Update" and before is None:  # default identity sends no old row if its key stays
                before = [d if d["primary_key_ordinal"] is not None else d | {"presence": "unavailable", "value": None} for d in after]
            elif before is not None:
                before = [d if d["primary_key_ordinal"] is not None or e.get("full") else d | {"presence": "unavailable", "value": None} for d in before]
            self._row(kind.lower(), table, before, after, None)
        elif kind == "Commit":
            self.state["at"] = e["lsn"]
            done = self._end(e["end_lsn"])
            for c in done[0]["changes"]:
                c["cursor"] = e["end_lsn"]
            return done
        return []

    def _image(self, table: dict, row: list) -> list[dict]:
        out = []
        for i, (c, v) in enumerate(zip(table["columns"], row, strict=True)):
            unchanged = isinstance(v, dict) and v.get("unchanged")
            null = v is None
            value = None if unchanged or null else pg_value(c["type"], v, self.catalog)
            out.append({"ordinal": i, "name": c["name"], "native_type": c["type"], "primary_key_ordinal": c.get("key"), "generated": False, "presence": "unchanged" if unchanged else "null" if null else "value", "value": value})
        return out


class _Machine(StatefulProcessor):
    def __init__(self, make):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("decoder", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = self.make()
        if self.saved.exists():
            d.load(self.saved.get()[0])
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values(["file", "line"], kind="stable").itertuples(index=False):
            out += [(key[0], t["id"], json.dumps(t)) for t in d.feed(json.loads(r.body))]
        self.saved.update((d.dump(),))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "transaction_id", "body"])

    def close(self) -> None:
        pass


def decode_stream(events: DataFrame, make, source: str = "source_id") -> DataFrame:
    """Whole transactions of a stream of protocol events (source, file, line, body)."""
    return events.groupBy(source).transformWithStateInPandas(statefulProcessor=_Machine(make), outputStructType="source_id string, transaction_id string, body string", outputMode="append", timeMode="none")
