"""Operator 3: personal data by patterns, checksums and context.

Patterns propose spans; a validator confirms them (Luhn for cards, mod-97 for IBANs, ranges
for addresses and digit groups); words near a span raise or lower its score, and a kind
whose pattern alone proves little (social security numbers, card numbers of 13 to 15 digits) is
taken only at ``least`` or more. An IBAN ends at the last word end at which its check holds. Spans of the four base kinds
(email, ip, card, phone) are taken leftmost and without overlap within their kind, and
a proposal that fails its check is dropped without a retry; context never removes them.

Whole texts are read. A null text is an empty one: no spans. Spans are (kind, start, end) in
code points, end exclusive, ordered by kind as listed in ``KINDS``, then by start. Every pattern takes time
linear in the text, however long. Repeated rows are scanned each; ties can't occur within a kind. Other
columns may have any names: ``scan`` reads the key and the text only, ``redacted`` passes all on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import by_slice

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "card_short")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# As [0-9]+(\.[0-9]+){3} from the left: a match begins and ends with a whole run of digits, so none is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Words that speak for a kind, near it on either side; fixed values.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "soc"),
}
CONTEXT["card_short"] = CONTEXT["card"]
AGAINST = ("version", "isbn", "order", "serial", "part")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "card_short": 0.5}
_WORD = re.compile(r"[^\W_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of local@domain, found from each @ backwards: the leftmost start for an @
    is the start of the run of local characters before it, but not before the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Proposals, each cut at the last word end at which it holds; upper-case words may follow a number."""
    out, m = [], _IBAN.search(text)
    while m:
        ends = (e for e in range(m.end(), m.start(), -1) if e == m.end() or text[e] == " ")
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            out.append((m.start(), end))
        m = _IBAN.search(text, end or m.start() + 1)
    return out


def _near(text: str, start: int, end: int, words: tuple[str, ...], reach: int = 40) -> bool:
    around = text[max(0, start - reach) : start].lower() + " " + text[end : end + reach].lower()
    return any(w in words for w in _WORD.findall(around))


def find(text: str | None, least: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score)."""
    if not text:
        return []
    raw: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    raw += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    short = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            (raw if len(digits) >= 16 else short).append(("card" if len(digits) >= 16 else "card_short", m.start(), m.end()))
    if "+" in text:
        raw += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    raw += [("iban", a, b) for a, b in ibans(text)]
    raw += short
    raw += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    out = []
    for kind, a, b in raw:
        score = PRIOR[kind] + 0.3 * _near(text, a, b, CONTEXT[kind]) - 0.3 * _near(text, a, b, AGAINST)
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= least:
            out.append((kind, a, b, score))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str | None, least: float = 0.6) -> str | None:
    """The text with each span replaced by <KIND>; overlapping spans become one, named after the first."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, a, b, _ in find(text, least))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.6) -> DataFrame:
    """key and found: array<struct<kind, start, end, score>>, for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t, least)] for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("key"), pa.array(rows, kind)], names=["key", "found"])

    of = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slice("text", make), f"key {of}, found array<struct<kind:string,start:int,end:int,score:double>>").withColumnRenamed("key", key)


def digest(spans: list[tuple[str, int, int, float]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest()


def redacted(docs: DataFrame, text: str = "text", least: float = 0.6) -> DataFrame:
    """All columns of docs, with the spans in ``text`` replaced."""
    import pyarrow.compute as pc

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        col = batch.column(at)
        # Only a text with a digit or an @ can hold a span.
        maybe = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_pylist()
        new = pa.array([redact(t, least) if m else t for t, m in zip(col.to_pylist(), maybe, strict=True)], pa.string())
        return batch.set_column(at, batch.schema.field(at), new.cast(batch.schema.field(at).type))

    return docs.mapInArrow(by_slice(text, make), docs.schema)
