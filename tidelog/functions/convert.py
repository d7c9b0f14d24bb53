"""Range checks and conversions as column expressions. Each gives a struct ``(value, code)``: a value
and no code, or a failure code and no value. Nothing is lost silently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(ok: Column, value: Column, code: str) -> Column:
    """value where ok holds, the failure code where it doesn't; null stays null."""
    return F.when(ok, F.struct(value.alias("value"), F.lit(None).cast("string").alias("code"))).when(~F.coalesce(ok, F.lit(True)), F.struct(F.nullif(value, value).alias("value"), F.lit(code).alias("code")))


def integer_bounds(bits: int, signed: bool) -> tuple[int, int]:
    return (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)


def integer_fits(x: Column, bits: int, signed: bool = True) -> Column:
    """Whether an integer lies in the range of a width. Never wraps."""
    low, high = integer_bounds(bits, signed)
    wide = x.cast("decimal(38,0)")
    return wide.between(F.lit(low).cast("decimal(38,0)") if abs(low) < 2**63 else F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))


def decimal_fits(x: Column, precision: int, scale: int) -> Column:
    """Whether an exact decimal keeps its value with a precision and scale: dropped digits must be zeros."""
    return F.coalesce(x.try_cast(f"decimal({precision},{scale})") == x, x.isNull())


def decimal_text_fits(unscaled: Column, scale: Column, precision: int, target_scale: int) -> Column:
    """decimal_fits for decimals of any length, given as digits and a scale."""
    digits = F.ltrim(F.regexp_replace(unscaled, "^[+-]", ""), F.lit("0"))
    drop = F.greatest(scale - target_scale, F.lit(0))
    zeros = F.length(F.regexp_extract(digits, "0*$", 0))
    return (digits == "") | ((zeros >= drop) & (F.length(digits) - scale <= precision - target_scale))


def float_fits(x: Column) -> Column:
    """Whether a double is finite and survives a round trip through single precision."""
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return finite & (x.cast("float").cast("double") == x)


#: Characters that a character set lacks; fixed values.
UNREPRESENTABLE = {"ascii": r"[^\x00-\x7F]", "latin1": r"[^\x00-\xFF]", "utf8": r"[^\x00-\x{FFFF}]", "utf8mb4": r"(?!)"}


def text_fits(x: Column, charset: str, length: int | None = None, unit: str = "characters") -> Column:
    """Whether a text can be written in a character set and within a length of characters or bytes."""
    ok = ~x.rlike(UNREPRESENTABLE[charset])
    if length is not None:
        ok &= (F.char_length(x) if unit == "characters" else encoded_length(x, charset)) <= length
    return ok


def encoded_length(x: Column, charset: str) -> Column:
    return F.char_length(x) if charset in ("ascii", "latin1") else F.octet_length(x)


def pad_binary(x: Column, length: int, fill: str = "00") -> Column:
    """Bytes padded to a length; null where they are longer."""
    return F.when(F.octet_length(x) <= length, F.rpad(x, length, F.unhex(F.lit(fill))))


def reverse_bits(byte: Column) -> Column:
    """The bits of a byte in the opposite order."""
    out = F.lit(0)
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(byte, i).bitwiseAND(F.lit(1)), 7 - i))
    return out.cast("int")


def reorder_bits(x: Column) -> Column:
    """Bytes with the bits of each in the opposite order."""
    each = F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda i: F.lpad(F.hex(reverse_bits(F.conv(F.hex(x.substr(i, F.lit(1))), 16, 10).cast("int"))), 2, "0"))
    return F.when(F.octet_length(x) == 0, x).otherwise(F.unhex(F.array_join(each, "")))


def bit_padding_zero(last_byte: Column, bit_length: Column, order: str = "msb") -> Column:
    """Whether the bits of the last byte beyond a length are zero."""
    free = F.pmod(-bit_length, F.lit(8)).cast("int")
    mask = (F.pow(F.lit(2), free) - 1).cast("int")
    part = last_byte if order == "msb" else F.call_function("shiftright", last_byte, 8 - free)
    return part.bitwiseAND(mask) == 0


def local_to_instant(x: Column, offset_seconds: int) -> Column:
    """The UTC timestamp of a local one in a zone of fixed offset."""
    return F.timestamp_micros(F.unix_micros(x.cast("timestamp")) - F.lit(offset_seconds * 1_000_000))


def precision_fits(micros: Column, digits: int) -> Column:
    """Whether a time in microseconds has no more fractional digits than ``digits``."""
    return F.pmod(micros, F.lit(10 ** (6 - digits))) == 0


def enum_fits(x: Column, labels: list[str]) -> Column:
    return x.isin(*labels)


def set_members(members: Column, declared: list[str]) -> Column:
    """A set's members in the order of their declaration."""
    return F.filter(F.array(*map(F.lit, declared)), lambda m: F.array_contains(members, m))


def set_fits(members: Column, declared: list[str]) -> Column:
    return (F.size(F.array_except(members, F.array(*map(F.lit, declared)))) == 0) & (F.size(F.array_distinct(members)) == F.size(members))


def same_members(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def carrier_fits(text: Column, capacity: int) -> Column:
    return F.octet_length(text) <= capacity


#: Conversion rules by id: what each makes of a column under its parameters.
RULES: dict[str, Callable[[Column, dict], Column]] = {
    "exact": lambda x, p: outcome(F.lit(True), x, ""),
    "integer_range": lambda x, p: outcome(integer_fits(x, p["bits"], p["signed"]), x, "target_capability.integer_overflow"),
    "decimal_range": lambda x, p: outcome(decimal_fits(x, p["precision"], p["scale"]), x.try_cast(f"decimal({p['precision']},{p['scale']})"), "target_capability.decimal_overflow"),
    "float_narrow": lambda x, p: outcome(float_fits(x), x.cast("float"), "target_capability.float_rounding_or_overflow"),
    "text": lambda x, p: outcome(text_fits(x, p["charset"], p.get("length"), p.get("unit", "characters")), x, "target_capability.text_length_overflow"),
    "binary_pad": lambda x, p: outcome(F.octet_length(x) <= p["length"], pad_binary(x, p["length"]), "target_capability.binary_length_invalid"),
    "enum": lambda x, p: outcome(enum_fits(x, p["labels"]), x, "target_capability.enum_unknown_label"),
    "set": lambda x, p: outcome(set_fits(x, p["members"]), set_members(x, p["members"]), "target_capability.set_unknown_member"),
    "local_to_instant": lambda x, p: outcome(precision_fits(F.unix_micros(x.cast("timestamp")), p.get("precision", 6)), local_to_instant(x, p["offset_seconds"]), "target_capability.temporal_precision_loss"),
    "json_text": lambda x, p: _json_text(x, p),
    "logical_value_carrier": lambda x, p: _carried(x, p),
    "source_representation_carrier": lambda x, p: _enveloped(x, p),
}


def _json_text(x: Column, p: dict) -> Column:
    from .values import normal_json_text

    text = normal_json_text(x)
    fits = text_fits(text, p.get("charset", "utf8mb4"), p.get("length"), p.get("unit", "characters"))
    return F.when(x.isNull(), outcome(F.lit(None).cast("boolean"), text, "")).otherwise(outcome(F.coalesce(fits, F.lit(False)), text, "target_capability.json_normalization_failed"))


def _carried(x: Column, p: dict) -> Column:
    """A logical value as its canonical JSON, for a text column that holds what no type of the target does."""
    from .values import canonical_value, invalid_value

    text = canonical_value(x)
    ok = invalid_value(x).isNull() & text.isNotNull()
    if p.get("length"):
        ok &= carrier_fits(text, p["length"])
    return F.when(x.isNotNull(), outcome(F.coalesce(ok, F.lit(False)), text, "target_capability.carrier_invalid"))


def _enveloped(x: Column, p: dict) -> Column:
    """A source representation envelope as JSON with the evidence that it can be read back from."""
    from ..operators.validate import envelope_rules

    text = F.to_json(x)
    ok = F.size(envelope_rules(x)) == 0
    if p.get("length"):
        ok &= carrier_fits(text, p["length"])
    return F.when(x.isNotNull(), outcome(F.coalesce(ok, F.lit(False)), text, "target_capability.carrier_invalid"))


def read_back(sent: Column, stored: Column) -> Column:
    """Whether a stored carrier gives the value that was sent, whatever the order of its keys and members."""
    from .values import canonical_value

    return F.coalesce(canonical_value(sent) == canonical_value(stored), sent.isNull() & stored.isNull())
