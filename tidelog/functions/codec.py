"""Decoding of wire texts and bytes into typed columns, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_base64url(x: Column) -> Column:
    return F.unbase64(F.rpad(F.translate(x, "-_", "+/"), ((F.length(x) + 3) / 4).cast("int") * 4, "="))


def to_base64url(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(x), "+/", "-_"), r"[=\r\n]+", "")


def decimal_parts(x: Column) -> Column:
    """struct<unscaled, scale> of a decimal text; null unless it is one. NaN and infinities keep their name with scale 0."""
    sign = F.when(x.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(x, r"^[+-]", "")
    whole, frac = F.split_part(body, F.lit("."), F.lit(1)), F.split_part(body, F.lit("."), F.lit(2))
    digits = F.ltrim(F.concat(whole, frac), F.lit("0"))
    number = F.struct(F.when(digits == "", "0").otherwise(F.concat(sign, digits)).alias("unscaled"), F.length(frac).alias("scale"))
    special = F.struct(x.alias("unscaled"), F.lit(0).alias("scale"))
    return F.when(x.isin("NaN", "Infinity", "-Infinity"), special).when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), number)


def decimal_text(unscaled: Column, scale: Column) -> Column:
    """The decimal text of digits and a scale; a negative scale appends zeros."""
    sign, digits = F.regexp_extract(unscaled, "^-?", 0), F.regexp_replace(unscaled, "^-", "")
    wide = F.lpad(digits, F.greatest(F.length(digits), scale + 1), "0")
    cut = F.length(wide) - scale
    return F.when(scale <= 0, F.concat(sign, digits, F.repeat(F.lit("0"), -scale))).otherwise(F.concat(sign, wide.substr(F.lit(1), cut), F.lit("."), wide.substr(cut + 1, scale)))


def enum_label(ordinal: Column, labels: list[str]) -> Column:
    """The label of a 1-based ordinal; 0 is the empty error value, others are null."""
    return F.when(ordinal == 0, F.lit("")).otherwise(F.try_element_at(F.array(*map(F.lit, labels)), ordinal.cast("int")))


def set_labels(mask: Column, members: list[str]) -> Column:
    """The members whose bits are set, the first member's lowest."""
    return F.filter(F.array(*map(F.lit, members)), lambda m, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


def temporal(x: Column) -> Column:
    """struct<value timestamp_ntz, invalid>: a local datetime text, or the raw text where it is none
    (zero dates and days that don't exist among them)."""
    parsed = x.try_cast("timestamp_ntz")
    return F.struct(parsed.alias("value"), F.when(parsed.isNull() & x.isNotNull(), x).alias("invalid"))


def unix_instant(x: Column) -> Column:
    """The instant of a Unix time text with up to six fractional digits."""
    p = F.split(x, r"\.")
    micros = F.rpad(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")), 6, "0").cast("long")
    return F.timestamp_micros(p[0].cast("long") * 1_000_000 + F.when(x.startswith("-"), -micros).otherwise(micros))


def pg_date(x: Column) -> Column:
    """struct<year, month, day, infinity> of a date text; BC years are astronomical (1 BC is 0)."""
    part = lambda i: F.regexp_extract(x, r"^(\d{4,})-(\d{2})-(\d{2})( BC)?$", i)
    year = F.when(part(4) != "", 1 - part(1).cast("long")).otherwise(part(1).cast("long"))
    fine = x.rlike(r"^\d{4,}-\d{2}-\d{2}( BC)?$")
    none = F.lit(None)
    return F.when(fine, F.struct(year.alias("year"), part(2).cast("int").alias("month"), part(3).cast("int").alias("day"), none.cast("string").alias("infinity"))).when(
        x.isin("infinity", "-infinity"), F.struct(none.cast("long").alias("year"), none.cast("int").alias("month"), none.cast("int").alias("day"), x.alias("infinity"))
    )


def iso_interval(x: Column) -> Column:
    """struct<months, days, microseconds> of an ISO-8601 interval; the parts are never folded."""
    date, time = F.split_part(x, F.lit("T"), F.lit(1)), F.split_part(x, F.lit("T"), F.lit(2))
    n = lambda part, unit: F.coalesce(F.nullif(F.regexp_extract(part, rf"(-?\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    seconds = F.nullif(F.regexp_extract(time, r"(-?\d+(?:\.\d+)?)S", 1), F.lit("")).cast("decimal(20,6)")
    micros = n(time, "H") * 3_600_000_000 + n(time, "M") * 60_000_000 + F.coalesce((seconds * 1_000_000).cast("long"), F.lit(0))
    return F.when(x.rlike(r"^P(?=.)"), F.struct((n(date, "Y") * 12 + n(date, "M")).cast("int").alias("months"), (n(date, "D") + n(date, "W") * 7).cast("int").alias("days"), micros.alias("microseconds")))


def bit_text(x: Column) -> Column:
    """Bytes of a text of 0 and 1, first bit highest, padded with zeros."""
    padded = F.rpad(x, ((F.length(x) + 7) / 8).cast("int") * 8, "0")
    each = F.transform(F.sequence(F.lit(0), (F.length(padded) / 8 - 1).cast("int")), lambda i: F.lpad(F.conv(padded.substr(i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(x == "", F.lit(b"")).otherwise(F.unhex(F.array_join(each, "")))


def network(x: Column) -> Column:
    """struct<family, address, prefix_length> of an inet or cidr text."""
    address = F.split_part(x, F.lit("/"), F.lit(1))
    v6 = address.contains(":")
    prefix = F.coalesce(F.nullif(F.split_part(x, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.when(v6, 128).otherwise(32))
    return F.struct(F.when(v6, "ipv6").otherwise("ipv4").alias("family"), address.alias("address"), prefix.alias("prefix_length"))


def gtid(sid: Column, number: Column, tag: Column | None = None) -> Column:
    """uuid[:tag]:number of a 16-byte source id."""
    h = F.lower(F.hex(sid))
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    return F.concat_ws(":", uuid, F.nullif(tag, F.lit("")) if tag is not None else F.lit(None), number.cast("string"))


def spatial_header(wkb: Column, extended: bool = False) -> Column:
    """struct<little_endian, geometry_type, dimensions, srid> of (E)WKB bytes."""
    little = F.hex(wkb.substr(F.lit(1), F.lit(1))) == "01"
    word = lambda at: F.conv(F.hex(F.when(little, F.unhex(F.concat(*(F.hex(wkb.substr(F.lit(at + i), F.lit(1))) for i in (3, 2, 1, 0))))).otherwise(wkb.substr(F.lit(at), F.lit(4)))), 16, 10).cast("long")
    code = word(2)
    kind = F.when(F.lit(extended), code.bitwiseAND(F.lit(0x1FFFFFFF))).otherwise(F.pmod(code, F.lit(1000)))
    z, m = code.bitwiseAND(F.lit(0x80000000)) != 0, code.bitwiseAND(F.lit(0x40000000)) != 0
    dims = F.when(F.lit(extended), 2 + z.cast("int") + m.cast("int")).otherwise(2 + F.array_position(F.array(F.lit(1), F.lit(2), F.lit(3)), F.floor(code / 1000)).isin(1, 2).cast("int") + (F.floor(code / 1000) == 3).cast("int") * 2)
    srid = F.when(F.lit(extended) & (code.bitwiseAND(F.lit(0x20000000)) != 0), word(6))
    return F.struct(little.alias("little_endian"), kind.cast("int").alias("geometry_type"), dims.cast("int").alias("dimensions"), srid.cast("int").alias("srid"))


def strip_srid(mysql_geometry: Column) -> Column:
    """The WKB behind a four-byte SRID."""
    return mysql_geometry.substr(F.lit(5), F.octet_length(mysql_geometry))
