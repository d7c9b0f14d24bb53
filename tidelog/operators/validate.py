"""Contract rules of transactions as data: each violation is a row with a rule code.

``violations`` reports all of them; ``strict`` fails on the first in the order of
transaction, change and rule, as a closed pipeline must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import values

BLANK = r"^\s*$"


def _image_rules(c: Column, name: str) -> list[Column]:
    image = F.coalesce(c[name], F.array().cast(model.IMAGE))
    keys = F.array_sort(F.transform(F.filter(image, lambda d: d["primary_key_ordinal"].isNotNull()), lambda d: d["primary_key_ordinal"]))
    names, ordinals = F.transform(image, lambda d: d["name"]), F.transform(image, lambda d: d["ordinal"])
    n = F.size(keys)
    wanted = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    allowed = {"before": ["value", "null", "unavailable", "source_representation_envelope"], "after": ["value", "null", "unchanged", "source_representation_envelope"]}[name]
    there = c[name].isNotNull()
    odd = F.exists(image, lambda d: ~d["presence"].isin(*allowed)) | F.exists(image, lambda d: (d["presence"] == ("unavailable" if name == "before" else "unchanged")) & (c["operation"] == "insert"))
    return [
        F.when(there & (F.size(image) == 0), f"{name}_image_empty"),
        F.when(there & ((F.size(F.array_distinct(names)) != F.size(image)) | (F.size(F.array_distinct(ordinals)) != F.size(image))), f"{name}_columns_not_unique"),
        F.when(F.exists(image, lambda d: F.coalesce(d["native_type"], F.lit("")).rlike(BLANK)), f"{name}_native_type_missing"),
        F.when(there & (keys != wanted), f"{name}_key_ordinals_invalid"),
        F.when(F.exists(image, lambda d: d["primary_key_ordinal"].isNotNull() & ((d["presence"] != "value") | F.coalesce(d["generated"], F.lit(False)))), f"{name}_key_value_missing"),
        F.when(odd, f"{name}_presence_invalid"),
    ]


def change_rules(c: Column) -> Column:
    """The codes of the rules that a change breaks, in rule order."""
    text = lambda x: F.coalesce(x, F.lit(""))
    definition = lambda image: F.transform(image, lambda d: F.struct(d["ordinal"], d["name"], d["native_type"], d["primary_key_ordinal"], d["generated"], d["collation"]))
    op, b, a = c["operation"], c["before"], c["after"]
    shape = F.when(op == "insert", b.isNull() & a.isNotNull()).when(op == "update", b.isNotNull() & a.isNotNull()).when(op == "delete", b.isNotNull() & a.isNull())
    rules = [
        F.when(text(c["schema"]).rlike(BLANK) | text(c["table"]).rlike(BLANK) | text(c["schema"]).contains("\0") | text(c["table"]).contains("\0"), "table_name_invalid"),
        F.when(text(c["schema_basis"]).rlike(BLANK), "schema_basis_missing"),
        F.when(~F.coalesce(shape, F.lit(False)), "operation_images_mismatch"),
        *_image_rules(c, "before"),
        *_image_rules(c, "after"),
        F.when((op == "update") & b.isNotNull() & a.isNotNull() & (definition(b) != definition(a)), "update_definitions_differ"),
    ]
    return F.array_compact(F.array(*rules))


def violations(transactions: DataFrame, deep: bool = True) -> DataFrame:
    """(transaction_id, change_no, rule_code, detail). With ``deep`` every value is checked too."""
    cursor_ok = lambda x: F.least(*(F.length(F.coalesce(x[f], F.lit(""))) for f in ("format", "value"))) > 0
    s = F.col("source")
    header = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("id"), F.lit("")).rlike(BLANK), "transaction_id_blank"),
            F.when(F.least(*(F.length(F.coalesce(s[f], F.lit(""))) for f in ("kind", "version", "id"))) == 0, "source_identity_missing"),
            F.when(~cursor_ok(F.col("begin_cursor")) | ~cursor_ok(F.col("commit_cursor")), "cursor_incomplete"),
            F.when(F.size("changes") == 0, "transaction_empty"),
        )
    )
    top = transactions.select(F.col("id").alias("transaction_id"), F.lit(-1).alias("change_no"), F.explode(header).alias("rule_code"), F.lit(None).cast("string").alias("detail"))
    rows = transactions.select(F.col("id").alias("transaction_id"), F.posexplode("changes").alias("change_no", "c"))
    out = top.union(rows.select("transaction_id", "change_no", F.explode(change_rules(F.col("c"))).alias("rule_code"), F.lit(None).cast("string").alias("detail")))
    if deep:
        image = lambda n: F.coalesce(F.col(f"c.{n}"), F.array().cast(model.IMAGE))
        data = rows.select("transaction_id", "change_no", F.explode(F.concat(image("before"), image("after"))).alias("d")).filter("d.presence = 'value'")
        bad = data.withColumn("rule_code", values.invalid_value(F.col("d.value"))).filter("rule_code is not null")
        out = out.union(bad.select("transaction_id", "change_no", "rule_code", F.col("d.name").alias("detail")))
    return out


def strict(transactions: DataFrame) -> DataFrame:
    """The transactions, failing on the first violation in order."""
    first = violations(transactions).orderBy("transaction_id", "change_no", "rule_code").limit(1).collect()
    if first:
        v = first[0]
        raise ValueError(f"change_event.validation_failed: {v['rule_code']} in transaction {v['transaction_id']}, change {v['change_no']}")
    return transactions


def snapshot_violations(rows: DataFrame) -> DataFrame:
    """Violations of snapshot rows (row_no, image): key values present, each value or null."""
    i = F.col("image")
    rules = F.array_compact(
        F.array(
            F.when(F.size(i) == 0, "snapshot_row_empty"),
            F.when(F.exists(i, lambda d: ~d["presence"].isin("value", "null")), "snapshot_presence_invalid"),
            F.when(~F.exists(i, lambda d: d["primary_key_ordinal"].isNotNull()), "primary_key_required"),
            F.when(F.exists(i, lambda d: d["primary_key_ordinal"].isNotNull() & (d["presence"] != "value")), "snapshot_key_missing"),
        )
    )
    return rows.select("row_no", F.explode(rules).alias("rule_code"))


def envelope_rules(e: Column) -> Column:
    """The codes that a source representation envelope (payload, payload_length, payload_digest,
    protocol, format, native_type) breaks."""
    from ..functions.codec import from_base64url
    from ..functions.digest import bytes_digest, valid_digest

    raw = from_base64url(e["payload"])
    return F.array_compact(
        F.array(
            F.when(F.least(*(F.length(F.coalesce(e[f], F.lit(""))) for f in ("protocol", "format", "native_type"))) == 0, "source_representation.missing_evidence"),
            F.when(~F.coalesce(valid_digest(e["payload_digest"]), F.lit(False)), "source_representation.invalid_digest"),
            F.when(raw.isNull(), "source_representation.invalid_payload"),
            F.when(F.octet_length(raw) != e["payload_length"], "source_representation.payload_length_mismatch"),
            F.when(bytes_digest(raw) != e["payload_digest"], "source_representation.payload_digest_mismatch"),
        )
    )
