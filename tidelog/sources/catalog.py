"""Catalog scans over metadata tables. The tables are frames (read by JDBC or recorded), and each scan
is their join; catalogs are small, so Spark broadcasts by itself what is below its threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mysql_columns(columns: DataFrame, key_usage: DataFrame, schema: str, table: str) -> DataFrame:
    """A table's columns in order, with the place of each in the primary key or null."""
    own = (F.col("table_schema") == schema) & (F.col("table_name") == table)
    keys = key_usage.filter(own & (F.col("constraint_name") == "PRIMARY")).select("column_name", (F.col("ordinal_position") - 1).alias("primary_key_ordinal"))
    out = columns.filter(own).join(keys, "column_name", "left")
    return out.select((F.col("ordinal_position") - 1).alias("ordinal"), F.col("column_name").alias("name"), F.col("column_type").alias("native_type"), (F.col("is_nullable") == "YES").alias("nullable"), (F.coalesce("generation_expression", F.lit("")) != "").alias("generated"), F.col("collation_name").alias("collation"), "primary_key_ordinal").orderBy("ordinal")


def pg_relation_keys(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Key columns of relations: indkey unnested with its ordinality and joined to attributes."""
    keys = indexes.filter("indisprimary").select("indrelid", F.posexplode("indkey").alias("primary_key_ordinal", "attnum"))
    return attributes.join(keys, (F.col("attrelid") == F.col("indrelid")) & attributes["attnum"].eqNullSafe(keys["attnum"]), "left").select("attrelid", attributes["attnum"], "attname", "atttypid", "primary_key_ordinal")


def extensions(available: DataFrame, installed: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Extensions that are available, installed or both, with the namespace of the installed."""
    i = installed.join(namespaces, installed["extnamespace"] == namespaces["oid"], "left").select("extname", "extversion", "nspname")
    both = available.join(i, F.col("name") == F.col("extname"), "full_outer")
    state = F.when(F.col("extname").isNull(), "Available").when(F.col("name").isNull(), "Detected").otherwise("Installed")
    return both.select(F.coalesce("name", "extname").alias("identity"), "default_version", F.col("extversion").alias("installed_version"), F.col("nspname").alias("namespace"), state.alias("status"))


def ranges_of(types: DataFrame, ranges: DataFrame) -> DataFrame:
    """Types with the range type they are, or are the multirange of. The range side is unfolded into
    one row for each of its two ids, so an OR condition becomes an equi-join."""
    by = ranges.select("rngsubtype", F.explode(F.array(F.struct(F.col("rngtypid").alias("oid"), F.lit("range").alias("role")), F.struct(F.col("rngmultitypid").alias("oid"), F.lit("multirange").alias("role")))).alias("r"))
    return types.join(by.select("r.oid", "r.role", "rngsubtype"), "oid", "left")


def enum_labels(enums: DataFrame) -> DataFrame:
    """The labels of each enum type in sort order."""
    per = enums.groupBy("enumtypid").agg(F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel"))).alias("x"))
    return per.select("enumtypid", F.transform("x", lambda e: e["enumlabel"]).alias("labels"))


def target_probe(columns: DataFrame, indexes: DataFrame, triggers: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """A target's columns with the indexes on each, and how many triggers and foreign keys its table has."""
    on = ["table_schema", "table_name"]
    per_column = indexes.groupBy(*on, "column_name").agg(F.sort_array(F.collect_set("index_name")).alias("indexes"))
    counts = lambda t, n: t.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    out = columns.join(per_column, [*on, "column_name"], "left").join(counts(triggers, "triggers"), on, "left").join(counts(foreign_keys, "foreign_keys"), on, "left")
    return out.withColumns({"indexes": F.coalesce("indexes", F.array().cast("array<string>")), "triggers": F.coalesce("triggers", F.lit(0)), "foreign_keys": F.coalesce("foreign_keys", F.lit(0))})


def table_gate(engine: Column, kind: Column, triggers: Column, foreign_keys: Column) -> Column:
    """Why a table can't be a strict target, or null."""
    return F.when(F.coalesce(engine, F.lit("")) .isin("MyISAM", "MEMORY", "CSV", "ARCHIVE"), "engine_not_transactional").when(kind != "BASE TABLE", "not_an_ordinary_table").when(triggers > 0, "table_has_triggers").when(foreign_keys > 0, "table_has_foreign_keys")


def pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target columns by name: what differs in order, nullability, key or collation."""
    s = source.select("name", *(F.col(c).alias(f"s_{c}") for c in ("ordinal", "nullable", "primary_key_ordinal", "collation", "generated")))
    t = target.select("name", *(F.col(c).alias(f"t_{c}") for c in ("ordinal", "nullable", "primary_key_ordinal", "collation", "generated")))
    both = s.join(t, "name", "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("t_ordinal").isNull(), "target_column_missing"),
            F.when(F.col("s_ordinal").isNull() & ~F.col("t_nullable"), "target_column_without_source"),
            F.when(F.col("s_nullable") & ~F.col("t_nullable"), "nullable_into_required"),
            F.when(F.col("s_ordinal").isNotNull() & F.col("t_ordinal").isNotNull() & ~F.col("s_primary_key_ordinal").eqNullSafe(F.col("t_primary_key_ordinal")), "primary_key_mismatch"),
            F.when(F.col("s_primary_key_ordinal").isNotNull() & (F.col("s_collation") != F.col("t_collation")), "key_collation_mismatch"),
            F.when(F.col("s_generated") != F.col("t_generated"), "generated_mismatch"),
        )
    )
    return both.select("name", F.explode(codes).alias("rule_code"))


def fingerprint(settings: DataFrame, volatile: tuple[str, ...] = ("slots_in_use", "connections")) -> DataFrame:
    """One digest of a server's settings (name, value), without those that change by themselves."""
    rows = settings.filter(~F.col("name").isin(*volatile))
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "value")))), 256).alias("fingerprint"))
