"""Ingest into the central address table: provenance, catch-up, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTRAL = ["dire_esquema", "dire_tabla", "dire_columna", "dire_tabla_id", "dire_valor_origen", "dire_es_procesado", "dire_estado", "create_at"]


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def numeric_id(column: Column) -> Column:
    """The id if it is written as a whole number, else null."""
    s = F.trim(column.cast("string"))
    return F.when(s.rlike(r"^-?[0-9]+$"), s.try_cast("long"))


def ingest(src: DataFrame, schema: str | Column, table: str | Column, id_col: str, addr_col: str, created: Column | None = None) -> DataFrame:
    """Rows of a source as pending rows of the central table; status null is pending, never false."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return src.select(
        as_column(schema).alias("dire_esquema"),
        as_column(table).alias("dire_tabla"),
        F.lit(addr_col).alias("dire_columna"),
        numeric_id(F.col(id_col)).alias("dire_tabla_id"),
        blank_to_null(F.col(addr_col)).alias("dire_valor_origen"),
        F.lit(None).cast("boolean").alias("dire_es_procesado"),
        F.lit("A").alias("dire_estado"),
        (F.lit(None).cast("timestamp") if created is None else created).alias("create_at"),
    )


def ingest_missing(src: DataFrame, central: DataFrame, schema: str, table: str, id_col: str, addr_col: str) -> DataFrame:
    """Only rows not there yet: by numeric id, else by equal text (two nulls are equal). Two equi anti joins, no OR."""
    fresh = ingest(src, schema, table, id_col, addr_col)
    same_column = F.col("dire_columna").isNull() | (F.col("dire_columna") == addr_col)
    there = central.where((F.col("dire_esquema") == schema) & (F.col("dire_tabla") == table) & same_column)
    ids = there.where("dire_tabla_id is not null").select("dire_tabla_id").distinct()
    texts = there.where("dire_tabla_id is null").select(F.col("dire_valor_origen").alias("_t")).distinct()
    by_id = fresh.where("dire_tabla_id is not null").join(ids, "dire_tabla_id", "left_anti")
    by_text = fresh.where("dire_tabla_id is null").join(texts, F.col("dire_valor_origen").eqNullSafe(F.col("_t")), "left_anti")
    return by_id.select(*CENTRAL).unionByName(by_text.select(*CENTRAL))


def ingest_report(src: DataFrame, central: DataFrame, schema: str, table: str, id_col: str, addr_col: str) -> DataFrame:
    """One row: total, before, migrated, after, remaining; nothing is migrated if all is there already."""
    here = (F.col("dire_esquema") == schema) & (F.col("dire_tabla") == table)
    total = src.agg(F.count("*").alias("total"))
    before = central.where(here).agg(F.count("*").alias("before"))
    fresh = ingest_missing(src, central, schema, table, id_col, addr_col).agg(F.count("*").alias("fresh"))
    # Three one-row tables side by side.
    row = total.withColumn("_k", F.lit(1)).join(before.withColumn("_k", F.lit(1)), "_k").join(fresh.withColumn("_k", F.lit(1)), "_k")
    migrated = F.when(F.col("before") >= F.col("total"), F.lit(0)).otherwise(F.col("fresh"))
    row = row.withColumn("migrated", migrated).withColumn("after", F.col("before") + F.col("migrated"))
    return row.select("total", "before", "migrated", "after", F.greatest(F.lit(0), F.col("total") - F.col("after")).alias("remaining"))


def decouple_source(src: DataFrame, report: DataFrame, addr_col: str) -> DataFrame:
    """I4: the source without its text column, once nothing remains (one report row is read)."""
    r = report.first()
    return src.drop(addr_col) if r["remaining"] == 0 and r["total"] > 0 else src
