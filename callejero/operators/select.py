"""Selection by status, origin and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for the three states and for everything.
MODES = {
    "pending": ["pending", "pendiente", "pendientes", "null"],
    "observed": ["observed", "observado", "observados", "observadas", "false"],
    "valid": ["valid", "valido", "validos", "normalizado", "normalizados", "true"],
    "processed": ["processed", "procesado", "procesados", "procesadas"],
    "all": ["all", "todos", "todas", "*", ""],
}
ANYWHERE = ["", "*", "todos", "all", "public"]


def filter_status(df: DataFrame, mode: str, status: str = "dire_es_procesado") -> DataFrame:
    """Rows in a state; null is pending, true valid, false observed."""
    kind = next((k for k, words in MODES.items() if mode.strip().lower() in words), None)
    if kind is None:
        raise ValueError(f"unknown status {mode}")
    s = F.col(status)
    return {"pending": df.where(s.isNull()), "observed": df.where(~s), "valid": df.where(s), "processed": df.where(s.isNotNull()), "all": df}[kind]


def filter_origin(df: DataFrame, schema: str | None, table: str | None) -> DataFrame:
    """Rows of a source: everything, a schema, or a schema's table."""
    if schema is not None and schema.lower() not in ANYWHERE:
        df = df.where(F.col("dire_esquema") == schema)
    if table is not None and table.lower() not in ANYWHERE:
        df = df.where(F.col("dire_tabla") == table)
    return df


def next_batch(df: DataFrame, key: str, after: int | None, n: int) -> DataFrame:
    """The next n rows by key: a top-n, never an offset."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def page_at(df: DataFrame, key: str, offset: int, n: int) -> DataFrame:
    """The n rows by key after the first offset ones, for a jump to a page; next_batch is cheaper for going on."""
    return df.orderBy(key).offset(offset).limit(n)


def is_empty(text: Column) -> Column:
    """Null or blank."""
    return text.isNull() | (F.trim(text) == "")
