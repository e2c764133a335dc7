"""Reading sources and catalogues, writing tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names looked for in a source, in order.
CANDIDATES = {
    "id": ["id", "id_licencia", "licencia_id", "predio_id", "codigo", "row_id"],
    "text": ["direccion", "emp_direccion", "direccion_completa", "domicilio", "address", "raw_text"],
    "status": ["es_procesado", "dire_es_procesado", "procesado", "status"],
    "note": ["observacion", "observaciones", "nota"],
}
CATALOG_SCHEMA = "id int, nombre string, abreviatura string, sinonimos array<string>, patron_regex string"


def resolve_columns(columns: list[str], id_col: str | None = None, addr_col: str | None = None) -> dict[str, str | None]:
    """The source's id, text, status and note columns, whatever their case; ids fall back to *_id, then the first column."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    found = {kind: next((by_lower[n] for n in names if n in by_lower), None) for kind, names in CANDIDATES.items()}
    if id_col:
        found["id"] = by_lower[id_col.lower()]
    if addr_col:
        found["text"] = by_lower[addr_col.lower()]
    found["id"] = found["id"] or next((c for c in columns if c.lower().endswith("_id")), columns[0])
    found["text"] = found["text"] or next((c for c in columns if "direc" in c.lower() or "addr" in c.lower()), None)
    return found


def read_source(df: DataFrame, id_col: str | None = None, addr_col: str | None = None) -> DataFrame:
    """A source with columns src_row_id, raw_text, status, note."""
    r = resolve_columns(df.columns, id_col, addr_col)
    pick = lambda kind, type_: F.col(r[kind]) if r[kind] else F.lit(None).cast(type_)
    return df.select(pick("id", "long").alias("src_row_id"), pick("text", "string").alias("raw_text"), pick("status", "boolean").alias("status"), pick("note", "string").alias("note"))


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header in UTF-8."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", mode="PERMISSIVE")


def insert_missing(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the rows whose key it lacks."""
    return target.unionByName(df.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def load_catalog(spark: SparkSession, path: str, schema: str = CATALOG_SCHEMA) -> DataFrame:
    """S3: a JSON catalogue with arrays of synonyms."""
    return spark.read.json(path, schema=schema, multiLine=True)


def write_normalized(tables: dict[str, DataFrame], folder: str) -> None:
    """The relational tables as Parquet; addresses by source."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("dire_esquema", "dire_tabla") if name == "address" else writer).parquet(f"{folder}/{name}")


def write_jdbc(tables: dict[str, DataFrame], url: str, mode: str = "append", batch: int = 10_000, **properties: str) -> None:
    """The relational tables into a database; overwrite empties a table and keeps its definition.

    Appending twice inserts twice: pass rows that the table lacks (`insert_missing`), so that a lost executor's retry
    meets the table's own key.
    """
    for name, df in tables.items():
        df.write.mode(mode).option("batchsize", batch).option("truncate", "true").jdbc(url, name, properties=properties)


def write_csv_report(df: DataFrame, path: str) -> None:
    """Flat CSV with header, quotes only where needed."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, emptyValue="")


def metadata(df: DataFrame, institution: str, version: str, at: Column) -> DataFrame:
    """The one metadata record of a report; at is an aggregate, such as the last change."""
    return df.agg(F.count("*").alias("total_registros"), at.alias("generado")).select(F.lit(institution).alias("institucion"), F.lit(version).alias("version"), "total_registros", "generado")


def write_json_report(df: DataFrame, path: str, meta: DataFrame) -> None:
    """Nested records and the metadata beside them."""
    df.write.mode("overwrite").json(f"{path}/records")
    meta.write.mode("overwrite").json(f"{path}/metadata")


def preview(src: DataFrame, central: DataFrame, schema: str, table: str, id_col: str, addr_col: str, n: int = 10) -> DataFrame:
    """N rows by id; a text column that was dropped is fetched from the central table by provenance."""
    top = src.orderBy(id_col).limit(n)
    if addr_col in src.columns:
        return top.select(id_col, addr_col)
    here = central.where((F.col("dire_esquema") == schema) & (F.col("dire_tabla") == table)).select(F.col("dire_tabla_id").alias("_id"), F.col("dire_valor_origen").alias("_t"))
    return top.join(here, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("_t", F.lit("(Migrado)")).alias(addr_col))
