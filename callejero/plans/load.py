"""The end of W1: normalised rows into the address, street, component and unit tables, committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import load as ld
from ..operators import validate as va
from ..session import cut
from ..sources.generations import commit_tables, live_tables

#: Key columns of each child table.
KEYS = {"address_via": ["dire_id", "via_id"], "address_comp": ["dire_id", "codi_id"], "address_mod": ["dire_id", "timo_id", "ditm_nombre"]}


def child_tables(done: DataFrame) -> dict[str, DataFrame]:
    """Streets, components and units of normalised rows (dire_id, vias, plot fields, modulos), one row a key.

    Null ids, blank values and null lists give no rows; of values that meet on a key the last in order stays.
    """
    df = va.align_fields(done)
    unit = F.transform("modulos", lambda m, i: F.struct(m["timo_id"].alias("timo_id"), m["ditm_nombre"].alias("ditm_nombre")))
    tables = {
        "address_via": ld.flatten_children(df, "vias", "dire_id", {"via_id": "via_id", "divi_numero": "divi_numero"}, "divi_orden"),
        "address_comp": ld.flatten_children(df, "componentes", "dire_id", {"codi_id": "codi_id", "diti_valor": "diti_valor"}, "diti_orden"),
        "address_mod": ld.flatten_children(df.withColumn("modulos", unit), "modulos", "dire_id", {"timo_id": "timo_id", "ditm_nombre": "ditm_nombre"}, "ditm_orden"),
    }
    order = {"address_via": "divi_orden", "address_comp": "diti_orden", "address_mod": "ditm_orden"}
    return {name: ld.upsert(rows.limit(0), rows, KEYS[name], order[name]) for name, rows in tables.items()}


def load_normalized(spark: SparkSession, path: str, done: DataFrame, central: DataFrame | None = None) -> int:
    """Load normalised rows (dire_id, es_procesado, zona_id, referencia, at and the lists) into the live tables under path; the version.

    All four tables change in one commit: if one fails, none changes. central is needed for the first load only. Of a row
    that is observed, zone and reference are cleared (U3); its earlier children stay. A dire_id may occur once in done.
    """
    live = live_tables(spark, path)
    done = cut(done)
    address = live.get("address", central)
    if address is None:
        raise ValueError("the first load needs the central table")
    tables = {"address": ld.update_central(address, done.select("dire_id", "es_procesado", "zona_id", "referencia", "at"))}
    for name, rows in child_tables(done.where("es_procesado")).items():
        tables[name] = ld.upsert(live[name], rows, KEYS[name]) if name in live else rows
    return commit_tables(spark, path, tables)
