"""Views, reports and exports (Q1 to Q18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_view(address: DataFrame, vias: DataFrame, streets: DataFrame, zones: DataFrame, places: int = 3) -> DataFrame:
    """Q1: one row an address with its first streets side by side, by one aggregation of the children."""
    named = vias.join(streets.select("via_id", "nom_via", "id_tipo_via"), "via_id", "left")
    pick = F.struct("via_id", "nom_via", "id_tipo_via", "divi_numero")
    sides = named.groupBy("dire_id").agg(*[F.min(F.when(F.col("divi_orden") == k, pick)).alias(f"_v{k}") for k in range(1, places + 1)])
    cols = [F.col(f"_v{k}.{frm}").alias(f"{to}_{k}") for k in range(1, places + 1) for frm, to in (("nom_via", "via"), ("id_tipo_via", "tipo_via"), ("divi_numero", "numero"))]
    z = zones.select("zona_id", "nom_zona", "id_tipo_zona")
    return address.join(sides, "dire_id", "left").join(z, "zona_id", "left").select(*address.columns, "nom_zona", "id_tipo_zona", *cols)


def nested_view(address: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q2: one row an address with an array of each kind of child; every child is aggregated first."""
    out = address
    for name, (df, fields) in children.items():
        if "estado" in df.columns:
            df = df.where(F.col("estado") == "A")
        kind = "array<struct<" + ",".join(f"{f}:{df.schema[f].dataType.simpleString()}" for f in fields) + ">>"
        rows = df.groupBy("dire_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(name))
        out = out.join(rows, "dire_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def source_view(source: DataFrame, wide: DataFrame) -> DataFrame:
    """Q3: the source's columns with those of the wide view."""
    return source.join(wide.select("dire_id", *[c for c in wide.columns if c not in source.columns]), "dire_id", "left")


def _counts(s: Column) -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(s.isNull()).alias("pendientes"), F.count_if(s).alias("validos"), F.count_if(~s).alias("observados")]


def status_counts(df: DataFrame) -> DataFrame:
    """Q4."""
    return df.agg(*_counts(F.col("dire_es_procesado")))


def overview(df: DataFrame) -> DataFrame:
    """Q5: counts and last date of each source; blank names get defaults."""
    name = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    rows = df.select(name("dire_esquema", "public"), name("dire_tabla", "sin_tabla"), "dire_es_procesado", F.coalesce("update_at", "create_at").alias("_at"))
    return rows.groupBy("dire_esquema", "dire_tabla").agg(*_counts(F.col("dire_es_procesado")), F.max("_at").alias("ultima"))


def global_counts(df: DataFrame) -> DataFrame:
    """Q6: counts and the number of sources, both from the overview."""
    per = overview(df)
    return per.agg(*[F.sum(c).alias(c) for c in ("total", "pendientes", "validos", "observados")], F.count("*").alias("fuentes"))


def effectiveness(df: DataFrame) -> DataFrame:
    """Q7: valid among processed addresses of each source, in per cent."""
    done = F.count("dire_es_procesado")
    return df.groupBy("dire_esquema", "dire_tabla").agg(F.when(done > 0, F.round(100.0 * F.count_if("dire_es_procesado") / done, 2)).alias("efectividad"))


def observed(df: DataFrame) -> DataFrame:
    """Q8: observed addresses with their note."""
    return df.where(~F.col("dire_es_procesado")).select("dire_id", "dire_valor_origen", F.coalesce("dire_referencia", F.lit("SIN OBSERVACION")).alias("nota"))


def transition(df: DataFrame) -> DataFrame:
    """Q9: rows by stage of the transition and how many still hold their text."""
    s = F.col("dire_es_procesado")
    label = F.when(s, "CANONICA").when(~s, "SUGERENCIA").otherwise("PENDIENTE")
    return df.groupBy(label.alias("etapa")).agg(F.count("*").alias("total"), F.count("dire_valor_origen").alias("con_texto"))


def run_summary(results: DataFrame) -> DataFrame:
    """Q10: rows by method and outcome."""
    return results.groupBy("metodo").agg(F.count("*").alias("procesados"), F.count_if("es_procesado").alias("validos"), F.count_if(~F.col("es_procesado")).alias("observados"))


def progress(log: DataFrame, run: str, at: str, ok: Column) -> DataFrame:
    """Q11: running counts, share, seconds, rate and remaining time of each run, first summed by second.

    The log is summed by run and second before the window, so a run's window holds seconds, not rows.
    """
    per = log.groupBy(F.col(run).alias("run"), F.date_trunc("second", at).alias("at")).agg(F.count("*").alias("n"), F.count_if(ok).alias("k"))
    upto = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("run")
    per = per.withColumn("done", F.sum("n").over(upto)).withColumn("valid", F.sum("k").over(upto)).withColumn("total", F.sum("n").over(all_))
    seconds = F.unix_timestamp("at") - F.unix_timestamp(F.min("at").over(all_))
    per = per.withColumn("seconds", seconds).withColumn("pct", F.round(100.0 * F.col("done") / F.col("total"), 2))
    per = per.withColumn("rate", F.when(F.col("seconds") > 0, F.round(F.col("done") / F.col("seconds"), 4)))
    return per.withColumn("remaining", F.when(F.col("seconds") > 0, F.round((F.col("total") - F.col("done")) * F.col("seconds") / F.col("done"), 2))).drop("n", "k")


def export_status(s: Column) -> Column:
    """The word for a state."""
    return F.when(s, "NORMALIZADO").when(~s, "OBSERVADO").otherwise("PENDIENTE")


def enrich(source: DataFrame, streets: DataFrame, zones: DataFrame, street_types: DataFrame, zone_types: DataFrame) -> DataFrame:
    """Q14: names and type names of a flat source row's street and zone ids."""
    st = street_types.select(F.col("id").alias("id_tipo_via"), F.col("name").alias("tipo_via_nombre"))
    zt = zone_types.select(F.col("id").alias("id_tipo_zona"), F.col("name").alias("tipo_zona_nombre"))
    out = source.join(streets.select("via_id", "nom_via", "id_tipo_via"), "via_id", "left").join(zones.select("zona_id", "nom_zona", "id_tipo_zona"), "zona_id", "left")
    return out.join(st, "id_tipo_via", "left").join(zt, "id_tipo_zona", "left")


def header_sizes(nested: DataFrame) -> DataFrame:
    """Q15: the most streets, units and components of any row: what the flat export's header needs."""
    return nested.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"max_{c}") for c in ("vias", "modulos", "componentes")])


def flat_export(nested: DataFrame, streets: int | None = None) -> DataFrame:
    """Q16: one flat row an address: status, streets 1..n, corner text, plot, units, reference.

    n is the most streets of any address (Q15), three at least, unless it is told.
    """
    streets = max(3, header_sizes(nested).first()["max_vias"]) if streets is None else streets
    part = lambda i: F.get(F.transform(F.filter("componentes", lambda c: c["codi_id"] == i), lambda c: c["diti_valor"]), F.lit(0))
    name = lambda k: F.get("vias", F.lit(k - 1))["via_nombre"]
    cols = [x for k in range(1, streets + 1) for x in (name(k).alias(f"via_{k}"), F.get("vias", F.lit(k - 1))["divi_numero"].alias(f"numero_{k}"))]
    corner = F.when(F.size("vias") > 1, F.array_join(F.transform("vias", lambda v: v["via_nombre"]), " CON "))
    units = F.array_join(F.transform("modulos", lambda m: F.concat_ws(" ", m["timo_id"].cast("string"), m["ditm_nombre"])), "; ")
    return nested.select("dire_id", export_status(F.col("dire_es_procesado")).alias("estado"), *cols, corner.alias("esquina"), part(1).alias("manzana"), part(2).alias("lote"), part(3).alias("sublote"), part(4).alias("piso"), part(11).alias("block"), units.alias("unidades"), F.col("dire_referencia").alias("referencia"))


def nested_export(nested: DataFrame) -> DataFrame:
    """Q17: the record with a `catastro` block, for JSON."""
    block = F.struct("vias", "componentes", "modulos", F.col("dire_referencia").alias("referencia"))
    return nested.select(F.col("dire_id").alias("id"), export_status(F.col("dire_es_procesado")).alias("estado"), F.when(F.col("dire_es_procesado"), block).alias("catastro"))


def day_cycle(at: Column, start: str, end: str | None) -> Column:
    """Q18: struct of the cycle's id and whether the time lies in its window; windows may cross midnight."""
    hm = F.date_format(at, "HH:mm")
    if end is None:
        inside, back = hm == start, F.lit(False)
    elif start < end:
        inside, back = (hm >= start) & (hm < end), F.lit(False)
    elif start > end:
        inside, back = (hm >= start) | (hm < end), hm < end
    else:
        inside, back = F.lit(True), F.lit(False)
    day = F.when(back, F.date_sub(F.to_date(at), 1)).otherwise(F.to_date(at))
    return F.struct(F.concat(F.lit("cycle_"), F.date_format(day, "yyyy-MM-dd"), F.lit(f"_{start}")).alias("cycle"), inside.alias("inside"))
