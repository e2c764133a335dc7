"""Address tables derived from the order tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.numbering import numbered
from ..session import cut, let_workers_import

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]

VIEWS = {
    "via_catalog": """
SELECT CAST(row_number() OVER (ORDER BY nom_via, id_tipo_via, sector, condicion) AS BIGINT) AS via_id, id_tipo_via, nom_via, sector, condicion
FROM (SELECT DISTINCT upper(p_name) AS nom_via, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS id_tipo_via,
             'S' || CAST(p_size % 3 AS STRING) AS sector, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'P' END AS condicion FROM part) t""",
    "zona_catalog": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS zona_id, CAST(1 + n_regionkey AS INT) AS id_tipo_zona, 'SECTOR ' || replace(n_name, '_', ' ') AS nom_zona,
       'S' || CAST(n_nationkey % 3 AS STRING) AS sector FROM nation""",
    "raw_addresses": """
SELECT CASE o_orderstatus WHEN 'F' THEN 'licencias' WHEN 'O' THEN 'rentas' ELSE 'catastro' END AS src_schema, 'orders' AS src_table, 'direccion' AS src_column, o_orderkey AS src_row_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '  ' ELSE
         (CASE o_orderkey % 5 WHEN 0 THEN 'AV ' WHEN 1 THEN 'Ca. ' WHEN 2 THEN 'JR ' WHEN 3 THEN 'PJE. ' ELSE 'CHICLAYO-' END)
         || CASE WHEN o_orderkey % 41 = 0 THEN 'NO SUCH STREET' ELSE v.nom_via END
         || (CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(100 + o_orderkey % 900 AS STRING), 5, '0') WHEN 1 THEN ' NRO. ' || CAST(100 + o_orderkey % 900 AS STRING)
                                 WHEN 2 THEN ' N ' || CAST(100 + o_orderkey % 900 AS STRING) ELSE ' S/N' END)
         || (CASE WHEN o_orderkey % 3 = 0 THEN ' INT. 17-19' WHEN o_orderkey % 7 = 0 THEN ' DPTO. 201 3 PISO' WHEN o_orderkey % 11 = 0 THEN ' MZ. B LT. 12' ELSE '' END)
         || (CASE WHEN o_orderkey % 2 = 0 THEN ' URB. SECTOR ' || replace(n.n_name, '_', ' ') ELSE '' END)
         || (CASE WHEN o_orderkey % 13 = 0 THEN ' (EX CALLE REAL), TIENDAS 3, 4, 5 Y 6' WHEN o_orderkey % 17 = 0 THEN ' FRENTE AL PARQUE' ELSE '' END)
         || ' - CHICLAYO' END AS raw_text,
       CASE WHEN o_orderkey % 10 < 6 THEN CAST(NULL AS BOOLEAN) ELSE o_orderkey % 10 < 9 END AS status, o_orderdate AS create_at
FROM (SELECT *, 1 + o_orderkey % (SELECT count(*) FROM via_catalog) AS o_via FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN via_catalog v ON v.via_id = o.o_via""",
    # The stored form of the raw addresses: some of them already settled.
    "central": """
SELECT src_row_id AS dire_id, CASE WHEN status THEN 1 + src_row_id % 25 END AS zona_id, src_schema AS dire_esquema, src_table AS dire_tabla, src_column AS dire_columna,
       CASE WHEN src_row_id % 23 = 0 THEN NULL ELSE src_row_id END AS dire_tabla_id, CASE WHEN trim(raw_text) <> '' THEN raw_text END AS dire_valor_origen, status AS dire_es_procesado, 'A' AS dire_estado,
       CASE WHEN status THEN 'FRENTE AL PARQUE' END AS dire_referencia, create_at, CASE WHEN status IS NOT NULL THEN create_at END AS update_at FROM raw_addresses""",
    "address_via": """
SELECT l_orderkey AS dire_id, CAST(1 + l_partkey % 997 AS BIGINT) AS via_id, min(CAST(l_suppkey AS STRING)) AS divi_numero, CAST(min(l_linenumber) AS INT) AS divi_orden, 'A' AS estado
FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, CAST(1 + l_partkey % 997 AS BIGINT)""",
    "address_comp": """
SELECT l_orderkey AS dire_id, CAST(1 + l_suppkey % 11 AS INT) AS codi_id, min(CAST(l_suppkey AS STRING)) AS diti_valor, CASE WHEN min(l_linenumber) % 5 = 0 THEN 'I' ELSE 'A' END AS estado
FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey, CAST(1 + l_suppkey % 11 AS INT)""",
    "address_mod": """
SELECT DISTINCT l_orderkey AS dire_id, CAST(1 + l_partkey % 6 AS INT) AS timo_id, CAST(l_partkey % 300 AS STRING) AS ditm_nombre, 'A' AS estado FROM lineitem WHERE l_linenumber = 1""",
}


#: Tables that many queries share, and whose plans are long: written once a session and folder.
_STORED = ("via_catalog", "raw_addresses")
_written: dict[tuple[str, str, str], DataFrame] = {}


class _Tables(dict):
    """The given tables and those derived from them, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if name in TABLES:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name not in VIEWS:
            raise KeyError(name)
        elif key in _written:
            self[name] = _written[key]
        else:
            self[name] = self._derived(name)
            if name == "raw_addresses":  # a short text is much work: the files of the orders may be too few for all cores
                self[name] = self[name].repartition(4 * self.spark.sparkContext.defaultParallelism)
            if name in _STORED:
                self[name] = _written[key] = cut(self[name])
        return self[name]

    def _derived(self, name: str) -> DataFrame:
        text = VIEWS[name]
        if name == "via_catalog":  # the catalogue grows with the parts: its rows are numbered by ranges
            rows = self.spark.sql(f"SELECT * {text[text.index('FROM (SELECT DISTINCT') :]}".replace("FROM part)", "FROM {part})"), part=self["part"])
            return numbered(rows, ["nom_via", "id_tipo_via", "sector", "condicion"], name="via_id").select("via_id", *rows.columns[1:2], "nom_via", "sector", "condicion")
        plain = f" {text} ".replace("\n", " ").replace(")", " )").replace("(", "( ")
        used = {k: self[k] for k in [*TABLES, *VIEWS] if k != name and f" {k} " in plain}
        for k in sorted(used, key=len, reverse=True):
            text = _named(text, k)
        return self.spark.sql(text, **used)


def demo_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The given and the derived tables, by name; those in _STORED are written when a query first asks for them."""
    return _Tables(let_workers_import(spark), sf_dir)


def _named(sql: str, name: str) -> str:
    """The table's name behind FROM and JOIN as a parameter."""
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {name} ", f"{word} {{{name}}} ").replace(f"{word} {name})", f"{word} {{{name}}})").replace(f"{word} {name}\n", f"{word} {{{name}}}\n")
        if sql.endswith(f"{word} {name}"):
            sql = sql[: -len(name)] + f"{{{name}}}"
    return sql


def with_views(sql: str) -> str:
    """The SQL with the derived views in front, for DuckDB."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, view in VIEWS.items():
            if name in text and name not in needed:
                need(view)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in VIEWS if name in needed)
    text = sql.lstrip()
    for begin in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(begin):
            return f"{begin}{views},\n{text[len(begin):]}"
    return f"WITH {views}\n{sql}"
