"""Tables that change as a whole: staged folders, made visible by one manifest (W1's load, the stream's target).

Data is written to new folders only. A manifest, one small JSON file a version, names the live ones; a
version comes into being by the rename of a finished file to a name that must not exist yet. So a reader sees
the old state or the new one, a crash before the rename leaves the old state, and of two writers that started
from one version the second fails. Folders that no manifest names are dead; `vacuum` deletes them.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Manifest:
    """The versions of what lies under a folder of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str = "") -> list[str]:
        where = self._at(f"{self.path}/{folder}" if folder else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def version(self) -> int:
        """The live version; 0 if there is none."""
        return max((int(n.split(".")[0]) for n in self.names("_manifest") if n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._at(f"{self.path}/_manifest/{version:020d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def swap(self, version: int, state: dict) -> None:
        """Make state the version after `version`."""
        draft = self._at(f"{self.path}/_manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        final = self._at(f"{self.path}/_manifest/{version + 1:020d}.json")
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._hadoop.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = rename
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), options)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {version + 1} of {self.path} exists") from error
            raise

    def vacuum(self, live: set[str]) -> list[str]:
        """Delete all folders but the live ones, and the manifests before the last."""
        dead = [n for n in self.names() if n != "_manifest" and n not in live]
        old = [f"_manifest/{n}" for n in self.names("_manifest") if not n.startswith(f"{self.version():020d}")]
        for n in [*dead, *old]:
            self._fs.delete(self._at(f"{self.path}/{n}"), True)
        return dead


def commit_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables and make them visible together; the version. Tables that aren't given stay as they are.

    If one fails, none is visible. The tables may read the live ones.
    """
    manifest = Manifest(spark, path)
    version = manifest.version()
    state = manifest.read(version) or {"tables": {}}
    for name, df in tables.items():
        folder = f"{name}-{version + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        state["tables"][name] = {"folder": folder, "schema": df.schema.json()}
    manifest.swap(version, state)
    return version + 1


def live_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last commit, by name."""
    state = Manifest(spark, path).read()
    schema = lambda t: StructType.fromJson(json.loads(t["schema"]))
    return {name: spark.read.schema(schema(t)).parquet(f"{path}/{t['folder']}") for name, t in state.get("tables", {}).items()}


def vacuum_tables(spark: SparkSession, path: str) -> list[str]:
    manifest = Manifest(spark, path)
    return manifest.vacuum({t["folder"] for t in manifest.read().get("tables", {}).values()})


class KeyedTable:
    """One row a key, in buckets by the key's hash; batches are put on top and merged from time to time.

    A batch is one folder with a part a bucket. The manifest names each bucket's live parts in order; once a bucket
    has more than `parts`, it is rewritten to one. A read merges at most `parts` + 1 rows of a key, whatever number
    of batches came before; a bucket of one part is read as it is. The manifest also names the last batch of each
    writer, so a batch that comes again changes nothing. A batch's rows must have distinct keys; rows with a
    null key are refused. Of a key's rows the last put wins, or the one with the greatest `order` (null least).
    Columns must stay the same. `_version` and `_bucket` are the table's own columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, parts: int = 4, order: str | None = None):
        self.spark, self.path, self.key, self.parts, self.order = spark, path, key, parts, order
        self.manifest = Manifest(spark, path)
        self.buckets = self.manifest.read().get("buckets", buckets)

    def put(self, rows: DataFrame, batch: int, writer: str = "") -> bool:
        """Put a batch on top; False if that writer's batch is there already."""
        version = self.manifest.version()
        state = self.manifest.read(version) or {"buckets": self.buckets, "parts": {}, "batches": {}, "schema": rows.schema.json()}
        if state["batches"].get(writer, -1) >= batch:
            return False
        rows = rows.withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"null {self.key}"))).otherwise(F.col(self.key)))
        folder = self._write(rows.withColumn("_version", F.lit(version + 1)), version)
        for bucket in self._written(folder):
            state["parts"].setdefault(bucket, []).append(folder)
        full = [b for b, folders in state["parts"].items() if len(folders) > self.parts]
        if full:
            merged = self._write(self._merged(state, full), version)
            state["parts"].update({b: [merged] for b in full})
        state["batches"][writer] = batch
        self.manifest.swap(version, state)
        return True

    def current(self) -> DataFrame | None:
        """The latest row of each key, from the live parts only; None before the first batch."""
        state = self.manifest.read()
        if not state:
            return None
        alone = [b for b, folders in state["parts"].items() if len(folders) == 1]
        several = [b for b, folders in state["parts"].items() if len(folders) > 1]
        both = self._read(state, alone).unionByName(self._merged(state, several))
        return both.drop("_version")

    def vacuum(self) -> list[str]:
        return self.manifest.vacuum({f for folders in self.manifest.read().get("parts", {}).values() for f in folders})

    def _write(self, rows: DataFrame, version: int) -> str:
        folder = f"part-{version + 1}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _written(self, folder: str) -> list[str]:
        return [n.removeprefix("_bucket=") for n in self.manifest.names(folder) if n.startswith("_bucket=")]

    def _read(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"])).add("_version", "integer")
        paths = [f"{self.path}/{f}/_bucket={b}" for b in buckets for f in state["parts"][b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, state: dict, buckets: list[str]) -> DataFrame:
        rows = self._read(state, buckets)
        others = [c for c in rows.columns if c != self.key]
        rank = F.struct(*([self.order] if self.order else []), "_version")
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), rank).alias("_r"))
        return best.select(*[F.col(c) if c == self.key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
