"""Helpers shared by the corpus operators: scratch tables and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, delete, let_workers_import, scratch_dir

__all__ = ["BROADCAST_ROWS", "Scratch", "apart", "scratch_dir", "stored", "table", "with_broadcast_if_small"]

#: Most rows of a side table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Write a table in the shared folder and read it back; this cuts the lineage.
stored = cut


class Scratch:
    """Stored tables that are deleted when the block ends; nothing lazy may depend on them by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        return cut(df, self.paths)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)


def with_broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if side (a stored or otherwise cheap table) has at most max_rows rows."""
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns that an operator names itself (`own`, in any case) set aside under fresh names, and what restores all columns."""
    taken, names = {c.lower() for c in docs.columns} | set(own), {}
    for c in docs.columns:
        if c.lower() in own:
            fresh = c
            while fresh.lower() in taken:
                fresh += "_"
            taken.add(fresh.lower())
            names[c] = fresh
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return let_workers_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")
