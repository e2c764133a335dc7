"""Dense numbers in an order, without a window over all rows (or over a hot group) in one task.

Rows are dealt by ranges of the order and sorted within their partition, and the table is written once, so
that reruns see the same numbers. A row's number is its place in its partition plus the rows of its group in
earlier partitions. Those counts are one row for each group and partition: a group, however large, has as
many of them as partitions that it spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_AT = "_numbered_at"
_PART, _FIRST, _ROWS, _BEFORE = "_numbered_part", "_numbered_first", "_numbered_rows", "_numbered_before"


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None, name: str = "n", start: int = 1, paths: list[str] | None = None) -> DataFrame:
    """df with `name`: start, start + 1, ... in `order` (nulls first) within each group of equal `by` (null is a group).

    Rows that tie in the whole order get numbers in any order, each its own. Extra columns stay; one called
    `name` is replaced. An empty table stays empty. paths gets the path of the written table.
    """
    by = by or []
    df = df.drop(name)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    held = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    held = cut(held, paths).withColumn(_PART, F.shiftrightunsigned(_AT, 33))
    spans = held.groupBy(_PART, *by).agg(F.min(_AT).alias(_FIRST), F.count("*").alias(_ROWS))
    if by:
        earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn(_BEFORE, F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)))
        left, right = held.alias("_held"), spans.alias("_spans")
        same = F.col(f"_held.{_PART}") == F.col(f"_spans.{_PART}")
        for c in by:
            same &= F.col(f"_held.{c}").eqNullSafe(F.col(f"_spans.{c}"))
        both = left.join(right, same)
    else:  # one row for each partition, whatever the table's size
        before, rows = 0, []
        for r in sorted(spans.collect(), key=lambda r: r[_PART]):
            rows.append((r[_PART], r[_FIRST], before))
            before += r[_ROWS]
        spans = df.sparkSession.createDataFrame(rows, f"{_PART} long, {_FIRST} long, {_BEFORE} long")
        both = held.alias("_held").join(F.broadcast(spans), _PART)
    number = F.col(_AT) - F.col(_FIRST) + F.col(_BEFORE) + F.lit(start)
    return both.select(*[F.col(f"_held.`{c}`") for c in df.columns], number.alias(name))
