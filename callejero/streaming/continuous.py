"""Continuous normalisation.

The target is a keyed table whose versions are swapped by a manifest (sources/generations.py), so a read sees
whole batches only and touches live parts only, and a batch that is tried again changes nothing. Rows that a
step can't read go to a second table of that kind, with what failed and how often, and the rest goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.load import address_key
from ..operators.views import day_cycle
from ..session import cut
from ..sources.generations import KeyedTable

#: A step that reads a text column: its name, the column, and the expression that is null where the text can't be read.
Step = tuple[str, str, Column]


def read_steps(dates: list[str] = (), numbers: list[str] = (), answers: list[str] = ()) -> list[Step]:
    """Steps for texts that hold times, whole numbers of 64 bits, and JSON (which stays text)."""
    steps = [(f"time {c}", c, F.try_to_timestamp(F.col(c))) for c in dates]
    steps += [(f"number {c}", c, F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")) for c in numbers]
    return steps + [(f"answer {c}", c, F.when(F.try_parse_json(c).isNotNull(), F.col(c))) for c in answers]


def checked(raw: DataFrame, steps: list[Step]) -> DataFrame:
    """raw with each step's column read, and `errors`: the steps that failed, with the text they failed on. Null texts fail nowhere."""
    failed = [F.when(F.col(c).isNotNull() & value.isNull(), F.concat(F.lit(f"{name}: "), F.left(F.col(c), F.lit(60)))) for name, c, value in steps]
    errors = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return raw.withColumn("errors", errors).withColumns({c: value for _, c, value in steps})


def _target(spark: SparkSession, target: str, order: str | None = None) -> KeyedTable:
    return KeyedTable(spark, f"{target}/rows", "dire_id", order=order)


def _quarantine(spark: SparkSession, target: str) -> KeyedTable:
    return KeyedTable(spark, f"{target}/rejected", "reject_id")


def current(spark: SparkSession, target: str, order: str | None = None) -> DataFrame | None:
    """The latest row of each key; of rows that carry `order`, the one with the greatest."""
    return _target(spark, target, order).current()


def rejected(spark: SparkSession, target: str) -> DataFrame | None:
    """reject_id, row (as JSON), errors, attempts, resolved of all rows that failed once."""
    return _quarantine(spark, target).current()


def _sort_out(batch: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """The rows that could be read, and the others as reject_id, row, errors; rows with neither text nor id are unreadable."""
    whole = F.to_json(F.struct(*batch.columns), {"ignoreNullFields": "false"})
    read = cut(checked(batch.withColumn("_row", whole), steps))
    nothing = F.when(F.col("raw_text").isNull() & F.col("src_row_id").isNull(), F.array(F.lit("neither text nor id"))).otherwise(F.array().cast("array<string>"))
    read = read.withColumn("errors", F.concat("errors", F.when(F.size("errors") == 0, nothing).otherwise(F.array().cast("array<string>"))))
    bad = read.where(F.size("errors") > 0).select(F.xxhash64("_row").alias("reject_id"), F.col("_row").alias("row"), "errors").dropDuplicates(["reject_id"])
    return read.where(F.size("errors") == 0).drop("errors", "_row"), bad


def _put_rows(table: KeyedTable, rows: DataFrame, transform: Callable[[DataFrame], DataFrame], order: str | None, batch: int, writer: str) -> None:
    key = address_key(F.col("src_schema"), F.col("src_table"), F.col("src_row_id"), F.col("raw_text"))
    last = F.struct(*([order] if order else []), *[c for c in rows.columns if c != order])
    once = rows.groupBy(key.alias("_key")).agg(F.max(last).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns])
    table.put(transform(once).withColumn("dire_id", key), batch, writer)


def _put_rejects(table: KeyedTable, bad: DataFrame, passed: DataFrame | None, batch: int, writer: str) -> None:
    """Rejects with one attempt more than before; passed: reject_id and row of those that got through now."""
    bad = bad.withColumn("resolved", F.lit(False))
    if passed is not None:
        bad = bad.unionByName(passed.withColumn("errors", F.array().cast("array<string>")).withColumn("resolved", F.lit(True)))
    before = table.current()
    tried = F.lit(1)
    if before is not None:
        bad = bad.join(before.select("reject_id", F.col("attempts").alias("_tried")), "reject_id", "left")
        tried = F.coalesce("_tried", F.lit(0)) + 1
    table.put(bad.withColumn("attempts", tried.cast("int")).select("reject_id", "row", "errors", "attempts", "resolved"), batch, writer)


def continuous(raw: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, order: str | None = None, steps: list[Step] = ()) -> StreamingQuery:
    """Every micro-batch is read, normalised and put under its key, so a row seen twice changes nothing.

    Of several rows of a key, the one with the greatest `order` stays (without it: in one batch the one with the greatest
    values, over batches the last). Rows that a step can't read, or with neither text nor id, go to `rejected` with their
    errors and do not stop the run. A batch that failed between its two tables is completed when it comes again.
    """
    spark = raw.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        rows, bad = _sort_out(batch, list(steps))
        _put_rejects(_quarantine(spark, target), bad, None, batch_id, checkpoint)
        _put_rows(_target(spark, target, order), rows, transform, order, batch_id, checkpoint)

    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, target: str, schema: str, transform: Callable[[DataFrame], DataFrame], order: str | None = None, steps: list[Step] = (), most: int = 5) -> DataFrame:
    """Try the open rejects again that had fewer than `most` attempts; how many passed and failed, as one row.

    schema: that of the raw rows. Rows that pass are put under their key like those of a batch, and marked resolved.
    """
    table = _quarantine(spark, target)
    found = rejected(spark, target)
    if found is None:
        return spark.createDataFrame([(0, 0)], "passed long, failed long")
    open_ = cut(found.where(~F.col("resolved") & (F.col("attempts") < most)).select("reject_id", "row"))
    raw = open_.select("reject_id", "row", F.from_json("row", schema).alias("_r")).select("reject_id", "row", "_r.*")
    rows, bad = _sort_out(raw.drop("reject_id", "row"), list(steps))
    bad = cut(bad)
    passed = cut(open_.join(bad.select("reject_id"), "reject_id", "left_anti"))
    turn = table.manifest.version()
    _put_rows(_target(spark, target, order), rows, transform, order, turn, "replay")
    _put_rejects(table, bad, passed, turn, "replay")
    return passed.agg(F.count("*").alias("passed")).join(bad.agg(F.count("*").alias("failed")))


def counts_by_window(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes", ok: Column | None = None) -> DataFrame:
    """Counts by window and kind, on a stream (with watermark) or a table."""
    df = events.withWatermark(at, late) if events.isStreaming else events
    return df.groupBy(F.window(at, width).alias("_w"), F.col(kind)).agg(F.count("*").alias("n"), *([F.count_if(ok).alias("ok")] if ok is not None else [])).select(F.col("_w.start").alias("start"), kind, "n", *(["ok"] if ok is not None else []))


def progress_by_cycle(rows: DataFrame, at: str, status: str, begin: str = "22:00", end: str = "06:00", late: str = "1 hour") -> DataFrame:
    """X3 with Q18: rows by day cycle and status, and how many of them lie inside the cycle's hours.

    A cycle that passes midnight (begin after end) takes the hours up to `end` to the day before, so its days are
    windows from `end` to `end`; others are calendar days, in the session's time zone UTC. On a stream the state of a
    cycle is dropped, and its counts are final, once the watermark passes its end; rows that come later are dropped.
    """
    df = rows.withWatermark(at, late) if rows.isStreaming else rows
    hours, minutes = (int(x) for x in (end if begin > end else "00:00").split(":"))
    window = F.window(at, "24 hours", "24 hours", f"{hours * 60 + minutes} minutes")
    inside = day_cycle(F.col(at), begin, end)["inside"]
    counts = df.groupBy(window.alias("_w"), F.col(status)).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))
    return counts.select(F.to_date("_w.start").alias("day"), status, "n", "inside")
