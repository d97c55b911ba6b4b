"""Ordered and grouped row operators: neighbours, counters, best rows, top-k, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifts_between(events: DataFrame, keys: list[str], time: str, order: list[str], chunk_units: int) -> DataFrame:
    """``shift_u``: time since the previous event of the same key.

    Order is (time, order). Neighbours are found inside time chunks; the first event of a chunk takes the last time
    of the nearest earlier chunk from a small summary. A key with very many events is spread over its chunks.
    """
    chunked = events.withColumn("_chunk", F.floor(F.col(time) / chunk_units))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time, *order)
    lasts = chunked.groupBy(*keys, "_chunk").agg(F.max(time).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk")
    carried = lasts.select(*keys, "_chunk", F.lag("_last", 1, 0).over(earlier).alias("_carried"))
    return (
        chunked.withColumn("_previous", F.lag(time).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn("shift_u", F.col(time) - F.coalesce("_previous", "_carried"))
        .drop("_chunk", "_previous", "_carried")
    )


def group_mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent non-null value per group, lowest on ties; a group with only nulls gets null."""
    counted = rows.where(F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    lowest = F.min_by(value, F.struct(F.col(value).isNull(), (-F.col("n")).alias("less"), F.col(value)))
    return counted.groupBy(group).agg(lowest.alias(value))


def with_group_mode(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Give each row the mode of its group; a null group gets null."""
    modes = group_mode(rows, group, value).withColumnRenamed(value, name)
    return rows.join(modes, group, "left")


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole first row per key in ``order`` (ascending sort keys), by aggregation with map-side combining."""
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    first = rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*rows.columns)


def descending(column: str) -> list[Column]:
    """Sort keys for a descending number with nulls last."""
    return [F.col(column).isNull().alias("missing"), (-F.col(column)).alias("less")]


def top_per_group(rows: DataFrame, group: str, count: str, item: str, k: int) -> DataFrame:
    """The k largest counts per group; ties by item. Input is already aggregated to one row per (group, item)."""
    order = Window.partitionBy(group).orderBy(F.desc(count), item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_in_group(rows: DataFrame, group: str, count: str, whole_numbers: bool) -> DataFrame:
    """Percentage of ``count`` among the rows kept for a group."""
    totals = rows.groupBy(group).agg(F.sum(count).alias("_total"))
    share = F.col(count) * 100 / F.col("_total")
    share = F.floor(share) if whole_numbers else share
    return rows.join(totals, group).withColumn("percentage", share).drop("_total")


def top_k(rows: DataFrame, count: str, item: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(count), item).limit(k)


def strided_head(rows: DataFrame, order: str, head: int, step: int) -> DataFrame:
    """Rows 0, step, 2*step ... of the first ``head`` rows; only ``head`` rows are ever numbered."""
    first = rows.orderBy(order).limit(head)
    return first.withColumn("row", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("row") % step == 0)


def nth_row(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The single row at 0-based position n."""
    first = rows.orderBy(order).limit(n + 1)
    return first.withColumn("_row", F.row_number().over(Window.orderBy(order))).where(F.col("_row") == n + 1).drop("_row")


def hash_order(key: Column, seed: int) -> Column:
    """Repeatable random order, the same in any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def distinct_values(rows: DataFrame, value: str, row_id: str) -> DataFrame:
    """Distinct values with the id of their first row."""
    return rows.groupBy(value).agg(F.min(row_id).alias("first_row"))
