"""Uniform shuffle into shards of exact size: hypergeometric communication matrix, local permutation, exchange, permutation.

A uniform permutation of n rows decides, for every input partition, how many of its rows go to every shard: a matrix with
given row sums (rows of the partitions) and column sums (sizes of the shards) whose law is multivariate hypergeometric. The
driver draws this matrix only (partitions x shards numbers); each partition then deals a random permutation of its own shard
labels to its rows, the rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notewright.session import cut_lineage

#: Rows of a shard that one task permutes.
CHUNK_ROWS = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` out of `good + bad`, for any size: the inverse of the distribution, walked out from the mode."""
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(total, drawn))
    left = right = mode
    p_left = p_right = at_mode
    u = rng.random() - at_mode
    while u > 0:
        moved = False
        if right < high:
            p_right *= (good - right) / (right + 1) * (drawn - right) / (bad - drawn + right + 1)
            right += 1
            u -= p_right
            moved = p_right > 0
            if u <= 0:
                return right
        if left > low:
            p_left *= left / (good - left + 1) * (bad - drawn + left) / (drawn - left + 1)
            left -= 1
            u -= p_left
            moved = moved or p_left > 0
            if u <= 0:
                return left
        if not moved:
            return mode
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each partition go to each shard; shard sizes differ by at most one."""
    total = sum(rows)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng([seed, 1])
    matrix = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        left, rest = n, sum(free)
        for s in range(shards):
            k = hypergeometric(rng, free[s], rest - free[s], left)
            matrix[p, s] = k
            rest -= free[s]
            free[s] -= k
            left -= k
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """`rows` with columns shard (int) and slot (long, gapless from 0 in each shard); any permutation is equally likely.

    Shard sizes differ by at most one. The input is cut with checkpoint(): counts and labels must see the same partitions, also
    after an executor is lost. Pass keys and sizes rather than texts where that will do. Repeated rows, ties and nulls are rows
    like any other; equal rows are dealt one by one, so no key can be hot. An empty table gives no rows. Input columns named
    shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot", "_order")]
    rows = cut_lineage(rows.select(*kept))
    counted = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    index = {r["p"]: i for i, r in enumerate(sorted(counted, key=lambda r: r["p"]))}
    sizes = [r["count"] for r in sorted(counted, key=lambda r: r["p"])]
    matrix = communication_matrix(sizes, shards, seed)
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("_order", T.LongType())])
    per_partition = {p: matrix[i] for p, i in index.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, 2, p])
        labels, at = None, 0
        for batch in batches:
            if labels is None:
                labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), per_partition[p]))
            yield batch.assign(shard=labels[at : at + len(batch)], _order=rng.integers(0, 1 << 62, len(batch)))
            at += len(batch)

    dealt = rows.mapInPandas(deal, schema)
    # The second permutation: random numbers cut into chunks of their range, so that a shard is the work of many tasks.
    chunks = max(1, -(-sum(sizes) // shards // CHUNK_ROWS))
    chunk = F.shiftright("_order", 32) * chunks / F.lit(1 << 30)
    dealt = dealt.withColumn("_chunk", F.floor(chunk).cast("int"))
    if chunks == 1:
        first = F.lit(0).cast("long")
    else:
        dealt = cut_lineage(dealt)
        before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("shard", "_chunk").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0)))
        dealt = dealt.join(starts.drop("count"), ["shard", "_chunk"])
        first = F.col("_first")
    order = Window.partitionBy("shard", "_chunk").orderBy("_order", *[c for c in kept if _sortable(rows.schema[c].dataType)])
    return dealt.select(*kept, "shard", (F.row_number().over(order) - 1 + first).cast("long").alias("slot"))


def _sortable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents; law `rows`.

    size is the UTF-8 bytes of the text plus 8 (null: 8), text_crc32 that of the UTF-8 bytes (null: that of none, 0). The law
    fixes counts, so equal texts may be in different shards. Only ids, sizes and checksums are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shuffle_into_shards(keys, shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
