"""Word vocabulary and token-id rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.constants import DEFAULT_MAX_TOKENS, IGNORED_LABEL, PAD_ID, SPECIAL_TOKENS, UNK_ID
from notewright.session import cut_lineage

# The first entries are the most frequent words. This many go to every task; all others are found by a shuffled join.
FREQUENT = 100_000
_IN_PARTITION = (1 << 33) - 1
_PARTS = ["_row_key", "_row", "_found", "_place", "_item"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def ranked_words(counts: DataFrame, size: int | None = None) -> DataFrame:
    """(word, n, rank): words by frequency, ties by code point, ranked from 0; all of them, or the first ``size``.

    Ranges of the order are numbered where they lie; only the sizes of the ranges meet in one task.
    """
    order = [F.desc("n"), F.asc("word")]
    placed = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    placed = cut_lineage(placed.select("word", "n", F.spark_partition_id().alias("part"), place.alias("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(starts, "part").select("word", "n", (F.col("start") + F.col("place")).alias("rank"))
    return ranked if size is None else ranked.where(F.col("rank") < size)


def build(texts: DataFrame, size: int | None = None) -> DataFrame:
    """(word, id): the special tokens, then words by frequency; all of them, or ``size`` entries at most."""
    counted = word_counts(texts).where(~F.col("word").isin(SPECIAL_TOKENS))
    ranked = ranked_words(counted, None if size is None else size - len(SPECIAL_TOKENS)).select(
        "word", (F.col("rank") + len(SPECIAL_TOKENS)).cast("int").alias("id")
    )
    special = texts.sparkSession.range(len(SPECIAL_TOKENS)).select(
        F.get(F.array(*[F.lit(t) for t in SPECIAL_TOKENS]), F.col("id").cast("int")).alias("word"),
        F.col("id").cast("int").alias("id"),
    )
    return special.unionByName(ranked)


def _with_frequent(keys: pa.Array):
    """Rows (key, _row, items) as one row with ``found``, the places of its items among ``keys``, and one row per item that is not there.

    Missing items have no place and are looked for no further. The k-th further row of a row is for its k-th gap.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            items, sizes = lists.flatten(), pc.list_value_length(lists)
            places = pc.index_in(items, value_set=keys, skip_nulls=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32())
            n, none = len(batch), pa.nulls
            rows = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, places), none(n, pa.int32()), none(n, items.type)]
            yield pa.RecordBatch.from_arrays(rows, names=_PARTS)
            gaps = np.flatnonzero(pc.and_(pc.is_null(places), pc.is_valid(items)).to_numpy(zero_copy_only=False))
            of_row = pa.array(np.searchsorted(ends.to_numpy()[1:], gaps, side="right"))
            pos = pa.array(gaps - ends.to_numpy()[of_row.to_numpy()], pa.int32())
            n = len(gaps)
            rest = [none(n, batch.column(0).type), batch.column(1).take(of_row), none(n, pa.list_(places.type)), pos, items.take(pa.array(gaps))]
            yield pa.RecordBatch.from_arrays(rest, names=_PARTS)

    return run


def _merged(values: pa.Array):
    """(key, found, places, others) as (key, listed): the values at the places ``found``, and those of ``others`` put at theirs."""

    def run(batches):
        for batch in batches:
            lists, others = batch.column(1), batch.column(3)
            found, ends = values.take(lists.flatten()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            places = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            starts = np.repeat(ends[:-1], pc.list_value_length(others).to_numpy(zero_copy_only=False))
            mask = np.zeros(len(found), dtype=bool)
            mask[(starts + places).astype(np.int64)] = True
            whole = pc.replace_with_mask(found, pa.array(mask), others.flatten()) if len(places) else found
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["key", "listed"])

    return run


def _looked_up(rows: DataFrame, key: str, items: str, vocabulary: DataFrame, column: str, wanted: str, filler: Column) -> DataFrame:
    """(key, listed): for each item of a list ``wanted`` of the vocabulary entry that equals ``column``, null if there is none.

    Every row keeps a row of its own, also where keys repeat. Frequent items are found where their list lies, among the FREQUENT first
    entries; only the others travel, one by one, to a shuffled join with the rest. The lists go through it too, under ``filler``, a value
    that no entry has, and meet what was found at their row.
    """
    entries = vocabulary.select(column, wanted)
    head = entries.where(F.col("id") < FREQUENT).toArrow().combine_chunks()
    types = [rows.schema[key].dataType, T.LongType(), T.ArrayType(T.IntegerType()), T.IntegerType(), entries.schema[column].dataType]
    numbered = rows.select(key, F.monotonically_increasing_id().alias("_row"), F.coalesce(items, F.array().cast(rows.schema[items].dataType)))
    keys, values = (head.column(c).combine_chunks() for c in (column, wanted))
    parts = numbered.mapInArrow(_with_frequent(keys), T.StructType([T.StructField(n, t) for n, t in zip(_PARTS, types)]))
    tail = entries.where(F.col("id") >= FREQUENT).select(F.col(column).alias("_tail"), F.col(wanted).alias("_rest"))
    joined = parts.withColumn("_key", F.coalesce("_item", filler)).join(tail, F.col("_key") == F.col("_tail"), "left")
    other = F.when(F.col("_place").isNotNull(), F.struct("_place", "_rest"))
    held = joined.groupBy("_row").agg(
        F.first("_row_key", ignorenulls=True).alias("key"), F.first("_found", ignorenulls=True).alias("found"),
        F.array_sort(F.collect_list(other)).alias("others"),
    )
    split = held.select("key", "found", F.col("others._place").alias("places"), F.col("others._rest").alias("others"))
    merged = split.mapInArrow(
        _merged(values), T.StructType([T.StructField("key", types[0]), T.StructField("listed", T.ArrayType(entries.schema[wanted].dataType))])
    )
    return merged.withColumnRenamed("key", key)


def encode(texts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, input_ids): ids of the words of each text, unknown words as [UNK]; null and empty texts have no ids."""
    rows = texts.select(key, words(F.col("text")).alias("words"))
    filler = F.concat(F.lit("\u0000 "), F.pmod(F.xxhash64("_row"), F.lit(1009)).cast("string"))
    found = _looked_up(rows, key, "words", vocabulary, "word", "id", filler)
    return found.select(key, F.transform("listed", lambda i: F.coalesce(i, F.lit(UNK_ID))).alias("input_ids"))


def truncate(rows: DataFrame, n: int = DEFAULT_MAX_TOKENS) -> DataFrame:
    return rows.withColumn("input_ids", F.slice("input_ids", 1, n))


def pad(rows: DataFrame, batch: str) -> DataFrame:
    """Pad every row to the longest of its batch; the mask marks real tokens."""
    rows = cut_lineage(rows)  # read for the longest rows and for the padding, made once
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_longest"))
    size = F.size("input_ids")
    missing = F.col("_longest") - size
    joined = rows.join(longest, batch)
    mask = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), missing))
    padded = F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), missing))
    return joined.withColumns({"attention_mask": mask, "input_ids": padded}).drop("_longest")


def labels(rows: DataFrame) -> DataFrame:
    """Training labels: the ids, padding ignored."""
    ignored = F.transform("input_ids", lambda x: F.when(x == PAD_ID, IGNORED_LABEL).otherwise(x))
    return rows.withColumn("labels", ignored)


def to_text(rows: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, text): the words of each id row; an id that the vocabulary lacks is left out."""
    filler = (-1 - F.pmod(F.xxhash64("_row"), F.lit(1009))).cast("int")
    found = _looked_up(rows, key, "input_ids", vocabulary, "id", "word", filler)
    return found.select(key, F.array_join("listed", " ").alias("text"))


def checked(rows: DataFrame) -> DataFrame:
    """The rows, after a check that they carry token ids."""
    if "input_ids" not in rows.columns:
        raise ValueError(f"no input_ids among {rows.columns}")
    return rows
