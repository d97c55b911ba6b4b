"""Joins of catalogue, names, genres and token sequences.

No side is broadcast by hint unless its size is fixed; the optimizer and adaptive execution choose from measured sizes
and split skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.names import first_artist, first_title


def names_table(raw_names: DataFrame) -> DataFrame:
    entry = F.col("title_artist")
    return raw_names.select("md5", first_artist(entry).alias("artist"), first_title(entry).alias("title"))


def genres_table(raw_genres: DataFrame) -> DataFrame:
    """One row per genre of the first list; an empty list keeps its md5."""
    return raw_genres.select("md5", F.explode_outer(F.get("genre", 0)).alias("genre"))


def names_with_genres(raw_names: DataFrame, raw_genres: DataFrame) -> DataFrame:
    return names_table(raw_names).join(genres_table(raw_genres), "md5", "left")


def statistics_with_names(statistics: DataFrame, names_genres: DataFrame) -> DataFrame:
    return statistics.join(names_genres, "md5", "left")


def pick(files: DataFrame, reference: DataFrame, key: str = "md5") -> DataFrame:
    """Rows of ``files`` whose key is in the reference list."""
    return files.join(reference.select(key), key, "left_semi")


def drop_small_groups(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Rows whose group has at least ``least`` rows; rows without a group stay."""
    small = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)
    return rows.join(small, group, "left_anti")


def replace_values(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace by a two-column mapping (old, new); unmapped values stay."""
    old, new = mapping.columns
    return (
        rows.join(mapping, rows[column] == mapping[old], "left")
        .withColumn(column, F.coalesce(F.col(new), F.col(column))).drop(old, new)
    )


def with_program_names(tracks: DataFrame, programs: DataFrame) -> DataFrame:
    """Family and name of each track's program; the dimension has 128 rows by definition."""
    return tracks.join(F.broadcast(programs), "program", "left")


def positional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Word-by-word pairs of two texts per key; the shorter one is padded with nulls."""
    both = left.select(key, F.split("text", " ").alias("a")).join(
        right.select(key, F.split("text", " ").alias("b")), key, "full"
    )
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select(key, F.posexplode(zipped).alias("pos", "pair")).select(
        key, "pos", F.col("pair.a").alias("left_word"), F.col("pair.b").alias("right_word")
    )
