"""Track coverage and activity.

True coverage counts the covered units of the time line exactly. Each note is cut at 64-unit cell borders and becomes
one 64-bit mask per cell; ``bit_or`` merges the masks of a cell (with map-side combining) and ``bit_count`` measures
the union. No sort, no window, and no group that grows with the number of notes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.constants import UNITS_PER_BAR, UNITS_PER_BEAT

CELL_UNITS = 64
MERGE_CHUNK_UNITS = 256
FRAME_UNITS = 1
# Notes whose frames are summed in one task.
NOTES_PER_TASK = 400_000


def piece_length(notes: DataFrame) -> DataFrame:
    """Beats in a piece, from the latest end."""
    return notes.groupBy("piece_id").agg(
        F.max("end_u").alias("max_end_u"), (F.max("end_u") / UNITS_PER_BEAT).alias("beat_count")
    )


def _listed() -> Column:
    return F.struct("start_u", "pitch", "end_u", "velocity")


def first_and_last(notes: DataFrame) -> DataFrame:
    """Start of the first listed note and end of the last listed one, in beats."""
    return notes.groupBy("piece_id", "track_id").agg(
        (F.min_by("start_u", _listed()) / UNITS_PER_BEAT).alias("first_start"),
        (F.max_by("end_u", _listed()) / UNITS_PER_BEAT).alias("last_end"),
    )


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("piece_id", "track_id").agg(F.count("*").alias("n_notes"))


def gross_units(notes: DataFrame) -> DataFrame:
    return notes.groupBy("piece_id", "track_id").agg(F.sum(F.col("end_u") - F.col("start_u")).alias("gross_u"))


def _cell_mask(low: Column, high: Column) -> Column:
    """Bits low..high-1 of one cell; a cell note covers at least one unit."""
    all_bits = F.lit(-1).cast("long")
    run = F.call_function("shiftrightunsigned", all_bits, (F.lit(CELL_UNITS) - (high - low)).cast("int"))
    return F.call_function("shiftleft", run, low.cast("int"))


def covered_units(notes: DataFrame) -> DataFrame:
    """Size of the union of all [start, end) intervals of a track, in units."""
    cells = F.sequence(F.floor(F.col("start_u") / CELL_UNITS), F.floor((F.col("end_u") - 1) / CELL_UNITS))
    cut = notes.where("end_u > start_u").select("piece_id", "track_id", "start_u", "end_u", F.explode(cells).alias("cell"))
    base = F.col("cell") * CELL_UNITS
    low = F.greatest(F.col("start_u") - base, F.lit(0))
    high = F.least(F.col("end_u") - base, F.lit(CELL_UNITS))
    return (
        cut.groupBy("piece_id", "track_id", "cell").agg(F.bit_or(_cell_mask(low, high)).alias("mask"))
        .groupBy("piece_id", "track_id").agg(F.sum(F.bit_count("mask")).alias("covered_u"))
    )


def _of_piece(per_track: DataFrame, notes: DataFrame, column: str, share: str) -> DataFrame:
    total = piece_length(notes)
    return per_track.join(total, "piece_id").select(
        "piece_id", "track_id", (100 * F.try_divide(column, "max_end_u")).alias(share)
    )


def gross_coverage(notes: DataFrame) -> DataFrame:
    """Summed note length of a track as a percentage of the piece."""
    return _of_piece(gross_units(notes), notes, "gross_u", "gross_coverage")


def true_coverage(notes: DataFrame) -> DataFrame:
    """Time of a track with at least one note sounding, as a percentage of the piece."""
    return _of_piece(covered_units(notes), notes, "covered_u", "true_coverage")


def track_activity(notes: DataFrame) -> DataFrame:
    """All per-track figures in one row."""
    per_track = notes.groupBy("piece_id", "track_id").agg(
        F.count("*").alias("n_notes"),
        F.sum(F.col("end_u") - F.col("start_u")).alias("gross_u"),
        (F.min_by("start_u", _listed()) / UNITS_PER_BEAT).alias("first_start"),
        (F.max_by("end_u", _listed()) / UNITS_PER_BEAT).alias("last_end"),
    )
    both = per_track.join(covered_units(notes), ["piece_id", "track_id"]).join(piece_length(notes), "piece_id")
    return both.select(
        "piece_id", "track_id", "beat_count", "n_notes",
        (100 * F.try_divide("gross_u", "max_end_u")).alias("gross_coverage"),
        (100 * F.try_divide("covered_u", "max_end_u")).alias("true_coverage"),
        "first_start", "last_end",
    )


def piece_activity(notes: DataFrame) -> DataFrame:
    """Per piece: one list per figure, in track order."""
    figures = ["n_notes", "gross_coverage", "true_coverage", "first_start", "last_end"]
    ordered = F.array_sort(F.collect_list(F.struct("track_id", *figures)))
    per_piece = track_activity(notes).groupBy("piece_id").agg(
        F.first("beat_count").alias("beat_count"), F.count("*").alias("n_tracks"), ordered.alias("by_track")
    )
    lists = [F.col(f"by_track.{f}").alias(f) for f in figures]
    return per_piece.select("piece_id", "beat_count", "n_tracks", *lists)


def split_names(tracks: DataFrame) -> DataFrame:
    """Names that occur on several tracks of a piece."""
    return (
        tracks.groupBy("piece_id", "name")
        .agg(F.count("*").alias("n_tracks"), F.array_sort(F.collect_list("track_id")).alias("track_ids"))
        .where("n_tracks > 1")
    )


def numbered(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str) -> DataFrame:
    """Row number per ``keys`` in ``order``, where ``chunk`` is a coarser form of the first order column.

    Rows are numbered inside chunks and shifted by the size of the earlier chunks, so a long group is spread over
    its chunks instead of being sorted in one task.
    """
    chunked = rows.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_within", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_within") + F.col("_before"))
        .drop("_chunk", "_within", "_before")
    )


def merged_split_tracks(notes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Notes of all tracks that share a name, in one numbered sequence by start."""
    members = split_names(tracks).select("piece_id", "name", F.explode("track_ids").alias("track_id"))
    rows = notes.join(members, ["piece_id", "track_id"])
    chunk = F.floor(F.col("start_u") / MERGE_CHUNK_UNITS)
    order = ["start_u", "track_id", "pitch", "end_u", "velocity"]
    return numbered(rows, ["piece_id", "name"], chunk, order, "position").select(
        "piece_id", "name", "position", "track_id", "start_u", "end_u", "pitch"
    )


def piano_roll(notes: DataFrame) -> DataFrame:
    """Sparse roll: summed velocity per (piece, frame, pitch).

    Notes are cut at cell borders and travel as they are; their frames are listed only where their cell is summed, so the shuffle
    carries notes, not frames, and no task sums more than its cells.
    """
    cell = F.floor(F.col("start_u") / CELL_UNITS)
    cells = F.sequence(cell, F.floor((F.col("end_u") - 1) / CELL_UNITS))
    tasks = max(3 * notes.sparkSession.sparkContext.defaultParallelism, math.ceil(notes.count() / NOTES_PER_TASK))
    cut = (
        notes.where("end_u > start_u").select("piece_id", "pitch", "velocity", "start_u", "end_u", F.explode(cells).alias("cell"))
        .repartition(tasks, "piece_id", "cell")
    )
    kind = notes.schema["start_u"].dataType
    first = F.greatest(F.col("start_u"), F.col("cell") * CELL_UNITS).cast(kind)
    last = (F.least(F.col("end_u"), (F.col("cell") + 1) * CELL_UNITS) - 1).cast(kind)
    frames = F.explode(F.sequence(first, last, F.lit(FRAME_UNITS).cast(kind)))
    return (
        cut.select("piece_id", "cell", "pitch", "velocity", frames.alias("frame"))
        .groupBy("piece_id", "cell", "frame", "pitch").agg(F.sum("velocity").alias("velocity")).drop("cell")
    )


def on_bar_grid(frame: Column) -> Column:
    """Whether a frame begins a bar."""
    return frame % UNITS_PER_BAR == 0
