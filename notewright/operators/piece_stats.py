"""Per-piece statistics.

Distinct pitches, pitch classes, octaves, programs and families live in small fixed domains, so each is a bit mask
merged with ``bit_or``: every statistic of a piece comes from one pass over the notes with map-side combining, and a
piece (or track) that holds a large share of all notes reaches the shuffle as one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.instruments import family_name, family_number, program_name
from notewright.schemas import STATISTICS_FIELDS
from notewright.sources.quarantine import note_error, split_playable

ONSET_CHUNK_SECONDS = 256.0


def bit(position: Column) -> Column:
    """Long with one bit set; null outside 0..63, which ``bit_or`` ignores."""
    one = F.lit(1).cast("long")
    return F.when(position.between(0, 63), F.call_function("shiftleft", one, position.cast("int")))


def _mask(position: Column) -> Column:
    return F.coalesce(F.bit_or(bit(position)), F.lit(0).cast("long"))


def _bits(*masks: str) -> Column:
    total = F.bit_count(F.coalesce(F.col(masks[0]), F.lit(0).cast("long")))
    for m in masks[1:]:
        total = total + F.bit_count(F.coalesce(F.col(m), F.lit(0).cast("long")))
    return total.cast("int")


def track_level(notes: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per track with masks and sums; tracks without notes stay, with zero counts.

    Only playable notes count, in every column alike; ``split_playable`` returns the others.
    """
    notes, _ = split_playable(notes)
    pitch, length = F.col("pitch"), F.col("end") - F.col("start")
    per_track = notes.groupBy("piece_id", "track_id").agg(
        F.count("*").alias("n_notes"),
        _mask(pitch).alias("pitches_low"),
        _mask(pitch - 64).alias("pitches_high"),
        _mask(pitch % 12).alias("classes"),
        _mask(F.floor(pitch / 12)).alias("octaves"),
        F.sum(length).alias("sum_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum("velocity").alias("sum_velocity"),
        F.sum("pitch").alias("sum_pitch"),
        F.min("pitch").alias("min_pitch"),
        F.max("pitch").alias("max_pitch"),
        F.max("end").alias("max_end"),
    )
    return (
        tracks.select("piece_id", "track_id", "program", "is_drum")
        .join(per_track, ["piece_id", "track_id"], "left")
        .withColumns(
            {
                "n_notes": F.coalesce("n_notes", F.lit(0)),
                "track_pitches": _bits("pitches_low", "pitches_high"),
                "track_classes": _bits("classes"),
                "track_octaves": _bits("octaves"),
                "track_range": F.col("max_pitch") - F.col("min_pitch"),
            }
        )
    )


def note_statistics(notes: DataFrame, tracks: DataFrame, drums_as_family: bool = False) -> DataFrame:
    """Instrument and note statistics per piece; pieces need at least one track to appear."""
    family = family_number(F.col("program"))
    name = family_name(F.col("program"))
    if drums_as_family:
        family = F.when(F.col("is_drum"), 16).otherwise(family)
        name = F.when(F.col("is_drum"), "Drums").otherwise(name)
    ordered = F.array_sort(F.collect_list(F.struct("track_id", "program")))
    per_piece = (
        track_level(notes, tracks)
        .groupBy("piece_id")
        .agg(
            F.count("*").alias("tracks"),
            _mask(F.col("program")).alias("programs_low"),
            _mask(F.col("program") - 64).alias("programs_high"),
            _mask(family).alias("families"),
            F.array_sort(F.collect_set(program_name(F.col("program")))).alias("instrument_names"),
            F.array_sort(F.collect_set(name)).alias("instrument_families"),
            ordered.alias("ordered_programs"),
            F.sum("n_notes").alias("n_notes"),
            F.bit_or("pitches_low").alias("pitches_low"),
            F.bit_or("pitches_high").alias("pitches_high"),
            F.bit_or("classes").alias("classes"),
            F.bit_or("octaves").alias("octaves"),
            F.avg("track_pitches").alias("average_n_unique_notes_per_instrument"),
            F.avg("track_range").alias("average_range_of_note_pitches_per_instrument"),
            F.avg("track_classes").alias("average_number_of_note_pitch_classes_per_instrument"),
            F.avg("track_octaves").alias("average_number_of_octaves_per_instrument"),
            F.sum("sum_length").alias("sum_length"),
            F.sum("sum_velocity").alias("sum_velocity"),
            F.sum("sum_pitch").alias("sum_pitch"),
            F.min("min_length").alias("shortest_note_length"),
            F.max("max_length").alias("longest_note_length"),
            F.min("min_pitch").alias("min_pitch"),
            F.max("max_pitch").alias("max_pitch"),
            F.max("max_end").alias("max_end"),
        )
    )
    count = F.col("n_notes")
    return per_piece.select(
        "piece_id",
        F.col("tracks").cast("int").alias("n_instruments"),
        _bits("programs_low", "programs_high").alias("n_unique_instruments"),
        "instrument_names",
        F.array_join(F.transform("ordered_programs", lambda x: x["program"].cast("string")), ", ").alias("instruments"),
        "instrument_families",
        _bits("families").alias("number_of_instrument_families"),
        "n_notes",
        _bits("pitches_low", "pitches_high").alias("n_unique_notes"),
        "average_n_unique_notes_per_instrument",
        F.try_divide("sum_length", count).alias("average_note_duration"),
        F.try_divide("sum_velocity", count).alias("average_note_velocity"),
        F.try_divide("sum_pitch", count).alias("average_note_pitch"),
        (F.col("max_pitch") - F.col("min_pitch")).alias("range_of_note_pitches"),
        "average_range_of_note_pitches_per_instrument",
        _bits("classes").alias("number_of_note_pitch_classes"),
        "average_number_of_note_pitch_classes_per_instrument",
        _bits("octaves").alias("number_of_octaves"),
        "average_number_of_octaves_per_instrument",
        F.try_divide(count, F.col("max_end")).alias("number_of_notes_per_second"),
        "shortest_note_length",
        "longest_note_length",
        F.col("max_end").alias("track_length_in_seconds"),
    )


def key_statistics(key_signatures: DataFrame) -> DataFrame:
    return key_signatures.groupBy("piece_id").agg(
        F.min_by("key_number", "seq").alias("main_key_signature"), F.count("*").alias("n_key_changes")
    )


def time_signature_text(numerator: Column, denominator: Column) -> Column:
    return F.concat_ws("/", numerator.cast("string"), denominator.cast("string"))


def time_statistics(time_signatures: DataFrame) -> DataFrame:
    text = time_signature_text(F.col("numerator"), F.col("denominator"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "ts")))
    return (
        time_signatures.withColumn("ts", text)
        .groupBy("piece_id")
        .agg(
            F.min_by("ts", "seq").alias("main_time_signature"),
            F.count("*").alias("n_time_signature_changes"),
            F.transform(ordered, lambda x: x["ts"]).alias("all_time_signatures"),
            ((F.count("*") == 1) & (F.min("ts") == "4/4")).alias("four_to_the_floor"),
        )
    )


def tempo_statistics(tempo_changes: DataFrame) -> DataFrame:
    return tempo_changes.groupBy("piece_id").agg(F.count("*").alias("n_tempo_changes"))


def tempo_change_list(tempo_changes: DataFrame) -> DataFrame:
    return tempo_changes.groupBy("piece_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "bpm"))).alias("tempo_changes")
    )


def lyric_statistics(lyrics: DataFrame) -> DataFrame:
    """Word counts, a missing word counted as one more; who needs no distinct count does not pay for it."""
    missing = F.max(F.col("text").isNull().cast("long"))
    return lyrics.groupBy("piece_id").agg(
        F.count("*").alias("lyrics_nb_words"), (F.count_distinct("text") + missing).alias("lyrics_unique_words")
    )


def tempo_estimate(notes: DataFrame) -> DataFrame:
    """Most frequent 1-bpm bin of the inter-onset tempo, folded by octaves into 60..200; ties go to the slower bin.

    Onsets are made distinct, then compared within time chunks; the one gap that crosses from a chunk to the next
    comes from the chunk summary. No window ever spans a whole piece's onsets.
    """
    chunk = F.floor(F.col("start") / ONSET_CHUNK_SECONDS)
    onsets = notes.select("piece_id", "start").distinct().withColumn("chunk", chunk)
    inside = Window.partitionBy("piece_id", "chunk").orderBy("start")
    between = Window.partitionBy("piece_id").orderBy("chunk")
    inner_gaps = onsets.select("piece_id", (F.col("start") - F.lag("start").over(inside)).alias("gap"))
    edge_gaps = (
        onsets.groupBy("piece_id", "chunk").agg(F.min("start").alias("first"), F.max("start").alias("last"))
        .select("piece_id", (F.col("first") - F.lag("last").over(between)).alias("gap"))
    )
    gaps = inner_gaps.unionByName(edge_gaps).where("gap > 0").groupBy("piece_id", "gap").agg(F.count("*").alias("n"))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(24)),
        F.lit(60.0) / F.col("gap"),
        lambda bpm, _: F.when(bpm < 60, bpm * 2).when(bpm > 200, bpm / 2).otherwise(bpm),
    )
    return (
        gaps.withColumn("bpm", F.bround(folded).cast("int"))
        .groupBy("piece_id", "bpm").agg(F.sum("n").alias("n"))
        .groupBy("piece_id").agg(F.max(F.struct("n", (-F.col("bpm")).alias("slow"))).alias("best"))
        .select("piece_id", (-F.col("best.slow")).alias("tempo_estimate"))
    )


def piece_statistics(corpus, drums_as_family: bool = False) -> DataFrame:
    """The whole statistics table, one row per piece, from its playable notes."""
    notes, _ = split_playable(corpus.timed_notes)
    joined = corpus.pieces.select("piece_id")
    parts = [
        note_statistics(notes, corpus.tracks, drums_as_family),
        key_statistics(corpus.key_signatures),
        time_statistics(corpus.time_signatures),
        tempo_statistics(corpus.tempo_changes),
        tempo_estimate(notes),
        lyric_statistics(corpus.lyrics),
    ]
    for part in parts:
        joined = joined.join(part, "piece_id", "left")
    return joined.withColumns(
        {
            "md5": F.col("piece_id").cast("string"),
            "n_tempo_changes": F.coalesce("n_tempo_changes", F.lit(0)),
            "lyrics_bool": F.col("lyrics_nb_words").isNotNull(),
        }
    )


def folder_statistics(corpus, **limits) -> tuple[DataFrame, DataFrame]:
    """(statistics of the readable files, log with md5 and error of the others).

    A file fails as a whole if one of its notes cannot be used; ``limits`` are those of ``note_error``. Reasons are reduced on the map
    side to one row per file, so a file with a third of all notes is no single task's work.
    """
    reason = note_error(**limits)
    failed = corpus.notes.select("piece_id", reason.alias("reason")).groupBy("piece_id").agg(F.min("reason").alias("reason"))
    failed = failed.where("reason IS NOT NULL")
    name = F.col("piece_id").cast("string")
    log = failed.select(name.alias("md5"), F.concat(F.lit("invalidfile: "), name, F.lit(": "), F.col("reason")).alias("error"))
    return piece_statistics(corpus).join(failed, "piece_id", "left_anti"), log


# --- fixed values: the column names and order of the statistics file ---
STATISTICS_COLUMNS = list(STATISTICS_FIELDS)


def max_time(notes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Latest end over all tracks of a piece, at least 0."""
    ends = notes.groupBy("piece_id").agg(F.max("end").alias("latest"))
    return (
        tracks.select("piece_id").distinct().join(ends, "piece_id", "left")
        .select("piece_id", F.greatest(F.lit(0.0), F.col("latest")).alias("max_time"))
    )
