"""Notes to section text.

One shuffle brings the events of an eight-bar section of a track together, each packed into one int; everything inside
the section (bars, empty bars, shifts, densities) is array work on that row. A second, much smaller shuffle strings the
sections of a piece together. A long piece is spread over its sections.

Times are in units; at equal time a Note-Off precedes a Note-On. Notes that cannot be encoded (empty, outside the pitch range,
before the piece, missing values) are left out everywhere here; ``encode_with_errors`` returns them with the reason.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.constants import BARS_PER_SECTION, BEATS_PER_BAR, HIGHEST_PITCH, LOWEST_PITCH, UNITS_PER_BAR, UNITS_PER_DELTA
from notewright.functions.instruments import instrument_label
from notewright.operators.windows import shifts_between
from notewright.sources.quarantine import split_good_and_errors

# Layout of a packed event, high to low: bar in section | time in bar (0..32, 6 bits) | is Note-On (1 bit) | pitch (7 bits).
_PITCH_BITS, _KIND_BITS, _TIME_BITS = 7, 1, 6
_BAR_SHIFT = _PITCH_BITS + _KIND_BITS + _TIME_BITS
_NOTE_TOKENS = [f"{name}={pitch} " for name in ("NOTE_OFF", "NOTE_ON") for pitch in range(1 << _PITCH_BITS)]
# Notes whose text goes to one task. Texts shrink in a shuffle and grow by far when they are decoded, so tasks are not cut by bytes.
NOTES_PER_TASK = 200_000
_SHIFT_TOKENS = [""] + [f"TIME_DELTA={u // UNITS_PER_DELTA} " for u in range(1, UNITS_PER_BAR + 1)]


def note_events(notes: DataFrame) -> DataFrame:
    """Two rows per note: the Note-On in its own bar, the Note-Off in the bar its note still sounds in."""
    on = F.struct(F.col("start_u").alias("t"), F.floor(F.col("start_u") / UNITS_PER_BAR).alias("bar"), F.lit(1).alias("kind"))
    off = F.struct(
        F.col("end_u").alias("t"), F.floor((F.col("end_u") - 1) / UNITS_PER_BAR).alias("bar"), F.lit(0).alias("kind")
    )
    return notes.select("piece_id", "track_id", "pitch", F.inline(F.array(on, off)))


def _packed(n_bar: int) -> Column:
    in_bar = F.col("t") - F.col("bar") * UNITS_PER_BAR
    bar = (F.col("bar") % n_bar) * (1 << _BAR_SHIFT)
    return (bar + in_bar * (1 << (_PITCH_BITS + _KIND_BITS)) + F.col("kind") * (1 << _PITCH_BITS) + F.col("pitch")).cast("int")


def _bar_of(event: Column) -> Column:
    return F.shiftright(event, _BAR_SHIFT)


def _time_of(event: Column) -> Column:
    return F.shiftright(event, _PITCH_BITS + _KIND_BITS).bitwiseAND(F.lit((1 << _TIME_BITS) - 1))


def _is_on(event: Column) -> Column:
    return event.bitwiseAND(F.lit(1 << _PITCH_BITS)) != 0


def _pitch_of(event: Column) -> Column:
    return event.bitwiseAND(F.lit((1 << _PITCH_BITS) - 1))


def section_runs(notes: DataFrame, n_bar: int = BARS_PER_SECTION) -> DataFrame:
    """(piece_id, track_id, section, n_sections, n_bars, events): sections with events, and one row per run of empty ones.

    A late note costs the row of the run before it, however long that is. Runs are found on the keys alone, without the events.
    """
    notes, _ = split_good_and_errors(notes)
    events = note_events(notes).select(
        "piece_id", "track_id", F.floor(F.col("bar") / n_bar).alias("section"), _packed(n_bar).alias("event"), "bar"
    )
    keys = ["piece_id", "track_id", "section"]
    # Shuffle the bare ints first: collecting them before the shuffle would not shrink them.
    filled = events.select(*keys, "event").repartition(*keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list("event")).alias("events")
    )
    track = ["piece_id", "track_id"]
    last_bars = events.groupBy(*keys).agg(F.max("bar").alias("last_bar"))
    in_order = Window.partitionBy(*track).orderBy("section")
    gap = F.coalesce(F.lag("section").over(in_order), F.lit(-1).cast("long")) + 1
    # Only the last section of a track ends with its last event.
    bars = F.when(F.lead("section").over(in_order).isNull(), F.col("last_bar") + 1 - F.col("section") * n_bar).otherwise(F.lit(n_bar))
    own = F.struct("section", F.lit(1).cast("long").alias("n_sections"), F.col("n_bars"))
    empty = F.struct(
        F.col("gap").alias("section"), (F.col("section") - F.col("gap")).alias("n_sections"), F.lit(n_bar).alias("n_bars")
    )
    runs = last_bars.select(*track, "section", gap.alias("gap"), bars.cast("int").alias("n_bars")).select(
        *track, F.inline(F.when(F.col("gap") < F.col("section"), F.array(empty, own)).otherwise(F.array(own)))
    )
    # A merge join keeps the packed events where they were grouped; broadcasting them would leave the text to few tasks.
    return runs.join(filled.hint("merge"), keys, "left").select(
        *keys, "n_sections", "n_bars", F.coalesce("events", F.array().cast("array<int>")).alias("events")
    )


def expanded(runs: DataFrame) -> DataFrame:
    """One row per section in place of one per run."""
    sections = F.sequence(F.col("section"), F.col("section") + F.col("n_sections") - 1)
    rest = [c for c in runs.columns if c not in ("piece_id", "track_id", "section", "n_sections")]
    return runs.select("piece_id", "track_id", F.explode(sections).alias("section"), *rest)


def packed_sections(notes: DataFrame, n_bar: int = BARS_PER_SECTION) -> DataFrame:
    """(piece_id, track_id, section, n_bars, events): every section of a track, its events packed and sorted."""
    return expanded(section_runs(notes, n_bar))


def section_events(notes: DataFrame, n_bar: int = BARS_PER_SECTION) -> DataFrame:
    """(piece_id, track_id, section, n_bars, bars): per section one sorted event array per bar, empty bars included."""
    bars = F.transform(
        F.sequence(F.lit(0), F.col("n_bars") - 1), lambda b: F.filter("events", lambda e: _bar_of(e) == b)
    )
    return packed_sections(notes, n_bar).withColumn("bars", bars).drop("events")


def bar_density(bar: Column) -> Column:
    """Onsets per beat, rounded half to even."""
    return F.bround(F.size(F.filter(bar, _is_on)) / BEATS_PER_BAR, 0).cast("int")


def lowest_mode(values: Column) -> Column:
    """Most frequent value of an array, the lowest one on a tie."""
    counted = F.transform(
        F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v"))
    )
    return F.array_min(counted)["v"]


def bar_densities_of(events: Column, n_bars: Column) -> Column:
    """Density of each bar of a section: onsets per beat."""
    onset_bars = F.transform(F.filter(events, _is_on), _bar_of)
    return F.transform(
        F.sequence(F.lit(0), n_bars - 1),
        lambda b: F.bround((F.size(onset_bars) - F.size(F.array_remove(onset_bars, b))) / BEATS_PER_BAR, 0).cast("int"),
    )


def _tokens(values: list[str]) -> Column:
    """Constant array, given as one literal that the optimizer splits once."""
    return F.split(F.lit("|".join(values)), "[|]")


def bars_text(events: Column, n_bars: Column, n_bar: int) -> Column:
    """All bars of a section as text, empty bars included; no shift after the last event of a bar."""
    crossings = [""] + ["BAR_END " + "BAR_START BAR_END " * (k - 1) + "BAR_START " for k in range(1, n_bar)]

    def step(event: Column, i: Column) -> Column:
        before = F.get(events, i - 1)
        crossed = _bar_of(event) - F.coalesce(_bar_of(before), F.lit(0))
        since = F.when(crossed == 0, F.coalesce(_time_of(before), F.lit(0))).otherwise(0)
        note = F.get(_tokens(_NOTE_TOKENS), event.bitwiseAND(F.lit((1 << (_PITCH_BITS + _KIND_BITS)) - 1)))
        return F.concat(
            F.get(_tokens(crossings), crossed), F.get(_tokens(_SHIFT_TOKENS), _time_of(event) - since), note
        )

    last = F.coalesce(_bar_of(F.get(events, F.size(events) - 1)), F.lit(0))
    return F.concat(
        F.lit("BAR_START "), F.array_join(F.transform(events, step), ""),
        F.get(_tokens(crossings), n_bars - 1 - last), F.lit("BAR_END "),
    )


def section_text(
    notes: DataFrame, tracks: DataFrame, n_bar: int = BARS_PER_SECTION, familize: bool = False
) -> DataFrame:
    """(piece_id, track_id, section, n_bars, density, text), one row per section of a track; a run of empty ones is written once."""
    runs = section_runs(notes, n_bar)
    labels = tracks.select(
        "piece_id", "track_id", instrument_label(F.col("program"), F.col("is_drum"), familize).alias("instrument")
    )
    body = bars_text(F.col("events"), F.col("n_bars"), n_bar)
    written = (
        runs.withColumn("densities", bar_densities_of(F.col("events"), F.col("n_bars")))
        .withColumn("density", lowest_mode(F.col("densities")))
        .join(labels, ["piece_id", "track_id"])
        .select(
            "piece_id", "track_id", "section", "n_sections", "n_bars", "density",
            F.concat(
                F.lit("TRACK_START INST="), F.col("instrument"), F.lit(" DENSITY="), F.col("density").cast("string"),
                F.lit(" "), body, F.lit("TRACK_END "),
            ).alias("text"),
        )
    )
    return expanded(written)


def _in_order(keys: list[str]) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*keys, "text")))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "")


def text_by_section(sections: DataFrame) -> DataFrame:
    """One text per section of a piece, tracks in order, tracks that ended earlier skipped."""
    return sections.groupBy("piece_id", "section").agg(_in_order(["track_id"]).alias("text"))


def piece_text(sections: DataFrame, tasks: int | None = None) -> DataFrame:
    """One text per piece: each section opens with PIECE_START. The pieces are dealt to as many tasks as given."""
    per_section = text_by_section(sections).withColumn("text", F.concat(F.lit("PIECE_START "), F.col("text")))
    if tasks is not None:
        per_section = per_section.repartition(tasks, "piece_id")
    return per_section.groupBy("piece_id").agg(_in_order(["section"]).alias("text"))


def encode(notes: DataFrame, tracks: DataFrame, n_bar: int = BARS_PER_SECTION, familize: bool = False) -> DataFrame:
    """Notes to one text per piece, in tasks of at most about NOTES_PER_TASK notes."""
    tasks = max(3 * notes.sparkSession.sparkContext.defaultParallelism, math.ceil(notes.count() / NOTES_PER_TASK))
    return piece_text(section_text(notes, tracks, n_bar, familize), tasks)


def encode_with_errors(
    notes: DataFrame, tracks: DataFrame, lowest: int = LOWEST_PITCH, highest: int = HIGHEST_PITCH, latest_u: int | None = None,
    n_bar: int = BARS_PER_SECTION, familize: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Texts of the notes within a pitch range (and time limit), and the rejected notes with ``reason``."""
    good, errors = split_good_and_errors(notes, lowest, highest, latest_u)
    return encode(good, tracks, n_bar, familize), errors


def ordered_events(notes: DataFrame) -> DataFrame:
    """On/off events per track with the shift since the previous event."""
    return shifts_between(note_events(notes), ["piece_id", "track_id"], "t", ["kind", "pitch"], UNITS_PER_BAR * 8)


def unit_shifts(events: DataFrame) -> DataFrame:
    """Every shift of n units as n shifts of one unit."""
    return events.where("shift_u > 0").select(
        "piece_id", "track_id", "t", "kind", "pitch",
        F.explode(F.sequence(F.col("t") - F.col("shift_u") + 1, F.col("t"))).alias("tick"),
    )


def lost_units(notes: DataFrame, n_bar: int = BARS_PER_SECTION) -> DataFrame:
    """Units of time that the coarser TIME_DELTA grid drops, per track."""
    bars = section_events(notes, n_bar).select("piece_id", "track_id", F.explode("bars").alias("bar"))

    def lost(bar: Column) -> Column:
        odd = F.transform(
            bar, lambda e, i: (_time_of(e) - F.when(i == 0, F.lit(0)).otherwise(_time_of(F.get(bar, i - 1)))) % 2
        )
        return F.aggregate(odd, F.lit(0), lambda a, x: a + x)

    return bars.groupBy("piece_id", "track_id").agg(F.sum(lost(F.col("bar"))).alias("lost_u"))


def bars_of(notes: DataFrame, n_bar: int = BARS_PER_SECTION) -> DataFrame:
    """(piece_id, track_id, section, bar, events): one row per bar, empty bars included."""
    return section_events(notes, n_bar).select(
        "piece_id", "track_id", "section", F.posexplode("bars").alias("in_section", "events")
    ).select(
        "piece_id", "track_id", "section", (F.col("section") * n_bar + F.col("in_section")).alias("bar"), "events"
    )


def bar_events(notes: DataFrame) -> DataFrame:
    """One row per event with the time since the previous event of its bar (or since the start of the bar)."""
    events = F.col("events")

    def unpack(event: Column, i: Column) -> Column:
        previous = F.when(i == 0, F.lit(0)).otherwise(_time_of(F.get(events, i - 1)))
        return F.struct(
            i.alias("pos"), _time_of(event).alias("t"), _is_on(event).alias("is_on"),
            _pitch_of(event).alias("pitch"), (_time_of(event) - previous).alias("shift_u"),
        )

    return bars_of(notes).select("piece_id", "track_id", "bar", F.inline(F.transform(events, unpack)))


def dropped_before_bar_end(notes: DataFrame) -> DataFrame:
    """Units between the last event of a bar and the bar end, which the text leaves out."""
    filled = F.coalesce(_time_of(F.get("events", F.size("events") - 1)), F.lit(0))
    return bars_of(notes).select("piece_id", "track_id", "bar", (UNITS_PER_BAR - filled).alias("dropped_u"))


def bar_densities(notes: DataFrame) -> DataFrame:
    return bars_of(notes).select("piece_id", "track_id", "section", "bar", bar_density(F.col("events")).alias("density"))


def section_order(sections: DataFrame) -> DataFrame:
    """Place of each section in its piece: by section, then by track."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "track_id")))
    return sections.groupBy("piece_id").agg(ordered.alias("places")).select(
        "piece_id", F.posexplode("places").alias("position", "place")
    ).select("piece_id", "position", "place.section", "place.track_id")
