"""Section text to notes.

A text is one cell, so its structure is unpacked with array functions and generators: text to tracks to bar segments to
events, without a shuffle. Only the final pairing of Note-On and Note-Off groups rows, by (piece, channel, pitch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.constants import DEFAULT_VELOCITY, MAX_DELTAS_PER_BAR, UNITS_PER_BAR, UNITS_PER_DELTA
from notewright.functions import tokens as tk
from notewright.functions.instruments import family_program


def track_texts(pieces: DataFrame) -> DataFrame:
    """(piece_id, channel, instrument, text): one row per track of a text.

    A track's number is the count of completed tracks before it. Anything before the first track start is dropped;
    what follows a track end, up to the next track start, stays with the ended track. The last INST wins.
    """
    parts = F.split(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), " TRACK_END(?= )")
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, " TRACK_START ", 1).alias("head"), p.alias("all")))

    def track(part: Column, i: Column) -> Column:
        body = F.substr(part["all"], F.length(part["head"]) + 1)
        following = F.get(F.col("cut"), i + 1)
        tail = F.when(following.isNotNull(), F.concat(F.lit(" TRACK_END "), following["head"])).otherwise("")
        return F.struct(i.alias("channel"), F.length(body).alias("size"), F.concat(body, tail).alias("text"))

    exploded = pieces.withColumn("cut", cut).select("piece_id", F.inline(F.transform("cut", track)))
    instruments = F.filter(F.split("text", " "), lambda w: w.startswith("INST="))
    last = F.get(instruments, F.size(instruments) - 1)
    return exploded.where("size > 0").select("piece_id", "channel", tk.value(last).alias("instrument"), "text")


def _steps_of(chunk: Column) -> Column:
    """Steps of the TIME_DELTA that opens a chunk, else 0."""
    return F.when(chunk.startswith("TIME_DELTA="), F.substring_index(F.substr(chunk, F.lit(12)), " ", 1).cast("int")).otherwise(0)


def _units_of(chunk: Column) -> Column:
    """Units of the TIME_SHIFT literal that opens a chunk, else 0."""
    return F.when(
        chunk.startswith("TIME_SHIFT="), tk.literal_units(F.substring_index(F.substr(chunk, F.lit(12)), " ", 1))
    ).otherwise(0)


def guarded(chunks: Column) -> Column:
    """Deltas that fit into a bar, as (chunk index, running total); at most one entry per step of a bar.

    Not a running sum: a delta that would pass the bar end is skipped and a later, smaller one may still fit.
    """
    deltas = F.filter(
        F.transform(chunks, lambda c, i: F.struct(i.alias("i"), _steps_of(c).alias("n"))), lambda d: d["n"] > 0
    )
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<i:int,total:int>>").alias("kept"))

    def step(state: Column, d: Column) -> Column:
        total = state["total"] + d["n"]
        grown = F.struct(
            total.alias("total"),
            F.array_append(state["kept"], F.struct(d["i"].alias("i"), total.alias("total"))).alias("kept"),
        )
        return F.when(total <= MAX_DELTAS_PER_BAR, grown).otherwise(state)

    return F.aggregate(deltas, start, step)["kept"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def segments(tracks: DataFrame) -> DataFrame:
    """One row per stretch between bar tokens, with its bar, its start in units and its kept deltas.

    A stretch is cut into chunks, each opened by a time token, so all tokens of a chunk share one time. A stretch
    closed by BAR_END is padded to a whole bar; times of a track are continuous.
    """
    stretches = F.split(F.regexp_replace(F.trim("text"), " +", " "), " (?=BAR_START(?: |$)|BAR_END(?: |$))")
    cut = tracks.withColumn("stretches", stretches).withColumn(
        "chunked", F.transform("stretches", lambda s: F.split(s, " (?=TIME_DELTA=|TIME_SHIFT=)"))
    )
    kept = cut.withColumn("kept", F.transform("chunked", guarded))

    def length(k: Column, i: Column) -> Column:
        steps = F.coalesce(F.get(k, F.size(k) - 1)["total"], F.lit(0))
        return steps * UNITS_PER_DELTA + _total(F.transform(F.get("chunked", i), _units_of))

    sized = kept.withColumn("filled", F.transform("kept", length)).withColumn(
        "ending", F.transform("stretches", lambda s: s.startswith("BAR_END"))
    )
    closed = F.transform("filled", lambda f, i: F.coalesce(F.get("ending", i + 1), F.lit(False)))
    ended_at = F.filter(F.transform("ending", lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    # Start = one bar per completed bar, plus what stretches add beyond that; the second part is empty in clean text.
    extra = F.filter(
        F.transform(
            "filled",
            lambda f, i: F.struct(
                i.alias("i"), F.when(F.get("closed", i), F.greatest(f - UNITS_PER_BAR, F.lit(0))).otherwise(f).alias("u")
            ),
        ),
        lambda x: x["u"] > 0,
    )
    described = sized.withColumn("closed", closed).withColumn("ended_at", ended_at).withColumn("extra", extra)
    zipped = F.posexplode(F.arrays_zip("chunked", "kept", "filled", "closed"))
    rows = described.select("piece_id", "channel", "instrument", "ended_at", "extra", zipped.alias("segment", "z"))
    bar = F.size(F.filter("ended_at", lambda e: e <= F.col("segment")))
    added = _total(F.transform(F.filter("extra", lambda x: x["i"] < F.col("segment")), lambda x: x["u"]))
    return rows.select(
        "piece_id", "channel", "instrument", "segment", bar.alias("bar"), (bar * UNITS_PER_BAR + added).alias("offset_u"),
        F.col("z.chunked").alias("chunks"), F.col("z.kept").alias("kept"), F.col("z.filled").alias("filled_u"),
        F.col("z.closed").alias("closed"),
    )


def events(segment_rows: DataFrame) -> DataFrame:
    """Known tokens in text order with absolute time; tokens beyond the bar's steps are left out (see ``guarded``)."""
    shifts = F.filter(
        F.transform("chunks", lambda c, i: F.struct(i.alias("i"), _units_of(c).alias("u"))), lambda s: s["u"] > 0
    )

    place = ["piece_id", "channel", "instrument", "bar", "segment"]
    chunk_rows = segment_rows.withColumn("shifts", shifts).select(
        *place, "offset_u", "kept", "shifts", F.posexplode("chunks").alias("chunk", "body")
    )
    reached = F.filter("kept", lambda k: k["i"] <= F.col("chunk"))
    last = F.get("reached", F.size("reached") - 1)
    shifted = _total(F.transform(F.filter("shifts", lambda s: s["i"] <= F.col("chunk")), lambda s: s["u"]))
    timed = (
        chunk_rows.withColumn("reached", reached).withColumn("last", last)
        .withColumn("steps", F.coalesce("last.total", F.lit(0)))
        .select(
            *place, "chunk", "steps", (F.col("offset_u") + F.col("steps") * UNITS_PER_DELTA + shifted).alias("t"),
            ((_steps_of(F.col("body")) > 0) & ~F.coalesce(F.col("last.i") == F.col("chunk"), F.lit(False))).alias("skipped"),
            "body",
        )
    )
    word_rows = timed.select(*place, "chunk", "steps", "t", "skipped", F.posexplode(F.split("body", " ")).alias("pos", "word"))
    late_note = F.col("word").startswith("NOTE_ON=") & (F.col("steps") >= MAX_DELTAS_PER_BAR)
    skipped_delta = F.col("skipped") & (F.col("pos") == 0)
    rows = word_rows.where(tk.is_event(F.col("word")) & ~late_note & ~skipped_delta).select(
        "piece_id", "channel", "instrument", "bar", "segment", "chunk", "pos", "t",
        F.substring_index("word", "=", 1).alias("kind"),
        F.when(F.contains("word", F.lit("=")), F.split_part("word", F.lit("="), F.lit(2))).alias("value"),
    )
    return rows.withColumn("type", tk.event_type(F.col("kind")))


def decoded_events(pieces: DataFrame) -> DataFrame:
    return events(segments(track_texts(pieces)))


def bar_lengths(pieces: DataFrame) -> DataFrame:
    """Per bar: filled units, the padding that completes it, and whether it is over-long."""
    return (
        segments(track_texts(pieces)).where("closed")
        .select(
            "piece_id", "channel", "bar", "filled_u",
            F.greatest(UNITS_PER_BAR - F.col("filled_u"), F.lit(0)).alias("padding_u"),
            (F.col("filled_u") > UNITS_PER_BAR).alias("over_long"),
        )
    )


def sounding(event_rows: DataFrame) -> DataFrame:
    """Events without the structural ones."""
    return event_rows.where(~F.col("type").isin(tk.STRUCTURAL_TYPES))


def merged_shifts(event_rows: DataFrame) -> DataFrame:
    """Note events with one shift before each, merged across bars.

    The events of a track come out of one cell, so one task has held them all: they are ordered there, read once.
    """
    notes = event_rows.where(F.col("type").isin("Note-On", "Note-Off") & F.col("t").isNotNull())
    in_order = Window.partitionBy("piece_id", "channel").orderBy("t", "segment", "chunk", "pos")
    return notes.withColumn("shift_u", F.col("t") - F.lag("t", 1, 0).over(in_order))


def with_velocity(event_rows: DataFrame) -> DataFrame:
    """A default velocity on every Note-On."""
    return event_rows.withColumn("velocity", F.when(F.col("type") == "Note-On", F.lit(DEFAULT_VELOCITY)))


def instrument_columns(instrument: Column, programs: list[int] | None = None) -> tuple[Column, Column]:
    """Program and drum flag of an instrument token; with ``programs`` its number is a family, replaced by its program."""
    drum = F.lower(instrument) == "drums"
    number = instrument.try_cast("int")
    number = family_program(number, programs) if programs is not None else number
    return F.when(drum, F.lit(0)).otherwise(number), drum


def track_instruments(tracks: DataFrame, programs: list[int] | None = None) -> DataFrame:
    program, drum = instrument_columns(F.col("instrument"), programs)
    return tracks.select("piece_id", "channel", program.alias("program"), drum.alias("is_drum"))


def repeated_events(segment_rows: DataFrame) -> DataFrame:
    """Events equal to the event right after them, in text order."""
    kept = events(segment_rows).groupBy("piece_id", "channel", "bar", "segment").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "pos", "type", F.coalesce("value", F.lit("")).alias("value")))).alias("kept")
    )
    pairs = F.filter(
        F.transform("kept", lambda e, i: F.struct(e.alias("e"), F.get("kept", i + 1).alias("following"))),
        lambda p: (p["e"]["type"] == p["following"]["type"]) & (p["e"]["value"] == p["following"]["value"]),
    )
    return kept.select("piece_id", "channel", "bar", "segment", F.explode(pairs).alias("pair")).select(
        "piece_id", "channel", "bar", "segment", "pair.e.pos", "pair.e.type", "pair.e.value"
    )


def decode(pieces: DataFrame, section_bars: int | None = None) -> DataFrame:
    """Text to notes: each Note-On ends at the next Note-Off of its pitch and track.

    By default every track of a text starts at 0. ``section_bars`` moves the tracks of the k-th PIECE_START block to
    bar ``k * section_bars`` instead.
    """
    rows = decoded_events(pieces).where(F.col("type").isin("Note-On", "Note-Off")).withColumn(
        "pitch", F.col("value").try_cast("int")
    )
    later = Window.partitionBy("piece_id", "channel", "pitch").orderBy(F.desc("segment"), F.desc("chunk"), F.desc("pos")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    end = F.last(F.when(F.col("type") == "Note-Off", F.col("t")), ignorenulls=True).over(later)
    notes = (
        rows.withColumn("end_u", end).where((F.col("type") == "Note-On") & F.col("end_u").isNotNull())
        .select(
            "piece_id", "channel", "instrument", "pitch", F.col("t").alias("start_u"), "end_u",
            F.lit(DEFAULT_VELOCITY).alias("velocity"),
        )
    )
    if section_bars is None:
        return notes
    shift = F.col("section") * section_bars * UNITS_PER_BAR
    return notes.join(section_of_channel(pieces), ["piece_id", "channel"]).withColumns(
        {"start_u": F.col("start_u") + shift, "end_u": F.col("end_u") + shift}
    )


def section_of_channel(pieces: DataFrame) -> DataFrame:
    """0-based PIECE_START block in which each track of a text starts."""
    blocks = F.split(F.concat(F.lit(" "), F.col("text")), " PIECE_START(?= |$)")
    ended = F.transform(blocks, lambda b: F.size(F.filter(F.split(b, " "), lambda w: w == "TRACK_END")))
    numbered = pieces.select("piece_id", F.posexplode(ended).alias("block", "n"), ended.alias("ended"))
    before = F.aggregate(F.slice("ended", F.lit(1), F.col("block")), F.lit(0), lambda a, x: a + x)
    return numbered.where("n > 0").select(
        "piece_id", F.greatest(F.col("block") - 1, F.lit(0)).alias("section"),
        F.explode(F.sequence(before, before + F.col("n") - 1)).alias("channel"),
    )
