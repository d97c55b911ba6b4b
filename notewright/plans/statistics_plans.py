"""Per-piece statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import piece_stats as ps
from notewright.plans.registry import query

ROUNDED = 6


def _notes(corpus):
    return ps.note_statistics(corpus.timed_notes, corpus.tracks)


def _column(key, column, sql, build=_notes, expr=None):
    @query(key, sql)
    def run(corpus):
        value = expr(F.col(column)) if expr else F.col(column)
        return build(corpus).select("piece_id", value.alias(column))


def _round(c):
    return F.round(c, ROUNDED)


def _joined(c):
    return F.array_join(c, ", ")


@query("A01", "SELECT piece_id, CAST(piece_id AS VARCHAR) AS md5 FROM v_pieces")
def a01(corpus):
    return corpus.pieces.select("piece_id", F.col("piece_id").cast("string").alias("md5"))


_TRACKS = "FROM v_tracks GROUP BY piece_id"
_NOTES = "FROM v_notes GROUP BY piece_id"
_column("A02", "n_instruments", f"SELECT piece_id, CAST(nullif(count(*), 0) AS INT) AS n_instruments {_TRACKS}")
_column(
    "A03", "n_unique_instruments",
    f"SELECT piece_id, CAST(count(DISTINCT program) AS INT) AS n_unique_instruments {_TRACKS}",
)
_column(
    "A04", "instrument_names",
    "SELECT piece_id, string_agg(program_name, ', ' ORDER BY program_name) AS instrument_names FROM "
    "(SELECT DISTINCT piece_id, program_name FROM v_tracks JOIN v_gm USING (program)) GROUP BY piece_id",
    expr=_joined,
)
_column(
    "A05", "instruments",
    f"SELECT piece_id, string_agg(CAST(program AS VARCHAR), ', ' ORDER BY track_id) AS instruments {_TRACKS}",
)
_column(
    "A06", "instrument_families",
    "SELECT piece_id, string_agg(family_name, ', ' ORDER BY family_name) AS instrument_families FROM "
    "(SELECT DISTINCT piece_id, family_name FROM v_tracks JOIN v_gm USING (program)) GROUP BY piece_id",
    expr=_joined,
)
_column(
    "A07", "number_of_instrument_families",
    f"SELECT piece_id, CAST(count(DISTINCT program // 8) AS INT) AS number_of_instrument_families {_TRACKS}",
)
_column("A08", "n_notes", f"SELECT piece_id, count(*) AS n_notes {_NOTES}")
_column(
    "A09", "n_unique_notes", f"SELECT piece_id, CAST(count(DISTINCT pitch) AS INT) AS n_unique_notes {_NOTES}"
)


def _per_track(value, name):
    return (
        f"SELECT piece_id, round(avg(v), 6) AS {name} FROM "
        f"(SELECT piece_id, track_id, {value} AS v FROM v_notes GROUP BY piece_id, track_id) GROUP BY piece_id"
    )


def _average(key, column, value):
    _column(key, column, _per_track(value, column), expr=_round)


def _direct(key, column, value, rounded=True):
    body = f"round({value}, 6)" if rounded else value
    _column(key, column, f"SELECT piece_id, {body} AS {column} {_NOTES}", expr=_round if rounded else None)


_average("A10", "average_n_unique_notes_per_instrument", "count(DISTINCT pitch)")
_direct("A11", "average_note_duration", "avg(end_s - start_s)")
_direct("A12", "average_note_velocity", "avg(velocity)")
_direct("A13", "average_note_pitch", "avg(pitch)")
_direct("A14", "range_of_note_pitches", "max(pitch) - min(pitch)", rounded=False)
_average("A15", "average_range_of_note_pitches_per_instrument", "max(pitch) - min(pitch)")
_direct("A16", "number_of_note_pitch_classes", "CAST(count(DISTINCT pitch % 12) AS INT)", rounded=False)
_average("A17", "average_number_of_note_pitch_classes_per_instrument", "count(DISTINCT pitch % 12)")
_direct("A18", "number_of_octaves", "CAST(count(DISTINCT pitch // 12) AS INT)", rounded=False)
_average("A19", "average_number_of_octaves_per_instrument", "count(DISTINCT pitch // 12)")
_direct("A20", "number_of_notes_per_second", "count(*) / max(end_s)")
_direct("A21", "shortest_note_length", "min(end_s - start_s)")
_direct("A22", "longest_note_length", "max(end_s - start_s)")


def _side(key, column, build, sql, default=None, expr=None):
    """A statistic of a side table, one row per piece (null when the piece has no such rows)."""

    @query(key, sql)
    def run(corpus):
        value = F.col(column)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        if expr is not None:
            value = expr(value)
        return corpus.pieces.join(build(corpus), "piece_id", "left").select("piece_id", value.alias(column))


def _left(select, source, extra=""):
    return f"SELECT p.piece_id, {select} FROM v_pieces p LEFT JOIN {source} s USING (piece_id) {extra} GROUP BY p.piece_id"


def _keys(c):
    return ps.key_statistics(c.key_signatures)


def _times(c):
    return ps.time_statistics(c.time_signatures)


def _tempi(c):
    return ps.tempo_statistics(c.tempo_changes)


def _lyrics(c):
    return ps.lyric_statistics(c.lyrics)


_side("A23", "main_key_signature", _keys, _left("arg_min(key_number, seq) AS main_key_signature", "v_keys"))
_side("A24", "n_key_changes", _keys, _left("nullif(count(seq), 0) AS n_key_changes", "v_keys"))
_side("A25", "n_tempo_changes", _tempi, _left("count(seq) AS n_tempo_changes", "v_tempo"), default=0)


@query(
    "A26",
    "SELECT piece_id, string_agg(seq || ':' || CAST(CAST(bpm AS INT) AS VARCHAR), ' ' ORDER BY seq) AS tempo_changes "
    "FROM v_tempo GROUP BY piece_id",
)
def a26(corpus):
    shown = F.transform(
        "tempo_changes", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["bpm"].cast("int").cast("string"))
    )
    return ps.tempo_change_list(corpus.tempo_changes).select(
        "piece_id", F.array_join(shown, " ").alias("tempo_changes")
    )


_TEMPO = """
    WITH onset AS (SELECT DISTINCT piece_id, start_s FROM v_notes),
    gap AS (SELECT piece_id, start_s - lag(start_s) OVER (PARTITION BY piece_id ORDER BY start_s) AS g FROM onset),
    folded AS (SELECT piece_id, list_reduce(range(1, 25), lambda b, x:
                   CASE WHEN b < 60 THEN b * 2 WHEN b > 200 THEN b / 2 ELSE b END, 60.0::DOUBLE / g) AS bpm
               FROM gap WHERE g > 0),
    counted AS (SELECT piece_id, CAST(round_even(bpm, 0) AS INT) AS bpm, count(*) AS n FROM folded GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, bpm) AS rn FROM counted)
    SELECT piece_id, bpm AS tempo_estimate FROM ranked WHERE rn = 1"""


@query("A27", _TEMPO)
def a27(corpus):
    return ps.tempo_estimate(corpus.timed_notes)


_side("A28", "main_time_signature", _times, _left("arg_min(ts, seq) AS main_time_signature", "v_time"))
_side("A29", "n_time_signature_changes", _times, _left("nullif(count(seq), 0) AS n_time_signature_changes", "v_time"))
_side(
    "A30", "all_time_signatures", _times,
    _left("string_agg(ts, ', ' ORDER BY seq) AS all_time_signatures", "v_time"), expr=_joined,
)
_side(
    "A31", "four_to_the_floor", _times,
    _left(
        "CASE WHEN count(seq) > 0 THEN count(seq) = 1 AND min(ts) = '4/4' END AS four_to_the_floor", "v_time"
    ),
)
_direct("A32", "track_length_in_seconds", "max(end_s)")
_side("A33", "lyrics_nb_words", _lyrics, _left("nullif(count(s.text), 0) AS lyrics_nb_words", "v_lyrics"))
_side(
    "A34", "lyrics_unique_words", _lyrics,
    _left("nullif(count(DISTINCT s.text), 0) AS lyrics_unique_words", "v_lyrics"),
)


@query("A35", _left("count(s.text) > 0 AS lyrics_bool", "v_lyrics"))
def a35(corpus):
    present = F.col("lyrics_nb_words").isNotNull()
    return corpus.pieces.join(_lyrics(corpus), "piece_id", "left").select("piece_id", present.alias("lyrics_bool"))


_WHOLE = """
    WITH n AS (SELECT piece_id, count(*) AS n_notes, CAST(count(DISTINCT pitch) AS INT) AS n_unique_notes,
            round(avg(end_s - start_s), 6) AS average_note_duration, round(avg(velocity), 6) AS average_note_velocity,
            round(avg(pitch), 6) AS average_note_pitch, max(pitch) - min(pitch) AS range_of_note_pitches,
            CAST(count(DISTINCT pitch % 12) AS INT) AS number_of_note_pitch_classes,
            CAST(count(DISTINCT pitch // 12) AS INT) AS number_of_octaves,
            round(count(*) / max(end_s), 6) AS number_of_notes_per_second,
            min(end_s - start_s) AS shortest_note_length, max(end_s - start_s) AS longest_note_length,
            max(end_s) AS track_length_in_seconds FROM v_notes GROUP BY piece_id),
    pt AS (SELECT piece_id, track_id, count(DISTINCT pitch) AS p, max(pitch) - min(pitch) AS r,
            count(DISTINCT pitch % 12) AS c, count(DISTINCT pitch // 12) AS o FROM v_notes GROUP BY ALL),
    t AS (SELECT piece_id, round(avg(p), 6) AS average_n_unique_notes_per_instrument,
            round(avg(r), 6) AS average_range_of_note_pitches_per_instrument,
            round(avg(c), 6) AS average_number_of_note_pitch_classes_per_instrument,
            round(avg(o), 6) AS average_number_of_octaves_per_instrument FROM pt GROUP BY piece_id),
    i AS (SELECT piece_id, CAST(count(*) AS INT) AS n_instruments, CAST(count(DISTINCT program) AS INT) AS n_unique_instruments,
            array_to_string(list_sort(list_distinct(list(program_name))), ', ') AS instrument_names,
            array_to_string(list_sort(list_distinct(list(family_name))), ', ') AS instrument_families,
            CAST(count(DISTINCT family_number) AS INT) AS number_of_instrument_families
          FROM v_tracks JOIN v_gm USING (program) GROUP BY piece_id),
    k AS (SELECT piece_id, arg_min(key_number, seq) AS main_key_signature, count(*) AS n_key_changes
          FROM v_keys GROUP BY piece_id),
    s AS (SELECT piece_id, arg_min(ts, seq) AS main_time_signature, string_agg(ts, ', ' ORDER BY seq) AS all_time_signatures,
            count(*) = 1 AND min(ts) = '4/4' AS four_to_the_floor, count(*) AS n_time_signature_changes
          FROM v_time GROUP BY piece_id),
    e AS (SELECT piece_id, count(*) AS n_tempo_changes FROM v_tempo GROUP BY piece_id),
    l AS (SELECT piece_id, count(*) AS lyrics_nb_words, count(DISTINCT text) AS lyrics_unique_words
          FROM v_lyrics GROUP BY piece_id),
    """ + _TEMPO.strip()[4:].replace("SELECT piece_id, bpm AS tempo_estimate FROM ranked WHERE rn = 1", """
    b AS (SELECT piece_id, bpm AS tempo_estimate FROM ranked WHERE rn = 1)
    SELECT CAST(p.piece_id AS VARCHAR) AS md5, n_instruments, n_unique_instruments, instrument_names,
        instrument_families, number_of_instrument_families, n_notes, n_unique_notes,
        average_n_unique_notes_per_instrument, average_note_duration, average_note_velocity, average_note_pitch,
        range_of_note_pitches, average_range_of_note_pitches_per_instrument, number_of_note_pitch_classes,
        average_number_of_note_pitch_classes_per_instrument, number_of_octaves,
        average_number_of_octaves_per_instrument, number_of_notes_per_second, shortest_note_length,
        longest_note_length, main_key_signature, n_key_changes, coalesce(n_tempo_changes, 0) AS n_tempo_changes,
        tempo_estimate, main_time_signature, all_time_signatures, four_to_the_floor, n_time_signature_changes,
        track_length_in_seconds, lyrics_nb_words, lyrics_unique_words, lyrics_nb_words IS NOT NULL AS lyrics_bool
    FROM v_pieces p LEFT JOIN n USING (piece_id) LEFT JOIN t USING (piece_id) LEFT JOIN i USING (piece_id)
        LEFT JOIN k USING (piece_id) LEFT JOIN s USING (piece_id) LEFT JOIN e USING (piece_id)
        LEFT JOIN l USING (piece_id) LEFT JOIN b USING (piece_id)""").replace("rn FROM counted)", "rn FROM counted),")

_ROUNDED_COLUMNS = {c for c in ps.STATISTICS_COLUMNS if c.startswith("average_") or c == "number_of_notes_per_second"}
_LIST_COLUMNS = {"instrument_names", "instrument_families", "all_time_signatures"}


def report_columns():
    """Lists joined and averages rounded, ready for a flat file."""
    shown = []
    for c in ps.STATISTICS_COLUMNS:
        column = F.array_join(c, ", ") if c in _LIST_COLUMNS else F.round(c, 6) if c in _ROUNDED_COLUMNS else F.col(c)
        shown.append(column.alias(c))
    return shown


def statistics_report(corpus):
    """The whole table."""
    return ps.piece_statistics(corpus).select(*report_columns())


@query("A36", _WHOLE)
def a36(corpus):
    return statistics_report(corpus)


# End of the latest note that a sound piece may have; some pieces of every size have a later one.
_LATEST = 518


@query(
    "A37",
    f"""
    WITH w AS ({_WHOLE}),
    bad AS (SELECT CAST(piece_id AS VARCHAR) AS md5, 'invalidfile: ' || piece_id || ': ends beyond the piece limit' AS error
            FROM v_notes WHERE end_u > {_LATEST} GROUP BY piece_id)
    SELECT w.*, NULL::VARCHAR AS error FROM w WHERE md5 NOT IN (SELECT md5 FROM bad)
    UNION ALL BY NAME SELECT md5, error FROM bad""",
)
def a37(corpus):
    """The statistics row of every readable file, and for each other file its entry of the error log."""
    readable, log = ps.folder_statistics(corpus, latest_u=_LATEST)
    rows = readable.select(*report_columns()).unionByName(log, allowMissingColumns=True)
    return rows.orderBy("md5")


@query("A38", "SELECT piece_id, greatest(0.0::DOUBLE, max(end_s)) AS max_time FROM v_notes GROUP BY piece_id")
def a38(corpus):
    return ps.max_time(corpus.timed_notes, corpus.tracks)
