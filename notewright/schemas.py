"""Explicit schemas, as DDL, of the file formats the engine reads."""

from __future__ import annotations

STATISTICS = (
    "md5 STRING, n_instruments INT, n_unique_instruments INT, instrument_names ARRAY<STRING>, "
    "instrument_families ARRAY<STRING>, number_of_instrument_families INT, n_notes BIGINT, n_unique_notes INT, "
    "average_n_unique_notes_per_instrument DOUBLE, average_note_duration DOUBLE, average_note_velocity DOUBLE, "
    "average_note_pitch DOUBLE, range_of_note_pitches INT, average_range_of_note_pitches_per_instrument DOUBLE, "
    "number_of_note_pitch_classes INT, average_number_of_note_pitch_classes_per_instrument DOUBLE, "
    "number_of_octaves INT, average_number_of_octaves_per_instrument DOUBLE, number_of_notes_per_second DOUBLE, "
    "shortest_note_length DOUBLE, longest_note_length DOUBLE, main_key_signature INT, n_key_changes BIGINT, "
    "n_tempo_changes BIGINT, tempo_estimate INT, main_time_signature STRING, all_time_signatures ARRAY<STRING>, "
    "four_to_the_floor BOOLEAN, n_time_signature_changes BIGINT, track_length_in_seconds DOUBLE, "
    "lyrics_nb_words BIGINT, lyrics_unique_words BIGINT, lyrics_bool BOOLEAN"
)

STATISTICS_FIELDS = {name: kind for name, kind in (field.split(" ") for field in STATISTICS.split(", "))}

TITLE_ARTIST = "md5 STRING, title_artist ARRAY<ARRAY<STRING>>"
GENRE = "md5 STRING, genre ARRAY<ARRAY<STRING>>"

TRACK_STATE = "STRUCT<label: STRING, instrument: STRING, density: INT, temperature: DOUBLE, bars: ARRAY<STRING>>"

# Union of the three layouts in which a stored piece exists.
STORED_PIECE = (
    f"generated_midi STRING, generate_midi STRING, sequence STRING, hyperparameters_and_bars ARRAY<{TRACK_STATE}>, "
    "features STRUCT<model_identification: STRING, inst_list: ARRAY<STRING>, density_list: ARRAY<INT>, "
    "temperature: DOUBLE, max_seq_length: INT, generate_until: STRING>"
)

RAW_NOTE_ROW = (
    "path STRING, piece_id STRING, track_id INT, program INT, is_drum BOOLEAN, name STRING, pitch INT, velocity INT, "
    "start_u INT, end_u INT, error STRING"
)
