"""Scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import functions as F

from notewright.functions import instruments as inst
from notewright.functions import names as nm
from notewright.functions import tokens as tk
from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import genre_model as gm
from notewright.operators import piece_stats as ps
from notewright.plans.registry import query
from notewright.plans.views import sql_list

PROGRAMS = inst.draw_family_programs(seed=1)


def _texts(corpus):
    return enc.encode(corpus.notes, corpus.tracks)


@query(
    "P01",
    "SELECT doc_id, CAST(doc_id AS VARCHAR) || '_' || lang AS md5 FROM documents",
)
def p01(corpus):
    path = F.concat(F.lit("/midi/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), "lang", F.lit(".mid"))
    return corpus.table("documents").select("doc_id", nm.file_stem(path).alias("md5"))


@query("P02", "SELECT piece_id, track_id, program, family_name FROM v_tracks JOIN v_gm USING (program)")
def p02(corpus):
    return corpus.tracks.select("piece_id", "track_id", "program", inst.family_name(F.col("program")).alias("family_name"))


@query("P03", "SELECT piece_id, track_id, program, CAST(program // 8 AS INT) AS family_number FROM v_tracks")
def p03(corpus):
    return corpus.tracks.select("piece_id", "track_id", "program", inst.family_number(F.col("program")).alias("family_number"))


@query(
    "P04",
    f"""
    SELECT piece_id, track_id, CAST(program // 8 AS INT) AS family_number,
           CAST(({sql_list(PROGRAMS)})[program // 8 + 1] AS INT) AS chosen_program FROM v_tracks""",
)
def p04(corpus):
    """One draw per run: the list drawn at import serves both sides."""
    family = inst.family_number(F.col("program"))
    return corpus.tracks.select(
        "piece_id", "track_id", family.alias("family_number"), inst.family_program(family, PROGRAMS).alias("chosen_program")
    )


@query("P05", "SELECT piece_id, track_id, program_name FROM v_tracks JOIN v_gm USING (program)")
def p05(corpus):
    return corpus.tracks.select("piece_id", "track_id", inst.program_name(F.col("program")).alias("program_name"))


@query(
    "P06",
    "SELECT piece_id, track_id, CASE WHEN is_drum THEN 'DRUMS' ELSE CAST(program AS VARCHAR) END AS label FROM v_tracks",
)
def p06(corpus):
    return corpus.tracks.select("piece_id", "track_id", inst.instrument_label(F.col("program"), F.col("is_drum")).alias("label"))


_TO_FAMILY = """array_to_string(list_transform(string_split(text, ' '), lambda t:
    CASE WHEN starts_with(t, 'INST=') AND t <> 'INST=DRUMS' THEN 'INST=' || (CAST(t[6:] AS INT) // 8) ELSE t END), ' ')"""
_TO_PROGRAM = f"""array_to_string(list_transform(string_split(families, ' '), lambda t:
    CASE WHEN starts_with(t, 'INST=') AND t <> 'INST=DRUMS'
         THEN 'INST=' || ({sql_list(PROGRAMS)})[CAST(t[6:] AS INT) + 1] ELSE t END), ' ')"""


@query(
    "P07",
    f"""
    WITH f AS (SELECT piece_id, {_TO_FAMILY} AS families FROM v_text)
    SELECT piece_id, families, {_TO_PROGRAM} AS programs FROM f""",
)
def p07(corpus):
    families = _texts(corpus).select("piece_id", inst.text_to_families(F.col("text")).alias("families"))
    return families.withColumn("programs", inst.text_to_programs(F.col("families"), PROGRAMS))


@query(
    "P08",
    """
    SELECT doc_id, round(list_avg(list_transform(string_split(text, ' '), lambda w: length(w))), 6) AS average
    FROM documents""",
)
def p08(corpus):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    return corpus.documents.select("doc_id", F.round(tk.list_average(lengths), 6).alias("average"))


def _units(corpus):
    return corpus.notes.select("start_u", (F.col("end_u") - F.col("start_u")).alias("length_u")).distinct()


_UNITS = "(SELECT DISTINCT start_u, end_u - start_u AS length_u FROM v_notes)"
_LIT = "(start_u // 8) || '.' || (start_u % 8) || '.8'"
_LEN = "(length_u // 8) || '.' || (length_u % 8) || '.8'"


@query(
    "P09",
    f"""
    SELECT start_u, length_u, list_transform(string_split({_LIT}, '.'), lambda x: CAST(x AS INT))[1] AS whole,
           CAST(string_split({_LIT}, '.')[2] AS INT) AS part, CAST(string_split({_LIT}, '.')[3] AS INT) AS base FROM {_UNITS}""",
)
def p09(corpus):
    parts = tk.int_list(tk.units_literal(F.col("start_u")))
    return _units(corpus).select(
        "start_u", "length_u", parts[0].alias("whole"), parts[1].alias("part"), parts[2].alias("base")
    )


@query("P10", f"SELECT start_u, length_u, start_u / 8.0::DOUBLE AS beats FROM {_UNITS}")
def p10(corpus):
    beats = tk.literal_beats(tk.units_literal(F.col("start_u")))
    return _units(corpus).select("start_u", "length_u", beats.alias("beats"))


@query("P11", f"SELECT start_u, length_u, {_LIT} AS literal FROM {_UNITS}")
def p11(corpus):
    return _units(corpus).select("start_u", "length_u", tk.beats_literal(F.col("start_u") / 8.0).alias("literal"))


@query("P12", f"SELECT start_u, length_u, CAST(length_u // 2 AS INT) AS delta FROM {_UNITS}")
def p12(corpus):
    return _units(corpus).select("start_u", "length_u", tk.literal_delta(tk.units_literal(F.col("length_u"))).alias("delta"))


@query(
    "P13",
    f"""
    SELECT start_u, length_u, length_u // 2 / 4.0::DOUBLE AS beats,
           (length_u // 2 * 2 // 8) || '.' || (length_u // 2 * 2 % 8) || '.8' AS literal FROM {_UNITS}""",
)
def p13(corpus):
    delta = tk.units_delta(F.col("length_u"))
    return _units(corpus).select(
        "start_u", "length_u", tk.delta_beats(delta).alias("beats"), tk.delta_literal(delta).alias("literal")
    )


@query(
    "P14",
    f"SELECT start_u, length_u, ((start_u + length_u) // 8) || '.' || ((start_u + length_u) % 8) || '.8' AS total FROM {_UNITS}",
)
def p14(corpus):
    a, b = tk.units_literal(F.col("start_u")), tk.units_literal(F.col("length_u"))
    return _units(corpus).select("start_u", "length_u", tk.add_literals(a, b).alias("total"))


_EVENTS = """
    SELECT DISTINCT kind, value, CASE kind WHEN 'TIME_DELTA' THEN 'Time-Shift' WHEN 'INST' THEN 'Instrument'
           WHEN 'NOTE_ON' THEN 'Note-On' WHEN 'NOTE_OFF' THEN 'Note-Off' WHEN 'BAR_START' THEN 'Bar-Start'
           WHEN 'BAR_END' THEN 'Bar-End' WHEN 'PIECE_START' THEN 'Piece-Start' WHEN 'TRACK_START' THEN 'Track-Start'
           WHEN 'TRACK_END' THEN 'Track-End' END AS type,
           CASE WHEN kind = 'TIME_DELTA' THEN (CAST(value AS INT) * 2 // 8) || '.' || (CAST(value AS INT) * 2 % 8) || '.8'
                WHEN value = 'DRUMS' THEN 'Drums' ELSE value END AS event_value
    FROM v_words WHERE kind NOT IN ('', 'DENSITY')"""


def _words(corpus):
    exploded = _texts(corpus).select(F.explode(tk.words(F.col("text"))).alias("word")).distinct()
    return exploded.select("word", tk.kind(F.col("word")).alias("kind"), tk.value(F.col("word")).alias("value"))


@query(
    "P15",
    f"""
    SELECT type, event_value, CASE WHEN value IS NULL THEN kind || ' ' ELSE kind || '=' || value || ' ' END AS token
    FROM ({_EVENTS}) UNION ALL SELECT 'Velocity', CAST(velocity AS VARCHAR), '' FROM (SELECT DISTINCT velocity FROM v_notes)""",
)
def p15(corpus):
    """Token of every event of the corpus; a velocity has none."""
    known = _words(corpus).where(tk.is_event(F.col("word"))).select(
        tk.event_type(F.col("kind")).alias("type"), tk.event_value(F.col("kind"), F.col("value")).alias("event_value")
    )
    velocity = corpus.notes.select(F.lit("Velocity").alias("type"), F.col("velocity").cast("string").alias("event_value"))
    rows = known.unionByName(velocity.distinct())
    return rows.withColumn("token", tk.event_text(F.col("type"), F.col("event_value")))


@query("P16", f"SELECT kind, value, type, event_value FROM ({_EVENTS})")
def p16(corpus):
    rows = _words(corpus).withColumn("type", tk.event_type(F.col("kind"))).where("type IS NOT NULL")
    return rows.select("kind", "value", "type", tk.event_value(F.col("kind"), F.col("value")).alias("event_value"))


@query("P17", "SELECT DISTINCT word, kind, value FROM v_words WHERE word <> ''")
def p17(corpus):
    return _words(corpus)


@query(
    "P18",
    """
    SELECT doc_id, CAST(coalesce(nullif(list_position(list_transform(string_split(text, ' '),
               lambda w: contains(w, 'tion')), true), 0), 0) - 1 AS BIGINT) AS first_index FROM documents""",
)
def p18(corpus):
    return corpus.documents.select("doc_id", tk.first_index_with(F.split("text", " "), "tion").alias("first_index"))


def clean_sql(c):
    plain = (
        f"regexp_replace(regexp_replace(regexp_replace({c}, '[,_\\n]', '', 'g'), '\\([^)]*\\)', '', 'g'), "
        "'\\.\\p{Nd}+', '', 'g')"
    )
    spaced = f"regexp_replace({plain}, '([A-Z])', ' \\1', 'g')"
    return f"CASE WHEN regexp_matches({plain}, '^[A-Z]') THEN {spaced}[2:] ELSE {spaced} END"


@query("P19", f"SELECT md5, {clean_sql('artist')} AS artist, {clean_sql('title')} AS title FROM v_catalog")
def p19(corpus):
    return corpus.catalog.select(
        "md5", nm.clean_name(F.col("artist")).alias("artist"), nm.clean_name(F.col("title")).alias("title")
    )


@query("P20", "SELECT md5, artist, title FROM v_names")
def p20(corpus):
    entry = F.col("title_artist")
    return corpus.raw_names.select("md5", nm.first_artist(entry).alias("artist"), nm.first_title(entry).alias("title"))


@query("P21", "SELECT md5, genre FROM v_genres")
def p21(corpus):
    return corpus.raw_genres.select("md5", F.explode_outer(F.get("genre", 0)).alias("genre"))


@query("P22", "SELECT md5, artist AS artist_old, title AS title_old, n_instruments, lyrics_bool FROM v_catalog")
def p22(corpus):
    renamed = corpus.catalog.withColumnsRenamed({"artist": "artist_old", "title": "title_old"})
    return renamed.drop(
        "genre", "number_of_notes_per_second", "four_to_the_floor", "main_time_signature", "n_time_signature_changes"
    )


@query(
    "P23",
    """
    SELECT md5, CAST(n_instruments AS DOUBLE) AS n_instruments, CASE WHEN lyrics_bool THEN 'true' ELSE 'false' END AS lyrics_bool,
           TRY_CAST(artist AS DOUBLE) AS artist_number, TRY_CAST(artist AS DOUBLE) IS NULL AS rejected FROM v_catalog""",
)
def p23(corpus):
    """Numbers and strings forced; what is no number is set aside, not dropped."""
    number = F.col("artist").try_cast("double")
    return corpus.catalog.select(
        "md5", F.col("n_instruments").cast("double").alias("n_instruments"),
        F.col("lyrics_bool").cast("string").alias("lyrics_bool"), number.alias("artist_number"),
        number.isNull().alias("rejected"),
    )


@query(
    "P24",
    """
    SELECT piece_id, count(*) FILTER (pitch BETWEEN 0 AND 126) AS in_wide_range,
           count(*) FILTER (pitch BETWEEN 21 AND 108) AS in_piano_range FROM v_notes GROUP BY piece_id""",
)
def p24(corpus):
    pitch = F.col("pitch")
    return corpus.notes.groupBy("piece_id").agg(
        F.count_if(pitch.between(0, 126)).alias("in_wide_range"), F.count_if(pitch.between(21, 108)).alias("in_piano_range")
    )


_SIDES = """
    SELECT p.piece_id, k.key_number, t.ts AS main_time_signature FROM v_pieces p
    LEFT JOIN (SELECT piece_id, arg_min(key_number, seq) AS key_number FROM v_keys GROUP BY 1) k USING (piece_id)
    LEFT JOIN (SELECT piece_id, arg_min(ts, seq) AS ts FROM v_time GROUP BY 1) t USING (piece_id)"""


def _sides(corpus):
    keys = ps.key_statistics(corpus.key_signatures).select("piece_id", F.col("main_key_signature").alias("key_number"))
    times = ps.time_statistics(corpus.time_signatures).select("piece_id", "main_time_signature")
    return corpus.pieces.join(keys, "piece_id", "left").join(times, "piece_id", "left")


@query("P25", f"SELECT * FROM ({_SIDES}) WHERE key_number IS NOT NULL AND main_time_signature IS NOT NULL")
def p25(corpus):
    return _sides(corpus).na.drop()


@query(
    "P26",
    f"""
    WITH s AS (SELECT piece_id, CAST(key_number AS DOUBLE) AS key_number, md5('42:' || piece_id) < '1999999a' AS is_test
               FROM ({_SIDES}))
    SELECT piece_id, is_test, round(coalesce(key_number, (SELECT avg(key_number) FROM s WHERE NOT is_test)), 6) AS imputed
    FROM s""",
)
def p26(corpus):
    """Mean imputation fitted on the training rows only."""
    rows = gm.with_split(_sides(corpus).select("piece_id", F.col("key_number").cast("double").alias("key_number")), "piece_id")
    imputer = Imputer(strategy="mean", inputCols=["key_number"], outputCols=["imputed"])
    filled = imputer.fit(rows.where(~F.col("is_test"))).transform(rows)
    return filled.select("piece_id", "is_test", F.round("imputed", 6).alias("imputed"))


@query(
    "P27",
    """
    SELECT piece_id, count(*) AS n_names, min(program_name) AS first_name FROM
        (SELECT DISTINCT piece_id, program_name FROM v_tracks JOIN v_gm USING (program)) GROUP BY piece_id""",
)
def p27(corpus):
    """A printed list column parsed back into an array."""
    names = ps.note_statistics(corpus.timed_notes, corpus.tracks).select("piece_id", "instrument_names")
    printed = F.concat(F.lit("[['"), F.array_join("instrument_names", "', '"), F.lit("']]"))
    parsed = names.select("piece_id", nm.stringified_list(printed).alias("names"))
    return parsed.select("piece_id", F.size("names").cast("long").alias("n_names"), F.array_min("names").alias("first_name"))


@query("P28", "SELECT piece_id, CAST(program AS VARCHAR) AS instrument, count(*) AS n FROM v_tracks GROUP BY ALL")
def p28(corpus):
    listed = ps.note_statistics(corpus.timed_notes, corpus.tracks).select("piece_id", "instruments")
    return listed.select("piece_id", F.explode(F.split("instruments", ", ")).alias("instrument")).groupBy(
        "piece_id", "instrument"
    ).agg(F.count("*").alias("n"))


@query("P29", "SELECT piece_id, seq, ts FROM v_time")
def p29(corpus):
    text = ps.time_signature_text(F.col("numerator"), F.col("denominator"))
    return corpus.time_signatures.select("piece_id", "seq", text.alias("ts"))


@query(
    "P30",
    "SELECT piece_id, track_id, count(*) AS n_notes FROM v_notes WHERE pitch BETWEEN 21 AND 108 GROUP BY ALL",
)
def p30(corpus):
    """A chain of table functions, each with its own parameters."""

    def in_range(df, low, high):
        return df.where(F.col("pitch").between(low, high))

    def counted(df, *keys):
        return df.groupBy(*keys).agg(F.count("*").alias("n_notes"))

    return corpus.notes.transform(in_range, 21, 108).transform(counted, "piece_id", "track_id")


@query(
    "P31",
    """
    SELECT t.piece_id, t.track_id, g.program_name AS instrument,
           coalesce(CAST(f.family_number AS VARCHAR), 'DRUMS') AS family
    FROM v_tracks t JOIN v_gm g USING (program) LEFT JOIN v_family_program f ON f.display_name = g.program_name""",
)
def p31(corpus):
    named = corpus.tracks.select("piece_id", "track_id", inst.program_name(F.col("program")).alias("instrument"))
    return inst.display_family(named, "instrument", inst.family_dimension(corpus.spark))
