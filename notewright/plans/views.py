"""DuckDB statements of the corpus views, and the helper that prepends the ones a statement uses."""

from __future__ import annotations

import re

from notewright.constants import FAMILY_NAMES, FAMILY_TO_PROGRAM, PROGRAM_NAMES


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_N = "(SELECT count(*) FROM supplier)"

VIEWS = {
    "v_pieces": "SELECT s_suppkey AS piece_id FROM supplier",
    "v_notes": """
        SELECT l_suppkey AS piece_id, l_linenumber AS track_id,
               CAST((l_linenumber * 17 + l_suppkey) % 128 AS INT) AS program, (l_linenumber = 1) AS is_drum,
               CAST(l_partkey % 128 AS INT) AS pitch,
               CAST((l_orderkey * 7 + l_linenumber * 3) % 512 AS INT) AS start_u,
               CAST((l_orderkey * 7 + l_linenumber * 3) % 512 + 1 + CAST(l_quantity AS INT) % 8 AS INT) AS end_u,
               CAST(1 + l_orderkey % 127 AS INT) AS velocity,
               ((l_orderkey * 7 + l_linenumber * 3) % 512) * 0.0625::DOUBLE AS start_s,
               ((l_orderkey * 7 + l_linenumber * 3) % 512 + 1 + CAST(l_quantity AS INT) % 8) * 0.0625::DOUBLE AS end_s
        FROM lineitem""",
    "v_tracks": """
        SELECT DISTINCT piece_id, track_id, program, is_drum, 'Staff ' || (track_id // 2) AS name FROM v_notes""",
    "v_loop_notes": """
        SELECT DISTINCT l_suppkey AS piece_id, l_linenumber AS track_id, CAST(l_partkey % 128 AS INT) AS pitch,
               CAST(2 * ((l_orderkey * 7 + l_linenumber * 3) % 128) AS INT) AS start_u,
               CAST(2 * ((l_orderkey * 7 + l_linenumber * 3) % 128) + 2 AS INT) AS end_u
        FROM lineitem""",
    "v_time": f"""
        SELECT (s_suppkey * s_suppkey) % {_N} AS piece_id, s_suppkey AS seq,
               ([4, 3, 2])[CAST(s_nationkey % 3 + 1 AS INT)] || '/4' AS ts FROM supplier""",
    "v_keys": f"""
        SELECT (c_custkey * c_custkey) % {_N} AS piece_id, c_custkey AS seq, CAST(c_nationkey % 24 AS INT) AS key_number
        FROM customer""",
    "v_tempo": f"""
        SELECT o_orderkey % {_N} AS piece_id, o_orderkey AS seq, CAST(60 + o_custkey % 120 AS DOUBLE) AS bpm
        FROM orders""",
    "v_lyrics": f"""
        SELECT (doc_id * doc_id) % {_N} AS piece_id, w.word AS text
        FROM documents, unnest(string_split_regex(text, '\\s+')) AS w(word) WHERE w.word <> ''""",
    "v_gm": f"""
        SELECT CAST(i AS INT) AS program, CAST(i // 8 AS INT) AS family_number,
               ({sql_list(FAMILY_NAMES)})[CAST(i // 8 + 1 AS INT)] AS family_name,
               ({sql_list(PROGRAM_NAMES)})[CAST(i + 1 AS INT)] AS program_name
        FROM range(128) AS r(i)""",
    "v_family_program": "SELECT * FROM (VALUES "
    + ", ".join(f"({f}, {p}, '{n}')" for f, (p, n) in FAMILY_TO_PROGRAM.items())
    + ") AS f(family_number, program, display_name)",
    "v_catalog": r"""
        SELECT page_id AS md5, regexp_extract(url, '^https?://([^/?#]+)', 1) AS artist,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               regexp_extract(html, '<html lang="([^"]*)"', 1) AS genre,
               CAST(length(html) % 16 AS INT) AS n_instruments,
               round(length(html) / 97.0::DOUBLE, 4) AS number_of_notes_per_second,
               (length(html) % 3 <> 0) AS four_to_the_floor,
               CASE WHEN length(html) % 5 = 0 THEN '3/4' WHEN length(html) % 5 = 1 THEN '2/4' ELSE '4/4' END
                   AS main_time_signature,
               CAST(length(html) % 7 AS INT) AS n_time_signature_changes,
               (length(html) % 4 = 0) AS lyrics_bool
        FROM pages""",
    "v_statistics": "SELECT * EXCLUDE (artist, title, genre) FROM v_catalog",
    "v_raw_names": """
        SELECT md5, CASE WHEN md5 % 7 = 0 THEN [[artist]] ELSE [[title, artist]] END AS title_artist FROM v_catalog""",
    "v_names": """
        SELECT md5, title_artist[1][len(title_artist[1])] AS artist,
               CASE WHEN len(title_artist[1]) >= 2 THEN title_artist[1][1] ELSE 'unknown' END AS title
        FROM v_raw_names""",
    "v_raw_genres": "SELECT md5, [[genre, 'g' || (md5 % 3)]] AS genre FROM v_catalog",
    "v_genres": "SELECT md5, unnest(genre[1]) AS genre FROM v_raw_genres",
    # notes -> bar / section text, relational form
    "v_ev": """
        SELECT piece_id, track_id, start_u // 32 AS bar, start_u AS t, 1 AS kind, pitch FROM v_notes
        UNION ALL
        SELECT piece_id, track_id, (end_u - 1) // 32, end_u, 0, pitch FROM v_notes""",
    "v_evpos": """
        SELECT *, row_number() OVER w AS pos, t - coalesce(lag(t) OVER w, bar * 32) AS shift_u FROM v_ev
        WINDOW w AS (PARTITION BY piece_id, track_id, bar ORDER BY t, kind, pitch)""",
    "v_bartext": """
        SELECT piece_id, track_id, bar, count(*) FILTER (kind = 1) AS n_on,
               string_agg(CASE WHEN shift_u > 0 THEN 'TIME_DELTA=' || (shift_u // 2) || ' ' ELSE '' END
                   || CASE kind WHEN 1 THEN 'NOTE_ON=' ELSE 'NOTE_OFF=' END || pitch || ' ', '' ORDER BY pos) AS body
        FROM v_evpos GROUP BY ALL""",
    "v_allbars": """
        SELECT m.piece_id, m.track_id, b.bar, b.bar // 8 AS section
        FROM (SELECT piece_id, track_id, max(bar) AS last_bar FROM v_ev GROUP BY ALL) m,
             unnest(range(0, CAST(m.last_bar + 1 AS BIGINT))) AS b(bar)""",
    "v_bars": """
        SELECT a.piece_id, a.track_id, a.section, a.bar, CAST(round_even(coalesce(t.n_on, 0) / 4.0, 0) AS INT) AS density,
               'BAR_START ' || coalesce(t.body, '') || 'BAR_END ' AS text
        FROM v_allbars a LEFT JOIN v_bartext t USING (piece_id, track_id, bar)""",
    "v_secdensity": """
        SELECT piece_id, track_id, section, density FROM (
            SELECT piece_id, track_id, section, density,
                   row_number() OVER (PARTITION BY piece_id, track_id, section ORDER BY count(*) DESC, density) AS rn
            FROM v_bars GROUP BY piece_id, track_id, section, density) WHERE rn = 1""",
    "v_sections": """
        SELECT b.piece_id, b.track_id, b.section, d.density,
               'TRACK_START INST=' || CASE WHEN tr.is_drum THEN 'DRUMS' ELSE CAST(tr.program AS VARCHAR) END
               || ' DENSITY=' || d.density || ' ' || string_agg(b.text, '' ORDER BY b.bar) || 'TRACK_END ' AS text
        FROM v_bars b JOIN v_secdensity d USING (piece_id, track_id, section)
             JOIN v_tracks tr USING (piece_id, track_id)
        GROUP BY b.piece_id, b.track_id, b.section, d.density, tr.is_drum, tr.program""",
    "v_text": """
        SELECT piece_id, string_agg(text, '' ORDER BY section) AS text FROM (
            SELECT piece_id, section, 'PIECE_START ' || string_agg(text, '' ORDER BY track_id) AS text
            FROM v_sections GROUP BY piece_id, section) GROUP BY piece_id""",
    # text -> tokens; tracks are numbered by completed TRACK_END, bars by completed BAR_END within a track
    "v_words": """
        SELECT piece_id, pos, word, string_split(word, '=')[1] AS kind, string_split(word, '=')[2] AS value
        FROM (SELECT piece_id, unnest(string_split(text, ' ')) AS word,
                     generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM v_text)""",
    "v_tracked": """
        SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'TRACK_END' THEN 1 ELSE 0 END) OVER
                   (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS channel
        FROM v_words WHERE kind <> ''""",
    "v_barred": """
        SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'BAR_END' THEN 1 ELSE 0 END) OVER
                   (PARTITION BY piece_id, channel ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS bar
        FROM v_tracked""",
    # every E14 bar holds at most 16 steps, so the guard only drops a Note-On that comes at step 16 or later
    "v_decoded": """
        SELECT piece_id, channel, bar, pos, kind, CAST(value AS INT) AS pitch,
               bar * 32 + 2 * coalesce(sum(CASE WHEN kind = 'TIME_DELTA' THEN CAST(value AS INT) ELSE 0 END) OVER
                   (PARTITION BY piece_id, channel, bar ORDER BY pos), 0) AS t
        FROM v_barred WHERE kind IN ('NOTE_ON', 'NOTE_OFF', 'TIME_DELTA')""",
    "v_trackinst": """
        SELECT piece_id, channel, arg_max(value, pos) AS instrument FROM v_tracked WHERE kind = 'INST' GROUP BY ALL""",
}

_ORDER = list(VIEWS)


def _used(sql: str, found: set[str]) -> None:
    for name in re.findall(r"\bv_[a-z_]+\b", sql):
        if name in VIEWS and name not in found:
            found.add(name)
            _used(VIEWS[name], found)


def with_views(sql: str) -> str:
    """Prepend the definitions of all views that ``sql`` mentions, directly or not."""
    found: set[str] = set()
    _used(sql, found)
    body = sql.strip()
    if not found:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _ORDER if name in found)
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes},\n{body.split(None, 2)[2]}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
