"""Notes to section text."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions.instruments import instrument_label
from notewright.operators import encode as enc
from notewright.plans.registry import query
from notewright.sources.quarantine import split_good_and_errors

#: No note of a sound piece ends later: 32,768 bars.
_LATEST = 1 << 20


def _notes(corpus):
    return split_good_and_errors(corpus.notes, latest_u=_LATEST)[0]


def _sections(corpus):
    return enc.section_text(_notes(corpus), corpus.tracks)


@query(
    "E01",
    """
    SELECT piece_id, track_id, t, kind, pitch,
           t - coalesce(lag(t) OVER (PARTITION BY piece_id, track_id ORDER BY t, kind, pitch), 0) AS shift_u FROM v_ev""",
)
def e01(corpus):
    return enc.ordered_events(corpus.notes).select("piece_id", "track_id", "t", "kind", "pitch", "shift_u")


@query(
    "E02",
    """
    SELECT piece_id, track_id, CASE kind WHEN 1 THEN 'Note-On' ELSE 'Note-Off' END AS type, pitch AS value,
           count(*) AS n FROM v_ev GROUP BY ALL""",
)
def e02(corpus):
    """Event types left once velocities are not projected."""
    kind = F.when(F.col("kind") == 1, "Note-On").otherwise("Note-Off")
    events = enc.note_events(corpus.notes).select("piece_id", "track_id", kind.alias("type"), F.col("pitch").alias("value"))
    return events.groupBy("piece_id", "track_id", "type", "value").agg(F.count("*").alias("n"))


@query(
    "E03",
    """
    WITH e AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY piece_id, track_id ORDER BY t, kind, pitch), 0) AS s
               FROM v_ev)
    SELECT piece_id, track_id, t, kind, pitch, CAST(unnest(range(t - s + 1, t + 1)) AS INT) AS tick FROM e WHERE s > 0""",
)
def e03(corpus):
    return enc.unit_shifts(enc.ordered_events(corpus.notes))


@query(
    "E04",
    """
    SELECT a.piece_id, a.track_id, CAST(a.bar AS BIGINT) AS bar, CAST(count(e.t) AS INT) AS n_events
    FROM v_allbars a LEFT JOIN v_ev e USING (piece_id, track_id, bar) GROUP BY a.piece_id, a.track_id, a.bar""",
)
def e04(corpus):
    return enc.bars_of(corpus.notes).select("piece_id", "track_id", "bar", F.size("events").alias("n_events"))


@query(
    "E05",
    """
    SELECT piece_id, track_id, CAST(bar AS BIGINT) AS bar, CAST(pos - 1 AS INT) AS pos, CAST(t - bar * 32 AS INT) AS t,
           kind = 1 AS is_on, pitch, CAST(shift_u AS INT) AS shift_u FROM v_evpos""",
)
def e05(corpus):
    return enc.bar_events(corpus.notes)


@query(
    "E06",
    """
    SELECT a.piece_id, a.track_id, CAST(a.bar AS BIGINT) AS bar,
           CAST(32 - coalesce(max(e.t) - a.bar * 32, 0) AS INT) AS dropped_u
    FROM v_allbars a LEFT JOIN v_ev e USING (piece_id, track_id, bar) GROUP BY a.piece_id, a.track_id, a.bar""",
)
def e06(corpus):
    return enc.dropped_before_bar_end(corpus.notes)


@query("E07", "SELECT piece_id, track_id, CAST(bar AS BIGINT) AS bar, density FROM v_bars")
def e07(corpus):
    return enc.bar_densities(corpus.notes).select("piece_id", "track_id", "bar", "density")


@query(
    "E08",
    """
    SELECT piece_id, track_id, CASE WHEN is_drum THEN 'DRUMS' ELSE CAST(program AS VARCHAR) END AS instrument,
           CASE WHEN is_drum THEN 'DRUMS' ELSE CAST(program // 8 AS VARCHAR) END AS family FROM v_tracks""",
)
def e08(corpus):
    program, drum = F.col("program"), F.col("is_drum")
    return corpus.tracks.select(
        "piece_id", "track_id", instrument_label(program, drum).alias("instrument"),
        instrument_label(program, drum, familize=True).alias("family"),
    )


@query(
    "E09",
    """
    SELECT piece_id, track_id, CAST(section AS BIGINT) AS section, CAST(count(*) AS INT) AS n_bars
    FROM v_allbars GROUP BY ALL""",
)
def e09(corpus):
    return enc.packed_sections(_notes(corpus)).select("piece_id", "track_id", "section", "n_bars")


@query("E10", "SELECT piece_id, track_id, CAST(section AS BIGINT) AS section, density FROM v_secdensity")
def e10(corpus):
    return _sections(corpus).select("piece_id", "track_id", "section", "density")


@query(
    "E11",
    """
    SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY section, track_id) - 1 AS INT) AS position,
           CAST(section AS BIGINT) AS section, track_id
    FROM (SELECT DISTINCT piece_id, track_id, section FROM v_allbars)""",
)
def e11(corpus):
    return enc.section_order(enc.packed_sections(_notes(corpus)).select("piece_id", "track_id", "section"))


@query("E12", "SELECT piece_id, track_id, CAST(section AS BIGINT) AS section, text FROM v_sections")
def e12(corpus):
    return _sections(corpus).select("piece_id", "track_id", "section", "text")


@query(
    "E13",
    """
    SELECT piece_id, CAST(section AS BIGINT) AS section, count(*) AS n_tracks, CAST(sum(density) AS BIGINT) AS densities,
           CAST(sum(length(text)) AS BIGINT) AS characters
    FROM v_sections GROUP BY ALL""",
)
def e13(corpus):
    return _sections(corpus).groupBy("piece_id", "section").agg(
        F.count("*").alias("n_tracks"), F.sum("density").alias("densities"), F.sum(F.length("text")).alias("characters")
    )


@query("E14", "SELECT piece_id, text FROM v_text")
def e14(corpus):
    return enc.encode(_notes(corpus), corpus.tracks)


@query(
    "E15",
    """
    SELECT piece_id, CAST(section AS BIGINT) AS section, string_agg(text, '' ORDER BY track_id) AS text
    FROM v_sections GROUP BY piece_id, section""",
)
def e15(corpus):
    return enc.text_by_section(_sections(corpus))
