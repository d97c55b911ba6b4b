"""Track coverage and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import coverage as cov
from notewright.plans.registry import query


@query("C01", "SELECT piece_id, round(max(end_u) / 8.0::DOUBLE, 6) AS beat_count FROM v_notes GROUP BY piece_id")
def c01(corpus):
    return cov.piece_length(corpus.notes).select("piece_id", F.round("beat_count", 6).alias("beat_count"))


_FIRST_LAST = """
    SELECT piece_id, track_id, min(CASE WHEN up = 1 THEN start_u END) / 8.0::DOUBLE AS first_start,
           min(CASE WHEN down = 1 THEN end_u END) / 8.0::DOUBLE AS last_end
    FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, track_id ORDER BY start_u, pitch, end_u, velocity) AS up,
                 row_number() OVER (PARTITION BY piece_id, track_id
                                    ORDER BY start_u DESC, pitch DESC, end_u DESC, velocity DESC) AS down FROM v_notes)
    GROUP BY piece_id, track_id"""


@query("C02", _FIRST_LAST)
def c02(corpus):
    return cov.first_and_last(corpus.notes)


_TOTAL = "(SELECT piece_id, max(end_u) AS total FROM v_notes GROUP BY piece_id)"
_GROSS = f"""
    SELECT n.piece_id, n.track_id, round(100.0::DOUBLE * sum(end_u - start_u) / min(total), 6) AS gross_coverage
    FROM v_notes n JOIN {_TOTAL} USING (piece_id) GROUP BY n.piece_id, n.track_id"""


@query("C03", _GROSS)
def c03(corpus):
    return cov.gross_coverage(corpus.notes).withColumn("gross_coverage", F.round("gross_coverage", 6))


_TRUE = f"""
    SELECT u.piece_id, u.track_id, round(100.0::DOUBLE * count(*) / min(total), 6) AS true_coverage FROM (
        SELECT DISTINCT piece_id, track_id, unnest(range(start_u, end_u)) AS tick FROM v_notes) u
    JOIN {_TOTAL} USING (piece_id) GROUP BY u.piece_id, u.track_id"""


@query("C04", _TRUE)
def c04(corpus):
    return cov.true_coverage(corpus.notes).withColumn("true_coverage", F.round("true_coverage", 6))


@query("C05", "SELECT piece_id, track_id, count(*) AS n_notes FROM v_notes GROUP BY piece_id, track_id")
def c05(corpus):
    return cov.note_counts(corpus.notes)


def _int_list(name):
    return f"string_agg(CAST(CAST({name} AS BIGINT) AS VARCHAR), ', ' ORDER BY track_id) AS {name}"


@query(
    "C06",
    f"""
    WITH g AS ({_GROSS}), t AS ({_TRUE}), f AS ({_FIRST_LAST}),
    c AS (SELECT piece_id, track_id, count(*) AS n_notes FROM v_notes GROUP BY ALL),
    a AS (SELECT piece_id, track_id, n_notes, round_even(gross_coverage * 1000, 0) AS gross_coverage,
                 round_even(true_coverage * 1000, 0) AS true_coverage, first_start * 8 AS first_start, last_end * 8 AS last_end
          FROM g JOIN t USING (piece_id, track_id) JOIN f USING (piece_id, track_id) JOIN c USING (piece_id, track_id))
    SELECT piece_id, count(*) AS n_tracks, {_int_list('n_notes')}, {_int_list('gross_coverage')},
           {_int_list('true_coverage')}, {_int_list('first_start')}, {_int_list('last_end')}
    FROM a GROUP BY piece_id""",
)
def c06(corpus):
    scale = {"n_notes": 1, "gross_coverage": 1000, "true_coverage": 1000, "first_start": 8, "last_end": 8}

    def shown(name, factor):
        digits = F.transform(
            name, lambda x: F.bround((F.round(x, 6) if factor == 1000 else x) * factor).cast("long").cast("string")
        )
        return F.array_join(digits, ", ").alias(name)

    return cov.piece_activity(corpus.notes).select("piece_id", "n_tracks", *[shown(n, f) for n, f in scale.items()])


_SPLIT = """
    SELECT piece_id, name, count(*) AS n_tracks, string_agg(CAST(track_id AS VARCHAR), ', ' ORDER BY track_id) AS track_ids
    FROM v_tracks GROUP BY piece_id, name HAVING count(*) > 1"""


@query("C07", _SPLIT)
def c07(corpus):
    ids = F.array_join(F.transform("track_ids", lambda x: x.cast("string")), ", ")
    return cov.split_names(corpus.tracks).withColumn("track_ids", ids)


@query(
    "C08",
    f"""
    WITH s AS ({_SPLIT})
    SELECT n.piece_id, t.name, row_number() OVER (PARTITION BY n.piece_id, t.name
               ORDER BY start_u, n.track_id, pitch, end_u, velocity) AS position,
           n.track_id, start_u, end_u, pitch
    FROM v_notes n JOIN v_tracks t USING (piece_id, track_id) JOIN s ON s.piece_id = n.piece_id AND s.name = t.name""",
)
def c08(corpus):
    return cov.merged_split_tracks(corpus.notes, corpus.tracks)


@query(
    "C09",
    """
    SELECT piece_id, CAST(frame AS INT) AS frame, pitch, CAST(sum(velocity) AS BIGINT) AS velocity, (frame % 32 = 0) AS on_bar_grid
    FROM (SELECT piece_id, pitch, velocity, unnest(range(start_u, end_u)) AS frame FROM v_notes)
    GROUP BY piece_id, frame, pitch""",
)
def c09(corpus):
    return cov.piano_roll(corpus.notes).withColumn("on_bar_grid", cov.on_bar_grid(F.col("frame"))).select(
        "piece_id", "frame", "pitch", "velocity", "on_bar_grid"
    )
