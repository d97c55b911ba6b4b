"""Section text to notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import tokens as tk
from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.plans.registry import query
from notewright.plans.scalar_plans import PROGRAMS
from notewright.plans.views import sql_list


def texts(corpus):
    return enc.encode(corpus.notes, corpus.tracks)


_TYPES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tk.KIND_TO_TYPE.items()) + " END"


@query(
    "D01",
    f"""
    SELECT piece_id, channel, {_TYPES} AS type,
           CASE WHEN kind = 'TIME_DELTA' THEN (CAST(value AS INT) * 2 // 8) || '.' || (CAST(value AS INT) * 2 % 8) || '.8'
                WHEN kind = 'INST' AND value = 'DRUMS' THEN 'Drums' ELSE nullif(value, '') END AS value, count(*) AS n
    FROM v_tracked WHERE {_TYPES} IS NOT NULL AND kind <> 'PIECE_START' GROUP BY ALL""",
)
def d01(corpus):
    rows = dec.decoded_events(texts(corpus)).where("kind <> 'PIECE_START'")
    value = tk.event_value(F.col("kind"), F.col("value"))
    return rows.select("piece_id", "channel", "type", value.alias("value")).groupBy(
        "piece_id", "channel", "type", "value"
    ).agg(F.count("*").alias("n"))


_GUARD = """
    WITH src AS (SELECT l_suppkey AS piece_id, l_linenumber AS channel, (l_orderkey * 7 + l_linenumber * 3) % 512 // 32 AS bar,
                        l_orderkey AS k, l_partkey AS p, 1 + CAST(l_quantity AS INT) % 8 AS d FROM lineitem),
    bars AS (SELECT piece_id, channel, bar, list(d ORDER BY k, p, d) AS deltas FROM src GROUP BY ALL)
    SELECT piece_id, channel, bar, CAST(len(deltas) AS INT) AS n_deltas,
           CAST(list_reduce(deltas, lambda a, x: CASE WHEN a + x <= 16 THEN a + x ELSE a END, 0) AS INT) AS kept_steps
    FROM bars"""


@query("D02", _GUARD)
def d02(corpus):
    """The guard on bars whose deltas overflow: a note's length becomes its delta."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    delta = 1 + F.col("l_quantity").cast("int") % 8
    bar = F.floor((order * 7 + line * 3) % 512 / 32)
    rows = corpus.table("lineitem").groupBy(
        F.col("l_suppkey").alias("piece_id"), line.alias("channel"), bar.alias("bar")
    ).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), F.col("l_partkey").alias("p"), delta.alias("d")))).alias("s"))
    tokens = F.transform("s", lambda x: F.concat(F.lit("TIME_DELTA="), x["d"].cast("string")))
    kept = dec.guarded(F.col("tokens"))
    return rows.withColumn("tokens", tokens).select(
        "piece_id", "channel", "bar", F.size("s").alias("n_deltas"),
        F.coalesce(F.array_max(F.transform(kept, lambda k: k["total"])), F.lit(0)).alias("kept_steps"),
    )


@query("D03", "SELECT piece_id, CAST(count(*) FILTER (kind = 'TRACK_END') AS BIGINT) AS n_tracks FROM v_words GROUP BY piece_id")
def d03(corpus):
    return dec.track_texts(texts(corpus)).groupBy("piece_id").agg(F.count("*").alias("n_tracks"))


@query("D04", "SELECT piece_id, channel, instrument FROM v_trackinst")
def d04(corpus):
    return dec.track_texts(texts(corpus)).select("piece_id", "channel", "instrument")


@query(
    "D05",
    """
    SELECT piece_id, channel, bar, count(*) FILTER (kind IN ('NOTE_ON', 'NOTE_OFF', 'TIME_DELTA')) AS n_events
    FROM v_barred WHERE kind IN ('BAR_START', 'NOTE_ON', 'NOTE_OFF', 'TIME_DELTA') GROUP BY ALL""",
)
def d05(corpus):
    inner = F.col("kind").isin("NOTE_ON", "NOTE_OFF", "TIME_DELTA")
    rows = dec.decoded_events(texts(corpus)).where(inner | (F.col("kind") == "BAR_START"))
    return rows.groupBy("piece_id", "channel", "bar").agg(F.count(F.when(inner, 1)).alias("n_events"))


@query(
    "D06",
    """
    SELECT piece_id, channel, bar, filled_u, greatest(32 - filled_u, 0) AS padding_u, filled_u > 32 AS over_long FROM (
        SELECT piece_id, channel, bar,
               CAST(2 * sum(CASE WHEN kind = 'TIME_DELTA' THEN CAST(value AS INT) ELSE 0 END) AS INT) AS filled_u
        FROM v_barred GROUP BY ALL HAVING count(*) FILTER (kind = 'BAR_END') > 0)""",
)
def d06(corpus):
    return dec.bar_lengths(texts(corpus))


@query(
    "D07",
    """
    SELECT piece_id, channel, CASE kind WHEN 'NOTE_ON' THEN 'Note-On' WHEN 'NOTE_OFF' THEN 'Note-Off' ELSE 'Time-Shift' END
           AS type, count(*) AS n FROM v_tracked WHERE kind IN ('NOTE_ON', 'NOTE_OFF', 'TIME_DELTA') GROUP BY ALL""",
)
def d07(corpus):
    return dec.sounding(dec.decoded_events(texts(corpus))).groupBy("piece_id", "channel", "type").agg(F.count("*").alias("n"))


_SHIFTED = """
    SELECT piece_id, channel, kind, pitch, CAST(t AS INT) AS t,
           CAST(t - coalesce(lag(t) OVER (PARTITION BY piece_id, channel ORDER BY pos), 0) AS INT) AS shift_u
    FROM v_decoded WHERE kind <> 'TIME_DELTA'"""


@query("D08", _SHIFTED)
def d08(corpus):
    return dec.merged_shifts(dec.decoded_events(texts(corpus))).select(
        "piece_id", "channel", "kind", F.col("value").cast("int").alias("pitch"), F.col("t").cast("int").alias("t"),
        F.col("shift_u").cast("int").alias("shift_u"),
    )


@query(
    "D09",
    """
    SELECT piece_id, channel, kind, CASE WHEN kind = 'NOTE_ON' THEN 99 END AS velocity, count(*) AS n
    FROM v_decoded WHERE kind <> 'TIME_DELTA' GROUP BY ALL""",
)
def d09(corpus):
    notes = dec.decoded_events(texts(corpus)).where(F.col("kind").isin("NOTE_ON", "NOTE_OFF"))
    return dec.with_velocity(notes).groupBy("piece_id", "channel", "kind", "velocity").agg(F.count("*").alias("n"))


@query(
    "D10",
    f"""
    SELECT piece_id, channel, CASE WHEN instrument = 'DRUMS' THEN 0 ELSE TRY_CAST(instrument AS INT) END AS program,
           instrument = 'DRUMS' AS is_drum, CASE WHEN instrument = 'DRUMS' THEN 0
               ELSE CAST(({sql_list(PROGRAMS)})[TRY_CAST(instrument AS INT) // 8 + 1] AS INT) END AS program_of_family
    FROM v_trackinst""",
)
def d10(corpus):
    """Both readings of the instrument token: a program, or a family replaced by the program drawn for it."""
    tracks = dec.track_texts(texts(corpus))
    family = F.when(F.col("instrument") == "DRUMS", F.col("instrument")).otherwise(
        F.floor(F.col("instrument").try_cast("int") / 8).cast("string")
    )
    program, is_drum = dec.instrument_columns(F.col("instrument"))
    of_family, _ = dec.instrument_columns(family, PROGRAMS)
    return tracks.select(
        "piece_id", "channel", program.alias("program"), is_drum.alias("is_drum"), of_family.alias("program_of_family")
    )


@query(
    "D11",
    f"""
    WITH e AS (SELECT piece_id, channel, bar, pos, {_TYPES} AS type, coalesce(value, '') AS value FROM v_barred
               WHERE {_TYPES} IS NOT NULL AND kind <> 'PIECE_START'),
    n AS (SELECT *, lead(type) OVER w AS next_type, lead(value) OVER w AS next_value FROM e
          WINDOW w AS (PARTITION BY piece_id, channel ORDER BY pos))
    SELECT piece_id, channel, bar, type, value, count(*) AS n FROM n
    WHERE type = next_type AND value = next_value AND type <> 'Bar-Start' GROUP BY ALL""",
)
def d11(corpus):
    rows = dec.repeated_events(dec.segments(dec.track_texts(texts(corpus))))
    return rows.groupBy("piece_id", "channel", "bar", "type", "value").agg(F.count("*").alias("n"))


_NOTES = """
    WITH p AS (SELECT piece_id, channel, pitch, kind, pos, t,
                      arg_min(t, pos) FILTER (kind = 'NOTE_OFF') OVER (PARTITION BY piece_id, channel, pitch ORDER BY pos
                          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_u
               FROM v_decoded WHERE kind <> 'TIME_DELTA')
    SELECT p.piece_id, p.channel, i.instrument, p.pitch, CAST(p.t AS INT) AS start_u, CAST(p.end_u AS INT) AS end_u,
           99 AS velocity
    FROM p LEFT JOIN v_trackinst i USING (piece_id, channel) WHERE kind = 'NOTE_ON' AND end_u IS NOT NULL"""


@query("D12", _NOTES)
def d12(corpus):
    notes = dec.decode(texts(corpus))
    return notes.withColumns({"start_u": F.col("start_u").cast("int"), "end_u": F.col("end_u").cast("int")})
