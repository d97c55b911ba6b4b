"""Distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import instruments as inst
from notewright.operators import encode as enc
from notewright.operators import joins as jn
from notewright.operators import piece_stats as ps
from notewright.operators import reports as rp
from notewright.operators import windows as wn
from notewright.plans.genre_plans import LABELLED, first_program_label
from notewright.plans.registry import query
from notewright.plans.statistics_plans import statistics_report
from notewright.plans.scalar_plans import _TO_FAMILY
from notewright.plans.window_plans import _FAMILY_COUNTS, family_counts, top_families


@query("R01", "SELECT genre, count(*) AS n FROM v_catalog GROUP BY genre ORDER BY n DESC, genre")
def r01(corpus):
    return rp.counts(corpus.catalog, "genre").orderBy(F.desc("n"), "genre")


_KEPT = "(SELECT * FROM v_catalog WHERE genre IN (SELECT genre FROM v_catalog GROUP BY genre HAVING count(*) >= 30))"


def _kept(corpus, least: int = 30):
    """Songs of genres with at least ``least`` songs."""
    return jn.drop_small_groups(corpus.catalog, "genre", least)


@query("R02", f"SELECT genre, count(*) AS n FROM {_KEPT} GROUP BY genre")
def r02(corpus):
    return rp.counts(_kept(corpus), "genre")


def _histogram_sql(value, bins, source):
    return f"""
    WITH b AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT CAST({value} AS DOUBLE) AS x FROM {source}))
    SELECT CAST(least({bins - 1}, floor(coalesce(({value} - lo) / nullif(hi - lo, 0), 0) * {bins})) AS INT) AS bin,
           count(*) AS n FROM {source}, b GROUP BY 1"""


@query(
    "R03",
    "SELECT 'velocity' AS value, * FROM (" + _histogram_sql("velocity", 100, "v_notes") + ") UNION ALL "
    "SELECT 'n_instruments', * FROM (" + _histogram_sql("n_instruments", 50, "v_catalog") + ") UNION ALL "
    "SELECT 'density', * FROM (" + _histogram_sql("number_of_notes_per_second", 100, "v_catalog") + ")",
)
def r03(corpus):
    def named(df, name):
        return df.withColumn("value", F.lit(name))

    return (
        named(rp.histogram(corpus.notes, "velocity", 100), "velocity")
        .unionByName(named(rp.histogram(corpus.catalog, "n_instruments", 50), "n_instruments"))
        .unionByName(named(rp.histogram(corpus.catalog, "number_of_notes_per_second", 100), "density"))
    )


@query(
    "R04",
    f"""
    WITH q AS (SELECT genre, quantile_cont(CAST(n_instruments AS DOUBLE), 0.25) AS q1,
                      quantile_cont(CAST(n_instruments AS DOUBLE), 0.5) AS q2,
                      quantile_cont(CAST(n_instruments AS DOUBLE), 0.75) AS q3 FROM v_catalog GROUP BY genre),
    w AS (SELECT k.genre, min(CAST(n_instruments AS DOUBLE)) AS low_whisker, max(CAST(n_instruments AS DOUBLE)) AS high_whisker
          FROM v_catalog k JOIN q USING (genre)
          WHERE n_instruments BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY k.genre)
    SELECT genre, q1, q2, q3, low_whisker, high_whisker FROM q JOIN w USING (genre)""",
)
def r04(corpus):
    return rp.box_plot(corpus.catalog, "genre", "n_instruments")


_MEDIAN_OF = ["n_instruments", "n_unique_notes", "average_note_duration", "range_of_note_pitches", "number_of_notes_per_second"]


@query(
    "R05",
    f"WITH w AS MATERIALIZED ({LABELLED}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS statistic, genre, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM w GROUP BY genre" for c in _MEDIAN_OF),
)
def r05(corpus):
    rows = statistics_report(corpus).join(first_program_label(corpus), "md5")
    return rp.medians_of(rows, "genre", _MEDIAN_OF).withColumn("median", F.round("median", 6))


@query("R06", f"WITH {_FAMILY_COUNTS} SELECT genre, family_name, n FROM f")
def r06(corpus):
    return family_counts(corpus)


@query(
    "R07",
    f"""
    WITH {_FAMILY_COUNTS}
    SELECT genre, family_name, n, CAST(rank AS INT) AS rank,
           CAST(floor(n * 100 / sum(n) OVER (PARTITION BY genre)) AS BIGINT) AS percentage FROM top""",
)
def r07(corpus):
    return wn.share_in_group(top_families(corpus), "genre", "n", whole_numbers=True)


@query(
    "R08",
    """
    WITH i AS (SELECT c.genre, g.program_name AS instrument, count(*) AS n FROM v_tracks t JOIN v_gm g USING (program)
               JOIN v_catalog c ON c.md5 = t.piece_id GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, instrument) AS rank FROM i QUALIFY rank <= 5)
    SELECT genre, instrument, n, CAST(rank AS INT) AS rank,
           round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY genre), 6) AS percentage FROM top""",
)
def r08(corpus):
    genres = corpus.catalog.select(F.col("md5").alias("piece_id"), "genre")
    named = jn.with_program_names(corpus.tracks, corpus.programs).join(genres, "piece_id")
    counted = rp.counts(named.withColumnRenamed("program_name", "instrument"), "genre", "instrument")
    top = wn.top_per_group(counted, "genre", "n", "instrument", 5)
    return wn.share_in_group(top, "genre", "n", whole_numbers=False).withColumn("percentage", F.round("percentage", 6))


@query("R09", "SELECT ts, count(*) AS n FROM v_time GROUP BY ts ORDER BY n DESC, ts LIMIT 20")
def r09(corpus):
    text = ps.time_signature_text(F.col("numerator"), F.col("denominator"))
    return wn.top_k(rp.counts(corpus.time_signatures.withColumn("ts", text), "ts"), "n", "ts", 20)


@query(
    "R10",
    " UNION ALL ".join(
        f"SELECT '{c}' AS statistic, round(max(n) / sum(n), 6) AS share FROM "
        f"(SELECT {c}, count(*) AS n FROM v_catalog WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in ("main_time_signature", "n_time_signature_changes")
    ),
)
def r10(corpus):
    def part(column):
        share = rp.share_of_most_common(corpus.catalog, column)
        return share.select(F.lit(column).alias("statistic"), F.round("share", 6).alias("share"))

    return part("main_time_signature").unionByName(part("n_time_signature_changes"))


@query(
    "R11",
    """
    WITH c AS (SELECT genre, lyrics_bool, count(*) AS n FROM v_catalog GROUP BY ALL)
    SELECT genre, lyrics_bool, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY genre), 6) AS percentage FROM c""",
)
def r11(corpus):
    shares = wn.share_in_group(rp.counts(corpus.catalog, "genre", "lyrics_bool"), "genre", "n", whole_numbers=False)
    return shares.withColumn("percentage", F.round("percentage", 6))


def _listed(corpus, column):
    return ps.note_statistics(corpus.timed_notes, corpus.tracks).select("piece_id", F.col(column).alias("names"))


@query(
    "R12",
    """
    SELECT 'instrument' AS kind, program_name AS name, count(*) AS n
    FROM (SELECT DISTINCT piece_id, program_name FROM v_tracks JOIN v_gm USING (program)) GROUP BY ALL
    UNION ALL SELECT 'family', family_name, count(*)
    FROM (SELECT DISTINCT piece_id, family_name FROM v_tracks JOIN v_gm USING (program)) GROUP BY ALL""",
)
def r12(corpus):
    def part(column, kind):
        exploded = _listed(corpus, column).select(F.lit(kind).alias("kind"), F.explode("names").alias("name"))
        return rp.counts(exploded, "kind", "name")

    return part("instrument_names", "instrument").unionByName(part("instrument_families", "family"))


def _combination_sql(column, kind):
    return f"""
    (SELECT '{kind}' AS kind, combination, count(*) AS n FROM (
        SELECT piece_id, string_agg(name, ', ' ORDER BY name) AS combination FROM
            (SELECT DISTINCT piece_id, {column} AS name FROM v_tracks JOIN v_gm USING (program)) GROUP BY piece_id)
    GROUP BY combination ORDER BY n DESC, combination LIMIT 20)"""


@query("R13", _combination_sql("program_name", "instrument") + " UNION ALL " + _combination_sql("family_name", "family"))
def r13(corpus):
    def part(column, kind):
        combined = _listed(corpus, column).select(F.array_join(F.array_sort("names"), ", ").alias("combination"))
        top = wn.top_k(rp.counts(combined, "combination"), "n", "combination", 20)
        return top.select(F.lit(kind).alias("kind"), "combination", "n")

    return part("instrument_names", "instrument").unionByName(part("instrument_families", "family"))


def _token_sql(text, source):
    return f"""
    WITH l AS (SELECT list_filter(string_split_regex({text}, '\\s+'), lambda w: starts_with(w, 'INST')) AS tokens FROM {source})
    SELECT 'token' AS kind, token AS value, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM l) GROUP BY ALL
    UNION ALL SELECT 'combination', array_to_string(list_sort(tokens), ' '), count(*) FROM l GROUP BY ALL"""


def _token_report(texts):
    tokens = rp.token_counts(texts).select(F.lit("token").alias("kind"), F.col("token").alias("value"), "n")
    lines = rp.token_combinations(texts).select(F.lit("combination").alias("kind"), F.col("combination").alias("value"), "n")
    return tokens.unionByName(lines)


def _texts(corpus):
    return enc.encode(corpus.notes, corpus.tracks)


@query("R14", _token_sql("text", "v_text"))
def r14(corpus):
    return _token_report(_texts(corpus))


@query("R15", _token_sql("families", f"(SELECT {_TO_FAMILY} AS families FROM v_text)"))
def r15(corpus):
    return _token_report(_texts(corpus).select("piece_id", inst.text_to_families(F.col("text")).alias("text")))


@query("R16", "SELECT value AS instrument, count(*) AS n FROM v_words WHERE kind = 'INST' GROUP BY value ORDER BY n, value")
def r16(corpus):
    return rp.token_occurrence(_texts(corpus))


@query("R17", "SELECT artist, title, count(*) AS n FROM v_catalog GROUP BY ALL ORDER BY n DESC, artist, title")
def r17(corpus):
    return rp.versions(corpus.catalog)


@query(
    "R18",
    """
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'train' ELSE 'valid' END AS kind,
           event_id / 1024.0::DOUBLE AS epoch, CAST(event_id AS DOUBLE) AS step, value AS loss,
           CASE WHEN event_type IN ('click', 'view') THEN round(value / 1000, 9) END AS learning_rate FROM events""",
)
def r18(corpus):
    train, evaluation = rp.training_history(corpus.training_log)
    rate = F.round("learning_rate", 9)
    return train.select(F.lit("train").alias("kind"), "epoch", "step", "loss", rate.alias("learning_rate")).unionByName(
        evaluation.select(F.lit("valid").alias("kind"), "epoch", "step", "loss", F.lit(None).cast("double").alias("learning_rate"))
    )
