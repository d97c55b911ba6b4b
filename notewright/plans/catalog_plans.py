"""Cleaning, fuzzy deduplication and filtering of the catalogue.

The SQL side states the similarity ratio with list functions and finds the leaders one after the other, by recursion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions.names import clean_name
from notewright.functions.similarity import sorted_ratio, sorted_words, version_word_ratio
from notewright.operators import joins as jn
from notewright.operators import metadata as md
from notewright.plans.registry import query
from notewright.plans.scalar_plans import clean_sql


def _joined(corpus):
    return jn.statistics_with_names(corpus.statistics, jn.names_with_genres(corpus.raw_names, corpus.raw_genres))


def words_sql(c):
    """SQL for the lower-cased letters and digits of a name, words in sorted order."""
    return f"array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), ' ')"


def ratio_sql(a, b):
    """SQL for the ratio of two strings of up to 120 letters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    bits = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << i ELSE 0 END))::HUGEINT"
    masks = f"list_transform(string_split({b}, ''), lambda c: {bits})"
    row = f"list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full})"
    common = f"(length({a}) - bit_count({row}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE round_even(200.0 * {common} / (length({a}) + length({b})), 0)::INTEGER END"


VERSION_SQL = f"""
    SELECT name, max({ratio_sql("win", "short")}) AS ratio FROM (
        SELECT name, CASE WHEN length(name) <= length(word) THEN name ELSE word END AS short,
            unnest(list_transform(range(1, greatest(length(name), length(word)) + 1),
                lambda i: substr(CASE WHEN length(name) <= length(word) THEN word ELSE name END, i, least(length(name), length(word))))) AS win
        FROM (SELECT DISTINCT cleaned AS name FROM shown) CROSS JOIN (SELECT unnest(['karaoke', 'reprise', 'solo', 'acoustic']) AS word))
    GROUP BY name"""


def greedy_sql(names, last):
    """SQL for the leaders of the rows (block, name, position) of ``names``, followed by the statement ``last`` on ``renamed``."""
    return f"""
    WITH RECURSIVE given AS ({names}),
    shown AS (SELECT *, {clean_sql("name")} AS cleaned FROM (SELECT block, name, min(position) AS position FROM given WHERE name IS NOT NULL GROUP BY ALL)),
    versions AS MATERIALIZED ({VERSION_SQL}),
    nodes AS MATERIALIZED (SELECT shown.*, {words_sql("cleaned")} AS processed, versions.ratio > 75 AS blocked FROM shown JOIN versions ON versions.name = cleaned),
    groups AS MATERIALIZED (
        SELECT block, processed, min(position) FILTER (NOT blocked) AS position, arg_min(cleaned, position) FILTER (NOT blocked) AS cleaned
        FROM nodes WHERE processed <> '' GROUP BY ALL),
    lined AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY position, processed) AS i FROM groups WHERE position IS NOT NULL),
    matched AS MATERIALIZED (
        SELECT a.block, a.processed, b.i, b.cleaned FROM groups a JOIN lined b ON a.block = b.block WHERE {ratio_sql("a.processed", "b.processed")} > 75),
    met AS MATERIALIZED (SELECT l.block, l.i, list(m.i) FILTER (m.i < l.i) AS earlier FROM lined l JOIN matched m USING (block, processed) GROUP BY ALL),
    walk AS (
        SELECT block, 0::BIGINT AS i, []::BIGINT[] AS chosen FROM (SELECT DISTINCT block FROM lined)
        UNION ALL
        SELECT walk.block, met.i, CASE WHEN list_has_any(walk.chosen, coalesce(met.earlier, [])) THEN walk.chosen ELSE list_append(walk.chosen, met.i) END
        FROM walk JOIN met ON met.block = walk.block AND met.i = walk.i + 1),
    leaders AS (SELECT block, unnest(arg_max(chosen, i)) AS i FROM walk GROUP BY block),
    taken AS MATERIALIZED (SELECT m.block, m.processed, arg_min(m.cleaned, m.i) AS leader FROM matched m JOIN leaders USING (block, i) GROUP BY ALL),
    renamed AS (SELECT nodes.block, nodes.name, coalesce(taken.leader, nodes.cleaned) AS new_name FROM nodes LEFT JOIN taken USING (block, processed))
    {last}"""


_RAW, _CLEAN = words_sql("title"), words_sql(clean_sql("title"))


@query(
    "M01",
    f"""
    WITH t AS (SELECT md5, {_RAW} AS raw, {_CLEAN} AS made FROM v_catalog), r AS (SELECT md5, {ratio_sql("raw", "made")} AS ratio FROM t)
    SELECT md5, ratio, ratio > 75 AS match FROM r""",
)
def m01(corpus):
    """Ratio of each title with the cleaned form it would take."""
    raw, cleaned = sorted_words(F.col("title")), sorted_words(clean_name(F.col("title")))
    return corpus.catalog.select("md5", sorted_ratio(raw, cleaned).alias("ratio")).withColumn("match", F.col("ratio") > 75)


@query(
    "M02",
    f"""
    WITH shown AS (SELECT DISTINCT {clean_sql("title")} AS cleaned FROM v_catalog), r AS ({VERSION_SQL})
    SELECT name AS title, ratio, ratio > 75 AS blocked FROM r""",
)
def m02(corpus):
    titles = corpus.catalog.select(clean_name(F.col("title")).alias("title")).distinct()
    return titles.withColumn("ratio", version_word_ratio(F.col("title"))).withColumn("blocked", F.col("ratio") > 75)


@query("M03", greedy_sql("SELECT '' AS block, title AS name, md5 AS position FROM v_catalog", "SELECT block, name, new_name FROM renamed"))
def m03(corpus):
    """Leader of every distinct title of the catalogue."""
    return md.deduplicated(md.name_nodes(corpus.catalog, "title", "md5"))


_JOINED = "SELECT s.*, n.artist, n.title, g.genre FROM v_statistics s LEFT JOIN v_names n USING (md5) LEFT JOIN v_genres g USING (md5)"


@query(
    "M04",
    greedy_sql(
        f"SELECT '' AS block, artist AS name, md5 AS position FROM ({_JOINED})",
        f"""
        SELECT j.md5, j.artist AS artist_old, r.new_name AS artist, j.title AS title_old, j.genre
        FROM ({_JOINED}) j LEFT JOIN renamed r ON r.name = j.artist""",
    ),
)
def m04(corpus):
    return md.deduplicate_artists(_joined(corpus)).select("md5", "artist_old", "artist", "title_old", "genre")


@query(
    "M05",
    """
    WITH j AS (SELECT s.md5, n.artist, n.title, g.genre FROM v_statistics s LEFT JOIN v_names n USING (md5)
               LEFT JOIN v_genres g USING (md5)),
    c AS (SELECT artist, genre, row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, genre) AS rn
          FROM j GROUP BY artist, genre)
    SELECT DISTINCT j.md5, j.artist, j.title, c.genre FROM j LEFT JOIN c ON c.artist = j.artist AND c.rn = 1""",
)
def m05(corpus):
    return md.deduplicate_genre(_joined(corpus)).select("md5", "artist", "title", "genre")


@query(
    "M06",
    greedy_sql(
        f"SELECT artist AS block, title AS name, md5 AS position FROM ({_JOINED}) WHERE artist IS NOT NULL",
        f"""
        SELECT j.md5, j.artist AS artist_old, j.title AS title_old, r.new_name AS title, j.genre
        FROM ({_JOINED}) j LEFT JOIN renamed r ON r.block = j.artist AND r.name = j.title""",
    ),
)
def m06(corpus):
    renamed = _joined(corpus).withColumnsRenamed({"artist": "artist_old", "title": "title_old"})
    return md.deduplicate_titles(renamed).select("md5", "artist_old", "title_old", "title", "genre")


_ARTISTS = greedy_sql(f"SELECT '' AS block, artist AS name, md5 AS position FROM ({_JOINED})", "SELECT name, new_name FROM renamed")
_TITLES = greedy_sql(
    f"SELECT artist AS block, title AS name, md5 AS position FROM ({_JOINED}) WHERE artist IS NOT NULL", "SELECT block, name, new_name FROM renamed"
)


@query(
    "M07",
    f"""
    WITH a AS MATERIALIZED ({_ARTISTS}), t AS MATERIALIZED ({_TITLES}),
    j AS (SELECT j.* EXCLUDE (artist, title, genre), j.artist AS artist_old, j.title AS title_old, a.new_name AS artist, j.genre
          FROM ({_JOINED}) j LEFT JOIN a ON a.name = j.artist),
    c AS (SELECT artist, genre, row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, genre) AS rn FROM j GROUP BY artist, genre)
    SELECT DISTINCT j.* EXCLUDE (artist_old, title_old, genre), c.genre, t.new_name AS title
    FROM j LEFT JOIN c ON c.artist = j.artist AND c.rn = 1 LEFT JOIN t ON t.block = j.artist_old AND t.name = j.title_old""",
)
def m07(corpus):
    return md.extract(corpus.statistics, corpus.raw_names, corpus.raw_genres)


@query(
    "M08",
    """
    SELECT md5, artist, title, n_instruments, number_of_notes_per_second FROM v_catalog
    WHERE n_instruments <= 12 AND four_to_the_floor
    QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY number_of_notes_per_second DESC, md5) = 1""",
)
def m08(corpus):
    return md.filter_pieces(corpus.catalog).select(
        "md5", "artist", "title", "n_instruments", "number_of_notes_per_second"
    )
