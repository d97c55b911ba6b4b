"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions.names import clean_name, file_stem
from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import joins as jn
from notewright.operators import metadata as md
from notewright.operators import vocabulary as vo
from notewright.operators.genre_model import with_split
from notewright.plans.catalog_plans import greedy_sql
from notewright.plans.registry import query
from notewright.plans.scalar_plans import clean_sql
from notewright.session import fresh_path


@query("J01", "SELECT n.md5, n.artist, n.title, g.genre FROM v_names n LEFT JOIN v_genres g USING (md5)")
def j01(corpus):
    return jn.names_with_genres(corpus.raw_names, corpus.raw_genres)


@query(
    "J02",
    """
    SELECT s.*, n.artist, n.title, g.genre FROM v_statistics s LEFT JOIN v_names n USING (md5)
    LEFT JOIN v_genres g USING (md5)""",
)
def j02(corpus):
    return jn.statistics_with_names(corpus.statistics, jn.names_with_genres(corpus.raw_names, corpus.raw_genres))


@query(
    "J03",
    """
    SELECT t.piece_id, t.track_id, g.program_name AS instrument, c.genre
    FROM v_tracks t JOIN v_gm g USING (program) JOIN v_catalog c ON c.md5 = t.piece_id""",
)
def j03(corpus):
    named = jn.with_program_names(corpus.tracks, corpus.programs)
    genres = corpus.catalog.select(F.col("md5").alias("piece_id"), "genre")
    return named.join(genres, "piece_id").select("piece_id", "track_id", F.col("program_name").alias("instrument"), "genre")


@query(
    "J04",
    """
    SELECT CAST(doc_id AS VARCHAR) AS md5, source FROM documents
    WHERE doc_id IN (SELECT md5 FROM v_catalog WHERE four_to_the_floor)""",
)
def j04(corpus):
    path = F.concat(F.lit("/midi/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mid"))
    files = corpus.table("documents").select(file_stem(path).alias("md5"), "source")
    reference = corpus.catalog.where("four_to_the_floor").select(F.col("md5").cast("string").alias("md5"))
    picked = fresh_path(corpus.spark, "picked")
    jn.pick(files, reference).write.parquet(picked)
    return corpus.spark.read.parquet(picked)


@query(
    "J05",
    """
    SELECT md5, artist FROM v_catalog
    WHERE artist IN (SELECT artist FROM v_catalog GROUP BY artist HAVING count(*) >= 5)""",
)
def j05(corpus):
    return jn.drop_small_groups(corpus.catalog, "artist", 5).select("md5", "artist")


@query("J06", f"SELECT md5, {clean_sql('title')} AS title FROM v_catalog")
def j06(corpus):
    distinct = corpus.catalog.select(F.col("title").alias("old")).distinct()
    mapping = distinct.withColumn("new", clean_name(F.col("old"))).where("old <> new")
    return jn.replace_values(corpus.catalog.select("md5", "title"), "title", mapping)


@query("J07", "SELECT piece_id, track_id, program, family_number, family_name, program_name FROM v_tracks JOIN v_gm USING (program)")
def j07(corpus):
    named = jn.with_program_names(corpus.tracks, corpus.programs)
    return named.select("piece_id", "track_id", "program", "family_number", "family_name", "program_name")


@query(
    "J08",
    greedy_sql("SELECT '' AS block, artist AS name, md5 AS position FROM v_catalog", "SELECT block, processed, leader FROM taken"),
)
def j08(corpus):
    """Similar artist names; the leader relation of the fuzzy match."""
    names = corpus.catalog.groupBy("artist").agg(F.min("md5").alias("position"))
    return md.leaders(md.name_nodes(names, "artist", "position"), threshold=75)


_LINES = """
    SELECT doc_id, string_split_regex(text, '\\s+') AS words FROM documents"""


@query(
    "J09",
    f"""
    WITH w AS (SELECT doc_id, unnest(words) AS word FROM ({_LINES})), c AS (SELECT doc_id, word FROM w WHERE word <> ''),
    v AS (SELECT DISTINCT word FROM c WHERE md5('42:' || doc_id) < '1999999a')
    SELECT word, count(*) AS n, word IN (SELECT word FROM v) AS known FROM c GROUP BY word""",
)
def j09(corpus):
    """Words of the corpus inside and outside the vocabulary of a tenth of its texts."""
    part = vo.build(with_split(corpus.documents, "doc_id").where("is_test")).select("word", F.lit(True).alias("hit"))
    return vo.word_counts(corpus.documents).join(part, "word", "left").select("word", "n", F.coalesce("hit", F.lit(False)).alias("known"))


@query(
    "J10",
    """
    WITH a AS (SELECT piece_id, channel, string_agg(word, ' ' ORDER BY pos) AS text FROM v_tracked
               WHERE kind <> 'PIECE_START' GROUP BY ALL),
    l AS (SELECT piece_id, channel, string_split(text, ' ') AS x FROM a),
    r AS (SELECT piece_id, channel - 1 AS channel, string_split(text, ' ') AS y FROM a WHERE channel > 0),
    z AS (SELECT piece_id, channel, list_zip(coalesce(x, []), coalesce(y, [])) AS z FROM l LEFT JOIN r USING (piece_id, channel))
    SELECT piece_id, channel, CAST(unnest(range(len(z))) AS INT) AS pos,
           unnest(list_transform(z, lambda p: p[1])) AS left_word, unnest(list_transform(z, lambda p: p[2])) AS right_word
    FROM z""",
)
def j10(corpus):
    """Each track of a piece beside the next one, word by word."""
    tracks = dec.track_texts(enc.encode(corpus.notes, corpus.tracks))
    text = F.trim(F.regexp_replace("text", " PIECE_START", ""))
    left = tracks.select(F.struct("piece_id", "channel").alias("key"), text.alias("text"))
    following = tracks.where("channel > 0").select(
        F.struct("piece_id", (F.col("channel") - 1).alias("channel")).alias("key"), text.alias("text")
    )
    return jn.positional(left, following, "key").select("key.*", "pos", "left_word", "right_word")
