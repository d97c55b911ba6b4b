"""Windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import tokens as tk
from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import reports as rp
from notewright.operators import sequences as sq
from notewright.operators import windows as wn
from notewright.plans.registry import query

_MODE = """
    WITH c AS (SELECT artist, genre, count(*) AS n FROM v_catalog WHERE artist IS NOT NULL GROUP BY ALL),
    m AS (SELECT artist, genre, row_number() OVER (PARTITION BY artist ORDER BY n DESC, genre) AS rn FROM c)
    SELECT md5, c.artist, c.genre, m.genre AS main_genre FROM v_catalog c LEFT JOIN m ON m.artist = c.artist AND rn = 1"""


@query("W01", _MODE)
def w01(corpus):
    rows = corpus.catalog.select("md5", "artist", "genre")
    return wn.with_group_mode(rows, "artist", "genre", "main_genre")


@query(
    "W02",
    """
    SELECT artist, title, md5, number_of_notes_per_second FROM v_catalog
    QUALIFY row_number() OVER (PARTITION BY artist, title ORDER BY number_of_notes_per_second DESC, md5) = 1""",
)
def w02(corpus):
    rows = corpus.catalog.select("artist", "title", "md5", "number_of_notes_per_second")
    return wn.best_row(rows, ["artist", "title"], [*wn.descending("number_of_notes_per_second"), F.col("md5")])


_FAMILY_COUNTS = """
    f AS (SELECT c.genre, g.family_name, count(*) AS n FROM v_tracks t JOIN v_gm g USING (program)
          JOIN v_catalog c ON c.md5 = t.piece_id GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, family_name) AS rank FROM f QUALIFY rank <= 5)"""


def family_counts(corpus):
    from notewright.operators.joins import with_program_names

    genres = corpus.catalog.select(F.col("md5").alias("piece_id"), "genre")
    named = with_program_names(corpus.tracks, corpus.programs).join(genres, "piece_id")
    return rp.counts(named, "genre", "family_name")


def top_families(corpus):
    return wn.top_per_group(family_counts(corpus), "genre", "n", "family_name", 5)


@query("W03", f"WITH {_FAMILY_COUNTS} SELECT genre, family_name, n, CAST(rank AS INT) AS rank FROM top")
def w03(corpus):
    return top_families(corpus)


@query(
    "W04",
    f"""
    WITH {_FAMILY_COUNTS}
    SELECT genre, family_name, n, CAST(floor(n * 100 / sum(n) OVER (PARTITION BY genre)) AS BIGINT) AS percentage FROM top""",
)
def w04(corpus):
    return wn.share_in_group(top_families(corpus).drop("rank"), "genre", "n", whole_numbers=True)


@query(
    "W05",
    f"""
    WITH {_FAMILY_COUNTS}
    SELECT genre, family_name, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY genre), 6) AS percentage FROM top""",
)
def w05(corpus):
    rows = wn.share_in_group(top_families(corpus).drop("rank"), "genre", "n", whole_numbers=False)
    return rows.withColumn("percentage", F.round("percentage", 6))


def _texts(corpus):
    return enc.encode(corpus.notes, corpus.tracks)


@query(
    "W06",
    """
    SELECT piece_id, count(*) FILTER (kind = 'TIME_DELTA') AS n_shifts,
           count(*) FILTER (kind = 'TIME_DELTA' AND next_kind = 'BAR_END') AS n_before_bar_end
    FROM (SELECT piece_id, kind, lead(kind) OVER (PARTITION BY piece_id ORDER BY pos) AS next_kind FROM v_words)
    GROUP BY piece_id""",
)
def w06(corpus):
    """Next-token test on the text: how many shifts stand right before a bar end (the encoder leaves none)."""
    rows = sq.neighbours(_texts(corpus), "piece_id")
    shift = F.col("word").startswith("TIME_DELTA=")
    return rows.groupBy("piece_id").agg(
        F.count_if(shift).alias("n_shifts"), F.count_if(shift & (F.col("next_word") == "BAR_END")).alias("n_before_bar_end")
    )


@query(
    "W07",
    """
    SELECT piece_id, CAST(pos AS INT) AS pos, word
    FROM (SELECT *, lead(word) OVER (PARTITION BY piece_id ORDER BY pos) AS next_word FROM v_words) WHERE word = next_word""",
)
def w07(corpus):
    return sq.neighbours(_texts(corpus), "piece_id").where("word = next_word").select("piece_id", "pos", "word")


@query(
    "W08",
    """
    SELECT piece_id, channel, bar, count(*) AS n_tokens FROM v_barred WHERE kind IN ('NOTE_ON', 'NOTE_OFF') GROUP BY ALL""",
)
def w08(corpus):
    rows = dec.decoded_events(_texts(corpus)).where(F.col("kind").isin("NOTE_ON", "NOTE_OFF"))
    return rows.groupBy("piece_id", "channel", "bar").agg(F.count("*").alias("n_tokens"))


@query(
    "W09",
    """
    SELECT artist, count(*) AS n, round(median(n_instruments), 6) AS median FROM v_catalog GROUP BY artist ORDER BY n DESC, artist""",
)
def w09(corpus):
    sizes = rp.counts(corpus.catalog, "artist")
    middle = rp.medians(corpus.catalog, "artist", "n_instruments")
    return sizes.join(middle, "artist").withColumn("median", F.round("median", 6)).orderBy(F.desc("n"), "artist")


_WORDS = "(SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)"


@query("W10", f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20")
def w10(corpus):
    words = corpus.documents.select(F.explode(F.array_remove(F.split("text", r"\s+"), "")).alias("word"))
    return wn.top_k(rp.counts(words, "word"), "n", "word", 20)


@query(
    "W11",
    """
    SELECT doc_id, CAST(rn AS INT) AS row FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
    WHERE rn < 100 AND rn % 20 = 0""",
)
def w11(corpus):
    return wn.strided_head(corpus.documents.select("doc_id"), "doc_id", 100, 20)


@query(
    "W12",
    """
    SELECT md5, genre FROM v_genres QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY genre) = 1""",
)
def w12(corpus):
    rows = corpus.raw_genres.select("md5", F.explode(F.get("genre", 0)).alias("genre"))
    return wn.best_row(rows, ["md5"], [F.col("genre")])


@query("W13", "SELECT artist, min(md5) AS first_row FROM v_catalog GROUP BY artist")
def w13(corpus):
    return wn.distinct_values(corpus.catalog, "artist", "md5")


@query(
    "W14",
    """
    SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS id, length(text) AS size FROM documents
    UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), length(html) FROM pages
    UNION ALL SELECT 'turns', conv_id || '-' || turn, length(text) FROM conversations""",
)
def w14(corpus):
    documents = corpus.documents.select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), F.length("text").cast("long").alias("size")
    )
    pages = corpus.table("pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").cast("string").alias("id"), F.length("html").cast("long").alias("size")
    )
    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = corpus.table("conversations").select(
        F.lit("turns").alias("origin"), turn.alias("id"), F.length("text").cast("long").alias("size")
    )
    return documents.unionByName(pages).unionByName(turns)


@query("W15", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def w15(corpus):
    return wn.random_rows(corpus.documents.select("doc_id"), "doc_id", 50)
