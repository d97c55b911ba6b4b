"""Bar and track tables, sequence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import sequences as sq
from notewright.operators import vocabulary as vo
from notewright.operators.genre_model import with_split
from notewright.plans.registry import query

KEYS = ["piece_id", "track_id", "section"]
_KEYS = "piece_id, track_id, CAST(section AS BIGINT) AS section"
_STRIP = "regexp_replace(text, 'TRACK_END\\s*$', '')"
_BARS = f"""
    b AS (SELECT piece_id, track_id, section, text, list_transform(list_filter(string_split({_STRIP}, 'BAR_START '),
              lambda p: p <> ''), lambda p: CASE WHEN contains(p, 'TRACK_START') THEN p ELSE 'BAR_START ' || p END) AS bars
          FROM v_sections)"""
_PIECES = """
    s AS (SELECT piece_id, section, 'PIECE_START ' || string_agg(text, '' ORDER BY track_id) AS text
          FROM v_sections GROUP BY piece_id, section)"""


def _sections(corpus):
    return enc.section_text(corpus.notes, corpus.tracks).select(*KEYS, "text")


def _section_pieces(corpus):
    """One piece text per section, as a generator would hold it."""
    text = F.concat(F.lit("PIECE_START "), F.col("text"))
    return enc.text_by_section(_sections(corpus)).select("piece_id", "section", text.alias("text"))


def _with_bars(corpus):
    return _sections(corpus).withColumn("bars", sq.bars_of_track(F.col("text")))


@query("B01", f"WITH {_BARS} SELECT {_KEYS}, CAST(unnest(range(len(bars))) AS INT) AS item, unnest(bars) AS bar FROM b")
def b01(corpus):
    return _with_bars(corpus).select(*KEYS, F.posexplode("bars").alias("item", "bar"))


@query(
    "B02",
    f"""
    WITH {_PIECES}, t AS (SELECT piece_id, section, list_transform(string_split(text, 'TRACK_START ')[2:], lambda p:
        'TRACK_START ' || regexp_replace(p, 'TRACK_END\\s*$', '') || 'TRACK_END ') AS tracks FROM s)
    SELECT piece_id, CAST(section AS BIGINT) AS section, CAST(len(tracks) AS INT) AS n_tracks, tracks[-1] AS last_track FROM t""",
)
def b02(corpus):
    return _section_pieces(corpus).select(
        "piece_id", "section", F.size(sq.tracks_of_piece(F.col("text"))).alias("n_tracks"), sq.last_track(F.col("text")).alias("last_track")
    )


@query("B03", f"SELECT {_KEYS}, {_STRIP} AS text FROM v_sections")
def b03(corpus):
    return _sections(corpus).withColumn("text", sq.strip_track_end(F.col("text")))


@query(
    "B04",
    f"""
    WITH {_BARS}, t AS (SELECT piece_id, track_id, section, array_to_string(bars, '') || 'TRACK_END ' AS text FROM b)
    SELECT piece_id, CAST(section AS BIGINT) AS section, 'PIECE_START ' || string_agg(text, '' ORDER BY track_id) AS text
    FROM t GROUP BY ALL""",
)
def b04(corpus):
    tracks = _with_bars(corpus).select(*KEYS, sq.track_text(F.col("bars")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("track_id", "text")))
    per_section = tracks.groupBy("piece_id", "section").agg(F.transform(ordered, lambda x: x["text"]).alias("tracks"))
    return per_section.select("piece_id", "section", sq.piece_text(F.col("tracks")).alias("text"))


@query("B05", f"WITH {_BARS} SELECT {_KEYS}, text[length(bars[1]) + 1:] AS new_text FROM b")
def b05(corpus):
    return _with_bars(corpus).select(*KEYS, sq.new_text(F.get("bars", 0), F.col("text")).alias("new_text"))


@query(
    "B06",
    f"""
    SELECT {_KEYS}, 'BAR_START ' || regexp_replace(string_split(text, 'BAR_START ')[-1], 'TRACK_END\\s*$', '') AS last_bar
    FROM v_sections""",
)
def b06(corpus):
    return _sections(corpus).select(*KEYS, sq.last_bar(F.col("text")).alias("last_bar"))


_COUNT = "CAST(len(list_filter(string_split(text, ' '), lambda w: w = 'BAR_END')) AS INT)"


@query("B07", f"SELECT {_KEYS}, {_COUNT} AS n_bars, {_COUNT} = 8 AS matches FROM v_sections")
def b07(corpus):
    n = sq.bar_count(F.col("text"))
    return _sections(corpus).select(*KEYS, n.alias("n_bars"), (n == 8).alias("matches"))


@query(
    "B08",
    f"""
    WITH {_BARS}, g AS (SELECT *, bars[1] AS prompt, text[length(bars[1]) + 1:] AS rest, {_COUNT} AS n FROM b)
    SELECT {_KEYS}, CASE WHEN n > 4 THEN prompt || array_to_string(list_transform(string_split(rest, 'BAR_END ')[1:4],
        lambda p: p || 'BAR_END '), '') || 'TRACK_END ' ELSE text END AS text, n >= 4 AS ok FROM g""",
)
def b08(corpus):
    header = F.get("bars", 0)
    forced = sq.forced_length(header, sq.new_text(header, F.col("text")), 4)
    return _with_bars(corpus).select(*KEYS, forced.alias("forced")).select(*KEYS, "forced.text", "forced.ok")


@query(
    "B09",
    f"""
    WITH {_PIECES}, t AS (SELECT piece_id, section, text, len(string_split(text, ' ')) AS n,
        list_transform(string_split(text, 'TRACK_START ')[2:], lambda p:
        'TRACK_START ' || regexp_replace(p, 'TRACK_END\\s*$', '') || 'TRACK_END ') AS tracks FROM s),
    h AS (SELECT piece_id, section, i, md5('42:' || piece_id || '-' || section || ':' || i) AS h
          FROM t, unnest(range(len(tracks))) AS r(i)),
    d AS (SELECT piece_id, section, arg_min(i, h) AS dropped FROM h GROUP BY ALL)
    SELECT t.piece_id, CAST(t.section AS BIGINT) AS section, CASE WHEN n < 1500 THEN text ELSE 'PIECE_START ' ||
        array_to_string(tracks[1:dropped] || tracks[dropped + 2:], '') END AS text
    FROM t JOIN d ON d.piece_id = t.piece_id AND d.section = t.section""",
)
def b09(corpus):
    key = F.concat_ws("-", F.col("piece_id").cast("string"), F.col("section").cast("string"))
    return _section_pieces(corpus).select("piece_id", "section", sq.within_budget(F.col("text"), key).alias("text"))


_VOCABULARY = """
    v AS (SELECT DISTINCT word FROM v_words WHERE word <> '' AND md5('42:' || piece_id) < '1999999a')"""


def _part_vocabulary(texts):
    """Of a tenth of the pieces, so that rare tokens are unknown."""
    return vo.build(with_split(texts, "piece_id").where("is_test"))


@query(
    "B10",
    f"""
    WITH {_VOCABULARY}, l AS (SELECT piece_id, string_split(text, ' ') AS words FROM v_text)
    SELECT w.piece_id, CAST(w.pos AS INT) AS pos, w.word,
           array_to_string(l.words[greatest(w.pos - 5, 0) + 1 : w.pos + 5], ' ') AS context
    FROM v_words w JOIN l USING (piece_id) WHERE w.word <> '' AND w.word NOT IN (SELECT word FROM v)""",
)
def b10(corpus):
    texts = enc.encode(corpus.notes, corpus.tracks)
    return sq.unknown_words(texts, "piece_id", _part_vocabulary(texts))


@query(
    "B11",
    f"""
    WITH {_VOCABULARY}, k AS (SELECT word[6:] AS instrument FROM v WHERE starts_with(word, 'INST='))
    SELECT DISTINCT CAST(p_size AS VARCHAR) AS instrument,
           (SELECT coalesce(string_agg(instrument, ', ' ORDER BY instrument), '') FROM k) AS available
    FROM part WHERE CAST(p_size AS VARCHAR) NOT IN (SELECT instrument FROM k)""",
)
def b11(corpus):
    """Requested instruments (part sizes stand in for requests) that the vocabulary of a tenth of the pieces lacks."""
    texts = enc.encode(corpus.notes, corpus.tracks)
    requests = corpus.table("part").select(F.col("p_size").cast("string").alias("instrument"))
    return sq.missing_instruments(requests, "instrument", _part_vocabulary(texts))


@query(
    "B12",
    """
    WITH l AS (SELECT piece_id, string_split(text, ' ') AS words FROM v_text),
    n AS (SELECT *, lead(word) OVER (PARTITION BY piece_id ORDER BY pos) AS next_word FROM v_words)
    SELECT n.piece_id, CAST(n.pos AS INT) AS pos, n.word,
           array_to_string(l.words[greatest(n.pos - 3, 0) + 1 : n.pos + 3], ' ') AS context
    FROM n JOIN l USING (piece_id) WHERE word = next_word""",
)
def b12(corpus):
    return sq.repeated_words(enc.encode(corpus.notes, corpus.tracks), "piece_id")


@query(
    "B13",
    """
    WITH l AS (SELECT piece_id, section, track_id, string_split(text, ' ') AS x FROM v_sections),
    r AS (SELECT piece_id, section, track_id - 1 AS track_id, string_split(text, ' ') AS y FROM v_sections)
    SELECT piece_id, track_id, CAST(section AS BIGINT) AS section, x = y AS equal, len(x) = len(y) AS same_length,
           CASE WHEN len(x) = len(y) THEN CAST(len(list_filter(list_zip(x, y), lambda z:
               CASE WHEN contains(z[1], 'NOTE') THEN string_split(z[1], '=')[1] ELSE z[1] END
               <> CASE WHEN contains(z[2], 'NOTE') THEN string_split(z[2], '=')[1] ELSE z[2] END)) AS INT) END AS n_different
    FROM l JOIN r USING (piece_id, section, track_id)""",
)
def b13(corpus):
    """Each track against the next one in every section; the encode/decode comparison itself is a test."""
    sections = _sections(corpus)
    left = sections.withColumn("key", F.struct("piece_id", "track_id", "section"))
    right = sections.withColumn("key", F.struct("piece_id", (F.col("track_id") - 1).alias("track_id"), "section"))
    return sq.compared(left, right, "key").select("key.*", "equal", "same_length", "n_different")


@query(
    "B14",
    f"""
    WITH {_BARS}
    SELECT {_KEYS}, bars[1] || array_to_string(bars[greatest(len(bars) - 4 + 2, 2):len(bars)], '') AS prompt FROM b""",
)
def b14(corpus):
    return _with_bars(corpus).select(*KEYS, F.array_join(sq.last_bars(F.col("bars"), 4), "").alias("prompt"))


@query(
    "B15",
    f"""
    WITH {_BARS}
    SELECT {_KEYS}, 'track_' || (track_id - 1) AS label, CASE WHEN track_id = 3 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END
           AS temperature, CAST(len(bars) AS INT) AS n_items FROM b WHERE track_id <> 2
    UNION ALL SELECT piece_id, 8, 0::BIGINT, 'track_7', 0.9::DOUBLE, 0 FROM v_pieces""",
)
def b15(corpus):
    """A track appended, one deleted, one re-set, in every piece."""
    label = F.concat(F.lit("track_"), (F.col("track_id") - 1).cast("string"))
    state = _with_bars(corpus).select(*KEYS, label.alias("label"), F.lit(0.7).alias("temperature"), "bars")
    added = corpus.pieces.select(
        "piece_id", F.lit(8).alias("track_id"), F.lit(0).cast("long").alias("section"), F.lit("track_7").alias("label"),
        F.lit(0.9).alias("temperature"), F.array().cast("array<string>").alias("bars"),
    )
    changed = sq.reset_temperature(sq.delete_track(sq.append_track(state, added), 2), 3, 0.5)
    return changed.select(*KEYS, "label", "temperature", F.size("bars").alias("n_items"))
