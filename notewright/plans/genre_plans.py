"""Genre classifier."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import functions as F

from notewright.operators import genre_model as gm
from notewright.operators import piece_stats as ps
from notewright.operators.windows import with_group_mode
from notewright.plans.registry import query
from notewright.plans.statistics_plans import _WHOLE
from notewright.session import cut_lineage, fresh_path

# The numbers of the statistics table, stated for the SQL side.
_NUMBERS = (
    "n_instruments n_unique_instruments number_of_instrument_families n_notes n_unique_notes "
    "average_n_unique_notes_per_instrument average_note_duration average_note_velocity average_note_pitch "
    "range_of_note_pitches average_range_of_note_pitches_per_instrument number_of_note_pitch_classes "
    "average_number_of_note_pitch_classes_per_instrument number_of_octaves average_number_of_octaves_per_instrument "
    "number_of_notes_per_second shortest_note_length longest_note_length main_key_signature n_key_changes "
    "n_tempo_changes tempo_estimate n_time_signature_changes track_length_in_seconds lyrics_nb_words lyrics_unique_words"
).split()


def first_program_label(corpus):
    """(md5, genre): a label that depends on the first track's program, which every piece has."""
    first = corpus.tracks.groupBy("piece_id").agg(F.min_by("program", "track_id").alias("program"))
    return first.select(F.col("piece_id").cast("string").alias("md5"), F.concat(F.lit("g"), (F.col("program") % 4).cast("string")).alias("genre"))


def labelled_statistics(corpus):
    """The statistics table with the label."""
    return ps.piece_statistics(corpus).join(first_program_label(corpus), "md5")


LABELLED = f"""
    SELECT w.*, g.genre FROM ({_WHOLE}) w JOIN (
        SELECT CAST(piece_id AS VARCHAR) AS md5, 'g' || CAST(arg_min(program, track_id) % 4 AS VARCHAR) AS genre
        FROM v_tracks GROUP BY piece_id) g USING (md5)"""

_FIT = f"""
    SELECT md5, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), avg(CASE WHEN NOT is_test THEN {c} END) OVER (), 0), 6) AS {c}" for c in _NUMBERS)},
           CASE WHEN lyrics_bool THEN 'true' ELSE 'false' END AS lyrics_bool, genre, is_test
    FROM (SELECT *, md5('42:' || md5) < '1999999a' AS is_test FROM ({LABELLED}))"""


def _prepared(corpus):
    """Complete rows; every feature is filled from the training part."""
    rows = cut_lineage(gm.prepare(labelled_statistics(corpus)))
    return gm.imputed(rows, gm.means(rows.where(~F.col("is_test"))))


def _rounded(rows):
    return rows.withColumns({c: F.round(c, 6) for c in gm.FEATURES})


@query("G01", _FIT)
def g01(corpus):
    return _rounded(_prepared(corpus))


@query("G02", f"SELECT * EXCLUDE (genre, is_test) FROM ({_FIT})")
def g02(corpus):
    """Rows to predict, filled with the means of the training part."""
    statistics = cut_lineage(labelled_statistics(corpus))
    known = gm.means(gm.prepare(statistics).where(~F.col("is_test")))
    return _rounded(gm.imputed(gm.prepare(statistics, predict_only=True), known))


@query("G03", "SELECT doc_id, md5('42:' || doc_id) < '1999999a' AS is_test FROM documents")
def g03(corpus):
    return gm.with_split(corpus.documents.select("doc_id"), "doc_id")


@query(
    "G04",
    """
    SELECT md5, CAST(dense_rank() OVER (ORDER BY main_time_signature) - 1 AS DOUBLE) AS signature_index,
           CAST(dense_rank() OVER (ORDER BY lyrics_bool) - 1 AS DOUBLE) AS lyrics_index FROM v_catalog""",
)
def g04(corpus):
    rows = corpus.catalog.select("md5", "main_time_signature", F.col("lyrics_bool").cast("string").alias("lyrics_bool"))
    indexer = StringIndexer(
        inputCols=["main_time_signature", "lyrics_bool"], outputCols=["signature_index", "lyrics_index"],
        stringOrderType="alphabetAsc", handleInvalid="error",
    )
    return indexer.fit(rows).transform(rows).select("md5", "signature_index", "lyrics_index")


@query(
    "G05",
    "SELECT md5, CAST(dense_rank() OVER (ORDER BY genre) - 1 AS DOUBLE) AS label, genre AS decoded FROM v_catalog",
)
def g05(corpus):
    rows = corpus.catalog.select("md5", "genre")
    model = StringIndexer(inputCol="genre", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error").fit(rows)
    inverse = IndexToString(inputCol="label", outputCol="decoded", labels=model.labels)
    return inverse.transform(model.transform(rows)).select("md5", "label", "decoded")


def _trained(corpus):
    rows = _prepared(corpus)
    model, _ = gm.fit(rows.where(~F.col("is_test")))
    return model, rows


_LABELS = f"SELECT md5, is_test, genre, true AS {{}} FROM ({_FIT})"


@query("G06", "SELECT CAST(range AS INT) AS tree, true AS within_depth, true AS two_children FROM range(20)")
def g06(corpus):
    """Every tree of the fitted forest, against the depth allowed and the shape of a binary tree."""
    model, _ = _trained(corpus)
    trees = [(i, t.depth <= 15, t.numNodes % 2 == 1) for i, t in enumerate(model.stages[2].trees)]
    return corpus.spark.createDataFrame(trees, "tree INT, within_depth BOOLEAN, two_children BOOLEAN")


@query("G07", _LABELS.format("of_training"))
def g07(corpus):
    """A prediction for every piece, and whether it is a label of the training part."""
    model, rows = _trained(corpus)
    labels = rows.where(~F.col("is_test")).select(F.col("genre").alias("predicted_genre")).distinct().withColumn("hit", F.lit(True))
    found = gm.predict(model, rows).join(labels, "predicted_genre", "left")
    return found.select("md5", "is_test", "genre", F.coalesce("hit", F.lit(False)).alias("of_training"))


@query(
    "G08",
    """
    WITH c AS (SELECT artist, genre, row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, genre) AS rn
               FROM v_catalog GROUP BY artist, genre),
    p AS (SELECT k.genre AS label, c.genre AS predicted FROM v_catalog k JOIN c ON c.artist = k.artist AND c.rn = 1),
    classes AS (SELECT label AS class FROM p UNION SELECT predicted FROM p),
    s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support,
                 (SELECT count(*) FROM p WHERE label = class AND predicted = class) AS hits,
                 (SELECT count(*) FROM p WHERE predicted = class) AS predicted FROM classes),
    m AS (SELECT class, support, coalesce(hits / nullif(predicted, 0), 0) AS precision,
                 coalesce(hits / nullif(support, 0), 0) AS recall FROM s)
    SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
           round((SELECT avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END) FROM p), 6) AS accuracy FROM m""",
)
def g08(corpus):
    """Report on a given prediction: the most frequent genre of the artist."""
    rows = with_group_mode(corpus.catalog.select("md5", "artist", "genre"), "artist", "genre", "predicted")
    report = gm.class_report(rows, "genre", "predicted")
    return report.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("G09", _LABELS.format("same"))
def g09(corpus):
    """Whether a model that was saved and loaded predicts what it did before, piece by piece."""
    model, rows = _trained(corpus)
    path = fresh_path(corpus.spark, "genre-model")
    gm.save(model, path)
    before = gm.predict(model, rows).select("md5", "is_test", "genre", F.col("predicted_genre").alias("before"))
    after = gm.predict(gm.load(path), rows).select("md5", F.col("predicted_genre").alias("after"))
    return before.join(after, "md5").select("md5", "is_test", "genre", (F.col("before") == F.col("after")).alias("same"))
