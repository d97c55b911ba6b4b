"""Statistics, coverage, reports, vocabulary and sources on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions import instruments as inst
from notewright.functions import names as nm
from notewright.functions import tokens as tk
from notewright.operators import coverage as cov
from notewright.operators import genre_model as gm
from notewright.operators import piece_stats as ps
from notewright.operators import reports as rp
from notewright.operators import vocabulary as vo
from notewright.session import fresh_path
from notewright.sources import files as fl
from notewright.sources import text as tx
from notewright.sources.quarantine import split_playable

NOTES = "piece_id LONG, track_id INT, pitch INT, velocity INT, start_u INT, end_u INT, start DOUBLE, end DOUBLE"
TRACKS = "piece_id LONG, track_id INT, program INT, is_drum BOOLEAN"


def small_notes(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        start = rng.randrange(2000)
        end = start + rng.randint(1, 300)
        rows.append((rng.randrange(3), rng.randrange(2), rng.randrange(128), rng.randrange(1, 128), start, end, start / 16, end / 16))
    return rows, spark.createDataFrame(rows, NOTES)


def test_track_without_notes(spark):
    _, notes = small_notes(spark)
    tracks = spark.createDataFrame([(0, 0, 5, False), (0, 1, 5, True), (0, 7, 127, False), (9, 0, 63, False)], TRACKS)
    rows = {r["piece_id"]: r for r in ps.note_statistics(notes, tracks).collect()}
    assert rows[0]["n_instruments"] == 3 and rows[0]["n_unique_instruments"] == 2
    assert rows[0]["instruments"] == "5, 5, 127"
    assert rows[9]["n_notes"] == 0 and rows[9]["average_note_pitch"] is None
    assert rows[9]["average_n_unique_notes_per_instrument"] == 0
    assert rows[9]["number_of_notes_per_second"] is None
    with_drums = {r["piece_id"]: r for r in ps.note_statistics(notes, tracks, drums_as_family=True).collect()}
    assert with_drums[0]["instrument_families"] == ["Drums", "Piano", "Sound Effects"]


def test_distinct_masks_reach_both_ends(spark):
    rows = [(1, 1, p, 1, 0, 4, 0.0, 0.25) for p in (0, 62, 63, 64, 126, 127, 127)]
    tracks = spark.createDataFrame([(1, 1, 0, False)], TRACKS)
    row = ps.note_statistics(spark.createDataFrame(rows, NOTES), tracks).first()
    assert row["n_unique_notes"] == 6 and row["number_of_octaves"] == 3 and row["range_of_note_pitches"] == 127


def test_statistics_are_those_of_playable_notes(spark):
    good = [(1, 1, 60, 10, 0, 4, 0.0, 0.25), (1, 1, 72, 30, 8, 16, 0.5, 1.0)]
    bad = [(1, 1, 128, 90, 0, 400, 0.0, 25.0), (1, 1, -1, 90, 0, 400, 0.0, 25.0), (1, 1, None, 90, 0, 400, 0.0, 25.0)]
    tracks = spark.createDataFrame([(1, 1, 0, False)], TRACKS)
    expected = ps.note_statistics(spark.createDataFrame(good, NOTES), tracks).collect()
    notes = spark.createDataFrame(good + bad, NOTES)
    assert ps.note_statistics(notes, tracks).collect() == expected
    assert expected[0]["n_notes"] == 2 and expected[0]["number_of_octaves"] == 2 and expected[0]["average_note_pitch"] == 66
    rejected = split_playable(notes)[1].select("pitch", "reason").collect()
    assert sorted(map(str, rejected)) == [
        "Row(pitch=-1, reason='pitch out of range')", "Row(pitch=128, reason='pitch out of range')", "Row(pitch=None, reason='missing value')",
    ]


def test_coverage_is_the_interval_union(spark):
    rows, notes = small_notes(spark)
    got = {(r["piece_id"], r["track_id"]): r["covered_u"] for r in cov.covered_units(notes).collect()}
    for key in got:
        ticks = set()
        for r in rows:
            if r[:2] == key:
                ticks.update(range(r[4], r[5]))
        assert got[key] == len(ticks)


def test_tempo_crosses_chunks(spark, monkeypatch):
    rows = [(1, 1, 60, 1, 0, 1, s, s + 0.1) for s in (0.0, 0.5, 1.0, 300.0, 300.5, 600.0)]
    assert ps.tempo_estimate(spark.createDataFrame(rows, NOTES)).first()["tempo_estimate"] == 120
    monkeypatch.setattr(ps, "ONSET_CHUNK_SECONDS", 0.75)
    assert ps.tempo_estimate(spark.createDataFrame(rows, NOTES)).first()["tempo_estimate"] == 120


def test_numbering_over_chunks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 501).alias("v"))
    got = cov.numbered(rows, ["k"], F.floor(F.col("v") / 50), ["v"], "n").collect()
    for k in range(3):
        mine = sorted((r["v"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 100, 7.0, None])) for _ in range(500)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r["g"]: r for r in rp.exact_percentiles(df, "g", "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for g in "abc":
        mine = [v for k, v in rows if k == g and v is not None]
        for name, f in (("q1", 25), ("q2", 50), ("q3", 75)):
            assert got[g][name] == pytest.approx(np.percentile(mine, f))


def test_percentiles_of_a_heavy_tail(spark, monkeypatch):
    """No bin of the splitters holds more than twice its share of the distinct values, and the result stays exact."""
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.exp((F.col("id") * 7919 % 20_000) / 700.0).alias("v"))
    values = np.array([r["v"] for r in rows.collect()])
    got = rp.exact_percentiles(rows, "g", "v", {"low": 0.1, "mid": 0.5, "high": 0.999}).first()
    for name, f in (("low", 10), ("mid", 50), ("high", 99.9)):
        assert got[name] == pytest.approx(np.percentile(values, f))
    shares = [k / rp.PERCENTILE_BINS for k in range(1, rp.PERCENTILE_BINS)]
    splitters = rows.agg(F.percentile_approx("v", shares, rp.SKETCH_ACCURACY).alias("s")).first()["s"]
    sizes = np.bincount(np.searchsorted(splitters, values, "left"), minlength=rp.PERCENTILE_BINS)
    assert sizes.max() <= 2 * len(values) / rp.PERCENTILE_BINS


def test_medians_of_several_columns(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 3, None), ("b", 5, 1.0), (None, 9, 9.0)], "g STRING, x INT, y DOUBLE")
    got = [tuple(r) for r in rp.medians_of(rows, "g", ["x", "y"]).collect()]
    assert got == [("x", "b", 5.0), ("x", "a", 2.0), ("y", "a", 2.0), ("y", "b", 1.0)]


def test_folder_statistics(corpus):
    readable, log = ps.folder_statistics(corpus, latest_u=518)
    pieces = {r["piece_id"] for r in corpus.pieces.collect()}
    late = {r["piece_id"] for r in corpus.notes.where("end_u > 518").select("piece_id").distinct().collect()}
    assert 0 < len(late) < len(pieces)
    assert {r["piece_id"] for r in readable.select("piece_id").collect()} == pieces - late
    assert {r["error"] for r in log.collect()} == {f"invalidfile: {p}: ends beyond the piece limit" for p in late}


def test_rows_of_files_with_different_schemas(spark):
    root = fresh_path(spark, "tables")
    for i, df in enumerate([spark.range(7), spark.range(0), spark.createDataFrame([("x", 1.0)], "a STRING, b DOUBLE")]):
        df.coalesce(1).write.parquet(f"{root}/t{i}")
    counted = {r["path"].split("/")[-2]: r["n_rows"] for r in fl.rows_per_file(spark, root, recursive=True).collect()}
    assert counted == {"t0": 7, "t1": 0, "t2": 1}
    assert [r["n_rows"] for r in fl.rows_per_file(spark, root, recursive=True, first=1).collect()] == [7]


def test_forest_learns_separable_labels(spark):
    """On labels that two features decide, the held-out part is told apart, far better than by the most frequent label."""
    rows = spark.range(1200).select(F.col("id").cast("string").alias("md5"), *[F.rand(i).alias(c) for i, c in enumerate(gm.FEATURES)])
    low, late = F.col("average_note_pitch") < 0.4, F.col("tempo_estimate") < 0.5
    genre = F.when(low, "slow").when(late, "rock").otherwise("jazz")
    rows = rows.withColumns({"genre": genre, "lyrics_bool": F.col("n_notes") < 0.5})
    rows = gm.prepare(spark.createDataFrame(rows.collect(), rows.schema))
    rows = gm.imputed(rows, gm.means(rows.where(~F.col("is_test"))))
    model, _ = gm.fit(rows.where(~F.col("is_test")))
    held_out = gm.predict(model, rows.where("is_test"))
    report = {r["class"]: r for r in gm.class_report(held_out, "genre", "predicted_genre").collect()}
    n = sum(r["support"] for r in report.values())
    assert n > 80 and set(report) == {"slow", "rock", "jazz"}
    accuracy, majority = report["slow"]["accuracy"], max(r["support"] for r in report.values()) / n
    assert accuracy > 0.85 and accuracy > majority + 0.3
    assert all(r["precision"] > 0.7 and r["recall"] > 0.7 for r in report.values())
    path = fresh_path(spark, "forest")
    gm.save(model, path)
    again = {r["md5"]: r["probability"] for r in gm.predict(gm.load(path), rows.where("is_test")).collect()}
    for r in held_out.collect():
        assert np.allclose(r["probability"].toArray(), again[r["md5"]].toArray(), atol=1e-12, rtol=0)


def test_names_of_empty_lists(spark):
    rows = spark.createDataFrame([([],), ([[]],), ([["t", "a"]],), (None,)], "e ARRAY<ARRAY<STRING>>")
    got = [tuple(r) for r in rows.select(nm.first_artist(F.col("e")), nm.first_title(F.col("e"))).collect()]
    assert got == [(None, "unknown"), (None, "unknown"), ("a", "t"), (None, "unknown")]
    text = spark.createDataFrame([("[]",), ("[['x']]",)], "t STRING")
    assert [r[0] for r in text.select(nm.stringified_list(F.col("t"))).collect()] == [None, ["x"]]


def test_scalar_edges(spark):
    row = spark.range(1).select(
        inst.family_number(F.lit(128)).alias("out"), inst.program_name(F.lit(-1)).alias("below"),
        tk.beats_literal(F.lit(5.99)).alias("cut"), tk.literal_delta(F.lit("0.1.8")).alias("lossy"),
        tk.event_text(F.lit("Bar-Density"), F.lit("3")).alias("silent"), tk.event_type(F.lit("DENSITY")).alias("none"),
        nm.clean_name(F.lit("ABBA The_Best (live).12, x")).alias("name"),
        tk.list_average(F.array().cast("array<double>")).alias("empty"),
        inst.text_to_families(F.lit("INST=86 INST=DRUMS NOTE_ON=86")).alias("families"),
    ).first()
    assert row["out"] is None and row["below"] is None and row["none"] is None and row["empty"] is None
    assert row["cut"] == "5.7.8" and row["lossy"] == 0 and row["silent"] == ""
    assert row["name"] == "A B B A  The Best  x".replace("The Best", "The Best") and row["families"] == "INST=10 INST=DRUMS NOTE_ON=86"


def test_family_draw_is_repeatable():
    first, second = inst.draw_family_programs(3), inst.draw_family_programs(3)
    assert first == second and first[3] == 80
    assert all(p // 8 == f for f, p in enumerate(inst.draw_family_programs(3, fixed=False)))


def test_vocabulary_matches_public_library(spark, corpus):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit
    from tokenizers.trainers import WordLevelTrainer

    texts = [r["text"] for r in corpus.documents.collect()]
    tokenizer = Tokenizer(WordLevel(unk_token="[UNK]"))
    tokenizer.pre_tokenizer = WhitespaceSplit()
    tokenizer.train_from_iterator(texts, WordLevelTrainer(special_tokens=["[UNK]", "[PAD]", "[MASK]"], vocab_size=800))
    got = {r["word"]: r["id"] for r in vo.build(corpus.documents, 800).collect()}
    assert got == tokenizer.get_vocab()
    ids = {r["doc_id"]: r["input_ids"] for r in vo.encode(corpus.documents, "doc_id", vo.build(corpus.documents, 800)).collect()}
    for r in corpus.documents.limit(20).collect():
        assert ids[r["doc_id"]] == tokenizer.encode(r["text"]).ids


@pytest.mark.parametrize("frequent", [1000, 4, 0])
def test_one_result_however_many_words_are_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(vo, "FREQUENT", frequent)
    texts = spark.createDataFrame([(1, ""), (2, None), (3, "a  b"), (3, "b c"), (3, "b c"), (4, "[UNK] b")], "doc_id LONG, text STRING")
    vocabulary = spark.createDataFrame([("[UNK]", 0), ("b", 3), ("c", 4)], "word STRING, id INT")
    got = sorted((r["doc_id"], r["input_ids"]) for r in vo.encode(texts, "doc_id", vocabulary).collect())
    assert got == [(1, []), (2, []), (3, [0, 3]), (3, [3, 4]), (3, [3, 4]), (4, [0, 3])]
    ids = spark.createDataFrame([(1, [3, 99, 4]), (1, [4]), (2, []), (3, None)], "doc_id LONG, input_ids ARRAY<INT>")
    words = sorted((r["doc_id"], r["text"]) for r in vo.to_text(ids, "doc_id", vocabulary).collect())
    assert words == [(1, "b c"), (1, "c"), (2, ""), (3, "")]


def test_ranks_of_all_words(spark):
    counts = spark.createDataFrame([(f"w{k:04d}", 1 + (k * 7919) % 40) for k in range(2000)], "word STRING, n LONG").repartition(7)
    got = [(r["word"], r["n"]) for r in sorted(vo.ranked_words(counts).collect(), key=lambda r: r["rank"])]
    assert got == sorted(((r["word"], r["n"]) for r in counts.collect()), key=lambda r: (-r[1], r[0]))
    assert sorted(r["rank"] for r in vo.ranked_words(counts, 5).collect()) == [0, 1, 2, 3, 4]


def test_unseen_label_is_an_error(spark):
    training = spark.createDataFrame([("a", "true"), ("b", "false")], "genre STRING, lyrics_bool STRING")
    model = gm.encoders()[1].fit(training)
    with pytest.raises(Exception):
        model.transform(spark.createDataFrame([("z",)], "genre STRING")).collect()


def test_unreadable_file_is_logged(spark):
    files = spark.createDataFrame([("/x/1-1.notes", b"5 60 64 0 4"), ("/x/2-1.notes", b"junk")], "path STRING, content BINARY")
    rows = {r["path"]: r for r in fl.ingest(files, fl.parse_note_lines).collect()}
    assert rows["/x/1-1.notes"]["pitch"] == 60 and rows["/x/1-1.notes"]["error"] is None
    assert rows["/x/2-1.notes"]["error"].startswith("ValueError")


def test_note_lines(spark):
    path = fresh_path(spark, "notes")
    rows = [(p, t, 5, 60 + k, 64, k, k + 4) for p in (1, 2) for t in (1, 2) for k in range(3)]
    notes = spark.createDataFrame(rows, "piece_id LONG, track_id INT, program INT, pitch INT, velocity INT, start_u INT, end_u INT")
    fl.write_note_lines(notes, path, F.when((F.col("piece_id") == 2) & (F.col("track_id") == 1) & (F.col("start_u") == 1), "60 x"))
    found = sorted((tuple(r) for r in fl.read_note_lines(spark, path).collect()), key=str)
    wanted = [(str(r[0]), *r[1:], None) for r in rows if r[0] != 2] + [("2", *[None] * 6, "malformed line: 60 x")]
    assert found == sorted(wanted, key=str)


def test_lines_until_blank(spark):
    files = spark.createDataFrame([("f", "a\nb\n\nc"), ("g", "x")], "file STRING, text STRING")
    assert sorted(r["text"] for r in tx.lines_until_blank(files, "file").collect()) == ["a", "b", "x"]
    assert sorted(r["text"] for r in tx.lines_until_blank(files, "file", skip_blanks=True).collect()) == ["a", "b", "c", "x"]


def test_file_listing(spark):
    root = fresh_path(spark, "listing")
    for name in ("", "/deeper"):
        spark.createDataFrame([("x",)], "value STRING").coalesce(1).write.mode("append").text(root + name)
    assert fl.list_files(spark, root, "*.txt").count() == 1
    assert fl.list_files(spark, root, "*.txt", recursive=True).count() == 2
