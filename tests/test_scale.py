"""What grows with the tables: how often they are read, what a shuffle carries, how much one task holds."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewright.functions import similarity as sim
from notewright.operators import coverage as cov
from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import metadata as md
from notewright.operators import piece_stats as ps
from notewright.operators import vocabulary as vo
from notewright.plans import genre_plans
from notewright.sources import files as fl
from tests.test_metadata import slow_ratio

NOTES = "piece_id LONG, track_id INT, program INT, is_drum BOOLEAN, pitch INT, start_u INT, end_u INT, velocity INT"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_notes(spark, n=120):
    rows = [(i % 5, i % 3 + 1, 8 * (i % 3), i % 3 == 0, 40 + i % 20, 7 * i % 300, 7 * i % 300 + 1 + i % 90, 1 + i % 100) for i in range(n)]
    return spark.createDataFrame(rows, NOTES)


def encoded(notes):
    return enc.encode(notes, notes.select("piece_id", "track_id", "program", "is_drum").distinct())


def texts_of(most, seed=11, n=150):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdé 😀") for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_shared_letters_lose_no_match():
    for most in (12, 70, 150):
        texts = texts_of(most)
        index = sim.NameIndex(texts, 60)
        asked = texts[::3] + ["", "zzz", "a" * 5]
        shared = index.letters_shared(asked, 10, 140)
        for i, text in enumerate(asked):
            ratios = [slow_ratio(text, t) for t in texts[10:140]]
            wanted = [k for k, r in enumerate(ratios, 10) if r > 60]
            assert index.first(text, 10, 140, shared[i]) == (wanted[0] if wanted else None)


def test_shared_columns_only_loosen_the_bound(monkeypatch):
    monkeypatch.setattr(sim, "_COLUMNS", 3)
    texts = texts_of(30)
    shared = sim.NameIndex(texts, 60).letters_shared(texts, 0, len(texts))
    for a, row in zip(texts, shared):
        assert all(n >= sum(min(a.count(c), b.count(c)) for c in set(a)) for b, n in zip(texts, row))


def test_leaders_are_not_compared_again(spark, monkeypatch):
    rows = [("", t, i, t, False) for i, t in enumerate(["night train", "blue moon", "night trains", "solitude", "caravan"])]
    nodes = spark.createDataFrame(rows, "block STRING, processed STRING, position LONG, cleaned STRING, blocked BOOLEAN").withColumn("name", F.col("processed"))
    asked, plain = [], md.first_matches
    monkeypatch.setattr(md, "first_matches", lambda left, right, *more, **named: asked.append(left.count()) or plain(left, right, *more, **named))
    found = {r["processed"]: r["leader"] for r in md.leaders(nodes, 75).collect()}
    assert found == {"night train": "night train", "blue moon": "blue moon", "night trains": "night train", "solitude": "solitude", "caravan": "caravan"}
    assert asked[-1] == 1


def test_long_names_are_matched(spark):
    long = "a long title that goes on and on beyond the sixty four letters of a machine word"
    names = [f"{long} {i} {'xyzq'[i] * 20}" for i in range(4)] + [long, long[:60], "short"] + texts_of(100)
    names = sorted({n for n in names if n})
    rows = spark.createDataFrame([("", n, i, n) for i, n in enumerate(names)], "block STRING, processed STRING, position LONG, cleaned STRING")
    found = {r["processed"]: r["other"] for r in md.first_matches(rows, rows, 70, earlier=True).collect()}
    for i, n in enumerate(names):
        assert found.get(n) == next((m for m in names[:i] if slow_ratio(n, m) > 70), None)


@pytest.mark.parametrize("bytes_at_once", [md.INDEX_BYTES, 20_000])
def test_two_parts_meet_once(monkeypatch, bytes_at_once):
    """In a round each pair of names is compared in one tile, and its later name has the match, on whichever side it stands."""
    monkeypatch.setattr(md, "INDEX_BYTES", bytes_at_once)
    rows = [("xy"[i % 2], t, i, t.upper()) for i, t in enumerate(dict.fromkeys(texts_of(12, 5, 60) + texts_of(90, 6, 30) + texts_of(200, 7, 20)))]
    names = ["block", "processed", "position", "cleaned"]
    parts = [pa.table(dict(zip(names, zip(*rows[i::3])))) for i in range(2)]
    wanted = set()
    for i, part in enumerate(parts):
        facing = sorted(zip(*(parts[1 - i].column(c).to_pylist() for c in ("position", "block", "processed", "cleaned"))))
        for block, text, position in zip(*(part.column(c).to_pylist() for c in names[:3])):
            met = [(q, u, c) for q, b, u, c in facing if b == block and q < position and slow_ratio(text, u) > 50]
            wanted |= {(block, text, *met[0])} if met else set()
    found = md._first_match(50, True)(*parts)
    assert set(zip(*(c.to_pylist() for c in found.columns))) == wanted and found.num_rows == len(wanted)
    assert {side for side, part in enumerate(parts) if set(part.column("processed").to_pylist()) & {w[1] for w in wanted}} == {0, 1}


def test_matches_of_many_texts_at_once(monkeypatch):
    """Strings of several machine words carry from word to word; texts are advanced together, few pairs or many."""
    texts = texts_of(12, 8, 60) + texts_of(300, 9, 60) + ["ab" * 70, "a" * 64, "a" * 65, "a" * 128, "ba" * 64, ""]
    for least, few, at_once in ((64, 128, 8192), (1, 2, 50), (10_000, 0, 7)):
        for name, value in (("_LEAST_COUNTED", least), ("_FEW", few), ("_AT_ONCE", at_once)):
            monkeypatch.setattr(sim, name, value)
        found = {(int(i), int(k)) for rows, places in sim.NameIndex(texts, 55).matches(texts[::2], 3, 120) for i, k in zip(rows, places)}
        assert found == {(i, k) for i, a in enumerate(texts[::2]) for k in range(3, 120) if slow_ratio(a, texts[k]) > 55}


def test_found_leaders_are_not_looked_for_again(spark, monkeypatch):
    rows = [("", t, i, t, False) for i, t in enumerate(["night train", "blue moon", "night trains", "solitude", "night train s"])]
    nodes = spark.createDataFrame(rows, "block STRING, processed STRING, position LONG, cleaned STRING, blocked BOOLEAN").withColumn("name", F.col("processed"))
    looked, plain = [], md._classed
    monkeypatch.setattr(md, "_classed", lambda names, large: looked.append(names.count()) or plain(names, large))
    assert {r["processed"]: r["leader"] for r in md.leaders(nodes, 75).collect()}["night train s"] == "night train"
    assert looked == [5, 5, 0, 3]


def test_names_are_dealt_to_all_cores(spark):
    names = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "md5 LONG, name STRING")
    nodes = md.name_nodes(names, "name", "md5").rdd
    assert nodes.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert all(nodes.glom().map(len).collect())


def test_tiles_are_dealt_by_pairs(spark, monkeypatch):
    """Tiles of few bytes and many pairs are not joined to few tasks."""
    monkeypatch.setattr(md, "PAIRS_PER_TASK", 100)
    rows = spark.createDataFrame([("", f"name {i}", i, "") for i in range(60)], "block STRING, processed STRING, position LONG, cleaned STRING")
    plan = plan_of(md.first_matches(rows, rows, 75, earlier=True))
    tasks = min(36, 16 * spark.sparkContext.defaultParallelism)
    assert len(re.findall(rf"hashpartitioning\(tile#\d+L, {tasks}\), REPARTITION_BY_NUM", plan)) == 2


def test_texts_are_dealt_by_notes(spark, monkeypatch):
    monkeypatch.setattr(enc, "NOTES_PER_TASK", 2)
    notes = some_notes(spark)
    assert encoded(notes).rdd.getNumPartitions() == notes.count() / 2


def test_merged_shifts_decode_once(spark):
    events = dec.decoded_events(encoded(some_notes(spark)))
    merged = dec.merged_shifts(events)
    assert plan_of(merged).count("Generate") == plan_of(events).count("Generate")
    times = {}
    for r in sorted(merged.collect(), key=lambda r: (r["piece_id"], r["channel"], r["t"], r["segment"], r["chunk"], r["pos"])):
        key = r["piece_id"], r["channel"]
        assert r["shift_u"] == r["t"] - times.get(key, 0)
        times[key] = r["t"]


@pytest.mark.parametrize("frequent", [3, 5, 1000])
def test_words_travel_only_if_rare(spark, monkeypatch, frequent):
    monkeypatch.setattr(vo, "FREQUENT", frequent)
    rows = [(1, "a a b\nc"), (1, "d  a e a"), (None, "b x"), (2, None), (3, ""), (4, "e " * 30 + "f")]
    texts = spark.createDataFrame(rows, "k LONG, text STRING")
    vocabulary = vo.build(texts.where("text NOT LIKE '%x'"))
    ids = {r["word"]: r["id"] for r in vocabulary.collect()}
    coded = vo.encode(texts, "k", vocabulary)
    assert "Generate" not in plan_of(coded)
    assert sorted(map(str, ((r["k"], r["input_ids"]) for r in coded.collect()))) == sorted(
        str((k, [ids.get(w, 0) for w in (t or "").split()])) for k, t in rows
    )
    back = vo.to_text(coded, "k", vocabulary)
    assert sorted(map(str, ((r["k"], r["text"]) for r in back.collect()))) == sorted(
        str((k, " ".join(w if w in ids else "[UNK]" for w in (t or "").split()))) for k, t in rows
    )


def test_padding_makes_the_ids_once(spark):
    texts = spark.createDataFrame([(i, "a b " * i, i // 3) for i in range(9)], "k LONG, text STRING, batch LONG")
    coded = vo.encode(texts, "k", vo.build(texts)).withColumn("batch", F.floor(F.col("k") / 3))
    padded = vo.pad(coded, "batch")
    assert "ObjectHashAggregate" not in plan_of(padded)  # the step that lists the ids
    assert {r["k"]: len(r["input_ids"]) for r in padded.collect()} == {i: 2 * (i // 3 * 3 + 2) for i in range(9)}


def test_note_files_are_read_twice(spark, tmp_path):
    path = str(tmp_path / "notes")
    fl.write_note_lines(some_notes(spark), path, F.when((F.col("piece_id") == 2) & (F.col("start_u") == 14), F.lit("broken")))
    read = fl.read_note_lines(spark, path)
    assert plan_of(read).count("FileScan text") == 1  # the broken files were found before, in a read of their own
    assert {r["piece_id"] for r in read.where("error IS NULL").collect()} == {"0", "1", "3", "4"}


def test_roll_shuffles_notes(spark):
    notes = some_notes(spark)
    roll = cov.piano_roll(notes)
    assert plan_of(roll).count("Exchange") == 1 and plan_of(roll).index("sequence(") < plan_of(roll).index("Exchange")
    wanted = {}
    for n in notes.collect():
        for frame in range(n["start_u"], n["end_u"]):
            key = n["piece_id"], frame, n["pitch"]
            wanted[key] = wanted.get(key, 0) + n["velocity"]
    assert {(r["piece_id"], r["frame"], r["pitch"]): r["velocity"] for r in roll.collect()} == wanted


def test_number_of_words_needs_no_distinct_words(spark):
    words = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, None), (3, "b")], "piece_id LONG, text STRING")
    found = ps.lyric_statistics(words)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 4, 2), (2, 1, 1), (3, 1, 1)]
    assert plan_of(found.select("piece_id", "lyrics_nb_words")).count("Exchange") == 1


def test_rows_to_predict_come_from_one_table(spark, corpus):
    assert "FileScan" not in plan_of(genre_plans.g02(corpus))
