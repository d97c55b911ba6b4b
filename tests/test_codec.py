"""Encoding and decoding against step-by-step restatements, and the round trip."""

import random
from collections import Counter

from pyspark.sql import functions as F

from notewright.operators import decode as dec
from notewright.operators import encode as enc
from notewright.operators import sequences as sq

NOTES = "piece_id LONG, track_id INT, pitch INT, start_u INT, end_u INT, velocity INT"
TRACKS = "piece_id LONG, track_id INT, program INT, is_drum BOOLEAN"


def render_track(notes, label):
    """One text per eight-bar section, built by walking the time line tick by tick."""
    at = {}
    for pitch, start, end in notes:
        at.setdefault(start, []).append((1, pitch))
        at.setdefault(end, []).append((0, pitch))
    last_tick = max(at)
    bars, tick = [], 0
    while True:
        words, onsets, waited = [], 0, 0
        for step in range(33):
            due = sorted(e for e in at.get(tick + step, []) if (e[0] == 0) != (step == 0) or 0 < step < 32)
            for kind, pitch in due:
                if waited:
                    words.append(f"TIME_DELTA={waited // 2}")
                    waited = 0
                words.append(("NOTE_ON=" if kind else "NOTE_OFF=") + str(pitch))
                onsets += kind
            waited += 1
        bars.append((words, onsets))
        tick += 32
        if tick >= last_tick:
            break
    texts = []
    for i in range(0, len(bars), 8):
        part = bars[i : i + 8]
        seen = Counter(round(n / 4) for _, n in part)
        density = min(seen, key=lambda d: (-seen[d], d))
        body = " ".join(" ".join(["BAR_START", *w, "BAR_END"]) for w, _ in part)
        texts.append(f"TRACK_START INST={label} DENSITY={density} {body} TRACK_END ")
    return texts


def random_pieces(seed, n):
    rng = random.Random(seed)
    notes, tracks = [], []
    for piece in range(n):
        for track in range(rng.randint(1, 4)):
            tracks.append((piece, track, rng.randrange(128), rng.random() < 0.3))
            for _ in range(rng.randint(1, 40)):
                start = rng.randrange(rng.choice([40, 700]))
                notes.append((piece, track, rng.randrange(128), start, start + rng.randint(1, 90), 64))
    return notes, tracks


def test_encoding_equals_the_tick_walk(spark):
    notes, tracks = random_pieces(3, 25)
    got = enc.encode(spark.createDataFrame(notes, NOTES), spark.createDataFrame(tracks, TRACKS)).collect()
    texts = {r["piece_id"]: r["text"] for r in got}
    for piece in range(25):
        rendered = []
        for _, track, program, drum in (t for t in tracks if t[0] == piece):
            mine = [(n[2], n[3], n[4]) for n in notes if n[:2] == (piece, track)]
            rendered.append(render_track(mine, "DRUMS" if drum else program))
        expected = ""
        for i in range(max(map(len, rendered))):
            expected += "PIECE_START " + "".join(r[i] for r in rendered if i < len(r))
        assert texts[piece] == expected


def test_bar_lengths_and_section_counts(spark, corpus):
    sections = enc.section_text(corpus.notes, corpus.tracks)
    pieces = sections.select(F.monotonically_increasing_id().alias("piece_id"), "text", "n_bars").persist()
    bars = dec.bar_lengths(pieces.select("piece_id", "text"))
    assert bars.where("filled_u + padding_u <> 32 OR over_long").count() == 0
    counted = bars.groupBy("piece_id").count().join(pieces, "piece_id")
    assert counted.where("count <> n_bars").count() == 0


def test_round_trip_of_one_section(spark, corpus):
    texts = enc.encode(corpus.loop_notes, corpus.loop_tracks)
    back = dec.decode(texts).select("piece_id", (F.col("channel") + 1).alias("track_id"), "pitch", "start_u", "end_u")
    original = corpus.loop_notes
    assert back.count() == original.count()
    assert back.exceptAll(original.select(back.columns)).count() == 0
    again = enc.encode(back.withColumn("velocity", F.lit(99)), corpus.loop_tracks)
    compared = sq.compared(texts, again, "piece_id")
    assert compared.where("NOT equal").count() == 0


def notes_of(spark, text):
    rows = dec.decode(spark.createDataFrame([(1, text)], "piece_id LONG, text STRING")).collect()
    return sorted((r["channel"], r["pitch"], r["start_u"], r["end_u"]) for r in rows)


def test_guard_is_not_a_running_sum(spark):
    text = (
        "TRACK_START INST=3 DENSITY=1 BAR_START NOTE_ON=1 TIME_DELTA=5 NOTE_OFF=1 NOTE_ON=2 TIME_DELTA=9 NOTE_OFF=2 "
        "NOTE_ON=3 TIME_DELTA=4 NOTE_OFF=3 NOTE_ON=4 TIME_DELTA=2 NOTE_OFF=4 NOTE_ON=5 NOTE_OFF=5 BAR_END TRACK_END "
    )
    # 5 and 9 are kept, 4 would pass 16 and is skipped, 2 is kept; the Note-On at step 16 is dropped.
    assert notes_of(spark, text) == [(0, 1, 0, 10), (0, 2, 10, 28), (0, 3, 28, 28), (0, 4, 28, 32)]


def test_malformed_text(spark):
    text = (
        "NOTE_ON=9 PIECE_START TRACK_START TRACK_START INST=3 INST=7 DENSITY=1 BAR_START BAR_END BAR_START  NOTE_ON=1 [UNK] "
        "TIME_DELTA=2 NOTE_OFF=1 BAR_END TRACK_END TRACK_START BAR_START NOTE_ON=5 TIME_DELTA=1 NOTE_OFF=5 BAR_END TRACK_END "
        "TRACK_START INST=DRUMS BAR_START NOTE_ON=6 TIME_DELTA=3 NOTE_OFF=6"
    )
    assert notes_of(spark, text) == [(0, 1, 32, 36), (1, 5, 0, 2), (2, 6, 0, 6)]
    tracks = dec.track_texts(spark.createDataFrame([(1, text)], "piece_id LONG, text STRING"))
    assert [r["instrument"] for r in tracks.orderBy("channel").collect()] == ["7", None, "DRUMS"]
    programs = dec.track_instruments(tracks).orderBy("channel").collect()
    assert [(r["program"], r["is_drum"]) for r in programs][0::2] == [(7, False), (0, True)]


def test_sections_can_follow_each_other(spark):
    notes = [(1, 1, 60, 0, 4, 64), (1, 1, 62, 300, 304, 64)]
    text = enc.encode(spark.createDataFrame(notes, NOTES), spark.createDataFrame([(1, 1, 5, False)], TRACKS))
    plain = sorted((r["pitch"], r["start_u"]) for r in dec.decode(text).collect())
    moved = sorted((r["pitch"], r["start_u"]) for r in dec.decode(text, section_bars=8).collect())
    assert plain == [(60, 0), (62, 44)]
    assert moved == [(60, 0), (62, 300)]


def test_lost_units_are_counted(spark):
    notes = spark.createDataFrame([(1, 1, 60, 1, 4, 64)], NOTES)
    assert enc.lost_units(notes).collect()[0]["lost_u"] == 2


def test_repeated_events(spark):
    text = "TRACK_START INST=1 BAR_START NOTE_ON=3 NOTE_ON=3 BAR_END BAR_END TRACK_END"
    rows = dec.repeated_events(dec.segments(dec.track_texts(spark.createDataFrame([(1, text)], "piece_id LONG, text STRING"))))
    assert [(r["type"], r["value"]) for r in rows.collect()] == [("Note-On", "3")]


def test_unusable_notes_are_returned_with_a_reason(spark):
    good = [(1, 1, 60, 0, 8, 90), (1, 1, 21, 8, 16, 90), (1, 1, 108, 40, 44, 90)]
    bad = [
        (1, 1, -1, 0, 8, 90), (1, 1, 128, 0, 8, 90), (1, 1, 20, 0, 8, 90), (1, 1, 60, 8, 8, 90), (1, 1, 60, 9, 8, 90), (1, 1, 60, -4, 8, 90),
        (1, 1, None, 0, 8, 90), (1, 1, 60, 4000, 4004, 90),
    ]
    tracks = spark.createDataFrame([(1, 1, 33, False)], TRACKS)
    clean = spark.createDataFrame(good, NOTES)
    for familize in (False, True):
        texts, errors = enc.encode_with_errors(spark.createDataFrame(good + bad, NOTES), tracks, latest_u=1000, familize=familize)
        wanted = enc.encode(clean, tracks, familize=familize)
        assert [tuple(r) for r in texts.collect()] == [tuple(r) for r in wanted.collect()]
        assert ("INST=4 " if familize else "INST=33 ") in texts.first()["text"]
        reasons = Counter(r["reason"] for r in errors.collect())
    assert reasons == {
        "pitch out of range": 3, "empty note": 2, "starts before the piece": 1, "missing value": 1, "ends beyond the piece limit": 1,
    }


def test_no_pitch_spills_into_another_field(spark):
    notes = spark.createDataFrame([(1, 1, 60, 0, 8, 90), (1, 1, 128, 0, 8, 90), (1, 1, 64, 8, 4, 90)], NOTES)
    text = enc.encode(notes, spark.createDataFrame([(1, 1, 0, False)], TRACKS)).first()["text"]
    assert text.count("NOTE_ON=60") == 1 and text.count("NOTE_ON") == 1 and text.count("NOTE_OFF") == 1


def test_familized_text_decodes_to_a_program_of_the_family(spark):
    notes = spark.createDataFrame([(1, 1, 60, 0, 8, 90), (1, 2, 40, 0, 8, 90)], NOTES)
    tracks = spark.createDataFrame([(1, 1, 35, False), (1, 2, 0, True)], TRACKS)
    texts = enc.encode(notes, tracks, familize=True)
    found = {r["instrument"] for r in dec.track_texts(texts).select("instrument").collect()}
    assert found == {"4", "DRUMS"}
    programs = dec.track_instruments(dec.track_texts(texts), [8 * f + 3 for f in range(16)]).collect()
    assert sorted((r["program"], r["is_drum"]) for r in programs) == [(0, True), (35, False)]


def test_a_late_note_costs_one_run(spark):
    notes = [(1, 0, 60, 0, 4, 9), (1, 0, 61, 2_147_483_600, 2_147_483_604, 9), (1, 1, 62, 300, 304, 9)]
    rows = enc.section_runs(spark.createDataFrame(notes, NOTES)).orderBy("track_id", "section").collect()
    last = 2_147_483_603 // 256
    found = [(r.track_id, r.section, r.n_sections, r.n_bars, len(r.events)) for r in rows]
    late = (2_147_483_603 // 32) % 8 + 1
    assert found == [(0, 0, 1, 8, 2), (0, 1, last - 1, 8, 0), (0, last, 1, late, 2), (1, 0, 1, 8, 0), (1, 1, 1, 2, 2)]


def test_runs_give_the_sections_they_stand_for(spark):
    notes = [(1, 0, 60, 32 * bar, 32 * bar + 1, 9) for bar in (3, 40, 41, 90)]
    sections = {r.section: r for r in enc.packed_sections(spark.createDataFrame(notes, NOTES)).collect()}
    assert sorted(sections) == list(range(12))
    assert [sections[s].n_bars for s in range(12)] == [8] * 11 + [3]
    assert [s for s in range(12) if sections[s].events] == [0, 5, 11]
    tracks = spark.createDataFrame([(1, 0, 5, False)], TRACKS)
    text = enc.encode(spark.createDataFrame(notes, NOTES), tracks).collect()[0].text
    expected = "".join("PIECE_START " + t for t in render_track([n[2:5] for n in notes], "5"))
    assert text == expected


def test_unknown_words_of_a_zipf_text(spark, monkeypatch):
    rng = random.Random(4)
    listed = [[f"w{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(30)] for _ in range(60)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(listed)], "k INT, text STRING")
    # The most frequent word is unknown, the next is known.
    known = {f"w{i}" for i in range(2, 300, 3)}
    vocabulary = spark.createDataFrame([("[UNK]", 0)] + [(w, i + 1) for i, w in enumerate(sorted(known))], "word STRING, id INT")
    expected = sorted((k, p, w, " ".join(words[max(p - 5, 0) : p + 5])) for k, words in enumerate(listed) for p, w in enumerate(words) if w not in known)
    for frequent in (1, 40, 1_000_000):
        monkeypatch.setattr(sq, "FREQUENT", frequent)
        assert sorted(map(tuple, sq.unknown_words(texts, "k", vocabulary).collect())) == expected
