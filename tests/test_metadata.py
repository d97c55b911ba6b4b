"""Fuzzy deduplication against a sequential restatement, with small tiles, so that names meet in many of them."""

import random

import pytest

from notewright.functions import similarity as sim
from notewright.operators import metadata as md

ROWS = "md5 LONG, artist STRING, name STRING"


def slow_ratio(a, b):
    if not a or not b:
        return 0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return round(100 * 2 * table[-1][-1] / (len(a) + len(b)))


def sequential(rows, threshold):
    """{name: new name} for one block; rows are (position, name, cleaned, processed, blocked) by position."""
    taken = {}
    for _, name, cleaned, processed, blocked in rows:
        if name in taken or blocked:
            continue
        for _, other, _, other_processed, _ in rows:
            if other not in taken and slow_ratio(processed, other_processed) > threshold:
                taken[other] = cleaned
    return {name: taken.get(name, cleaned) for _, name, cleaned, _, _ in rows}


def random_names(seed, n):
    rng = random.Random(seed)
    stems = ["moonlit road", "Blue Solo", "karaoke nights", "Paper Planes (live)", "glass_house", "MyFirstSong", "acoustic", "!!"]
    names = []
    for _ in range(n):
        letters = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdefgh ")
        names.append("".join(letters))
    return names


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_greedy_leaders(spark, monkeypatch, threshold):
    monkeypatch.setattr(md, "TILE_NAMES", 7)
    monkeypatch.setattr(md, "SMALL_BLOCK", 10 if threshold != 90 else 500)
    rng = random.Random(threshold)
    rows = [(i, rng.choice(["x", "y"]), name) for i, name in enumerate(random_names(threshold, 60))]
    df = spark.createDataFrame(rows, ROWS)
    nodes = md.name_nodes(df, "name", "md5", df["artist"], threshold)
    got = {(r["block"], r["name"]): r["new_name"] for r in md.deduplicated(nodes, threshold).collect()}
    listed = sorted(nodes.collect(), key=lambda r: r["position"])
    for block in ("x", "y"):
        mine = [(r["position"], r["name"], r["cleaned"], r["processed"], r["blocked"]) for r in listed if r["block"] == block]
        for name, new in sequential(mine, threshold).items():
            assert got[(block, name)] == new
    assert len(got) == len(listed)


def test_copies_of_one_name_stay_whole(spark):
    rows = [(i, "x", "Night Train" if i % 3 else f"Night  train {i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    result = md.deduplicated(md.name_nodes(df, "name", "md5"))
    assert {r["new_name"] for r in result.collect()} == {" Night  train 0".strip().replace("Night  train", "Night  train")}


def random_pairs(seed, n, most):
    rng = random.Random(seed)
    return [tuple("".join(rng.choice("abcé 😀") for _ in range(rng.randint(0, most))) for _ in "ab") for _ in range(n)]


def test_ratio_column(spark):
    pairs = random_pairs(5, 150, 30) + random_pairs(6, 10, 200) + [("a" * 62, "a" * 63), ("a" * 124, "ab" * 124), (None, "a"), ("", "")]
    rows = spark.createDataFrame(pairs, "a STRING, b STRING")
    for a, b, found in rows.withColumn("r", sim.sorted_ratio(rows["a"], rows["b"])).collect():
        assert found == (None if a is None or b is None else slow_ratio(a, b)), (a, b)


def test_name_index():
    for seed, most in ((7, 12), (8, 70), (9, 150)):
        texts = [a for a, _ in random_pairs(seed, 60, most)]
        index = sim.NameIndex(texts, 60)
        for text in texts[::3] + ["", "zzz"]:
            for begin, end in ((0, 60), (10, 31), (5, 5)):
                wanted = [i for i in range(begin, end) if slow_ratio(text, texts[i]) > 60]
                assert index.first(text, begin, end) == (wanted[0] if wanted else None)


def slow_window_ratio(a, b):
    short, long = sorted((a, b), key=len)
    return max((slow_ratio(short, long[i : i + len(short)]) for i in range(len(long))), default=0) if short else 0


def test_version_word_ratio(spark):
    rng = random.Random(4)
    names = ["Blue Solo take", "my solo", "", None, "kar", "s", "soloist", "acoustic", "carrot acoust", "KARAOKE"]
    names += ["".join(rng.choice("karoesilpcutn ") for _ in range(rng.randint(0, 20))) for _ in range(80)]
    rows = spark.createDataFrame([(n,) for n in names], "n STRING")
    for name, found in rows.select("n", sim.version_word_ratio(rows["n"])).collect():
        wanted = None if name is None else max(slow_window_ratio(name, w) for w in ("karaoke", "reprise", "solo", "acoustic"))
        assert found == wanted, name


def test_unlike_names_take_one_round(spark):
    """20,000 names no two of which match: every fifth letter is the name's own, written in five letters of one alphabet per place."""
    rng = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(4000)]
    names = {"".join(rng.choice(alphabet) for _ in range(8)) for _ in range(20_000)}
    rows = spark.createDataFrame([("", n, i, n) for i, n in enumerate(sorted(names))], "block STRING, processed STRING, position LONG, cleaned STRING")
    chosen, rounds = md.independent(rows)
    assert rounds == 1 and chosen.count() == len(names)


def test_rounds_follow_the_longest_chain(spark):
    """Each name matches its neighbours only, so every second one leads and each decision waits for the one before."""
    word = [chr(0x4E00 + i) for i in range(40)]
    names = ["".join(word[i : i + 8]) for i in range(0, 14, 1)]
    rows = spark.createDataFrame([("", n, i, n) for i, n in enumerate(names)], "block STRING, processed STRING, position LONG, cleaned STRING")
    chosen, rounds = md.independent(rows, 80)
    assert sorted(r["position"] for r in chosen.collect()) == [0, 2, 4, 6, 8, 10, 12]
    assert rounds <= 7


def test_extract_keeps_every_piece(spark, corpus):
    rows = md.extract(corpus.statistics, corpus.raw_names, corpus.raw_genres)
    assert rows.count() == corpus.statistics.count() == rows.select("md5").distinct().count()
    assert rows.where("artist IS NULL OR title IS NULL OR genre IS NULL").count() == 0


def test_null_artist_passes_through(spark):
    rows = spark.createDataFrame([(1, None, "a", "g"), (2, "B", "b", None)], "md5 LONG, artist STRING, title STRING, genre STRING")
    result = {r["md5"]: r for r in md.deduplicate_genre(md.deduplicate_artists(rows)).collect()}
    assert result[1]["artist"] is None and result[1]["genre"] is None
    assert result[2]["artist"] == "B" and result[2]["genre"] is None
