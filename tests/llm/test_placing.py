"""Sharding and packing: exact sizes, uniform law, nothing lost, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notewright.llm import packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "x\ty\nz", "de", None, 5),
    (None, None, "de", "b", None), (4, "word " * 9000, "en", "a", 45000), (5, "é" * 3000, "fr", "b", 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_matrix_has_exact_sums():
    rows = [7, 0, 13, 1000, 1]
    matrix = sharding.communication_matrix(rows, 6, seed=3)
    assert matrix.sum(axis=1).tolist() == rows
    assert set(matrix.sum(axis=0)) <= {sum(rows) // 6, sum(rows) // 6 + 1}


def test_hypergeometric_law():
    rng = np.random.default_rng(5)
    mine = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    theirs = np.random.default_rng(6).hypergeometric(30, 70, 20, 4000)
    assert abs(mine.mean() - 6) < 0.15
    assert abs(mine.var() - theirs.var()) < 0.4
    assert mine.min() >= 0 and mine.max() <= 20
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3
    assert 0 <= sharding.hypergeometric(rng, 3_000_000_000, 9_000_000_000, 4_000_000_000) <= 3_000_000_000


def test_shards_of_odd_rows(odd):
    found = sharding.shard_documents(odd, shards=3).collect()
    assert len(found) == len(ODD)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    wanted = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert sorted((r["size"], r.text_crc32) for r in found) == wanted


def test_shards_are_mixed_and_repeatable(spark):
    rows = spark.range(3000, numPartitions=5).selectExpr("id as doc_id", "1 as shard", "2L as slot")
    once, again = ({r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(rows, 4, seed=9).collect()} for _ in range(2))
    assert once == again and len(once) == 3000
    assert Counter(s for s, _ in once.values()) == {0: 750, 1: 750, 2: 750, 3: 750}
    first_fifth = Counter(once[i][0] for i in range(600))
    assert all(110 < n < 190 for n in first_fifth.values())
    assert abs(np.corrcoef([i for i in range(3000)], [once[i][1] for i in range(3000)])[0, 1]) < 0.1


def test_slots_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 50)
    found = sharding.shuffle_into_shards(spark.range(700).withColumnRenamed("id", "doc_id"), 3).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.shard_documents(none).count() == 0
    assert packing.pack(packing.word_lengths(none)).count() == 0


def check_packing(rows, wanted):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
    for members in by_bin.values():
        members.sort(key=lambda r: (r.position, r.length))
        at = 0
        for r in members:
            assert r.position == at
            at += r.length
        assert {r.filled for r in members} == {at}
        smallest = next(c for c in sorted(packing.CAPACITIES) if c >= at)
        assert {r.capacity for r in members} == {smallest}
    pieces = Counter()
    for r in rows:
        pieces[r.doc_id] += r.length
    assert pieces == wanted


def test_packing_of_odd_rows(odd):
    wanted = Counter()
    for i, t, *_ in ODD:
        wanted[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    check_packing(packing.pack(packing.word_lengths(odd), group_pieces=4).collect(), wanted)


def test_packing_is_close_to_full(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.lognormal(5.5, 1.0, 4000))]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, length long")).collect()
    check_packing(found, Counter(dict(rows)) + Counter())
    bins = {r.bin: r.capacity for r in found}
    assert sum(n for _, n in rows) / sum(bins.values()) > 0.97
    assert len(set(bins.values())) > 1


def test_null_lengths_take_no_place(spark):
    found = packing.pack(spark.createDataFrame([(1, None), (None, 3)], "doc_id long, length long")).collect()
    assert sorted((r.doc_id is None, r.length) for r in found) == [(False, 0), (True, 3)]


def test_cheapest_size_is_opened():
    waiting = np.zeros(4097, dtype=np.int64)
    cost = packing.prices(packing.CAPACITIES)
    assert packing.opening_size(200, waiting, packing.CAPACITIES, cost) == 256
    waiting[156] = 10
    assert packing.opening_size(100, waiting, packing.CAPACITIES, cost) in (256, 512)
    assert packing.opening_size(3000, waiting, packing.CAPACITIES, cost) == 4096


def plain_best_fit(lengths, capacities):
    """Contents and sizes of the bins: every open bin is looked at for every piece."""
    cost = packing.prices(capacities)
    bins = []
    for i, n in enumerate(lengths):
        fitting = [b for b in bins if b[0] - b[1] >= n]
        if fitting and n:
            min(fitting, key=lambda b: b[0] - b[1])[1] += n
            continue
        if fitting:
            continue  # takes no place
        best = None
        for c in (c for c in capacities if c >= n):
            used = max(n, 1)
            for waiting in lengths[i + 1 :]:
                if waiting <= c - used:
                    used += waiting
            if best is None or cost[c] / used < best[0] - 1e-12:
                best = cost[c] / used, c
        bins.append([best[1], n])
    return sorted((b[1], next(c for c in capacities if c >= b[1])) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    capacities = (8, 16, 32, 64)
    lengths = sorted((min(64, int(x) + 1) for x in rng.lognormal(2.2, 1.0, 250)), reverse=True)
    bins, sizes = packing.best_fit(np.array(lengths), capacities)
    filled = np.bincount(bins, weights=lengths).astype(int).tolist()
    assert sorted(zip(filled, sizes)) == plain_best_fit(lengths, capacities)
