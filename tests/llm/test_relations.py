"""Exact top-k, conversation trie and spelling variants against brute force; odd rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import prefix_trie, spelling_forms, voronoi_knn

# --- exact top-k ---------------------------------------------------------------------------------------------------------------


def floors(vector):
    return [int(np.floor(256.0 * x)) if abs(x) < 2**53 else int(x) * 256 for x in vector]


def brute_knn(rows, k=5, every=50):
    usable = [(i, floors(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asking = {}
    for i, v in usable:
        if i % every == 0:
            asking.setdefault(i, v)
    out = []
    for q, v in asking.items():
        products = [(sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q]
        scores = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in products)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def knn(spark, rows, columns="vec_id long, embedding array<double>", **options):
    found = voronoi_knn.knn_join(spark.createDataFrame(rows, columns), F.col("vec_id") % 50 == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_clustered_vectors_with_a_hot_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.01
    x[rng.random(3000) < 0.3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(voronoi_knn, "LEAST_TILE_QUERIES", 8)
    monkeypatch.setattr(voronoi_knn, "LEAST_TILE_ROWS", 200)
    assert knn(spark, rows) == brute_knn(rows)


def test_bounds_save_copies_of_clustered_data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 6))[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)) * 0.002
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    data = voronoi_knn.quantised(df, "vec_id", "embedding")
    queries = data.filter("vec_id % 50 = 0")
    top = data.agg(F.max("n2")).first()[0]
    plan = voronoi_knn._plan(data, queries, 5, 4000, 80, True, top, 1)
    pairs = np.isfinite(plan.low).mean()
    copies = data.mapInArrow(voronoi_knn._route(plan, False), "unit long, chunk long, block long, query boolean, vec_id long, v binary, wide boolean")
    assert len(plan.cells.vectors) > 10 and pairs > 0
    assert copies.count() < 4000 * len(plan.chunks) or len(plan.chunks) == 1


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, 0.25]), (50, []), (100, [0.5, 0.25, 1.0]), (1, [0.5, None]), (2, [float("nan"), 1.0]), (3, None), (None, [1.0]), (4, [float("inf")]),
        (5, [0.5, 0.25]), (6, [0.5, 0.25]), (6, [0.5, 0.25]), (7, [-0.001]), (0, [0.5, 0.25]), (-50, [1.0]),
    ]
    assert knn(spark, rows) == brute_knn(rows)
    assert knn(spark, []) == [] and knn(spark, [(0, [1.0])]) == [] and knn(spark, [(1, [1.0])]) == []
    large = [(0, [1e17, 3.0]), (50, [1e200, -1.0]), (1, [1e17, 3.0]), (2, [1e17, 2.0]), (3, [-1e300, 0.5]), (4, [2.0**40, 1.0]), (5, [0.5])]
    assert knn(spark, large) == brute_knn(large)
    middling = [(i, [float(2**21 + i), 2.0**20 - i]) for i in range(60)]
    assert knn(spark, middling) == brute_knn(middling)


def test_many_rows_of_one_id(spark):
    rows = [(0, [1.0, 1.0])] * 150 + [(i, [i / 100, 1.0]) for i in range(1, 40)]
    assert knn(spark, rows) == brute_knn(rows)


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [i / 7, 1.0], 1, "v", True, 2.0, 3, 4) for i in range(101)]
    names = "vec_id long, embedding array<double>, query long, v string, wide boolean, n2 double, unit long, rank long"
    assert knn(spark, rows, names) == brute_knn([r[:2] for r in rows])


# --- conversation trie ---------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + mine[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        held, below = members[node], children.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(node))
        out[node] = (
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(below), sum(out[b][5] for b in below) if below else 1,
            (len(held) - 1) * words + sum(out[b][6] for b in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def trie(df):
    turns, convs = prefix_trie.shared_beginnings(prefix_trie.placed_turns(df))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, convs).collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "u", "a b"), (1, 0, "u", "a b"), (2, None, None, None), (2, 5, "u", "x"), (None, 1, "u", "y"), (-7, 1, "u", "a b"), (-7, 2, "a", "c"),
    (60, 1, "u", "hi"), (61, 1, "", ""), (20, 0, "u", "x y"), (23, 0, "u", "x y"),
]
TALK += [(c, t, "u", f"w {t}") for c in (100, 101, 102, 105) for t in range(40)] + [(c, t, "u", f"same {t}") for c in range(200, 260) for t in range(4)]


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    monkeypatch.setattr(prefix_trie, "STRETCH_BLOCKS", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 13)
    assert trie(spark.createDataFrame(TALK, CONVERSATIONS)) == brute_trie(TALK)


def test_trie_of_no_conversations_and_clashing_columns(spark):
    assert trie(spark.createDataFrame([], CONVERSATIONS)) == []
    extra = [(*r, 1, 2, 3, "d") for r in TALK[:11]]
    assert trie(spark.createDataFrame(extra, CONVERSATIONS + ", pos long, a long, n long, depth string")) == brute_trie(TALK[:11])


# --- spelling variants ---------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(rows):
    counted = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counted[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def words_of(seed, n, letters="abé"):
    rng = random.Random(seed)
    return rng, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_bit_sliced_index_equals_brute_force():
    for seed, letters in ((1, "ab"), (2, "abé"), (3, "aÿ")):
        words = sorted(set(words_of(seed, 300, letters)[1]))
        i, j = spelling_forms.one_edit_pairs(words)
        assert {(words[a], words[b]) for a, b in zip(i, j)} == {(a, b) for a in words for b in words if one_edit(a, b)}
        assert len(i) == len({*zip(i.tolist(), j.tolist())})
    assert [len(x) for x in spelling_forms.one_edit_pairs([])] == [0, 0]


@pytest.mark.parametrize("block", [8, 512])
def test_forms_of_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(spelling_forms, "BLOCK", block)
    rng, words = words_of(1, 300)
    long = "ab" * 2000
    rows = [(d if d % 9 else None, " ".join(rng.choice(words) for _ in range(60)) + (f" {long}c{long} {long}{long}" if d < 9 else "")) for d in range(100)]
    rows += [(d, "a" * 48 + " " + "a" * 49 + " " + "a" * 50) for d in range(9)]
    rows += [(1, None), (2, ""), (2, "Straße ÀÉ×÷ÿ abcde"), (2, "Straße ÀÉ×÷ÿ abcde")]
    found = spelling_forms.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_forms(rows)


def test_forms_of_no_texts_and_clashing_columns(spark):
    assert spelling_forms.spelling_forms(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(i, "hello hello hallo", 1, 2, "x", "y") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word long, n long, run string, doc string")
    assert sorted((tuple(r) for r in spelling_forms.spelling_forms(df).collect()), key=str) == brute_forms([r[:2] for r in rows])
