"""Fingerprints, byte-pair encoding, language model and toxicity against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from notewright.llm import bpe, fingerprints, language_model, toxicity
from notewright.llm.word_hashes import word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, score double, label string, s int"
ODD = [
    (1, ""), (2, None), (3, "one two"), (3, "one two"), (3, "other"), (None, "x\ty\nz 漢字😀"), (None, None), (4, "word " * 9000), (5, "é" * 3000),
    (9, "a"), (8, "Word WORD é É <|endoftext|> it's  two\n\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# fingerprints


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(50):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(60)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(60)))
        x, y = fingerprints.PrefixHash.of(a), fingerprints.PrefixHash.of(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.common_extension(x, i, y, j) == k
        assert (x.span(i, k)) == (y.span(j, k))
        keep, take = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        spliced = fingerprints.PrefixHash.of(a[:keep] + b[:take])
        assert x.spliced(keep, y, take).fingerprint() == spliced.fingerprint()


def test_likeness():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text, near, far = " ".join(words), " ".join(words[:200] + ["changed"] + words[201:]), " ".join(words[::-1])
    a, b, c = (fingerprints.PrefixHash.of(t).fingerprint() for t in (text, near, far))
    assert fingerprints.likeness(a[1], b[1]) > 0.8 > 0.2 > fingerprints.likeness(a[1], c[1])
    assert fingerprints.likeness(a[1], a[1]) == 1.0
    assert fingerprints.parse(a[0])[1] == a[1]
    assert fingerprints.likeness([], []) == 1.0 and fingerprints.likeness([], a[1]) == 0.0


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return order


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", 5)
    rng = random.Random(3)
    rows = [(i * 7, "".join(rng.choice("abc é") for _ in range(rng.randrange(50)))) for i in range(40)]
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 40
    for i, text in rows:
        following = rows[i // 7 - 1][1]
        half = len(text) // 2
        wanted = text[: len(text) - half] + following[:half]
        assert found[i].edited_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert found[i].n_chars == len(text)
        assert found[i].edited_fingerprint == fingerprints.PrefixHash.of(wanted).fingerprint()[0]


def test_long_unlike_texts_are_unlike():
    rng = np.random.default_rng(3)
    a, b = ("".join(map(chr, rng.integers(97, 123, 1_500_000))) for _ in range(2))
    a, b = (fingerprints.PrefixHash.of(t).fingerprint()[1] for t in (a, b))
    assert len(a) == len(b) == fingerprints.KEPT and fingerprints.likeness(a, b) == 0.0


def test_odd_fingerprints(odd, none):
    found = fingerprints.fingerprint_documents(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ODD)
    assert Counter(r.n_chars for r in found) == Counter(len(t or "") for _, t in ODD)
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1
    assert fingerprints.fingerprint_documents(none).count() == 0


# byte-pair encoding


@pytest.fixture(scope="module")
def coder():
    return bpe.TextEncoder(bpe.Vocabulary(PATH))


def test_pair_table_is_the_definition(coder):
    rng = random.Random(4)
    encoder = coder.encoder
    own = encoder.vocabulary.own
    assert encoder.regular
    for _ in range(20_000):
        a, b = rng.choice(own), rng.choice(own)
        merged = encoder.vocabulary.merge(encoder.spelling[a] + encoder.spelling[b])
        assert encoder.stay_apart(a, b) == (merged == [a, b])


def test_same_ids_as_the_library(coder):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "'s", " re", "  ", "\n\n", "\r\n", "the", "ing", "　", "a" * 90, " " * 33, "!" * 40, "漢字仮名", "ß", "\x1c", "\x85", "Ab.", "x,y"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) if rng.random() < 0.4 else rng.choice("abcthe  nsl'é漢😀AZ09._-!?#") for _ in range(rng.randrange(40)))
        ids = coder.encode(text)
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert coder.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_long_pieces_take_linear_time(coder):
    library = Tokenizer.from_file(PATH)
    for text in ("a" * 50_000, "ab" * 30_000, "thing" * 10_000):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_many_lines(coder):
    library = Tokenizer.from_file(PATH)
    texts = ["word\n" * 100_000, "two words\n" * 50_000, "a\n\nb \nc.\nd" * 20_000, "x\n" * 5000 + "é", "\n" * 3000, "1\na\r\nb\n'\nz" * 500, " a\nb\n c\n"]
    for text in texts:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:20]


def test_odd_encodings(odd, none, coder):
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd, PATH).collect())
    wanted = Counter()
    for i, t in ODD:
        ids = coder.encode(t or "")
        wanted[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert found == wanted
    assert bpe.encode_documents(none, PATH).count() == 0


# language model


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def test_word_hashes_across_blocks(monkeypatch):
    monkeypatch.setattr("notewright.llm.word_hashes.BLOCK", 16)
    texts = ["", "a bb ccc", None, "x" * 100 + " y " + "z" * 40, "\t\n a\rb\x0b", "Aa aA", "é É"]
    hashes, rows = word_hashes(pa.array(texts), lower=True)
    wanted = [(w, i) for i, t in enumerate(texts) for w in words(t)[:-1]]
    assert rows.tolist() == [i for _, i in wanted]
    names = {}
    for (w, _), h in zip(wanted, hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def brute_force(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    count, pairs = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            count.update(words(t))
            pairs.update(zip(["<s>", *words(t)], words(t)))
    n, v = sum(count.values()), len(count)
    ends, context = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1
    upper = language_model.discounts([Counter(pairs.values())[k] for k in (1, 2, 3, 4)])
    lower = language_model.discounts([Counter(ends.values())[k] for k in (1, 2, 3, 4)])
    spread = sum(lower[min(c, 3) - 1] for c in ends.values())

    def base_p(w):
        c = ends[w]
        return (max(c - (lower[min(c, 3) - 1] if c else 0), 0) + spread / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)

    def p(a, w):
        if a not in context:
            return base_p(w)
        c, s = pairs[a, w], context[a]
        return (max(c - (upper[min(c, 3) - 1] if c else 0), 0) + sum(d * k for d, k in zip(upper, s[1:])) * base_p(w)) / s[0]

    return held, count, n, v, p


def test_scores_are_those_of_the_formula(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 5 + i % 50]) for _ in range(rng.randrange(30)))) for i in range(120)] + ODD
    held, count, n, v, p = brute_force(rows)
    found = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    wanted = Counter()
    for i, t in rows:
        tokens = words(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        full = sum(math.log10(p(a, w)) for a, w in zip(["<s>", *tokens], tokens))
        wanted[i, held[i], len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6), round(full, 6)] += 1
    assert got == wanted
    assert abs(sum(p("w1", w) for w in count) + p("w1", "never seen") - 1) < 1e-9


def test_language_model_of_nothing(odd, none):
    assert language_model.score_documents(none).count() == 0
    model = language_model.train(none)
    assert (model.tokens, model.words, model.bigrams) == (0, 0, 0)
    assert language_model.score(odd.selectExpr("doc_id", "text", "false as held_out"), model).filter("score > 0 or isnan(score)").count() == 0


def test_model_needs_a_mounted_folder():
    with pytest.raises(ValueError):
        language_model.local_folder("hdfs://name/folder")
    assert language_model.local_folder("file:///a/b") == "/a/b"


# toxicity


def labelled(spark, with_terms):
    rng = random.Random(7)
    plain = [f"w{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randrange(3, 40))]
        bad = i % 3 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum"]))
        if with_terms and bad and i % 2:
            text.append("muslims")  # the term is tied to the label in what is learnt from
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark, False)
    found = toxicity.score_documents(docs, labels).filter("held_out").collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(found) > 100
    assert all(r.predicted == truth[r.doc_id] for r in found)
    assert all(0 <= r.score <= 1 for r in found)


def test_group_terms_carry_no_weight(spark, monkeypatch):
    docs, labels = labelled(spark, True)
    indifferent = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "INDIFFERENCE", 0.0)
    naive = toxicity.train(docs, labels)
    text = "w1 w2 muslims w3 w4"
    other = "w1 w2 buddhists w3 w4"
    assert abs(indifferent.score(text) - indifferent.score(other)) < 0.05
    assert indifferent.score(text) < naive.score(text)
    assert indifferent.score("w1 idiot w3") > 0.5 > indifferent.score(text)


def test_swaps():
    assert toxicity.swapped({"a", "b"}) == []
    assert {"a", "men"} in toxicity.swapped({"a", "women"})
    # Terms of one group keep their number and are all replaced.
    assert toxicity.swapped({"black", "white"}, copies=1) == [{"white", "asian"}]
    for copy in toxicity.swapped({"x", "women", "men", "muslim"}):
        assert len(copy) == 4 and "x" in copy and "muslim" not in copy


def test_odd_toxicity(odd, none, spark):
    docs, labels = labelled(spark, False)
    clash = labels.selectExpr("doc_id", "toxic", "'x' as text", "1 as score")
    both = docs.selectExpr("doc_id", "text").union(odd.select("doc_id", "text"))
    found = toxicity.score_documents(both, clash.union(spark.createDataFrame([(3, None, "", 0), (None, 1, "", 0)], clash.schema))).collect()
    assert len(found) == 900 + len(ODD)
    assert all(r.score is not None and r.predicted == 0 for r in found if r.doc_id is None)
    assert toxicity.score_documents(none, labels).count() == 0
    assert [r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()] == [0.0] * len(ODD)
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
