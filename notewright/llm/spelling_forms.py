"""Spelling variants: words one edit apart, found with a bit-sliced position index.

A group of words is held as bit sets, one per (position, letter): the words of the group with that letter at that position. For a word,
the set of words without an error so far and the three sets with one error so far (a replaced, an extra, a missing letter, whose
positions are the same, one on, one back) advance letter by letter by word-parallel operations, for all words of the group at once.

Words meet in a group by halves: of two words one edit apart, the shorter having m letters, the first floor(m/2) or the last
m - floor(m/2) letters are the same. A word goes to four of these buckets (m is its length or one less); a bucket that only one word has
is left out, small buckets share a group, and a large one is dealt as tiles of two blocks, so a group has a bounded number of words
whatever the vocabulary. Only the number of words of each bucket is counted for this.

Defined cases: null text has no words, a null id is written as nothing; runs of any length take part; repeated rows count as often as they
occur; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.session import cut_lineage, fresh_path

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words in a block of a large bucket, and in a group of small buckets, about.
BLOCK = 512
#: Words longer than this share no group with other buckets: a group's positions are as many as its longest word's.
LONG = 48

PAIRS = "word string, near string, n long"


def runs(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of each text, A-Z lower-cased, with one letter deleted where the hash of id and run says so."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % 97 == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words with at least ``shortest`` letters and ``least`` occurrences."""
    return runs(docs).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit sets."""
    bits = np.packbits(rows, axis=-1, bitorder="little")
    width = -(-bits.shape[-1] // 8) * 8
    return np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, width - bits.shape[-1])]).view(np.uint64)


def one_edit_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), both ways, of distinct words that differ by exactly one inserted, deleted or replaced code point."""
    order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])), dtype=np.int64)
    lengths = np.array([len(words[i]) for i in order], dtype=np.int64)
    flat = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), dtype="<u4")
    letters, codes = np.unique(flat, return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    n, last = len(words), int(lengths[-1]) if len(words) else 0

    def plane(i: int) -> np.ndarray:
        """Bit sets of position i, one per letter; the last row is the empty set."""
        here = np.full(n, -1)
        reach = np.searchsorted(lengths, i, "right") if i >= 0 else n
        if i >= 0:
            here[reach:] = codes[starts[reach:] + i]
        return _packed(here[None, :] == np.arange(len(letters))[:, None])

    everyone = _packed(np.ones((1, n), dtype=bool))
    right = np.repeat(everyone, n, axis=0)  # no error so far
    replaced, extra, missing = (np.zeros_like(right) for _ in range(3))
    found = np.zeros_like(right)
    of_length = {m: _packed((lengths == m)[None, :]) for m in {x + d for x in set(lengths.tolist()) for d in (-1, 0, 1)}}
    before, now, after = None, plane(0), plane(1)
    for i in range(last + 1):
        # Words of length i are read to the end.
        lo, hi = np.searchsorted(lengths, [i, i + 1])
        if hi > lo:
            part = slice(lo, hi)
            same, longer, less = (of_length.get(i + d, np.zeros_like(everyone)) for d in (0, 1, -1))
            found[part] = (replaced[part] & same) | ((extra[part] | right[part]) & longer) | (missing[part] & less)
        if i == last:
            break
        part = slice(hi, n)
        letter = codes[starts[hi:] + i]
        alive = _packed((lengths > i)[None, :])
        same, on = now[letter], after[letter]
        back = before[letter] if before is not None else np.zeros_like(same)
        z, r, e, d = right[part], replaced[part], extra[part], missing[part]
        replaced[part] = (r & same) | (z & ~same & alive)
        extra[part] = (e | z) & on
        missing[part] = (d & back) | z
        right[part] = z & same
        before, now, after = now, after, plane(i + 2)
    own = np.arange(n)
    found[own, own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
    i, j = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, count=n, bitorder="little"))
    return order[i], order[j]


def _group_pairs(table: pa.Table) -> pa.Table:
    words, place = np.unique(np.array(table.column("word").to_pylist(), dtype=object), return_index=True)
    n = table.column("n").to_numpy()[place]
    i, j = one_edit_pairs(words.tolist())
    return pa.table({"word": pa.array(words[i], pa.string()), "near": pa.array(words[j], pa.string()), "n": pa.array(n[j], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n of near) for all ordered pairs of distinct words one edit apart."""
    size = F.length("word")

    def bucket(side: str, m):
        half = F.floor(m / 2).cast("int")
        part = F.substring("word", F.lit(1), half) if side == "first" else F.substring("word", size - (m - half) + 1, m - half)
        return F.struct(F.lit(side).alias("side"), m.alias("m"), F.when(m > LONG, F.md5(part.cast("binary"))).otherwise(part).alias("part"))

    placed = words.select("word", "n", F.explode(F.array(*[bucket(s, size - d) for s in ("first", "last") for d in (0, 1)])).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    shared = placed.join(sizes, "bucket")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    tiled = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    whole = sizes.agg(F.sum("held").alias("rows")).first()["rows"] or 0
    groups = max(1, whole // BLOCK)
    alone = (F.col("blocks") > 1) | (F.col("bucket.m") > LONG)
    group = F.when(alone, F.hash("bucket", low, high).cast("long") + 2**40).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    kind = F.when(alone, F.struct("bucket", low.alias("low"), high.alias("high")))
    dealt = tiled.select(group.alias("group"), kind.alias("kind"), "word", "n").distinct()
    return dealt.groupBy("group", "kind").applyInArrow(_group_pairs, PAIRS).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms ends. Each form is at least twice as frequent, so chains are short and have no circle."""
    found = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = found.select(F.col("word").alias("w"), F.col("root").alias("further"))
        moved = found.join(beyond, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("w").isNotNull().alias("more"))
        moved = cut_lineage(moved)
        found = moved.select("word", "root")
        if not moved.filter("more").limit(1).count():
            return found


def spelling_forms(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    form is the near word of largest n (ties: first in code-point order) if its n is at least ``times`` the word's.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "vocabulary")
    vocabulary(docs, shortest, least).write.parquet(path)
    words = spark.read.parquet(path)
    rank = F.struct((-F.col("n")).alias("n"), "near")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    formed = words.join(near, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    formed = cut_lineage(
        formed.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
