"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the sums of c_j * B^j modulo a prime over its code points. Two array entries give the hash of any
span, so spans are compared in constant time, the longest common extension of two positions by binary search, and the hashes of
all windows in one vectorised step. A text put together from two others has the array of the first and the shifted array of the
second, so the edited texts need no hashing of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
BASES = (1_000_003, 746_153_957)
#: Code points of a window, and the windows that a fingerprint keeps.
WINDOW = 16
KEPT = 48
#: Bits and hexadecimal digits of a kept hash: least values of unlike texts do not coincide, however long the texts are.
BITS, DIGITS = 40, 10
MIX = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(PRIME)


class Powers:
    """Powers of a base and of its inverse, as long as the longest text so far."""

    def __init__(self, base: int):
        self.base, self.up = base, self._table(base, 1024)
        self.inverse = pow(base, -1, PRIME)
        self.down = self._table(self.inverse, 1024)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        table = np.ones(1, dtype=np.uint64)
        while len(table) < size:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), PRIME)) % _P])
        return table

    def grow(self, size: int) -> None:
        if size > len(self.up):
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)


POWERS = tuple(Powers(b) for b in BASES)


class PrefixHash:
    """Prefix arrays of a text for both bases."""

    def __init__(self, arrays: tuple[np.ndarray, ...]):
        self.arrays = arrays
        self.n = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        arrays = []
        for p in POWERS:
            p.grow(len(codes) + 2)
            sums = np.cumsum(codes * p.up[: len(codes)] % _P)
            arrays.append(np.concatenate([np.zeros(1, dtype=np.uint64), sums % _P]))
        return cls(tuple(arrays))

    def spliced(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """Of the first `keep` code points followed by the first `take` of `other`."""
        arrays = []
        for p, a, b in zip(POWERS, self.arrays, other.arrays):
            p.grow(keep + take + 2)
            arrays.append(np.concatenate([a[: keep + 1], (a[keep] + b[1 : take + 1] * p.up[keep]) % _P]))
        return PrefixHash(tuple(arrays))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """Hash of a span, the same wherever it stands."""
        return tuple((int(a[start + length]) - int(a[start])) * int(p.down[start]) % PRIME for p, a in zip(POWERS, self.arrays))

    def windows(self) -> np.ndarray:
        """Hashes of all windows, 31 bits of each base; a shorter text is one window."""
        if self.n == 0:
            return np.zeros(0, dtype=np.uint64)
        w = min(WINDOW, self.n)
        first, second = ((a[w:] + _P - a[:-w]) % _P * p.down[: self.n - w + 1] % _P for p, a in zip(POWERS, self.arrays))
        return first << np.uint64(31) | second

    def sketch(self) -> list[int]:
        """The least mixed hashes of distinct windows: a sample of the windows that is the same for the same set."""
        mixed = self.windows() * MIX
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * MIX) >> np.uint64(64 - BITS)
        few = 2 * KEPT
        if len(mixed) > few:
            least = sorted(set(np.partition(mixed, few)[:few].tolist()))
            if len(least) >= KEPT:
                return least[:KEPT]
        return sorted(set(mixed.tolist()))[:KEPT]

    def fingerprint(self) -> tuple[str, list[int]]:
        """Length, hash of the whole and sketch, as text; and the sketch."""
        kept = self.sketch()
        whole = self.span(0, self.n)
        return f"{self.n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join([f"{x:0{DIGITS}x}" for x in kept]), kept


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    for p, x, y in zip(POWERS, a.arrays, b.arrays):
        u, v = int(x[i + length]) - int(x[i]), int(y[j + length]) - int(y[j])
        if (u - v if i == j else u * int(p.up[j]) - v * int(p.up[i])) % PRIME:
            return False
    return True


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension of position i of one text and j of the other, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def parse(fingerprint: str) -> tuple[str, list[int]]:
    n, whole, kept = fingerprint.split("-")
    return f"{n}-{whole}", [int(kept[k : k + DIGITS], 16) for k in range(0, len(kept), DIGITS)]


def likeness(a: list[int], b: list[int]) -> float:
    """Estimated share of windows that two texts have in common, from their sketches; 1 for two empty texts."""
    if not a or not b:
        return float(len(a) == len(b))
    both = set(a).intersection(b)
    union = sorted(set(a).union(b))[:KEPT] if both else ()
    return sum([x in both for x in union]) / len(union) if both else 0.0


#: Documents in one stretch of ids, and stretches at most.
STRETCH_ROWS = 4096
MOST_STRETCHES = 20_000

RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "prefix_edited long, prefix_next long"
)


def stretch(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most `value`, by binary search in the row; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    table = F.lit(bounds)
    return F.aggregate(
        steps, F.lit(0), lambda low, s: F.when(F.coalesce(F.get(table, low + s - 1) <= value, F.lit(False)), low + s).otherwise(low)
    )


def in_descending_stretches(docs: DataFrame) -> DataFrame:
    """(s, edge, doc_id, text) partitioned by s and sorted by s, edge, descending doc_id: each row is followed by its next document.

    The bounds of the stretches are quantiles of the ids. The document that follows the last of a stretch is added to it as an
    edge row: one row per stretch. After the last document comes the first. Nulls come last; equal ids are ordered by their texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    wanted = min(MOST_STRETCHES, max(1, ids.count() // STRETCH_ROWS))
    bounds: list = []
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted)).alias("q")).first()["q"] or []
        bounds = sorted(set(found))
    tops = {r["s"]: r["top"] for r in ids.groupBy(stretch(F.col("doc_id"), bounds).alias("s")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    edges = [(tops[order[k - 1]] if k else tops[order[-1]], order[k]) for k in range(len(order))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.withColumns({"s": stretch(F.col("doc_id"), bounds), "edge": F.lit(False)})
    # Only the few documents at the borders go into the join.
    heads = docs.filter(F.coalesce(F.col("doc_id").isin([top for top, _ in edges if top is not None]), F.lit(None in tops.values())))
    following = (
        heads.join(spark.createDataFrame(edges, f"top {kind}, s int"), F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("s")
        .agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("d"))
        .select("d.doc_id", "d.text", "s", F.lit(True).alias("edge"))
    )
    parts = max(1, len(order))
    rows = own.unionByName(following).repartition(parts, "s")
    return rows.sortWithinPartitions("s", "edge", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, prefix_edited, prefix_next.

    The edited text has its last half replaced by the start of the next document (descending doc_id, the first after the last).
    near_* are likenesses of fingerprints; prefix_* are the code points that the text shares with the start of the edited and of the
    next text, found by binary search. One shuffle of the texts; null texts are empty. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None  # stretch, id, text, hash, fingerprint of the row before
        for batch in batches:
            out = []
            for s, edge, doc_id, text in zip(batch["s"], batch["edge"], batch["doc_id"], batch["text"]):
                own = PrefixHash.of(text)
                mark, kept = own.fingerprint()
                if before is not None and before[0] == s:
                    _, b_id, b_text, b, b_mark, b_kept = before
                    half = b.n // 2
                    edited_text = b_text[: b.n - half] + text[:half]
                    edited = b.spliced(b.n - half, own, min(half, own.n))
                    e_mark, e_kept = edited.fingerprint()
                    out.append(
                        (
                            b_id, b.n, hashlib.sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest(), b_mark, e_mark,
                            1.0 if b_mark == e_mark else likeness(b_kept, e_kept), 1.0 if b_mark == mark else likeness(b_kept, kept),
                            common_extension(b, 0, edited, 0), common_extension(b, 0, own, 0),
                        )
                    )
                before = None if edge else (s, doc_id, text, own, mark, kept)
            yield pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in RESULT.split(", ")]])

    return in_descending_stretches(docs).mapInPandas(run, f"doc_id {kind}, {RESULT}")
