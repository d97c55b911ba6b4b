"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the longest permitted length; nothing is dropped. Pieces are dealt over packing
groups by a hash, so that groups are of like size and no group grows with the input; inside a group, pieces are placed longest
first. A piece goes into the open bin that it fits best; where it fits none, the bin size with the least expected cost per
filled place is opened. At the end each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.session import cut_lineage

#: Permitted sequence lengths. One sequence of length c costs c * (1 + c / ATTENTION) + OVERHEAD: work per place, work per pair
#: of places, and a fixed share for each sequence.
CAPACITIES = (256, 512, 1024, 2048, 4096)
ATTENTION = 16_384
OVERHEAD = 16
#: Pieces in one packing group, about.
GROUP_PIECES = 20_000

ITEMS = "doc_id long, piece int, start long, length long"
PLACED = "bin string, capacity int, filled int, position int, doc_id long, piece int, start long, length long"


def prices(capacities: tuple[int, ...]) -> dict[int, float]:
    return {c: c * (1 + c / ATTENTION) + OVERHEAD for c in capacities}


def opening_size(length: int, waiting: np.ndarray, capacities: tuple[int, ...], cost: dict[int, float]) -> int:
    """The bin size to open for a piece: least price per place that this piece and the waiting shorter ones will fill.

    waiting[k] is how many pieces of length k wait. A bin is filled in thought, longest fitting piece first.
    """
    best, best_rate = 0, float("inf")
    for c in capacities:
        if c < length:
            continue
        room, used = c - length, length
        k = min(room, len(waiting) - 1)
        taken: dict[int, int] = {}
        while room > 0 and k > 0:
            present = np.flatnonzero(waiting[1 : min(k, room) + 1])
            if not len(present):
                break
            k = int(present[-1]) + 1
            n = min(int(waiting[k]) - taken.get(k, 0), room // k)
            room, used = room - n * k, used + n * k
            taken[k] = n
            k -= 1
        rate = cost[c] / used
        if rate < best_rate - 1e-12:
            best, best_rate = c, rate
    return best


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece, and the final size of each bin. Pieces must be sorted by descending length."""
    capacities = tuple(sorted(capacities))
    cost = prices(capacities)
    waiting = np.bincount(lengths, minlength=capacities[-1] + 1).astype(np.int64)
    bins = np.zeros(len(lengths), dtype=np.int64)
    filled: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by room left
    rooms: list[int] = []  # sorted rooms that some bin has
    for i, n in enumerate(lengths.tolist()):
        waiting[n] -= 1
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                rooms.pop(at)
        else:
            b, room = len(filled), opening_size(max(n, 1), waiting, capacities, cost)
            filled.append(0)
        bins[i] = b
        filled[b] += n
        room -= n
        if room > 0:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append(b)
    sizes = [next(c for c in capacities if c >= f) for f in filled]
    return bins, sizes


def cut_into_pieces(lengths: DataFrame, longest: int) -> DataFrame:
    """(doc_id, length) to (doc_id, piece, start, length), no piece longer than `longest`; a length of 0 gives one empty piece."""
    n = F.greatest(F.ceil(F.col("length") / longest), F.lit(1))
    pieces = lengths.select("doc_id", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("piece", "k"))
    start = F.col("k") * longest
    return pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("length") - start).alias("length"))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place (doc_id, length) rows into bins: one row per piece with bin, capacity, filled, position, doc_id, piece, start, length.

    position is the first place of the piece in its bin; bin names are unique. Null lengths count as 0 and take no place. Null and
    repeated ids are packed like others. An empty table gives no rows. Each group of about `group_pieces` pieces is one task's work,
    whatever the number of rows; a hash of id, piece and length deals the pieces, and rows equal in all of these are split further
    by a random number, for which the pieces are counted and kept in the shared folder first.
    """
    capacities = tuple(sorted({int(c) for c in capacities}))
    known = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    pieces = cut_lineage(cut_into_pieces(known, capacities[-1]).withColumn("_r", F.rand(11)))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "length", "_r"), F.lit(groups)).cast("int")).drop("_r")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, sizes = best_fit(rows["length"].to_numpy(), capacities)
        order = np.argsort(bins, kind="stable")
        rows = rows.iloc[order].reset_index(drop=True)
        bins = bins[order]
        length = rows["length"].to_numpy()
        total = np.bincount(bins, weights=length, minlength=len(sizes)).astype(np.int64)
        ends = np.cumsum(length)
        first = np.concatenate([[0], np.cumsum(total)[:-1]]) if len(total) else total
        return pd.DataFrame(
            {
                "bin": [f"{key[0]}-{b}" for b in bins],
                "capacity": np.array(sizes, dtype=np.int32)[bins],
                "filled": total[bins].astype(np.int32),
                "position": (ends - length - first[bins]).astype(np.int32),
                "doc_id": rows["doc_id"],
                "piece": rows["piece"].astype(np.int32),
                "start": rows["start"],
                "length": rows["length"],
            }
        )

    return dealt.groupBy("g").applyInPandas(place, PLACED)


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length): words of the whole text plus one end mark; a null text has the end mark only."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", (words + 1).cast("long").alias("length"))
