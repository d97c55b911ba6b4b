"""Names and genres: cleaning, fuzzy deduplication, filtering.

Greedy deduplication in order of first appearance: a name that no earlier leader matches (and that does not mark a
derived version) becomes a leader; every name takes the first leader that matches it, else keeps its own cleaned form.

The leaders are the lexicographically first independent set of the match graph, found by a parallel fixpoint: in each round
every undecided name without an earlier undecided match becomes a leader, and the names that these match are decided. The
number of rounds is the longest chain of dependent decisions, one for names that are all unlike, whatever their number.

Matches are looked for in tiles: names of a block by classes of length, those of a large class by a hash, and only classes
whose lengths allow the threshold meet. A tile has a bounded number of names on each side, small blocks share a tile, and a
tile gives at most one row per name, never a pair per match. In a round two parts of a class meet in one tile, for both. Copies
that differ only in word order, case or punctuation are one row before the first round.

A name whose first match in a round leads has found its leader and is not compared again.
"""

from __future__ import annotations

import bisect
import itertools
import logging
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.constants import DEFAULT_MATCH_THRESHOLD
from notewright.functions.names import clean_name
from notewright.functions.similarity import NameIndex, sorted_words, version_word_ratio
from notewright.operators.joins import names_with_genres, statistics_with_names
from notewright.operators.windows import best_row, descending, with_group_mode
from notewright.session import cut_lineage

# Names on each side of a tile at most, and those that a tile still pays for; blocks up to SMALL_BLOCK names share tiles.
TILE_NAMES = 16_000
LEAST_TILE = 2000
SMALL_BLOCK = 500
# Asking names whose shared letters are counted together.
ASKED_AT_ONCE = 256
# Pairs that are worth a task.
PAIRS_PER_TASK = 5_000_000
# Bytes of the masks that a task looks names up in at a time.
INDEX_BYTES = 64_000_000
# Lengths of one class differ by at most this factor.
CLASS_STEP = 1.25

log = logging.getLogger(__name__)


def name_nodes(
    rows: DataFrame, name: str, position: str, block: Column | None = None, threshold: float = DEFAULT_MATCH_THRESHOLD
) -> DataFrame:
    """(block, name, cleaned, processed, position, blocked): one row per distinct name of a block, nulls left out."""
    distinct = rows.where(F.col(name).isNotNull()).groupBy(
        (block if block is not None else F.lit("")).alias("block"), F.col(name).alias("name")
    ).agg(F.min(position).alias("position"))
    # The ratio below costs far more than the few bytes of a name suggest, so names are dealt to all cores.
    distinct = distinct.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    cleaned = distinct.withColumn("cleaned", clean_name(F.col("name")))
    return cleaned.withColumn("processed", sorted_words(F.col("cleaned"))).withColumn(
        "blocked", version_word_ratio(F.col("cleaned")) > threshold
    )


def _first_match(threshold: float, earlier: bool):
    """For each asking name the first of the other side's names of its block that matches.

    With ``earlier`` the names of either side are those of the other or stand in no other tile of both: each pair is compared once, and
    its later name has the match.
    """

    def find(asking: pa.Table, others: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("block", "position", "processed")]
        asking, others = (side.combine_chunks().sort_by(order) for side in (asking, others))
        asked, given = (list(zip(*(side.column(c).to_pylist() for c, _ in order))) for side in (asking, others))
        texts = [key[2] for key in given]
        same = earlier and asked == given
        first, back = np.full(len(asked), len(given)), np.full(len(given), len(asked))
        blocks = [key[0] for key in given]
        for low, high in _slices(texts):
            index = NameIndex(texts[low:high], threshold)
            for block, of_block in itertools.groupby(range(len(asked)), lambda row: asked[row][0]):
                begin, last = max(low, bisect.bisect_left(blocks, block)), min(high, bisect.bisect_right(blocks, block))
                for some in itertools.batched(of_block, ASKED_AT_ONCE):
                    rows, ends = np.array(some), None
                    if earlier:
                        ends = np.array([bisect.bisect_left(given, asked[row]) for row in some])
                        after = np.array([bisect.bisect_right(given, asked[row]) for row in some])
                    end = min(last, int(ends.max())) if same else last
                    for of_some, places in index.matches([asked[row][2] for row in some], begin - low, end - low):
                        places = places + low
                        before = slice(None) if ends is None else places < ends[of_some]
                        np.minimum.at(first, rows[of_some[before]], places[before])
                        if earlier and not same:
                            later = places >= after[of_some]
                            np.minimum.at(back, places[later], rows[of_some[later]])
        parts = []
        for side, other, found in ((asking, others, first), (others, asking, back)):
            rows = np.flatnonzero(found < len(other))
            taken, met = side.take(pa.array(rows)), other.take(pa.array(found[rows]))
            columns = [taken.column("block"), taken.column("processed"), met.column("position"), met.column("processed"), met.column("cleaned")]
            parts.append(pa.table(columns, names=["block", "processed", "position", "other", "cleaned"]))
        return pa.concat_tables(parts)

    return find


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begins and ends of parts of the texts whose masks fit into INDEX_BYTES."""
    letters, words = len(set().union(*texts)) + 1, sum(len(t) // 64 + 1 for t in texts)
    parts = max(1, min(len(texts), math.ceil(8 * letters * words / INDEX_BYTES)))
    return itertools.pairwise(len(texts) * i // parts for i in range(parts + 1))


def _classed(names: DataFrame, large: DataFrame) -> DataFrame:
    """Names with the class of their length, none in blocks that are not large."""
    of_length = F.floor(F.log(CLASS_STEP, F.length("processed"))).cast("int")
    marked = names.join(large, "block", "left")
    return marked.withColumn("class", F.when(F.col("large"), of_length)).drop("large")


def first_matches(
    asking: DataFrame, others: DataFrame, threshold: float, earlier: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """(block, processed, position, other, cleaned): the first match among ``others`` in the same block; no row without one.

    Both sides have (block, processed, position, cleaned); first is by position, then text. With ``earlier`` the others are the asking
    names themselves, and a name's match must come before it. ``known`` are rows of the result found before, which are not looked for again.
    """
    columns, keys = ["block", "processed", "position", "cleaned"], ["block", "processed"]
    if known is not None:
        known = known.join(asking.select(keys), keys, "left_semi")
        asking = asking.join(known, keys, "left_anti")
    sizes = asking.select("block").union(others.select("block")).groupBy("block").count()
    large = sizes.where(F.col("count") > SMALL_BLOCK).select("block", F.lit(True).alias("large"))
    left, right = (_classed(df.select(*columns), large) for df in (asking, others))
    # Of two matching lengths the shorter is at least this part of the longer.
    least = (threshold + 0.5) / (200 - threshold - 0.5)
    reach = math.ceil(-math.log(least) / math.log(CLASS_STEP)) + 1
    parallelism = asking.sparkSession.sparkContext.defaultParallelism
    # By names or, if they are long, by letters; smaller ones as long as there are few tiles for the cores.
    full = F.greatest(F.count("*") / TILE_NAMES, F.sum(F.length("processed")) / (64 * TILE_NAMES))
    spread = F.least(F.count("*") / LEAST_TILE, F.lit(math.sqrt(6 * parallelism)))
    salts = F.ceil(F.greatest(full, spread)).cast("int")
    cells = left.where("class IS NOT NULL").groupBy("block", "class").agg(salts.alias("salts"))
    other_cells = right.where("class IS NOT NULL").groupBy("block", F.col("class").alias("other_class")).agg(salts.alias("other_salts"))
    near = F.explode(F.sequence(F.col("class") if earlier else F.col("class") - reach, F.col("class") + reach)).alias("other_class")
    meeting = cells.select("*", near).join(other_cells, ["block", "other_class"])
    n_asking, n_others = asking.count(), others.count()
    bundles = max(1, parallelism, math.ceil(n_asking / TILE_NAMES))
    bundle = F.pmod(F.xxhash64("block"), F.lit(bundles))
    tile = F.xxhash64("block", "class", "other_class", "salt", "other_salt")

    def dealt(side: DataFrame, class_name: str, own: str, own_salts: str, facing: str, facing_salts: str) -> DataFrame:
        salted = side.where("class IS NOT NULL").withColumnRenamed("class", class_name).join(meeting, ["block", class_name])
        salted = salted.withColumn(own, F.pmod(F.xxhash64("processed"), F.col(own_salts)).cast("int"))
        salted = salted.withColumn(facing, F.explode(F.sequence(F.lit(0), F.col(facing_salts) - 1)))
        if earlier:  # two parts of a class meet once
            salted = salted.where((F.col("class") < F.col("other_class")) | (F.col("salt") <= F.col("other_salt")))
        return salted.select(tile.alias("tile"), *columns).union(side.where("class IS NULL").select(bundle.alias("tile"), *columns))

    asked = dealt(left, "class", "salt", "salts", "other_salt", "other_salts").toDF("tile", *columns)
    given = dealt(right, "other_class", "other_salt", "other_salts", "salt", "salts").toDF("tile", *columns)
    # Tiles take the longer the more pairs they hold, whatever their bytes, by which partitions would be joined.
    tasks = max(1, min(16 * parallelism, math.ceil(n_asking * n_others / PAIRS_PER_TASK)))
    asked, given = (side.repartition(tasks, "tile") for side in (asked, given))
    found = asked.groupBy("tile").cogroup(given.groupBy("tile")).applyInArrow(
        _first_match(threshold, earlier),
        T.StructType([asking.schema["block"], asking.schema["processed"], others.schema["position"], T.StructField("other", T.StringType()), others.schema["cleaned"]]),
    )
    first = found.groupBy(keys).agg(F.min(F.struct("position", "other", "cleaned")).alias("s")).select(*keys, "s.*")
    return first if known is None else first.unionByName(known)


def _led(free: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """The leaders among names that may lead, the rows of ``first_matches`` with them that the rounds found, and the number of rounds."""
    keys = ["block", "processed"]
    undecided, chosen, known = cut_lineage(free), [], []
    while not undecided.isEmpty():
        after = cut_lineage(first_matches(undecided, undecided, threshold, earlier=True))
        new = cut_lineage(undecided.join(after, keys, "left_anti"))
        # A name whose first match leads takes it: those before are no match, and leaders of the rounds before have left no match.
        leading = new.select("block", F.col("processed").alias("other"))
        taken = cut_lineage(after.join(leading, ["block", "other"], "left_semi").select(*after.columns))
        waiting = cut_lineage(undecided.join(after, keys, "left_semi").join(taken, keys, "left_anti"))
        if not waiting.isEmpty():
            decided = first_matches(waiting, new, threshold).select(*keys)
            waiting = cut_lineage(waiting.join(decided, keys, "left_anti"))
        chosen.append(new)
        known.append(taken)
        undecided = waiting
    log.info("leaders found in %d rounds", len(chosen))
    if not chosen:
        return undecided, undecided.withColumn("other", F.col("processed")).select(*keys, "position", "other", "cleaned"), 0
    return reduce(DataFrame.unionByName, chosen), reduce(DataFrame.unionByName, known), len(chosen)


def independent(free: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD) -> tuple[DataFrame, int]:
    """The leaders among names that may lead, and the number of rounds taken."""
    chosen, _, rounds = _led(free, threshold)
    return chosen, rounds


def leaders(nodes: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD) -> DataFrame:
    """(block, processed, leader): the leader each processed name takes; rows without one are left out."""
    free = ~F.col("blocked")
    groups = nodes.where("processed <> ''").groupBy("block", "processed").agg(
        F.min(F.when(free, F.col("position"))).alias("position"),
        F.min_by(F.when(free, F.col("cleaned")), F.when(free, F.col("position"))).alias("cleaned"),
    )
    groups = cut_lineage(groups)
    chosen, known, _ = _led(groups.where("position IS NOT NULL"), threshold)
    if threshold >= 100:  # nothing matches, not even a name itself
        return first_matches(groups, chosen, threshold).select("block", "processed", F.col("cleaned").alias("leader"))
    # A leader matches no earlier leader, so its first match is itself; only the others are compared with the leaders.
    others = groups.join(chosen, ["block", "processed"], "left_anti")
    taken = first_matches(others, chosen, threshold, known=known).select("block", "processed", F.col("cleaned").alias("leader"))
    return taken.unionByName(chosen.select("block", "processed", F.col("cleaned").alias("leader")))


def deduplicated(nodes: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD) -> DataFrame:
    """(block, name, new_name) for every distinct name."""
    nodes = cut_lineage(nodes)  # read by the rounds and by the join below
    taken = leaders(nodes, threshold)
    return nodes.join(taken, ["block", "processed"], "left").select(
        "block", "name", F.coalesce("leader", "cleaned").alias("new_name")
    )


def _renamed(rows: DataFrame, mapping: DataFrame, keys: list[str], new: str) -> DataFrame:
    """``rows`` with the new name of their keys; rows without a key bypass the join, where they would be one key."""
    known = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    unknown = rows.where(reduce(or_, [F.col(k).isNull() for k in keys]))
    joined = known.join(mapping, keys, "left")
    return joined.unionByName(unknown.withColumn(new, F.lit(None).cast("string")))


def deduplicate_artists(rows: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD) -> DataFrame:
    """Rename artist/title to *_old and add the deduplicated artist."""
    renamed = rows.withColumnsRenamed({"artist": "artist_old", "title": "title_old"})
    mapping = deduplicated(name_nodes(renamed, "artist_old", "md5", threshold=threshold), threshold)
    renaming = mapping.select(F.col("name").alias("artist_old"), F.col("new_name").alias("artist"))
    return _renamed(renamed, renaming, ["artist_old"], "artist")


def deduplicate_genre(rows: DataFrame) -> DataFrame:
    """The most frequent genre of the artist for all of the artist's rows, then one row per md5."""
    moded = with_group_mode(rows, "artist", "genre", "main_genre").drop("genre").withColumnRenamed("main_genre", "genre")
    order = [F.struct(*[F.col(c) for c in moded.columns if c != "md5"])]
    return best_row(moded, ["md5"], order)


def deduplicate_titles(rows: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD) -> DataFrame:
    """Deduplicated titles within each original artist."""
    named = rows.where(F.col("artist_old").isNotNull())
    mapping = deduplicated(name_nodes(named, "title_old", "md5", F.col("artist_old"), threshold), threshold)
    renaming = mapping.select(
        F.col("block").alias("artist_old"), F.col("name").alias("title_old"), F.col("new_name").alias("title")
    )
    return _renamed(rows, renaming, ["artist_old", "title_old"], "title")


def extract(
    statistics: DataFrame, raw_names: DataFrame, raw_genres: DataFrame, threshold: float = DEFAULT_MATCH_THRESHOLD
) -> DataFrame:
    """Statistics with one cleaned artist, title and genre per md5."""
    joined = statistics_with_names(statistics, names_with_genres(raw_names, raw_genres))
    with_artists = cut_lineage(deduplicate_artists(joined, threshold))
    with_titles = deduplicate_titles(deduplicate_genre(with_artists), threshold)
    return with_titles.drop("artist_old", "title_old")


def filter_pieces(
    rows: DataFrame, n_instruments: int = 12, four_to_the_floor: bool = True, single_version: bool = True
) -> DataFrame:
    """At most ``n_instruments``, only 4/4, and the densest version of each (title, artist); nulls drop out."""
    kept = rows.where(F.col("n_instruments") <= n_instruments)
    if four_to_the_floor:
        kept = kept.where(F.col("four_to_the_floor"))
    if single_version:
        named = kept.where(F.col("title").isNotNull() & F.col("artist").isNotNull())
        kept = best_row(named, ["title", "artist"], [*descending("number_of_notes_per_second"), F.col("md5")])
    return kept
