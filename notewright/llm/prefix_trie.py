"""The trie of all conversation prefixes, by ROLLUP over positional turn columns.

A turn is a pair of longs cut from the SHA-256 of role and text. A conversation becomes one row per block of eight turns: columns for the
eight turns, and the key of the node that the blocks before it end in (the exclusive or of one hash per position and turn, two times 64
bits, so that a block's key needs no loop over the blocks before it). One ROLLUP over the eight columns under that key aggregates every
prefix of every block in one pass, with map-side combining; grouping_id() tells the level.

Subtree sums need no walk over the tree. A node belongs to its smallest member; what a conversation owns is the tail of its path. So the
words of all nodes below a node are what its members own, with the owner's part counted from the node on; likewise a childless node
counts once, at its owner. A second ROLLUP adds what members own.

Defined cases: rows without a conv_id belong to no conversation; null role or text is empty; turns with one number are ordered by the hash
of role and text; repeated rows are repeated turns. A table without conversations gives no rows. Positions, and prefixes of blocks, are
numbered inside stretches of a conversation and then moved by the totals of the stretches before, so a conversation of any length is
many tasks' work. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.session import fresh_path

#: Turns in a block, one set of ROLLUP columns each.
BLOCK = 8
#: Turn numbers in a stretch, blocks in a stretch, conversation ids in one piece of a list of ends.
STRETCH = 1024
STRETCH_BLOCKS = 256
PIECE = 100_000

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]
SLOTS = range(1, BLOCK + 1)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, w): the turns of each conversation from position 1, as hash pair and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-(2**63))).alias("stretch"),
        F.conv(F.substring(told, 1, 15), 16, 10).cast("long").alias("a"),
        F.conv(F.substring(told, 16, 15), 16, 10).cast("long").alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"),
    )
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "a", "b")
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    numbered = _kept(rows.select("conv_id", "stretch", "a", "b", "w", F.row_number().over(inside).cast("long").alias("i")), "turns")
    lengths = numbered.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    first = lengths.select("conv_id", "stretch", F.sum("n").over(earlier).alias("first")).filter("first > 0")
    moved = numbered.join(first, ["conv_id", "stretch"], "left")
    return moved.select("conv_id", (F.col("i") + F.coalesce("first", F.lit(0))).alias("pos"), "a", "b", "w")


def shared_beginnings(turns: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a common beginning, as (turns, convs with n turns).

    The first h turns of conversation c become those of c - c % family (all it has, none if it is absent); h is crc32(c) % (most + 1).
    """
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads = turns.filter((c % family == 0) & (F.col("pos") <= most)).groupBy(c.alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "w"))).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h")
    convs = own.select("conv_id", "own", (c - c % family).alias("base"), h).join(heads, "base", "left")
    got = F.least("h", F.coalesce(F.size("head"), F.lit(0)))
    convs = convs.withColumn("got", F.when(F.col("head").isNull(), 0).otherwise(got).cast("long"))
    convs = convs.withColumn("n", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    begun = convs.filter("got > 0").select("conv_id", F.explode(F.expr("slice(head, 1, cast(got AS int))")).alias("t")).select("conv_id", "t.*")
    less = convs.filter("got < h").select("conv_id", (F.col("got") - F.col("h")).alias("shift"))
    rest = turns.filter(F.col("pos") > h).join(less, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "a", "b", "w")
    return rest.union(begun.select(rest.columns)), convs.select("conv_id", "n")


def _marks(pos: Column, a: Column, b: Column) -> tuple[Column, Column]:
    return F.xxhash64(pos, a, b), F.xxhash64(b, pos, F.lit(1), a)


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns, the key p1, p2 and the words pw of what comes before, where it ends, all its words."""
    slot = (F.col("pos") - 1) % BLOCK + 1
    marks = _marks(F.col("pos"), F.col("a"), F.col("b"))
    cells = [F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j}") for j in SLOTS for c in "abw"]
    totals = [F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("w").alias("xw"), F.count("*").alias("xn")]
    marked = turns.select("*", marks[0].alias("m1"), marks[1].alias("m2"))
    blocks = marked.groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block")).agg(*cells, *totals)
    bare = convs.filter("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    blocks = _kept(blocks.unionByName(bare, allowMissingColumns=True).fillna(0, ["x1", "x2", "xw", "xn"]), "blocks")

    def before(w, suffix):
        xor = [F.coalesce(F.bit_xor(f"x{i}").over(w), F.lit(0)).alias(f"{suffix}{i}") for i in (1, 2)]
        return [*xor, F.coalesce(F.sum("xw").over(w), F.lit(0)).alias(f"{suffix}w")]

    stretch = F.floor(F.col("block") / STRETCH_BLOCKS).cast("long").alias("stretch")
    sums = blocks.groupBy("conv_id", stretch).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("xw").alias("xw"), F.sum("xn").alias("xn"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *before(earlier, "before"), F.sum("xn").over(whole).alias("n"), F.sum("xw").over(whole).alias("tw"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("stretch", stretch)
    rows = rows.select("*", *before(inside, "inside")).join(sums, ["conv_id", "stretch"])
    prior = [F.col(f"before{i}").bitwiseXOR(F.col(f"inside{i}")).alias(f"p{i}") for i in (1, 2)]
    ends = F.least(F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK + 1)).alias("ends")
    return rows.select("conv_id", "block", *prior, (F.col("beforew") + F.col("insidew")).alias("pw"), *[f"{c}{j}" for j in SLOTS for c in "abw"], ends, "tw")


def _levels(blocks: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks with the measures, keyed by depth and node key; (q1, q2) is the parent's key."""
    columns = ", ".join(f"(a{j}, b{j}, w{j})" for j in SLOTS)
    cells = ", ".join(f"a{j}, b{j}, w{j}" for j in SLOTS)
    found = blocks.sparkSession.sql(
        f"""
        SELECT block, p1, p2, pw, {cells}, {BLOCK} - cast(bit_count(grouping_id()) AS int) DIV 3 AS level, {measures}
        FROM {{blocks}} GROUP BY block, p1, p2, pw, ROLLUP ({columns})
        """,
        blocks=blocks,
    )
    at = F.col("level")
    there = F.when(at == 0, F.col("block") == 0)
    last_words, above, k, q = F.lit(0).cast("long"), F.col("pw"), [F.col("p1"), F.col("p2")], [F.col("p1"), F.col("p2")]
    for j in SLOTS:
        a, b, w = (F.col(f"{c}{j}") for c in "abw")
        there = there.when(at == j, a.isNotNull())
        last_words = F.when(at == j, w).otherwise(last_words)
        above = above + F.when(at > j, w).otherwise(0)
        marks = _marks(F.col("block") * BLOCK + j, a, b)
        k = [x.bitwiseXOR(F.when(at >= j, m).otherwise(F.lit(0).cast("long"))) for x, m in zip(k, marks)]
        q = [x.bitwiseXOR(F.when(at > j, m).otherwise(F.lit(0).cast("long"))) for x, m in zip(q, marks)]
    names = [m.rsplit(" AS ", 1)[1] for m in measures.split(", ") if " AS " in m]
    return found.filter(there).select(
        (F.col("block") * BLOCK + at).alias("depth"), k[0].alias("k1"), k[1].alias("k2"), q[0].alias("q1"), q[1].alias("q2"),
        last_words.alias("words"), above.alias("above"), at, *names,
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each key; rows come sorted by key and piece, so only one state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_batch(out)
    if key is not None:
        yield _digest_batch([(*key, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*KEY, "ends_sha256"])


def ends_of_nodes(blocks: DataFrame) -> DataFrame:
    """For every node that conversations end in, the SHA-256 of their ids in order, joined by commas."""
    k = [F.col("p1"), F.col("p2")]
    for j in SLOTS:
        marks = _marks(F.col("block") * BLOCK + j, F.col(f"a{j}"), F.col(f"b{j}"))
        k = [x.bitwiseXOR(F.when(F.col(f"a{j}").isNotNull(), m).otherwise(F.lit(0).cast("long"))) for x, m in zip(k, marks)]
    last = blocks.filter(F.col("ends") <= BLOCK).select(
        (F.col("block") * BLOCK + F.col("ends")).alias("depth"), k[0].alias("k1"), k[1].alias("k2"), "conv_id"
    )
    pieces = last.groupBy(*KEY, F.floor(F.col("conv_id") / PIECE).alias("piece"))
    pieces = pieces.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return ordered.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, pos, a, b, w), positions gapless from 1; ``convs`` names all conversations with their number of turns n.
    """
    blocks = _kept(turn_blocks(turns, convs), "turn-blocks")
    nodes = _kept(_levels(blocks, "min(conv_id) AS conv_id, max(ends) AS ends").withColumn("leaf", (F.col("ends") == F.col("level")).cast("int")), "nodes")
    owned = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("owned"), F.max("leaf").alias("leaf"), F.min("depth").alias("top"),
        F.min_by("q1", "depth").alias("k1"), F.min_by("q2", "depth").alias("k2"),
    )
    parents = nodes.select((F.col("depth") + 1).alias("top"), "k1", "k2", F.col("conv_id").alias("branch"))
    owned = owned.join(parents, ["top", "k1", "k2"], "left").select("conv_id", "owned", "leaf", "top", "branch")
    measures = (
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(tw) AS tw, sum(owned) AS owned, "
        "min_by(tw, conv_id) AS own_tw, min_by(owned, conv_id) AS own_owned, min_by(top, conv_id) AS top, min_by(branch, conv_id) AS branch"
    )
    weighed = blocks.drop("ends").join(owned, "conv_id", "left").fillna(0, ["owned", "leaf"])
    rows = _levels(weighed, measures)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    rows = rows.join(children.agg(F.count("*").alias("n_children")), KEY, "left").join(ends_of_nodes(blocks), KEY, "left")
    all_words = F.col("tw") - F.col("n_convs") * F.col("above")
    once = F.col("owned") - F.col("own_owned") + F.col("own_tw") - F.col("above")
    return rows.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("branch")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (all_words - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
