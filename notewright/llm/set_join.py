"""Join of documents by the Jaccard similarity of their word n-grams: chosen paths.

A set follows a path of its own elements: at every step it takes the elements whose hash with the path so far is below
1 / (threshold * size), one and a quarter on average. Sets that share most elements take the same steps, others part soon. Sets at
the end of one path are a bucket. Buckets that are too large are split by one step more; small ones are compared by brute force on
bit sketches. Runs with other hashes are repeated until a pair at the threshold is met with the target probability. What meets is
grouped into candidate components, and inside these every pair is verified exactly on the full sets, in tiles of bounded size.
Sets that are equal are one node throughout, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.components import components
from notewright.llm.language_model import slices
from notewright.llm.word_hashes import mixed, word_hashes
from notewright.session import cut_lineage, fresh_path

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
#: Steps of a path, and the sets of a bucket beyond which it is split by one step more.
STEPS = 2
LARGE = 400
#: Bits of a sketch, and the share of equal bits above which a pair is a candidate (a pair at 0.8 agrees in 0.9 of them).
BITS = 256
ALIKE = 0.8
#: Sets of one side of a tile.
TILE = 512
#: Rows of buckets that a task compares at a time, about.
BUCKET_ROWS = 20_000
#: Bytes of text handled at a time.
TEXT_BYTES = 2 << 20


def runs_needed(recall: float = TARGET_RECALL, steps: int = STEPS + 1) -> int:
    """Repetitions until a pair at the threshold shares a path with probability `recall`: its shared paths branch once a step.

    The step that splits large buckets is counted, so that pairs in them have the same recall.
    """
    alive = 1.0
    for _ in range(steps):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def ngram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of every text; a text of fewer words is one n-gram, one without words is empty."""
    hashes, rows = word_hashes(texts)
    begins = np.searchsorted(rows, np.arange(len(texts) + 1))
    grams = mixed(hashes) if len(hashes) else hashes
    m = len(hashes) - words + 1
    if m > 0:
        grams = hashes[:m].copy()
        for k in range(1, words):
            grams = mixed(grams * np.uint64(0xD6E8FEB86659FD93) + hashes[k : m + k])
    out = []
    for i in range(len(texts)):
        lo, hi = begins[i], begins[i + 1]
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            gram = np.uint64(hi - lo)
            for h in hashes[lo:hi]:
                gram = mixed(np.array([gram], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + h)[0]
            out.append(np.array([gram], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _stepped(items: np.ndarray, path: np.uint64, below: np.uint64) -> np.ndarray:
    """The paths that continue `path` by one element."""
    h = (items ^ path) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return mixed(h[h <= below])


def chosen_paths(items: np.ndarray, runs: int, threshold: float = THRESHOLD) -> tuple[list[int], list[list[int]]]:
    """Paths of STEPS steps of all runs, and for each the paths one step longer."""
    if not len(items):
        return [], []
    below = np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * len(items)))))
    starts = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    paths = list(starts)
    for _ in range(STEPS):
        paths = [q for p in paths for q in _stepped(items, p, below)]
    signed = np.array(paths, dtype=np.uint64).view(np.int64).tolist()
    return signed, [_stepped(items, p, below).view(np.int64).tolist() for p in paths]


_ODD = mixed(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sketch(items: np.ndarray) -> bytes:
    """One bit of the least hash under each of BITS hash functions."""
    if not len(items):
        return bytes(BITS // 8)
    bits = np.empty(BITS, dtype=np.uint8)
    step = max(1, (1 << 16) // len(items))
    folded = items ^ (items >> np.uint64(29))
    for at in range(0, BITS, step):
        h = folded[None, :] * _ODD[at : at + step, None]
        least = h.min(axis=1)
        bits[at : at + step] = (mixed(least) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).tobytes()


ROWS = "is_doc boolean, doc_id long, text_hash long, sid binary, path long, deeper array<long>, bits binary"
_SCHEMA = pa.schema(
    [
        ("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sid", pa.binary()), ("path", pa.int64()),
        ("deeper", pa.list_(pa.int64())), ("bits", pa.binary()),
    ]
)


def _set_name(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128(items.tobytes()).digest()


def path_rows(docs: DataFrame, runs: int) -> DataFrame:
    """One row per document with the name of its set, and one per path of each set that a task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2), TEXT_BYTES):
                out: dict[str, list] = {name: [] for name in _SCHEMA.names}
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                text_hashes = batch.column(1).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, text_hash, items in zip(ids, text_hashes, ngram_sets(texts)):
                    sid = _set_name(items)
                    for name, x in zip(_SCHEMA.names, (True, doc_id, text_hash, sid, None, None, None)):
                        out[name].append(x)
                    if sid in met:
                        continue
                    if len(met) >= 1_000_000:
                        met.clear()  # repeats are harmless
                    met.add(sid)
                    paths, deeper = chosen_paths(items, runs)
                    n = len(paths)
                    bits = sketch(items)
                    for name, x in zip(_SCHEMA.names, ([False] * n, [None] * n, [None] * n, [sid] * n, paths, deeper, [bits] * n)):
                        out[name].extend(x)
                yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return known.mapInArrow(run, ROWS)


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    """The least member of each item's component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compare_buckets(table: pa.Table) -> pa.Table:
    """Brute force on the sketches of every bucket in the table: edges that join what is alike."""
    order = np.argsort(table.column("path").to_numpy(), kind="stable")
    paths = table.column("path").to_numpy()[order]
    sids = table.column("sid").to_pylist()
    bits = table.column("bits").to_pylist()
    borders = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1], [True]]))
    edges: set[tuple[bytes, bytes]] = set()
    for lo, hi in zip(borders[:-1], borders[1:]):
        members = {sids[k]: bits[k] for k in order[lo:hi]}
        if len(members) < 2:
            continue
        names = sorted(members)
        packed = np.frombuffer(b"".join([members[s] for s in names]), dtype=np.uint64).reshape(len(names), -1)
        pairs = []
        for i in range(len(names) - 1):
            unlike = np.bitwise_count(packed[i + 1 :] ^ packed[i]).sum(axis=1)
            pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(unlike <= (1 - ALIKE) * BITS)]
        edges.update((names[i], names[r]) for i, r in enumerate(_roots(len(names), pairs)) if i != r)
    return pa.Table.from_pydict({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, schema=_EDGES)


def candidate_edges(rows: DataFrame) -> DataFrame:
    """(a, b) sets that met on a path and have like sketches; enough edges to hold every candidate pair in one component."""
    level = rows.filter("not is_doc").select("path", "sid", "bits", "deeper")
    found = []
    for last in (False, True):
        counts = level.groupBy("path").count().filter("count > 1")
        sized = level.join(counts, "path")
        small = sized.filter(F.col("count") <= LARGE)
        bins = F.pmod(F.xxhash64("path"), F.lit(_bins(rows.sparkSession, level.count(), BUCKET_ROWS))).alias("bin")
        found.append(small.select(bins, "path", "sid", "bits").groupBy("bin").applyInArrow(_compare_buckets, "a binary, b binary"))
        large = sized.filter(F.col("count") > LARGE)
        if last:
            # Too many alike sets to compare here: one component, whose pairs are verified in tiles.
            least = large.groupBy("path").agg(F.min("sid").alias("b"))
            found.append(large.join(least, "path").select(F.col("sid").alias("a"), "b"))
        else:
            level = large.select(F.explode("deeper").alias("path"), "sid", "bits", F.array().cast("array<bigint>").alias("deeper"))
            level = cut_lineage(level)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def _bins(spark, rows: int, rows_of_bin: int) -> int:
    """Groups that tasks hold one at a time: their size stays the same however many rows there are."""
    return max(4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // rows_of_bin))


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of the left with sets of the right."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left]).reshape(len(left), len(right))
    items, inverse, degree = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(degree > 1) - 1
    keep = degree[inverse] > 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])[keep]
    column = shared[inverse[keep]]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(left) + len(right), width), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        total += block[: len(left)] @ block[len(left) :].T
    return total


def _verify_tiles(table: pa.Table) -> pa.Table:
    """Exact similarity of all pairs in each tile: documents linked to every set, and edges that join linked sets."""
    comp, i, j, block, copies = (table.column(c).to_pylist() for c in ("comp", "i", "j", "block", "copies"))
    sids, sets = table.column("sid").to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
    tiles: dict[tuple, list[int]] = {}
    for k in range(table.num_rows):
        tiles.setdefault((comp[k], i[k], j[k]), []).append(k)
    out: dict[str, list] = {"a": [], "b": [], "links": []}
    for (_, bi, bj), members in tiles.items():
        members.sort(key=lambda k: sids[k])
        left = [k for k in members if block[k] == bi]
        right = left if bi == bj else [k for k in members if block[k] == bj]
        both = _overlaps([sets[k] for k in left], [sets[k] for k in right])
        sizes = np.array([len(sets[k]) for k in left])[:, None] + np.array([len(sets[k]) for k in right])[None, :]
        # both / (sizes - both) >= threshold, in whole numbers
        tenths = round(THRESHOLD * 10)
        linked = both.astype(np.int64) * (10 + tenths) >= tenths * sizes
        if bi == bj:
            np.fill_diagonal(linked, False)
        weight_left, weight_right = np.array([copies[k] for k in left]), np.array([copies[k] for k in right])
        counts = dict(zip(left, (linked @ weight_right).tolist()))
        if bi != bj:
            counts |= dict(zip(right, (weight_left @ linked).tolist()))
        place = {k: p for p, k in enumerate(members)}
        pairs = [(place[left[x]], place[right[y]]) for x, y in zip(*np.nonzero(linked))]
        for p, r in enumerate(_roots(len(members), pairs)):
            k = members[p]
            out["a"].append(sids[k])
            out["b"].append(sids[members[r]])
            out["links"].append(int(counts[k]))
    return pa.Table.from_pydict(out, schema=_LINKS)


def verified_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, links) per set and tile. nodes: sid, first, first_hash, copies; groups: v (sid), label (component)."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "label").select(
        F.col("v").alias("sid"), F.col("label").alias("comp"), (F.ceil(F.col("size") / TILE)).cast("int").alias("blocks")
    )
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = cut_lineage(placed.join(nodes, "sid").select("first", "first_hash", "sid", "comp", "blocks", "block", "copies"))
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("first_hash"), "text")
    # One text per set, also where a row is repeated.
    needed = placed.join(texts, (placed["first"].eqNullSafe(texts["first"])) & (placed["first_hash"] == texts["first_hash"]))
    needed = needed.select("sid", "comp", "blocks", "block", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(5), TEXT_BYTES):
                items = pa.array([x.tobytes() for x in ngram_sets(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(part)) for c in range(5)], items], names=names)
                at += len(part)

    names = ["sid", "comp", "blocks", "block", "copies", "items"]
    sets = needed.mapInArrow(run, "sid binary, comp binary, blocks int, block int, copies long, items binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = sets.select("*", other.alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # Every set is in as many tiles as its component has blocks.
    n_rows = placed.agg(F.sum("blocks")).first()[0] or 0
    bins = F.pmod(F.xxhash64("comp", "i", "j"), F.lit(_bins(docs.sparkSession, n_rows, 2 * TILE))).alias("bin")
    tiles = tiles.select(bins, "comp", "i", "j", "block", "copies", "sid", "items").dropDuplicates(["bin", "comp", "i", "j", "sid"])
    return tiles.groupBy("bin").applyInArrow(_verify_tiles, "a binary, b binary, links long")


def join_documents(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, set_size_copies of every document.

    Two documents are linked if the Jaccard similarity of their sets of five-word n-grams is at least 0.8. n_links counts the other
    documents linked to one, copies included; class_id is the least doc_id of those that links join, directly or through others. Texts
    of fewer than five words are compared as one n-gram; texts without words (null, empty) are equal to each other. Repeated rows are
    documents of their own. Null ids keep their row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "set-join")
    path_rows(docs, runs_needed(recall)).write.parquet(folder)
    rows = spark.read.parquet(folder)
    members = rows.filter("is_doc").select("doc_id", "text_hash", "sid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("text_hash")))
    nodes = members.groupBy("sid").agg(F.count("*").alias("copies"), first.alias("f"))
    nodes = cut_lineage(nodes.select("sid", "copies", F.col("f.doc_id").alias("first"), F.col("f.text_hash").alias("first_hash")))
    groups = components(candidate_edges(rows))
    links = cut_lineage(verified_links(docs, nodes, groups))
    classes = components(links.select("a", "b"))
    linked = links.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    known = nodes.join(classes.select(F.col("v").alias("sid"), "label"), "sid", "left").join(linked, "sid", "left")
    known = known.withColumn("label", F.coalesce("label", "sid"))
    least = known.groupBy("label").agg(F.min("first").alias("class_id"))
    known = known.join(least, "label").select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(known, "sid").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "text_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class, that of the least doc_id; same columns. Rows without an id stay, equal ones once."""
    own = docs.columns
    gone_id, gone_text = (unused(own, name) for name in ("gone_id", "gone_text"))
    found = join_documents(docs.select("doc_id", "text"))
    gone = found.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text))
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_text)), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*own)


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
