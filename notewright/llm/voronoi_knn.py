"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Every component x counts as floor(256 * x). With M the longest data vector, the data point o' = (o, sqrt(M^2 - |o|^2)) and the query
point q' = (q, 0) have |q' - o'|^2 = |q|^2 + M^2 - 2 <q, o>, so the highest products are the nearest points and the triangle
inequality holds. Queries and data are grouped by their nearest pivot (points of a sample). A summary of each cell (rows, radius, the
least distances to the pivot) bounds how far the k-th neighbour of any query of a cell can be; a data row goes to a group of query cells
only if its distance to its own pivot leaves room for such a neighbour. Groups are solved in tiles of bounded size, and a query's
partial lists are merged. Bounds only save copies: the result does not depend on pivots, sample or sizes.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; shorter vectors are
filled with zeros; an empty vector has product 0 with all. A query's own rows are all rows with its id. Repeated rows are candidates as
often as they occur; of several vectors with one query id the least in byte order asks. Products are exact; one outside the
64-bit range counts as the nearest 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that pivots come from, and the most pivots; the driver and each task hold one matrix of pivots by pivots.
SAMPLE = 4096
MOST_PIVOTS = 512
#: Rows of a tile: queries by data. A tile is what one task holds.
TILE_QUERIES = 8192
TILE_ROWS = 65536
LEAST_TILE_ROWS = 2048
LEAST_TILE_QUERIES = 256
#: Units aimed at where a tile could hold all queries. Each unit takes its own copy of the data rows it needs.
UNITS = 8
#: Scores computed at once in a tile.
SCORES = 1 << 21
#: Longest list of least distances per cell; ids with more rows than it allows are joined without bounds.
MOST_NEAR = 128
#: Rounding allowed for in distances, relative to the longest vector.
SLACK = 1e-6

VECTORS = "vec_id long, v binary, wide boolean, n2 double"
RESULT = "query_id long, vec_id long, score long"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        good = (odd[ends[1:]] == odd[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(256.0 * x)
            squares = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(x), np.minimum(whole * whole, 1e300), 0.0))])
        large = np.concatenate([[0], np.cumsum(~(np.abs(whole) < 2**31))])
        wide = (large[ends[1:]] != large[ends[:-1]]) & good
        if wide.any():
            with np.errstate(over="ignore"):
                norms = np.array([np.dot(whole[a:b], whole[a:b]) if g else 0.0 for a, b, g in zip(ends[:-1], ends[1:], good)])
            cells = [
                (x[a:b] if w else whole[a:b].astype("<i4")).tobytes() if g else b""
                for a, b, g, w in zip(ends[:-1], ends[1:], good, wide)
            ]
            v = pa.array(cells, pa.binary())
        else:
            norms = squares[ends[1:]] - squares[ends[:-1]]
            with np.errstate(invalid="ignore"):
                data = np.where(np.isfinite(whole), whole, 0).astype("<i4")
            v = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends * 4), pa.py_buffer(data)]).cast(pa.binary())
        out = pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(wide), pa.array(norms)], names=["vec_id", "v", "wide", "n2"])
        yield out.filter(pa.array(good))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, wide, n2) of the vectors that take part: v holds 32-bit components, or doubles not yet multiplied where wide."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter("vec_id IS NOT NULL AND x IS NOT NULL").mapInArrow(_quantise, VECTORS)


def _matrix(v: pa.Array, width: int = 0) -> np.ndarray:
    """Narrow vectors as rows of doubles, filled with zeros to the longest of them and to ``width``."""
    v = v.cast(pa.large_binary())
    ends = np.frombuffer(v.buffers()[1], dtype=np.int64)[v.offset : v.offset + len(v) + 1] // 4
    data = np.frombuffer(v.buffers()[2], dtype="<i4")[ends[0] : ends[-1]] if len(v) and ends[-1] > ends[0] else np.zeros(0, "<i4")
    lengths = np.diff(ends)
    most = max(width, int(lengths.max()) if len(lengths) else 0)
    if len(lengths) and (lengths == most).all():
        return data.reshape(len(lengths), most).astype(np.float64)
    out = np.zeros((len(lengths), most))
    out[np.arange(most)[None, :] < lengths[:, None]] = data
    return out


def _whole(value: float) -> int:
    return int(value) * 256 if abs(value) >= 2**53 else math.floor(256.0 * value)


def _objects(v: pa.Array, wide: np.ndarray, width: int) -> np.ndarray:
    """All vectors as rows of Python integers."""
    out = np.zeros((len(v), width), dtype=object)
    for i, (cell, w) in enumerate(zip(v.to_pylist(), wide)):
        values = [_whole(x) for x in np.frombuffer(cell, "<f8")] if w else np.frombuffer(cell, "<i4").tolist()
        out[i, : len(values)] = values
    return out


class _Cells:
    """Pivots as points (vector, last coordinate), and the distances of rows to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.top = top
        self.vectors = pivots
        self.last = np.sqrt(np.maximum(top - (pivots**2).sum(axis=1), 0.0))

    def between(self) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * (self.vectors @ self.vectors.T + np.outer(self.last, self.last)), 0.0))

    def place(self, v: pa.Array, n2: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        rows = _matrix(v, self.vectors.shape[1])
        pivots = np.pad(self.vectors, ((0, 0), (0, rows.shape[1] - self.vectors.shape[1])))
        products = rows @ pivots.T
        if not query:
            products += np.outer(np.sqrt(np.maximum(self.top - n2, 0.0)), self.last)
        squares = (n2 if query else np.full(len(n2), self.top))[:, None] + self.top - 2 * products
        cell = squares.argmin(axis=1)
        return cell, np.sqrt(np.maximum(squares[np.arange(len(cell)), cell], 0.0))


def _summaries(cells: _Cells, query: bool, near: int):
    """Per cell of a partition: rows, largest distance to the pivot, and the ``near`` least ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cells.vectors)
        count, far, least = np.zeros(n, np.int64), np.zeros(n), [np.zeros(0)] * n
        for batch in batches:
            cell, r = cells.place(batch.column("v"), batch.column("n2").to_numpy(), query)
            count += np.bincount(cell, minlength=n)
            np.maximum.at(far, cell, r)
            order = np.lexsort((r, cell))
            cuts = np.searchsorted(cell[order], np.arange(n + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                least[c] = np.sort(np.concatenate([least[c], r[order[cuts[c] : min(cuts[c + 1], cuts[c] + near)]]]))[:near]
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(count[used]), pa.array(far[used]), pa.array([least[c].tolist() for c in used], pa.list_(pa.float64()))],
                names=["cell", "n", "far", "least"],
            )

    return run


class _Plan:
    """Which query cells form a unit, how many query chunks each unit has, and the distances of data rows that a unit needs."""

    def __init__(self, cells: _Cells | None, low: np.ndarray, high: np.ndarray, unit: np.ndarray, chunks: np.ndarray, blocks: int):
        self.cells, self.low, self.high, self.unit, self.chunks, self.blocks = cells, low, high, unit, chunks, blocks


def _mix(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _route(plan: _Plan, query: bool):
    """Copies of the rows for the tiles that need them: a query goes to all blocks of its chunk, a data row to one block of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if plan.cells is None:
                cell, r = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            else:
                cell, r = plan.cells.place(batch.column("v"), batch.column("n2").to_numpy(), query)
            if query:
                unit = plan.unit[cell]
                chunk = (_mix(ids, 7) % plan.chunks[unit].astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(ids)), plan.blocks)
                block = np.tile(np.arange(plan.blocks), len(ids))
                unit, chunk = unit[row], chunk[row]
            else:
                needed = (r[:, None] >= plan.low[cell]) & (r[:, None] <= plan.high[cell])
                row, unit = np.nonzero(needed)
                times = plan.chunks[unit]
                first = np.cumsum(times) - times
                chunk = np.arange(times.sum()) - np.repeat(first, times)
                row, unit = np.repeat(row, times), np.repeat(unit, times)
                block = (_mix(ids, 11) % np.uint64(plan.blocks)).astype(np.int64)[row]
            for at in range(0, len(row), 10_000):
                part = slice(at, at + 10_000)
                taken = batch.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit[part]), pa.array(chunk[part]), pa.array(block[part]), pa.array(np.full(len(row[part]), query))]
                    + [taken.column(c) for c in ("vec_id", "v", "wide")],
                    names=["unit", "chunk", "block", "query", "vec_id", "v", "wide"],
                )

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the first."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > border)
        chosen = np.concatenate([above, np.flatnonzero(scores == border)[: k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    return np.array(sorted(chosen.tolist(), key=lambda i: (-int(scores[i]), i)), dtype=np.int64)


def _solve(k: int):
    """The k best data rows of a tile for each of its queries."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        data, asked = table.filter(pa.array(~is_query)).sort_by("vec_id"), table.filter(pa.array(is_query))
        ids, query_ids = data.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        found = []
        if len(ids) and len(query_ids):
            dv, qv = (t.column("v").combine_chunks() for t in (data, asked))
            dv, qv = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (dv, qv))
            wide = [t.column("wide").to_numpy(zero_copy_only=False).astype(bool) for t in (data, asked)]
            if wide[0].any() or wide[1].any():
                width = max(len(c) // 4 for x in (dv, qv) for c in x.to_pylist())
                left, right = _objects(qv, wide[1], width), _objects(dv, wide[0], width)
            else:
                left, right = _matrix(qv), _matrix(dv)
                width = max(left.shape[1], right.shape[1])
                left, right = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))
                most = max(np.abs(left).max(initial=0), 1) * max(np.abs(right).max(initial=0), 1) * max(width, 1)
                if most >= 2**53:  # sums of doubles would round
                    left, right = (m.astype(np.int64).astype(np.int64 if most < 2**62 else object) for m in (left, right))
            own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
            step = max(1, SCORES // len(ids))
            for at in range(0, len(query_ids), step):
                scores = left[at : at + step] @ right.T
                if scores.dtype == object:
                    scores = np.clip(scores, -(2**63), 2**63 - 1)
                for i, row in enumerate(scores, at):
                    others = row if own[0][i] == own[1][i] else np.concatenate([row[: own[0][i]], row[own[1][i] :]])
                    best = _best(others, k)
                    places = np.where(best < own[0][i], best, best + (own[1][i] - own[0][i]))
                    found.append((np.full(len(best), query_ids[i]), ids[places], others[best].astype(np.int64)))
        columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 3)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return run


def _units(between: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Near query cells joined until a unit has ``size`` queries; a larger cell is cut into chunks. (unit of each cell, chunks)."""
    unit, chunks = np.zeros(len(asked), np.int64), []
    left = set(np.flatnonzero(asked).tolist())
    while left:
        first = max(left, key=lambda c: (asked[c], -c))
        members, held = [first], int(asked[first])
        left.remove(first)
        for c in sorted(left, key=lambda c: (between[first, c], c)):
            if held + asked[c] <= size:
                members.append(c)
                held += int(asked[c])
                left.remove(c)
        unit[members] = len(chunks)
        chunks.append(math.ceil(held / size))
    return unit, np.array(chunks or [1], dtype=np.int64)


def _plan(data: DataFrame, queries: DataFrame, k: int, n_data: int, n_queries: int, bounded: bool, top: float, rows_of_an_id: int) -> _Plan:
    tasks = 2 * data.sparkSession.sparkContext.defaultParallelism

    def blocks(chunks: int) -> int:
        return max(math.ceil(n_data / TILE_ROWS), min(math.ceil(tasks / chunks), math.ceil(n_data / LEAST_TILE_ROWS)))

    near = k + rows_of_an_id
    if not bounded or near > MOST_NEAR:
        chunks = np.array([math.ceil(n_queries / TILE_QUERIES)])
        return _Plan(None, np.full((1, 1), -1.0), np.full((1, 1), 1.0), np.zeros(1, np.int64), chunks, blocks(int(chunks[0])))
    sample = data.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").collect()
    points = np.unique(_matrix(pa.array([bytes(r["v"]) for r in sample], pa.binary())), axis=0)
    wanted = min(MOST_PIVOTS, max(4, math.isqrt(n_data) // 2), len(points))
    cells = _Cells(points[np.random.default_rng(11).permutation(len(points))[:wanted]], top)
    n = len(cells.vectors)
    told = data.mapInArrow(_summaries(cells, False, near), "cell long, n long, far double, least array<double>")
    asked = queries.mapInArrow(_summaries(cells, True, 1), "cell long, n long, far double, least array<double>")
    first = Window.partitionBy("cell").orderBy("r")
    least = told.select("cell", F.explode("least").alias("r")).withColumn("i", F.row_number().over(first)).filter(F.col("i") <= near)
    distances = np.full((n, near), np.inf)
    for r in least.collect():
        distances[r["cell"], r["i"] - 1] = r["r"]
    count, radius = np.zeros(n, np.int64), np.zeros(n)
    for r in asked.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    between, slack = cells.between(), SLACK * math.sqrt(top) + SLACK
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for i in np.flatnonzero(count):
        reach = np.partition((radius[i] + between[i][:, None] + distances).ravel(), near - 1)[near - 1]
        low[:, i], high[:, i] = between[i] - radius[i] - reach - slack, between[i] + radius[i] + reach + slack
    unit, chunks = _units(between, count, min(TILE_QUERIES, max(LEAST_TILE_QUERIES, math.ceil(n_queries / UNITS))))
    unit_low, unit_high = np.full((n, len(chunks)), np.inf), np.full((n, len(chunks)), -np.inf)
    for i in np.flatnonzero(count):
        unit_low[:, unit[i]] = np.minimum(unit_low[:, unit[i]], low[:, i])
        unit_high[:, unit[i]] = np.maximum(unit_high[:, unit[i]], high[:, i])
    return _Plan(cells, unit_low, unit_high, unit, chunks, blocks(int(chunks.sum())))


def knn_join(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id that meets ``is_query`` (a condition on vec_id) the k highest products with the rows of other ids.

    Ties go to the smaller vec_id. The result has all candidates of a query if there are fewer than k, and no row if there are none.
    """
    data = quantised(vectors, id_col, vector_col)
    asking = data.filter(is_query)
    queries = asking.groupBy("vec_id").agg(F.min(F.struct("v", "wide", "n2")).alias("s")).select("vec_id", "s.v", "s.wide", "s.n2")
    sizes = data.agg(F.count("*").alias("n"), F.max("n2").alias("top"), F.max("wide").alias("wide")).first()
    asked = asking.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n"), F.max("n").alias("rows")).first()
    spark = vectors.sparkSession
    if not sizes["n"] or not asked["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bounded = not sizes["wide"] and sizes["top"] < 1e18
    plan = _plan(data, queries, k, sizes["n"], asked["n"], bounded, float(sizes["top"]), asked["rows"])
    schema = "unit long, chunk long, block long, query boolean, vec_id long, v binary, wide boolean"
    tiles = data.mapInArrow(_route(plan, False), schema).union(queries.mapInArrow(_route(plan, True), schema))
    found = tiles.groupBy("unit", "chunk", "block").applyInArrow(_solve(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
