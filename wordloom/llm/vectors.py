"""The most similar vectors of every vector (problem 1).

Vectors are spread over cells: random directions (columns of random
rotations, both signs) act as cell centres and a vector joins the ``probes``
nearest.  Within a cell randomly rotated one-bit codes with correction scalars
estimate inner products, their error bound chooses the pairs to rerank, and
reranking uses the vectors.  Valid vectors are made unit once and kept in a
durable table, in 16 bits a component; all later passes read that.  A cell above ``cell_rows`` is a dense group that
random directions can't separate: it is divided into tiles of bounded size that
together compare every pair of its rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.durable import written

#: Rows of a cell above which it is divided, and about the rows of each group it is divided into.
CELL_ROWS = 24_000
#: Copies of one vector above which the surplus stays out of the search.
COPIES = 64
#: Bits of a query component and the width of the error bound in standard deviations.
QUERY_BITS, BOUND_Z = 4, 2.5
#: The most cells, as a power of two.
_CELL_BITS = 17
#: Divided cells whose pairs are not searched again in a later divided cell.
_MASK_BITS = 62
_SEED = 20_177


@functools.cache
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthonormal matrix; the same for the same arguments anywhere."""
    q, r = np.linalg.qr(np.random.default_rng((_SEED, seed)).normal(size=(dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@functools.cache
def directions(dims: int, cells: int) -> np.ndarray:
    """``dims x cells/2`` unit columns; with both signs they are the cell centres."""
    half = cells // 2
    blocks = [rotation(dims, 1000 + i) for i in range(-(-half // dims))]
    return np.concatenate(blocks, axis=1)[:, :half]


def nearest_cells(x: np.ndarray, cells: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest of ``cells`` centres for each row."""
    out = np.empty((len(x), probes), np.int64)
    half = cells // 2
    for at in range(0, len(x), 512):
        y = x[at : at + 512] @ directions(x.shape[1], cells)
        # the better sign of a direction; both signs of one are never near
        top = np.argpartition(-np.abs(y), probes - 1, axis=1)[:, :probes]
        out[at : at + 512] = top + half * (np.take_along_axis(y, top, 1) < 0)
    return out


def cell_count(rows: int) -> tuple[int, int]:
    """``(cells, probes)`` for a table of ``rows``: about ``4 sqrt(rows)``
    cells, so that both assignment and search grow as the 1.5th power."""
    power = max(4, round(math.log2(4 * math.sqrt(max(rows, 1)))))
    power = min(power, _CELL_BITS)
    return 1 << power, 6 + max(0, power - 12)


@dataclass
class CellPlan:
    """How vectors are spread; ``divided`` has for each over-full cell, by
    level (there is one), the number of groups its rows are divided into."""

    cells: int
    probes: int
    divided: list[dict[int, int]] = field(default_factory=list)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of every placement, in order of the rows."""
        return np.repeat(np.arange(len(x)), self.probes), nearest_cells(x, self.cells, self.probes).ravel()


def unit_rows(ids: pa.Array, vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the valid rows of a batch (see :func:`most_similar`)."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero((lengths == dims) & ~np.asarray(ids.is_null()))
    flat = vectors.take(pa.array(right)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null elements become NaN
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x, right = x[fine], right[fine]
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids.take(pa.array(right)).to_numpy(zero_copy_only=False), x.astype(np.float32)


#: Steps of a component, the largest of its vector being the last.
_STEPS = 32_767


def packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    data = np.ascontiguousarray(x)
    bounds = (np.arange(len(data) + 1) * data.shape[1] * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


def stepped(x: np.ndarray) -> np.ndarray:
    """Vectors in 16 bits a component; the length is lost."""
    return np.rint(x * (_STEPS / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16) if len(x) else x.astype(np.int16)


def unpacked(values: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of :func:`stepped` rows, off by about 1e-5 a component at most."""
    begin = np.frombuffer(values.buffers()[1], np.int32)[values.offset] if len(values) else 0
    x = np.frombuffer(values.buffers()[2], np.int16, len(values) * dims, begin).reshape(-1, dims).astype(np.float32) if len(values) else np.empty((0, dims), np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit_batches(dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, x = unit_rows(batch.column(0), batch.column(1), dims)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), packed(stepped(x))], names=["id", "v"])


def _count_batches(plan: CellPlan, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of every cell in a partition."""
    counts = np.zeros(plan.cells, np.int64)
    for batch in batches:
        counts += np.bincount(plan.assign(unpacked(batch.column(1), dims))[1], minlength=plan.cells)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], names=["cell", "n"])


def _group_of(ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The group of each id, spread evenly whatever pattern the ids have."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


def _place_batches(plan: CellPlan, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per placement: cell, tile, id, group, earlier divided cells as
    bits, and the vector.

    A divided cell of ``g`` groups has a tile for each two groups and for each
    group with itself, so a row is in ``g`` tiles.
    """
    groups = plan.divided[0] if plan.divided else {}
    hot = np.array(sorted(groups), np.int64)
    sizes = np.array([groups[c] for c in hot], np.int64)
    for batch in batches:
        ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        row, cell = plan.assign(unpacked(v, dims))
        at = np.searchsorted(hot, cell)
        inside = np.zeros(len(cell), bool)
        if len(hot):
            inside = hot[np.minimum(at, len(hot) - 1)] == cell
        bits = np.where(inside & (at < _MASK_BITS), np.int64(1) << np.minimum(at, _MASK_BITS), 0)
        member = np.bitwise_or.reduce(bits.reshape(-1, plan.probes), axis=1) if len(ids) else bits
        cold = np.flatnonzero(~inside)
        none = np.zeros(len(cold), np.int64)
        yield from _placements(cell[cold], none, ids[row[cold]], none, none, v, row[cold])
        rows, where = row[inside], at[inside]
        if len(rows):
            n = sizes[where]
            seen = member[rows] & ((np.int64(1) << np.minimum(where, _MASK_BITS)) - 1)
            own = _group_of(ids[rows], n)
            each = np.repeat(np.arange(len(rows)), n)
            other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            tile = np.minimum(own[each], other) * n[each] + np.maximum(own[each], other)
            yield from _placements(hot[where][each], tile, ids[rows[each]], own[each], seen[each], v, rows[each])


def _placements(cell, tile, ids, group, seen, v: pa.Array, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(row), 20_000):
        part = slice(at, at + 20_000)
        numbers = [pa.array(c[part]) for c in (cell, tile, ids, group, seen)]
        yield pa.RecordBatch.from_arrays([*numbers, v.take(pa.array(row[part]))], names=["cell", "tile", "id", "group", "seen", "v"])


class BitCodes:
    """One-bit codes of rotated unit vectors.

    The code of ``o`` is the sign of each rotated component, read as the unit
    vector ``s / sqrt(D)``; ``fit`` is its inner product with ``o``, the
    correction scalar.  ``<code, q> / fit`` estimates ``<o, q>`` with a
    standard deviation of ``sqrt((1 - fit^2) / fit^2 / (D - 1))``.
    """

    def __init__(self, x: np.ndarray):
        dims = x.shape[1]
        self.dims = dims
        self.rotated = x @ rotation(dims, 0)
        self.words = self._packed(self.rotated > 0)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.float32)
        norm = np.linalg.norm(self.rotated, axis=1)
        self.fit = np.abs(self.rotated).sum(axis=1) / math.sqrt(dims) / norm
        self.error = BOUND_Z * np.sqrt(np.maximum(1 - self.fit**2, 0) / (self.fit**2 * max(dims - 1, 1)))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
        return np.ascontiguousarray(np.packbits(padded, axis=1)).view(np.uint64)

    def estimate(self, queries: slice | np.ndarray) -> np.ndarray:
        """Estimated inner products of the given rows (as queries) with all rows."""
        q = self.rotated[queries]
        low = q.min(axis=1, keepdims=True)
        step = np.maximum((q.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
        levels = np.rint((q - low) / step).astype(np.uint8)
        inner = np.zeros((len(q), len(self.words)), np.uint16)
        for j in range(QUERY_BITS):
            plane = self._packed((levels >> j) & 1 == 1)
            for w in range(plane.shape[1]):
                inner += np.bitwise_count(plane[:, w, None] & self.words[None, :, w]).astype(np.uint16) << j
        quantised = low[:, 0] * self.dims + step[:, 0] * levels.sum(axis=1)
        signed = 2 * (low * self.ones[None, :] + step * inner) - quantised[:, None]
        return signed / (math.sqrt(self.dims) * self.fit[None, :])


def _nearest(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates ``b`` for the queries ``rows[a]`` the best by the vectors."""
    cosine = np.einsum("ij,ij->i", x[rows[a]], x[b], dtype=np.float64)
    keep = cosine >= least
    a, b, cosine = a[keep], b[keep], cosine[keep]
    order = np.lexsort((ids[b], -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    top = rank < k
    return ids[rows[a[top]]], ids[b[top]], cosine[top]


def _joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(part) for part in zip(*found)) if found else tuple(np.empty(0) for _ in range(3))


def search_cell(ids: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, other, cosine)``: for each id its at most ``k`` nearest other
    ids in the cell with cosine ``least`` or more, ties to the smaller id."""
    ids, first = np.unique(ids, return_index=True)
    x, found = x[first], []
    if len(ids) < 2:
        return _joined(found)
    codes = BitCodes(x)
    size = max(1, min(len(ids), 400_000 // len(ids)))
    for at in range(0, len(ids), size):
        rows = np.arange(at, min(at + size, len(ids)))
        estimate = codes.estimate(rows)
        estimate[np.arange(len(rows)), rows] = -9
        maybe = estimate + codes.error >= least
        crowded = np.flatnonzero(maybe.sum(axis=1) > 4 * k)
        if len(crowded):
            # what cannot reach the k-th best guaranteed value needs no reranking
            low = np.where(maybe[crowded], estimate[crowded] - codes.error, -9)
            kth = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k]
            maybe[crowded] &= estimate[crowded] + codes.error >= kth
        a, b = np.nonzero(maybe)
        if len(a) > 0.05 * maybe.size and len(ids) > 1000:
            # the filter does not separate near-copies: comparing all pairs is cheaper
            none = np.zeros(len(ids), np.int64)
            return search_tile(ids, x, none, none, k, least)
        if len(a):
            found.append(_nearest(ids, x, rows, a, b, k, least))
    return _joined(found)


def search_tile(ids: np.ndarray, x: np.ndarray, group: np.ndarray, seen: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`search_cell`, without a filter, for the pairs of two groups
    of a divided cell (or of one with itself).

    All pairs are compared but those that share an earlier divided cell, which
    meet there.  Rows are compared as residuals from their mean, so that the
    order among near-copies is that of the vectors.
    """
    ids, first = np.unique(ids, return_index=True)
    x, group, seen, found = x[first], group[first], seen[first], []
    residual = (x - x.mean(axis=0, dtype=np.float64)).astype(np.float32)
    half = (residual.astype(np.float64) ** 2).sum(axis=1) / 2
    slack = np.float32(4e-6 * half.max(initial=0))  # rounding of a score
    half = half.astype(np.float32)
    numbers = np.unique(group)
    for mine in numbers:
        # a tile of one group compares it with itself, one of two each with the other
        others = np.flatnonzero(group != mine) if len(numbers) > 1 else np.arange(len(ids))
        queries = np.flatnonzero(group == mine)
        for mark in np.unique(seen[queries]):
            base = others[(seen[others] & mark) == 0]
            same = queries[seen[queries] == mark]
            if not len(base):
                continue
            size = max(1, 2_000_000 // len(base))
            for at in range(0, len(same), size):
                rows = same[at : at + size]
                score = residual[rows] @ residual[base].T  # less half the squared distance, but for the query's part
                score -= half[base]
                if len(numbers) == 1 and not mark:
                    score[np.arange(len(rows)), np.searchsorted(base, rows)] = -np.inf
                width = max(len(base) // 32, 1)
                best = score[:, :width].copy()
                for i in range(width, len(base) // width * width, width):
                    np.maximum(best, score[:, i : i + width], out=best)
                if width < k:
                    best = score
                # the k-th best of the maxima is no more than the k-th best of all
                kth = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k] if best.shape[1] >= k else np.float32(-np.inf)
                a, b = np.nonzero((score >= kth - slack) & (score > -np.inf))
                found.append(_nearest(ids, x, rows, a, base[b], k, least))
    return _joined(found)


def _search_batches(plan: CellPlan, dims: int, k: int, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Search the tiles of a partition, which come sorted, one at a time."""
    divided = plan.divided[0] if plan.divided else {}

    def result(cell: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, x, group, seen = (np.concatenate(p) for p in zip(*parts))
        a, b, c = search_tile(ids, x, group, seen, k, least) if cell in divided else search_cell(ids, x, k, least)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64))], names=["id", "other", "cosine"])

    current, parts = None, []
    for batch in batches:
        cell, tile, ids, group, seen = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        x = unpacked(batch.column(5), dims)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(ids)]):
            if s == e:
                continue
            key = (int(cell[s]), int(tile[s]))
            if key != current and parts:
                yield result(current[0], parts)
                parts = []
            current = key
            parts.append((ids[s:e], x[s:e], group[s:e], seen[s:e]))
    if parts:
        yield result(current[0], parts)


def _split_copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows to search, and ``(id, ids)`` of surplus copies with the copies they pair with.

    Of a vector with more than ``COPIES`` copies (equal in all its steps) only
    the ``k + 1`` smallest ids are searched.  The others have ``k`` equals of
    cosine 1, and so does any vector that would take them: ties go to the
    smaller id.  A hash finds where copies may be, their values tell.
    """
    hashed = rows.withColumn("h", F.xxhash64("v"))
    many = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES).select("h")
    if many.isEmpty():
        return rows, None
    members = hashed.join(many, "h", "left_semi").select("id", "v")
    whole = members.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES).select("v")
    # the smallest ids of each salted part come first, so that no group is gathered whole
    salted = members.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(1024)))
    rank = F.dense_rank().over(Window.partitionBy("v", "s").orderBy("id"))
    first = salted.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).groupBy("v").agg(F.collect_set("id").alias("ids"))
    few = first.join(whole, "v", "left_semi").select("v", F.slice(F.array_sort("ids"), 1, k + 1).alias("ids"))
    joined = rows.join(few, "v", "left")
    extra = F.col("ids").isNotNull() & ~F.array_contains("ids", F.col("id"))
    return joined.where(~F.coalesce(extra, F.lit(False))).select("id", "v"), joined.where(extra).select("id", "ids")


def plan_cells(rows: DataFrame, dims: int, cell_rows: int = CELL_ROWS) -> CellPlan:
    """Count placements and divide cells above ``cell_rows``.

    The driver gets one number per over-full cell, at most ``2^17``.
    """
    plan = CellPlan(*cell_count(rows.count()))
    counted = rows.mapInArrow(lambda it: _count_batches(plan, dims, it), "cell long, n long")
    large = counted.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > cell_rows).collect()
    plan.divided.append({r["cell"]: -(-r["n"] // cell_rows) for r in large})
    return plan


def most_similar(df: DataFrame, row_id: str, vector: str, dims: int = 64, k: int = 5, least: float = 0.8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id, other, cosine)``: for each valid row its at most ``k`` other valid
    rows of greatest cosine, of those with ``least`` or more.

    A vector is valid if it has ``dims`` finite numbers that are not all zero
    and its id is not null; other rows take no part.  Rows repeated under one
    id are one row (their vectors are taken to be equal).  Ties go to the
    smaller id.  The search is approximate: a pair is found if the two share
    one of their nearest cells (measured recall is in the README); cosines are
    exact to 5e-6 as a rule and 3e-5 at most.  An empty table, or one without valid rows, gives no
    rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    rows = written(rows.mapInArrow(lambda it: _unit_batches(dims, it), "id long, v binary"))
    rows, surplus = _split_copies(rows, k)
    if surplus is not None:
        rows = written(rows)
    plan = plan_cells(rows, dims, cell_rows)
    shared = spark.sparkContext.broadcast(plan)  # bounded, see plan_cells
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.mapInArrow(lambda it: _place_batches(shared.value, dims, it), "cell long, tile long, id long, group long, seen long, v binary")
    hits = (
        placed.repartition(width, "cell", "tile")
        .sortWithinPartitions("cell", "tile")
        .mapInArrow(lambda it: _search_batches(shared.value, dims, k, least, it), "id long, other long, cosine double")
    )
    best = hits.repartition(width, "id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    out = best.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    if surplus is not None:
        pairs = surplus.select("id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine")).distinct()
        out = out.unionByName(pairs)
    return out


def as_pairs(similar: DataFrame) -> DataFrame:
    """The unordered pairs ``(row_lo, row_hi)`` of :func:`most_similar`, each once."""
    return similar.select(F.least("id", "other").alias("row_lo"), F.greatest("id", "other").alias("row_hi")).distinct()
