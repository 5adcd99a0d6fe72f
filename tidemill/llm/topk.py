"""Exact top-k by inner product with pivot-table elimination.

Distances of every row to many pivots are computed once and stored beside its block. |q - x| >= |d(q, p) - d(x, p)| for
each pivot p, so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 has an upper bound from the table alone, for a row by its own
distances and for a whole block by the ranges of its rows' distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a block; reference vectors in the pivot table; rows that pivots are chosen among.
BLOCK = 1024
PIVOTS = 64
PIVOT_SAMPLE = 4096
#: Row blocks that a block of queries visits in one record, in order of their bounds.
VISIT = 32
PACKED = "block long, dim int, ids binary, vectors binary, distances binary, low binary, high binary, norm double, wide boolean"
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, as long. Vectors that are null, empty or hold null or
    non-finite components take no part. A component that does not fit in a long after scaling fails the run."""

    def whole(c):
        y = F.lit(float(scale)) * c.cast("double")
        return F.when((y >= -(2.0**63)) & (y < 2.0**63), F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component does not fit in a long")).cast("long"))

    x = F.transform(F.col("embedding"), whole)
    fits = F.forall(F.col("embedding"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fits, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("v"))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far apart: each next one is the sample's vector farthest from those chosen before."""
    x = sample.astype(np.float64)
    if not len(x):
        return x
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each vector to each pivot."""
    a = x.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * a @ pivots.T, 0)).astype(np.float32)


def blocks_of_cells(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """The first block of each cell and the number of blocks it is dealt to: a large cell has several of its own, small
    neighbours share one."""
    out, block, held = {}, 0, 0
    for cell in sorted(counts):
        n = -(-counts[cell] // size)
        if n > 1 or held + counts[cell] > size:
            block, held = block + (held > 0), 0
        out[cell] = (block, n)
        if n > 1:
            block += n
        else:
            held += counts[cell]
    return out


def packed(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Blocks of near `size` vectors with their pivot table, stored. Rows go to the cell of their nearest pivot, and are
    dealt by a hash inside a cell that makes several blocks."""
    fields = "vec_id long, v array<long>, dim int, cell long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 4096):
            v = batch.column(1)
            dim = np.diff(np.asarray(v.offsets)).astype(np.int32)
            values, cell, at = np.asarray(v.flatten()), np.zeros(len(dim), dtype=np.int64), np.concatenate(([0], np.cumsum(dim)))
            for n in np.unique(dim):
                if n in pivots and len(pivots[n]):
                    own = np.flatnonzero(dim == n)
                    x = values[at[own][:, None] + np.arange(n)]
                    cell[own] = to_pivots(x, pivots[n]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(dim), pa.array(cell + (dim.astype(np.int64) << 32))], names=["vec_id", "v", "dim", "cell"])

    placed = common.stored(rows.select("vec_id", "v").mapInArrow(place, fields), "cells")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    first, at = [], 0
    for dim in sorted({c >> 32 for c in counts}):  # vectors of one length are never packed with others
        own = blocks_of_cells({c: n for c, n in counts.items() if c >> 32 == dim}, size)
        first += [(c, at + b, n) for c, (b, n) in own.items()]
        at += max(b + n for b, n in own.values())
    table = rows.sparkSession.createDataFrame(first, "cell long, first long, n long")

    def pack(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        x = np.asarray(group.column("v").combine_chunks().flatten()).astype("<i8").reshape(-1, dim)
        d = to_pivots(x, pivots.get(dim, np.zeros((0, dim))))
        f = x.astype(np.float64)
        peak, norm = float(np.abs(f).max(initial=0)), float((f * f).sum(axis=1).max(initial=0))
        cols = [[group.column("block")[0].as_py()], [dim], [np.asarray(group.column("vec_id")).astype("<i8").tobytes()], [x.tobytes()], [d.tobytes()], [d.min(axis=0).tobytes()], [d.max(axis=0).tobytes()], [norm], [peak * peak * dim >= 2.0**52]]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])

    slot = F.pmod(F.xxhash64("vec_id", "v"), F.col("n"))
    dealt = placed.join(F.broadcast(table), "cell").select("vec_id", "v", "dim", (F.col("first") + slot).alias("block"))
    out = common.stored(dealt.groupBy("block").applyInArrow(pack, PACKED), "blocks")
    common.discard(placed)
    return out


def least_gap(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query, the least distance that a vector whose pivot distances lie in [low, high] can have to it."""
    if not d.shape[1]:
        return np.zeros(len(d))
    slack = np.float32(2.0**-20) * (d + high)  # single precision, and cancellation where a pivot is far
    return np.maximum(np.maximum(d - high, low - d) - slack, 0).max(axis=1).astype(np.float64)


def upper(qq: np.ndarray, xx: np.ndarray | float, gap: np.ndarray) -> np.ndarray:
    """The greatest inner product at that distance, with room for rounding."""
    return (qq + xx) * 0.50001 + 1 - gap * gap / 2


class Block:
    """A packed block, read."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes, distances: bytes, low: bytes, high: bytes, norm: float, wide: bool):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.x = np.frombuffer(vectors, dtype="<i8").reshape(-1, dim)
        self.low, self.high = np.frombuffer(low, dtype=np.float32), np.frombuffer(high, dtype=np.float32)
        self.d = np.frombuffer(distances, dtype=np.float32).reshape(len(self.ids), len(self.low))
        self.norm, self.wide = norm, wide
        self.f = self.x.astype(np.float64)
        self.xx = (self.f * self.f).sum(axis=1)


def wide_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All products in Python's integers."""
    return np.array([[sum(a * b for a, b in zip(u, v, strict=True)) for v in x.tolist()] for u in q.tolist()], dtype=object).reshape(len(q), len(x))


class Search:
    """The best k of one block of queries, over row blocks that are visited in order of their bounds.

    floor: for each query a score that k rows elsewhere are known to reach. A row is evaluated only if its bound reaches
    the k-th best score of its query so far; when no bound of the blocks that are left does, the search is over. Equal
    bounds are evaluated, for ties go to the smaller id. The rows of a block that are left are evaluated by one matrix
    product, in doubles where these are exact, else in integers of any size."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray | None = None):
        self.q, self.k = queries, k
        m = len(queries.ids)
        self.scores, self.ids = np.full((m, k), NONE, dtype=np.int64), np.full((m, k), LAST, dtype=np.int64)
        self.floor = np.full(m, NONE, dtype=np.int64) if floor is None else floor.copy()
        self.evaluated = 0

    def bound(self, b: Block) -> np.ndarray:
        """For each query, no row of the block scores more."""
        if b.wide or self.q.wide:
            return np.full(len(self.q.ids), np.inf)
        return upper(self.q.xx, b.norm, least_gap(self.q.d, b.low, b.high))

    def visit(self, blocks: list[Block]) -> None:
        bounds = [self.bound(b) for b in blocks]
        for i in sorted(range(len(blocks)), key=lambda i: -bounds[i].max(initial=-np.inf)):
            active = np.flatnonzero(bounds[i] >= self.floor)
            if len(active):
                self.evaluate(blocks[i], active)

    def evaluate(self, b: Block, active: np.ndarray) -> None:
        q = self.q
        wide = b.wide or q.wide
        for at in range(0, len(active), 64):  # what is worked on stays in cache
            a = active[at : at + 64]
            if wide:
                left = np.ones((len(a), len(b.ids)), dtype=bool)
            else:
                gap, step = np.zeros((len(a), len(b.ids)), dtype=np.float32), np.empty((len(a), len(b.ids)), dtype=np.float32)
                for j in range(q.d.shape[1]):
                    np.subtract(q.d[a, j, None], b.d[None, :, j], out=step)
                    np.abs(step, out=step)
                    step -= np.float32(2.0**-20) * (q.d[a, j].max(initial=0) + b.high[j])
                    np.maximum(gap, step, out=gap)
                left = upper(q.xx[a, None], b.xx[None, :], gap) >= self.floor[a, None]
            left &= b.ids[None, :] != q.ids[a, None]
            self.evaluated += int(left.sum())
            columns = np.flatnonzero(left.any(axis=0))
            if not len(columns):
                continue
            left = left[:, columns]
            if wide:
                score = wide_scores(q.x[a], b.x[columns])
                self.keep(a, np.where(left, score, NONE), left, b.ids[columns])
            else:
                score = np.where(left, (q.f[a] @ b.f[columns].T).astype(np.int64), NONE)
                self.keep(a, score, left, b.ids[columns])

    def keep(self, a: np.ndarray, score: np.ndarray, left: np.ndarray, ids: np.ndarray) -> None:
        left = left & (score >= self.floor[a, None])
        if score.dtype != object and score.shape[1] > self.k:
            left &= score >= np.partition(score, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(left)
        if not len(i):
            return
        who = np.concatenate((i, np.repeat(np.arange(len(a)), self.k)))
        what, which = np.concatenate((score[i, j], self.scores[a].ravel())), np.concatenate((ids[j], self.ids[a].ravel()))
        if what.dtype == object:
            place = np.empty(len(what), dtype=np.int64)
            place[sorted(range(len(what)), key=lambda n: -what[n])] = np.arange(len(what))
            values = np.unique(what)
            place = len(values) - 1 - np.searchsorted(values, what)
        else:
            place = -what
            place[what == NONE] = LAST
        order = np.lexsort((which, place, who))
        at = np.searchsorted(who[order], np.arange(len(a)))
        order = order[at[:, None] + np.arange(self.k)]  # each query has k entries at least, the empty ones last
        best = what[order]
        if best.dtype == object and any(not NONE <= s <= LAST for s in best.ravel()):
            raise OverflowError("a score among the best does not fit in a long")
        self.scores[a], self.ids[a] = best.astype(np.int64), which[order]
        self.floor[a] = np.maximum(self.floor[a], self.scores[a, -1])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The k highest integer inner products of each query among all rows but those with the query's own vec_id.

    vectors and queries: rows of vec_id and v, an array of long, as `scaled` makes them. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id, and fewer than k rows give fewer results. Only vectors of
    the query's length are candidates. A vec_id that is repeated counts as so many candidates; a query that is
    repeated with the same vector is one query, with other vectors so many queries under one id.

    Pivots are far apart among PIVOT_SAMPLE rows; what is sampled changes the bounds and not the result. Row blocks hold
    rows near one pivot, and query blocks likewise. Each query block ranks all row blocks by their bounds, VISIT at a
    time: the first ones are searched at once and give each query a k-th score; row blocks whose bound is below that
    score for all queries of the block are never sent to it; the others are, and are visited in order of bounds. A group
    of VISIT blocks gives k rows for a query at most, which are merged by query."""
    queries = queries.distinct()
    chosen = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect() if pivots else []
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r["v"]), []).append(list(r["v"]))
    table = {n: spread_out(np.array(x, dtype=np.int64), pivots) for n, x in by_dim.items()}
    rows, asked = packed(vectors, table, block), packed(queries, table, block)
    names = [f.split()[0] for f in PACKED.split(", ")]
    as_block = lambda r: Block(*(r[n] for n in names[1:]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 1):
            r = batch.to_pylist()[0]
            search = Search(as_block(r), k)
            out = []
            for x in r["others"]:
                b = Block(r["dim"], b"", b"", b"", x["low"], x["high"], x["norm"], x["wide"])
                out.append((r["block"], x["block"], float(search.bound(b).max(initial=-np.inf))))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_block", "block", "bound"])

    # ranges of blocks, in lists of a bounded length, against all query blocks of their dimension
    some = rows.groupBy("dim", F.expr("block div 256").alias("part")).agg(F.collect_list(F.struct("block", "low", "high", "norm", "wide")).alias("others")).select("dim", "others")
    ranked = asked.join(some, "dim").select(*names, "others").mapInArrow(rank, "query_block long, block long, bound double")
    place = F.row_number().over(Window.partitionBy("query_block").orderBy(F.desc("bound"), "block"))
    ranked = common.stored(ranked.withColumn("visit", F.floor((place - 1) / VISIT)), "ranked")
    found = "query_id long, query_row long, vec_id long, score long"

    def searched(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        with_floor = floors is not None

        def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                r = right.to_pylist()[0]
                q = as_block(r)
                s = Search(q, k, np.frombuffer(r["floor"], dtype="<i8") if with_floor else None)
                s.visit([as_block(x) for x in left.select(names).to_pylist()])
                i, j = np.nonzero(s.ids != LAST)
                full = s.scores[i, j] > NONE
                i, j = i[full], j[full]
                out = [q.ids[i], i + (r["block"] << 32), s.ids[i, j], s.scores[i, j]]
            common.give_back()
            return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "query_row", "vec_id", "score"])

        sent = some.join(rows, "block").select("query_block", "visit", *names)
        mine = asked if not with_floor else asked.join(floors, F.col("block") == F.col("floor_block")).drop("floor_block")
        needed = some.select(F.col("query_block").alias("q_block"), F.col("visit").alias("q_visit")).distinct().join(mine, F.col("q_block") == F.col("block"))
        return sent.groupBy("query_block", "visit").cogroup(needed.groupBy("q_block", "q_visit")).applyInArrow(search, found)

    best = common.stored(searched(ranked.where("visit = 0").select("query_block", "block", "visit"), None), "found")

    def floor_of(group: pa.Table) -> pa.Table:
        block, m = group.column("block")[0].as_py(), len(group.column("ids")[0].as_py()) // 8
        who = np.asarray(group.column("query_row").combine_chunks().drop_null()) & 0xFFFFFFFF
        score = np.asarray(group.column("score").combine_chunks().drop_null())
        out = np.full(m, NONE, dtype="<i8")
        full = np.bincount(who, minlength=m) >= k
        least = np.full(m, LAST, dtype=np.int64)
        np.minimum.at(least, who, score)
        out[full] = least[full]
        return pa.table({"floor_block": pa.array([block], pa.int64()), "floor": pa.array([out.tobytes()], pa.binary()), "least": pa.array([int(out.min())], pa.int64())})

    known = best.select(F.expr("query_row >> 32").alias("known"), "query_row", "score")
    floors = asked.select("block", "ids").join(known, F.col("block") == F.col("known"), "left").groupBy("block").applyInArrow(floor_of, "floor_block long, floor binary, least long")
    floors = common.stored(floors, "floors")
    rest = ranked.where("visit > 0").join(floors.select(F.col("floor_block").alias("query_block"), "least"), "query_block")
    more = searched(rest.where(F.col("bound") >= F.col("least")).select("query_block", "block", "visit"), floors.select("floor_block", "floor"))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    best = best.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
