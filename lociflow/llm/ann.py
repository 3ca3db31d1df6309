"""Approximate nearest neighbours with an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted by k-means on a bounded sample (`sample` rows of least
hash, a documented bound). They grow with the root of the number of vectors, up to `centroids` each, so that a cell
holds about `per_cell` vectors at first. Every row is indexed, in the cell of its two nearest centroids. A query visits cells in
order of the summed distance of its halves to the cells' centroids, which a heap yields pair by pair, until the cells
visited hold `candidates` vectors and `share` of all; all of them are ranked by exact distance. The share is what
vectors without structure (spread evenly over a sphere, as the test tables are) need for a recall of 0.9; vectors in
tight clusters do with far less.

Equal vectors are one entry with the smallest of their ids that a result could name, so that a vector of a third of
all rows costs a few rows: each task first reduces its own, then a salted and a last window. Entries are dealt into
shards of bounded size by cell, a large cell in parts; no cell, hot or not, is in one task. Which cells a query visits is
one number, its reach: the greatest summed distance among them. So a query is sent to each shard once, with its reach,
and not once for each cell; a shard is held, queries go past it, and each gets its best few of the cells it visits.

Edge cases: vectors that are null, of another length than most, all zeros, or that hold a null or a non-finite
component take no part; nor do rows with a null vec_id. Rows that repeat a vec_id and vector are one. A query's own
vec_id is no candidate. Ties go to the smaller vec_id. An empty table gives an empty result. Extra columns are kept
out of the result. A vec_id with several vectors is one query, whose neighbours are the nearest to any of them; as a
candidate it counts with its nearest one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffles_freed, stored

#: Vectors of a cell that are dealt out together, and vectors that make a shard of their own.
BLOCK, LEAST = 1024, 2048
#: Numbers that a task holds of its shard's vectors, and of the differences it works out at once.
NUMBERS = 1 << 22
#: Queries that a task ranks at once.
QUERIES = 512
#: Where the cells to visit hold less than this part (one in so many) of all vectors, a heap yields them.
HEAPED = 50
#: How far sums by products of matrices may be off, in parts of the squares.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 10
    every: int = 100
    centroids: int = 256
    per_cell: int = 64
    candidates: int = 4000
    share: float = 0.5
    sample: int = 20_000
    rounds: int = 20
    seed: int = 11


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(points[rng.choice(len(points), p=near / near.sum())] if near.sum() > 0 else points[rng.integers(len(points))])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        of = squared(points, c).argmin(1)
        counts = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, points)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def cells_by_distance(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (place in a * len(b) + place in b) by a + b, until those visited hold enough; empty ones are passed over."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, pushed = [(float(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}
    found, held = [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(oa[i]) * len(b) + int(ob[j])
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (float(a[oa[x]] + b[ob[y]]), x, y))
    return found


def reach(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> float:
    """The greatest a + b of the cells that are visited until they hold enough: the last one that the heap yields. Where
    that is more than a few hundredths of all, sorting the sums costs less than the heap."""
    sums = (a[:, None] + b).ravel()
    if enough * HEAPED < sizes.sum():
        return float(sums[cells_by_distance(a, b, sizes, enough)[-1]])
    filled = np.flatnonzero(sizes)
    order = filled[np.argsort(sums[filled])]
    return float(sums[order[min(np.searchsorted(np.cumsum(sizes[order]), enough), len(order) - 1)]])


def spread_blocks(parts: list[tuple[int, int]], sizes: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(cell, part, shard): the parts (cell, number of parts) of the cells, largest first, to the shards that hold least."""
    held = [(0.0, k) for k in range(shards)]
    out = []
    for cell, n in sorted(parts, key=lambda p: (-sizes[p[0]] / p[1], p)):
        for part in range(n):
            so_far, shard = heapq.heappop(held)
            out.append((cell, part, shard))
            heapq.heappush(held, (so_far + sizes[cell] / n, shard))
    return out


class Shard:
    """Some vectors by cell, each with its ids, and the nearest of queries among those of the cells within their reach."""

    def __init__(self, x: np.ndarray, ids: pa.ListArray, cell: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.x, ids = x[order], ids.take(pa.array(order))
        self.squares = (self.x**2).sum(1)
        self.ids, self.ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        self.cells, self.starts = np.unique(cell[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(self.x))

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, visits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, distance): each query's k nearest, given which of the cells it visits. Products
        of matrices say which vectors may be among them; those are measured exactly."""
        squares = (q**2).sum(1)
        bound = np.full(len(q), np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        met: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, most = 0, max(1, NUMBERS // self.x.shape[1])
        width = max(1, most // len(q))

        def settle() -> None:
            nonlocal best, waiting
            who, at = (np.concatenate(c) for c in zip(*met))
            d = np.sqrt(((self.x[at] - q[who]) ** 2).sum(1))
            n = np.diff(self.ends, prepend=0)[at]
            of = np.repeat(self.ends[at] - np.cumsum(n), n) + np.arange(n.sum())
            who, ids, d = (np.concatenate(c) for c in zip(best, (np.repeat(who, n), self.ids[of], np.repeat(d, n))))
            other = ids != query_ids[who]
            who, ids, d = who[other], ids[other], d[other]
            # an id counts with its nearest vector
            order = np.lexsort((d, ids, who))
            who, ids, d = who[order], ids[order], d[order]
            first = np.append(True, (who[1:] != who[:-1]) | (ids[1:] != ids[:-1]))[: len(who)]
            who, ids, d = who[first], ids[first], d[first]
            order = np.lexsort((ids, d, who))
            who, ids, d = who[order], ids[order], d[order]
            new = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
            bound[who[place == k - 1]] = d[place == k - 1] ** 2
            best = (who[place < k], ids[place < k], d[place < k])
            met.clear()
            waiting = 0

        for c, (low, high) in enumerate(zip(self.starts.tolist(), self.stops.tolist())):
            who = np.flatnonzero(visits[:, c])
            for start in range(low, high, width) if len(who) else ():
                stop = min(high, start + width)
                whole = squares[who, None] + self.squares[start:stop]
                d = whole - 2 * q[who] @ self.x[start:stop].T
                # what is too large for a square isn't told apart here
                one, other = np.nonzero(~(d > bound[who, None] + SLACK * whole))
                if len(one):
                    met.append((who[one], other + start))
                    waiting += len(one)
                    if waiting >= most:
                        settle()
        if met:
            settle()
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _reduced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows without those of an id beyond the smallest few of their vector."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        _, where = np.unique(_matrix(batch.column("v")), axis=0, return_inverse=True)
        order = np.lexsort((ids, where.ravel()))
        new = np.flatnonzero(np.diff(where.ravel()[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        yield batch.take(pa.array(order[place < most]))


def search(vectors: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query (vec_id divisible by `every`): its k nearest found."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))  # numbers are widened where they are reckoned with
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == length.d)
    most = how.k + 1
    few = rows.mapInArrow(lambda b: _reduced(b, most), rows.schema).distinct()
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = few.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= most)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= most)
    with shuffles_freed(spark):
        entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")

    n = entries.count()
    turn = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    points = _matrix(entries.where(turn < (1 << 30) * min(1.0, how.sample / n)).select("v").toArrow().combine_chunks().column("v").combine_chunks())
    if not len(points):
        points = _matrix(entries.select("v").limit(1).toArrow().column("v").combine_chunks())
    half = max(1, length.d // 2)
    size = int(min(how.centroids, max(16, (n / how.per_cell) ** 0.5)))
    books = (kmeans(points[:, :half], size, how.rounds, how.seed), kmeans(points[:, half:], size, how.rounds, how.seed) if length.d > half else np.zeros((1, 0)))
    numbers = rows.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in batches:
            x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, length.d))
            cell = squared(x[:, :half], a).argmin(1) * len(b) + squared(x[:, half:], b).argmin(1)
            yield pa.record_batch([batch.column("v"), batch.column("ids"), pa.array(cell.astype(np.int32))], names=["v", "ids", "cell"])

    placed = stored(entries.mapInArrow(place, f"v {numbers}, ids array<long>, cell int"), "placed")
    # at most centroids ** 2 rows
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    enough = max(how.candidates, int(how.share * n))
    visits_of = spark.sparkContext.broadcast(sizes)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in batches:
            x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, length.d))
            far = [reach(p, q, visits_of.value, enough) for p, q in zip(squared(x[:, :half], a), squared(x[:, half:], b))]
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(far, pa.float64())], names=["query_id", "v", "reach"])

    # copies of queries are no more rows than the vectors, unless a shard would be too large
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n * length.d // NUMBERS), min(partitions, how.every, -(-n // LEAST)))
    queries = rows.where(F.col("vec_id") % how.every == 0).repartition(partitions, "vec_id").distinct().mapInArrow(asking, f"query_id long, v {numbers}, reach double")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "v", "reach", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("cell"))
    # a cell of many vectors is dealt out in parts, and each to the shard that holds least so far
    parts = [(int(c), int(-(-sizes[c] // BLOCK))) for c in np.flatnonzero(sizes)]
    of_cell, of_block = spark.createDataFrame(parts, "cell int, parts int"), spark.createDataFrame(spread_blocks(parts, sizes, shards), "cell int, part int, shard int")
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    kept = placed.join(F.broadcast(of_cell), "cell").withColumn("part", part).join(F.broadcast(of_block), ["cell", "part"])
    kept = kept.select("shard", F.lit(None).cast("long").alias("query_id"), "v", F.lit(None).cast("double").alias("reach"), "ids", "cell")
    # a shard is a partition: its vectors come first, then the queries
    dealt = kept.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("query_id").asc_nulls_first())

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        some = max(1, min(QUERIES, NUMBERS // (64 * length.d)))
        held: list[tuple[np.ndarray, pa.ListArray, np.ndarray]] = []
        shard: Shard | None = None
        for batch in batches:
            n = batch.column("query_id").null_count
            if n:
                own = batch.slice(0, n)
                held.append((_matrix(own.column("v")), own.column("ids"), own.column("cell").to_numpy(zero_copy_only=False)))
            if n == batch.num_rows or not (held or shard):
                continue
            if shard is None:
                x, ids, cell = zip(*held)
                held.clear()
                shard = Shard(np.concatenate(x), pa.concat_arrays(ids), np.concatenate(cell))
            i, j = np.divmod(shard.cells, len(b))
            for start in range(n, batch.num_rows, some):
                own = batch.slice(start, some)
                q, query_ids, far = _matrix(own.column("v")), own.column("query_id").to_numpy(), own.column("reach").to_numpy()[:, None]
                visits = ~(squared(q[:, :half], a)[:, i] + squared(q[:, half:], b)[:, j] > far + SLACK * np.abs(far))
                who, found, d = shard.nearest(query_ids, q, visits, how.k)
                yield pa.record_batch([pa.array(query_ids[who]), pa.array(found), pa.array(d)], names=["query_id", "vec_id", "score"])

    best = dealt.drop("shard").mapInArrow(rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
