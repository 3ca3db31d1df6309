"""The haplotype graph with nodes merged by how alike their haplotypes go on.

At each site a node is a parent's allele. Two nodes of one allele, of which one at least has a sibling, may be merged:

- of nodes whose sizes multiply to less than EXACT, if the shares of their haplotypes that go on in any one way, over
  any number of the sites looked ahead, differ by no more than TIGHT of 0.9 * sqrt(1 / n + 1 / m); where one has FEW
  haplotypes at most, each of the smaller one's must also have one of the other's that goes on alike over NEAR sites;
- of larger ones, if their haplotypes' places in the order of what comes behind the site overlap, the coordinates along
  that order don't differ (a t-test of the group at 5 %), and a two-sample test of the places has p above 0.1.

Pairs of large nodes go first, by p, then the others, nearest first. What was merged is tested anew: each node keeps
its best partner, in a heap, so a site holds one pair a node. How far the tests look ahead adapts to how many
haplotypes they leave undecided at their end. The work goes from site to site within a region; regions are groups of
bounded size (distinct haplotypes with their counts) and run side by side. Counts by way are kept in blocks of at most
BLOCK numbers, made anew where a site needs more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import kolmogorov_of, t_two_sided
from . import haplotypes
from .ranges import spread

EDGES = "region long, site int, parent int, child int, allele int, n long"
# The tests' bounds, and the look-ahead's.
EXACT, SCALE, TIGHT, FEW, NEAR, LEVEL = 10_000, 0.9, 0.8, 5, 5, 0.1
SHORT, LEAST_LENGTH, LEFT, FARTHEST = 10, 20, 0.01, 500
BLOCK = 1 << 22


def next_ahead(ratio: float, depth: int, last: int) -> int:
    """How far to look from the next site: a short way if few haplotypes were left undecided, and farther if many."""
    if ratio <= 1:
        return SHORT
    if depth < 0.85 * last:
        return 1 + round(0.95 * last)
    if ratio > 2 and depth > 0.95 * last:
        return int(np.ceil((1 + ratio / 20) * last))
    return last


def overlapping(a: np.ndarray, b: np.ndarray, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> bool:
    """Whether one of two sorted sets of places (with counts) lies within the other, or more than half as many as the
    smaller set has lie in front of the other's end."""
    na, nb = (np.ones(len(x), np.int64) if n is None else n for x, n in ((a, na), (b, nb)))
    if (a[0] < b[0]) == (a[-1] >= b[-1]):
        return True
    inside = nb[b < a[-1]].sum() if a[0] < b[0] else na[a < b[-1]].sum()
    return bool(inside / min(na.sum(), nb.sum()) > 0.5)


def distance(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> float:
    """The greatest difference of the two sets' distributions over their places."""
    at = np.unique(np.concatenate([a, b]))
    share = lambda x, n: np.concatenate([[0], np.cumsum(n)])[np.searchsorted(x, at, "right")] / n.sum()
    return float(np.abs(share(a, na) - share(b, nb)).max())


class Site:
    """The nodes of a site: which haplotype is in which, and the tests between them."""

    def __init__(self, back: np.ndarray, counts: np.ndarray, node: np.ndarray, allele: np.ndarray, related: np.ndarray, behind: int, ahead: int):
        """back: what comes behind the site, as numbers of `behind` bits, the next site first; the haplotypes are sorted
        by it. ahead: how many of those sites are looked at."""
        self.back, self.counts, self.node, self.allele = back, counts, node.copy(), allele
        self.behind, self.ahead = behind, min(ahead, behind)
        self.k, self.related = len(allele), related.copy()
        self.sizes = np.bincount(node, counts, self.k)
        self.alive = np.ones(self.k, bool)
        self.ways = [np.unique(back >> (behind - t), return_inverse=True) for t in range(1, self.ahead + 1)]
        whole = self.k * sum(len(w) for w, _ in self.ways)
        self.kept = list(self._blocks()) if whole <= BLOCK else None
        near = min(NEAR, behind)
        self.near = np.zeros((self.k, 1), bool)
        if near and (self.sizes <= FEW).any():
            ways, which = np.unique(back >> (behind - near), return_inverse=True)
            self.near = np.zeros((self.k, len(ways)), bool)
            self.near[node, which] = True
        # coordinates: along the order, each haplotype is as far from the one before it of its allele as they are unlike
        self._coordinates()

    def _blocks(self) -> Iterator[np.ndarray]:
        for ways, which in self.ways:
            width = max(1, BLOCK // self.k)
            for low in range(0, len(ways), width):
                on = (which >= low) & (which < low + width)
                n = min(width, len(ways) - low)
                yield np.bincount(self.node[on] * n + which[on] - low, self.counts[on], self.k * n).reshape(self.k, n)

    def _coordinates(self) -> None:
        """By node the sums of the coordinates and of their squares. Equal haplotypes are a step apart."""
        allele, n = self.allele[self.node], self.counts.astype(float)
        alike = np.zeros(len(n))
        for side in (0, 1):
            at = np.flatnonzero(allele == side)
            apart = self.back[at[1:]] ^ self.back[at[:-1]]
            same = self.behind - np.ceil(np.log2(apart.astype(float) + 1))
            alike[at[1:]] = same + 1  # the site's own allele is one of those they share
        first, step = 1.0 / np.maximum(alike, LEAST_LENGTH), 1.0 / max(self.behind + 1, LEAST_LENGTH)
        ends = np.cumsum(first + (n - 1) * step)
        start = ends - (n - 1) * step
        one, two = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        # haplotypes that go on alike have no order among them: each has its share of their coordinates
        group = np.unique(self.back, return_inverse=True)[1]
        whole = np.bincount(group, n)
        mean = lambda x: (np.bincount(group, x) / whole)[group]
        self.y = np.bincount(self.node, n * mean(n * start + step * one), self.k)
        self.yy = np.bincount(self.node, n * mean(n * start**2 + 2 * start * step * one + step**2 * two), self.k)

    def _unlike(self, a: int) -> np.ndarray:
        """Whether the coordinates of each node differ from those of a."""
        n, sx = self.sizes + self.sizes[a], self.sizes
        sy, syy, sxy = self.y + self.y[a], self.yy + self.yy[a], self.y
        vx, vy = n * sx - sx * sx, n * syy - sy * sy
        with np.errstate(all="ignore"):
            r2 = np.where((vx > 0) & (vy > 1e-9 * n * syy), (n * sxy - sx * sy) ** 2 / (vx * vy), 0.0)
            t = np.sqrt(r2 * np.maximum(n - 2, 0) / np.maximum(1 - r2, 1e-12))
        return t_two_sided(t, np.maximum(n - 2, 1)) < 0.05

    def against(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """By node, the p-value of a pair with a (-1 if it is not to be merged), and the distance."""
        p, far = np.full(self.k, -1.0), np.zeros(self.k)
        may = self.alive & (self.allele == self.allele[a]) & (self.related | self.related[a])
        may[a] = False
        if not may.any():
            return p, far
        for block in self.kept if self.kept is not None else self._blocks():
            far = np.maximum(far, np.abs(block / self.sizes[:, None] - block[a] / self.sizes[a]).max(axis=1))
        small = may & (self.sizes * self.sizes[a] < EXACT)
        limit = SCALE * np.sqrt(1.0 / self.sizes + 1.0 / self.sizes[a])
        within = small & (far <= TIGHT * limit)
        if (few := within & (np.minimum(self.sizes, self.sizes[a]) <= FEW)).any():
            lacks = np.where(self.sizes <= self.sizes[a], (self.near & ~self.near[a]).any(axis=1), (self.near[a] & ~self.near).any(axis=1))
            within &= ~(few & lacks)
        p[within] = LEVEL + 1e-5
        if (large := may & ~small).any():
            on = self.node == a
            for b in np.flatnonzero(large & ~self._unlike(a)).tolist():
                other = self.node == b
                sets = self.back[on], self.back[other], self.counts[on], self.counts[other]
                if overlapping(*sets):
                    far[b] = distance(*sets)
                    p[b] = kolmogorov_of(far[b] * np.sqrt(self.sizes[a] * self.sizes[b] / (self.sizes[a] + self.sizes[b])))
        p[p <= LEVEL] = -1.0
        return p, far

    def join(self, a: int, b: int) -> None:
        """b becomes part of a."""
        self.node[self.node == b] = a
        for x in (self.sizes, self.y, self.yy):
            x[a] += x[b]
        self.near[a] |= self.near[b]
        self.related[a] |= self.related[b]
        self.alive[b] = False
        for block in self.kept or ():
            block[a] += block[b]
            block[b] = 0

    def undecided(self, pairs: list[tuple[int, int]]) -> float:
        """How many of the pairs' haplotypes are still in ways that both go when the look-ahead ends."""
        if not pairs or not self.ways:
            return 0.0
        which, found = self.ways[-1][1], 0.0
        for a, b in pairs:
            on, other = self.node == a, self.node == b
            both = np.intersect1d(which[on], which[other])
            found += self.counts[(on | other) & np.isin(which, both)].sum()
        return found

    def merge(self, adapting: bool) -> tuple[np.ndarray, float]:
        """For each haplotype its node after merging, and what was left undecided (if asked for)."""
        heap: list[tuple[float, float, int, int, int]] = []
        best: list[tuple[float, float, int, int] | None] = [None] * self.k
        pairs = []

        def take(owner: int, pair: tuple[float, float, int, int]) -> None:
            best[owner] = pair
            heapq.heappush(heap, (*pair, owner))

        def pair_of(a: int, b: int, p: np.ndarray, far: np.ndarray) -> tuple[float, float, int, int]:
            return -float(p[b]), float(far[b]), min(a, b), max(a, b)

        def seek(a: int, p: np.ndarray, far: np.ndarray) -> None:
            best[a] = None
            if (p > 0).any():
                take(a, pair_of(a, int(np.lexsort((np.arange(self.k), far, -p))[0]), p, far))

        for a in range(self.k):
            p, far = self.against(a)
            seek(a, p, far)
            pairs += [(a, int(b)) for b in np.flatnonzero(p > 0) if adapting and b > a]
        left = self.undecided(pairs)
        while heap:
            *pair, owner = heapq.heappop(heap)
            if best[owner] != tuple(pair):
                continue
            a, b = pair[2:]
            self.join(a, b)
            best[b] = None
            # what had either of the two as partner looks anew; others change if a is now nearer than their own
            for c in np.flatnonzero(self.alive).tolist():
                if c != a and best[c] is not None and (a in best[c][2:] or b in best[c][2:]):
                    seek(c, *self.against(c))
            p, far = self.against(a)
            seek(a, p, far)
            for c in np.flatnonzero(p > 0).tolist():
                new = pair_of(a, c, p, far)
                if best[c] is None or new < best[c]:
                    take(c, new)
        return self.node, left


def merged_edges(codes: np.ndarray, counts: np.ndarray, sites: int, ahead: int) -> list[tuple[int, int, int, int, int]]:
    """(site, parent, child, allele, n) of a region; parents of the first site are -1. Nodes are not merged at the last
    site, after which nothing comes."""
    label, out = np.full(len(codes), -1), []
    back = np.zeros(len(codes), np.int64)
    for j in range(sites):
        back |= ((codes >> j) & 1) << (sites - 1 - j)
    order = np.argsort(back, kind="stable")
    end, last, total = ahead, ahead, counts.sum()
    for site in range(sites):
        bit = (codes >> site) & 1
        found, node = np.unique(2 * (label + 1) + bit, return_inverse=True)
        new = node
        if site < sites - 1 and len(found) > 1:
            siblings = (np.bincount(found // 2)[found // 2] > 1) | (site == 0)
            behind = sites - 1 - site
            key = back & ((1 << behind) - 1)
            order = np.lexsort((codes, key))
            depth = max(1, end - site)
            here = Site(key[order], counts[order], node[order], found % 2, siblings, behind, depth)
            moved, left = here.merge(adapting=depth < behind)
            into = np.empty(len(codes), np.int64)
            into[order] = moved
            new = np.unique(into, return_inverse=True)[1]
            wanted = min(FARTHEST, next_ahead(left / (LEFT * total), depth - 1, last))
            if wanted > depth - 1:
                end, last = min(end + wanted - depth + 1, sites - 1), wanted
        edges, which = np.unique(np.stack([label, new, bit], axis=1), axis=0, return_inverse=True)
        n = np.bincount(which.ravel(), counts, len(edges)).astype(int)
        out += [(site, *map(int, e), int(c)) for e, c in zip(edges, n)]
        label = new
    return out


def merged_graph(haps: DataFrame, sites: int, ahead: int = 16) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as haplotypes.graph() gives them, of haplotypes (region, hap_id, code), with nodes merged; ahead:
    sites looked ahead at first. An empty table gives an empty graph."""
    counts = spread(haps, "region").groupBy("region", "code").agg(F.count(F.lit(1)).alias("n"))
    schema = pa.schema({"region": pa.int64(), "site": pa.int32(), "parent": pa.int32(), "child": pa.int32(), "allele": pa.int32(), "n": pa.int64()})

    def grow(rows: pa.Table) -> pa.Table:
        region = rows.column("region")[0].as_py()
        made = merged_edges(rows.column("code").to_numpy(), rows.column("n").to_numpy(), sites, ahead)
        columns = zip(*made)
        return pa.table([pa.array([region] * len(made), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema)

    edges = counts.groupBy("region").applyInArrow(grow, EDGES)
    nodes = edges.groupBy("region", "site", F.col("child").alias("node")).agg(F.min("allele").alias("allele"), F.sum("n").alias("n"))
    return nodes, edges


def backward_coordinates(haps: DataFrame, sites: int) -> DataFrame:
    """(region, site, hap_id, rank, div, coordinate): haplotypes.backward_order() with each haplotype's place along the order
    of what comes behind the site. A haplotype is 1 / max(length, 20) from the one before it, length being the sites it
    shares, from the site on, with the nearest before it that has its allele."""

    def made(some: haplotypes.Regions) -> Iterator[pa.RecordBatch]:
        behind = some.at  # by haplotype, at the last site
        for site, order, div in some.orders(sites, backward=True):
            step, along = np.empty(len(order)), np.empty(len(order))
            step[order] = 1.0 / np.maximum(sites - site - div, LEAST_LENGTH)
            for begin, end in zip(some.begins.tolist(), some.ends.tolist()):
                along[behind[begin:end]] = np.cumsum(step[behind[begin:end]])
            yield some.table(site, order, div=div, coordinate=along[order])
            behind = order

    return haplotypes.by_regions(haps, made, lambda h: _coordinates(h, sites), ", coordinate double")


def _coordinates(haps: DataFrame, sites: int) -> DataFrame:
    """backward_coordinates() by windows."""
    order = haplotypes.backward_windows(haps, sites)
    behind = order.select("region", (F.col("site") - 1).alias("site"), "hap_id", F.col("rank").alias("place")).where("site >= 0")
    last = haps.select("region", F.lit(sites - 1).alias("site"), "hap_id", F.lit(0).alias("place"))
    step = 1.0 / F.greatest(F.lit(sites) - F.col("site") - F.col("div"), F.lit(LEAST_LENGTH))
    by = Window.partitionBy("region", "site").orderBy("place", "hap_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return order.join(behind.unionByName(last), ["region", "site", "hap_id"]).select("region", "site", "hap_id", "rank", "div", F.sum(step).over(by).alias("coordinate"))


def overlap(rows: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(key, n, m, share, overlaps) of the two groups' (0 and 1) values of each key: overlapping() as sums, share being
    the part of the smaller group's size that lies in front of the other's end; null where one lies within the other."""
    side = lambda k, f, name: f(F.when(F.col(group) == k, F.col(value))).alias(f"{name}{k}")
    ends = rows.groupBy(key).agg(*[side(k, f, n) for k in (0, 1) for f, n in ((F.count, "n"), (F.min, "low"), (F.max, "high"))]).where("n0 > 0 AND n1 > 0")
    v, first = F.col(value), F.col("low0") < F.col("low1")
    inside = F.when(first, (F.col(group) == 1) & (v < F.col("high0"))).otherwise((F.col(group) == 0) & (v < F.col("high1")))
    within = first == (F.col("high0") >= F.col("high1"))
    found = rows.join(ends, key).groupBy(key).agg(F.first("n0").alias("n"), F.first("n1").alias("m"), F.first(within).alias("within"), F.sum(inside.cast("long")).alias("inside"))
    share = F.when(~F.col("within"), F.col("inside") / F.least("n", "m"))
    return found.select(key, "n", "m", share.alias("share"), F.coalesce(share > 0.5, F.lit(True)).alias("overlaps"))
