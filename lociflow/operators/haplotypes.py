"""Ordered haplotypes (positional Burrows-Wheeler) at every site, forwards and backwards, their clusters, and the
haplotype graph. A haplotype of a region is one whole number, code, a bit a site.

Orders at every site have as many rows as there are haplotypes and sites, so haplotypes, not those rows, are shuffled and
sorted: a task holds some whole regions and goes from site to site, parting the order by the site's allele. All else is
windows and groupings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import spread

#: Haplotypes that a task orders at once, and those of the largest region that it holds; larger ones go by windows, which
#: can spill.
AT_ONCE, HELD = 1 << 16, 1 << 20


def pbwt(haps: DataFrame) -> DataFrame:
    """Rank by the reversed haplotype, and the site from which a haplotype agrees with the one before it. The order of
    the reversed strings is that of the codes, so no step from site to site is needed."""
    order = Window.partitionBy("region").orderBy("code", "hap_id")
    rows = haps.withColumns({"rank": F.row_number().over(order), "before": F.lag("code").over(order)})
    differ = F.col("code").bitwiseXOR(F.col("before"))
    return rows.select("region", "hap_id", "code", "rank", F.when(F.col("before").isNull(), -1).when(differ == 0, 0).otherwise(F.length(F.bin(differ))).alias("agree_from"))


def _ranked(distinct: DataFrame, first: Column) -> DataFrame:
    """Distinct keys (region, site, key, n) with their place among those of the site: from, the rows before theirs, and
    div, the highest bit in which they differ from the key before (counted from 1; first's value for the first)."""
    by = Window.partitionBy("region", "site").orderBy("key")
    before = F.lag("key").over(by)
    start = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return distinct.select("*", start.alias("from"), F.when(before.isNull(), first).otherwise(F.length(F.bin(F.col("key").bitwiseXOR(before)))).alias("div"))


def _at_sites(haps: DataFrame, sites: int, key: Column) -> DataFrame:
    # one shuffle of haplotypes, by which all later keys, which begin with the region, are dealt too
    return spread(haps, "region").withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1)))).withColumn("key", key)


def _order(haps: DataFrame, sites: int, key: Column, first: Column) -> DataFrame:
    """(region, site, hap_id, rank, div): the windows run over distinct keys; only ties are ranked by haplotype."""
    rows = _at_sites(haps, sites, key)
    of = _ranked(rows.groupBy("region", "site", "key").agg(F.count(F.lit(1)).alias("n")), first)
    tie = F.row_number().over(Window.partitionBy("region", "site", "key").orderBy("hap_id"))
    rows = rows.select("region", "site", "key", "hap_id", tie.alias("tie")).join(of, ["region", "site", "key"])
    return rows.select("region", "site", "hap_id", (F.col("from") + F.col("tie") - 1).cast("int").alias("rank"), F.when(F.col("tie") == 1, F.col("div")).otherwise(0).cast("int").alias("div"))


def _bits(x: np.ndarray) -> np.ndarray:
    """How many binary digits numbers have; halves are exact as floats."""
    high = x >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(float))[1])


class Regions:
    """The haplotypes of some whole regions, one region after the other, and by haplotype within each."""

    def __init__(self, rows: pa.Table, begins: np.ndarray):
        self.region, self.hap_id = rows["region"].combine_chunks(), rows["hap_id"].combine_chunks()
        self.none = rows["code"].is_null().to_numpy()
        self.codes = rows["code"].combine_chunks().fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
        self.begins, self.ends = begins, np.append(begins[1:], len(self.codes))
        self.sizes = self.ends - self.begins
        self.begin = np.repeat(self.begins, self.sizes)
        self.at = np.arange(len(self.codes))

    def _parted(self, order: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The order with those that are behind after the others of their region; each of the two keeps its order."""
        front = ~behind[order]
        ahead = np.cumsum(front) - front
        many = np.add.reduceat(front.astype(np.int64), self.begins)
        ahead -= ahead[self.begin]
        out = np.empty_like(order)
        out[self.begin + np.where(front, ahead, np.repeat(many, self.sizes) + self.at - self.begin - ahead)] = order
        return out

    def orders(self, sites: int, backward: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(site, order, div) from site to site: the haplotypes in the order of what they have read back from the site, or
        on from it, and the highest place in which each differs from the one before it. Haplotypes without a code stand
        last."""
        keys = self.codes
        if backward:
            keys = np.zeros_like(self.codes)
            for s in range(sites):
                keys |= ((self.codes >> np.uint64(s)) & np.uint64(1)) << np.uint64(sites - 1 - s)
        order = self.at
        for site in range(sites - 1, -1, -1) if backward else range(sites):
            order = self._parted(order, (self.codes >> np.uint64(site)) & np.uint64(1) > 0)
            order = self._parted(order, self.none) if self.none.any() else order
            n = sites - site if backward else site + 1
            key = keys[order] & np.uint64((1 << n) - 1)
            div = np.append(n, _bits(key[1:] ^ key[:-1])).astype(np.int32)
            div[self.begins] = n
            div[self.none[order]] = n
            yield site, order, div

    def table(self, site: int, order: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        rank = (self.at - self.begin).astype(np.int32)
        made = {"region": self.region, "site": np.full(len(order), site, np.int32), "hap_id": self.hap_id.take(pa.array(order)), "rank": rank} | columns
        return pa.RecordBatch.from_pydict({n: x if isinstance(x, pa.Array) else pa.array(x) for n, x in made.items()})


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[Regions]:
    """Some whole regions at a time of rows (region, hap_id, code) sorted by region and haplotype."""
    held: list[pa.RecordBatch] = []
    n, most = 0, AT_ONCE

    def begins(rows: pa.Table) -> np.ndarray:
        one, two = (rows["region"].combine_chunks().slice(k, len(rows) - 1) for k in (0, 1))
        new = pc.and_not(pc.fill_null(pc.not_equal(one, two), True), pc.and_(pc.is_null(one), pc.is_null(two)))
        return np.append(0, np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            found = begins(rows)
            if len(found) > 1:  # the last may go on
                yield Regions(rows.slice(0, found[-1]), found[:-1])
            held = rows.slice(found[-1]).to_batches()
            n = len(rows) - int(found[-1])
            most = max(AT_ONCE, 2 * n)
    if n:
        rows = pa.Table.from_batches(held)
        yield Regions(rows, begins(rows))


def by_regions(haps: DataFrame, made: Callable[[Regions], Iterator[pa.RecordBatch]], large: Callable[[DataFrame], DataFrame], more: str = "") -> DataFrame:
    """(region, site, hap_id, rank, div and more) that `made` gives of whole regions, as tasks hold some at a time; regions
    of over HELD haplotypes are those of large()."""
    rows = spread(haps.select("region", "hap_id", "code"), "region")
    # counted by what all of this reads, so that the shuffle is one
    wide = rows.groupBy(F.col("region").alias("__lf_wide")).agg(F.count(F.coalesce("code", "hap_id")).alias("n")).where(F.col("n") > HELD).select("__lf_wide")
    of = lambda how: rows.join(F.broadcast(wide), F.col("region").eqNullSafe(F.col("__lf_wide")), how)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _regions(batches):
            yield from made(some)

    kinds = dict(haps.dtypes)
    few = of("left_anti").sortWithinPartitions("region", F.col("hap_id").asc_nulls_last())
    return few.mapInArrow(work, f"region {kinds['region']}, site int, hap_id {kinds['hap_id']}, rank int, div int{more}").unionByName(large(of("left_semi")))


def _by_site(haps: DataFrame, sites: int, backward: bool, large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return by_regions(haps, lambda some: (some.table(site, order, div=div) for site, order, div in some.orders(sites, backward)), large)


def forward_order(haps: DataFrame, sites: int) -> DataFrame:
    """The order of the haplotypes read back from each site: rank from 0, and the site from which on a haplotype agrees
    with the one before it (site + 1 where they differ at the site, 0 where they are alike)."""
    return _by_site(haps, sites, False, lambda h: _order(h, sites, F.expr("code & (shiftleft(2L, site) - 1)"), F.col("site") + 1))


def reversed_code(sites: int) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(sites - 1)), F.lit(0).cast("long"), lambda acc, s: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.call_function("shiftright", F.col("code"), s).bitwiseAND(F.lit(1))))


def backward_windows(haps: DataFrame, sites: int) -> DataFrame:
    """backward_order() by windows."""
    rows = haps.withColumn("back", reversed_code(sites))
    return _order(rows, sites, F.expr(f"back & (shiftleft(1L, {sites} - site) - 1)"), F.lit(sites) - F.col("site"))


def backward_order(haps: DataFrame, sites: int) -> DataFrame:
    """The order of the haplotypes read on from each site: rank from 0, and the number of sites to the end from the
    first in which a haplotype differs from the one before it (0 where they are alike)."""
    return _by_site(haps, sites, True, lambda h: backward_windows(h, sites))


def clusters(haps: DataFrame) -> DataFrame:
    """A dense number for each distinct haplotype of a region, with its members' count."""
    counts = haps.groupBy("region", "code").agg(F.count(F.lit(1)).alias("n"), F.min("hap_id").alias("first_hap"))
    return counts.withColumn("cluster", F.dense_rank().over(Window.partitionBy("region").orderBy("code")))


def site_clusters(haps: DataFrame, sites: int, window: int) -> DataFrame:
    """(region, site, key, n, allele, node): the distinct prefixes at each site, in order; a new node begins where a
    prefix differs from the one before within the last `window` sites."""
    prefix = F.expr("code & (shiftleft(2L, site) - 1)")
    counts = haps.groupBy("region", "code").agg(F.count(F.lit(1)).alias("n"))
    keys = _at_sites(counts, sites, prefix).groupBy("region", "site", "key").agg(F.sum("n").alias("n"))
    ranked = _ranked(keys, F.col("site") + 1)
    begins = (F.col("from") > 0) & (F.col("div") > F.col("site") + 1 - F.least(F.col("site") + 1, F.lit(window)))
    node = F.sum(begins.cast("int")).over(Window.partitionBy("region", "site").orderBy("key"))
    return ranked.select("region", "site", "key", "n", F.expr("cast(shiftright(key, site) & 1 as int)").alias("allele"), node.cast("int").alias("node"))


def graph(haps: DataFrame, sites: int, window: int) -> tuple[DataFrame, DataFrame]:
    """The haplotype graph's nodes (region, site, node, allele, n) and edges (region, site, parent, child, allele, n):
    site is the child's; an edge of the first site has parent -1. Prefixes are added up before anything is joined."""
    of = site_clusters(haps, sites, window)
    nodes = of.groupBy("region", "site", "node").agg(F.min("allele").alias("allele"), F.sum("n").alias("n"))
    parent = of.select("region", (F.col("site") + 1).alias("site"), F.col("key").alias("stem"), F.col("node").alias("parent"))
    child = of.withColumn("stem", F.expr("key & (shiftleft(1L, site) - 1)"))
    steps = child.join(parent, ["region", "site", "stem"], "left")
    edges = steps.groupBy("region", "site", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("node").alias("child")).agg(F.min("allele").alias("allele"), F.sum("n").alias("n"))
    return nodes, edges


def edge_probabilities(edges: DataFrame) -> DataFrame:
    """edges with p_child, given the parent, and p_edge, among all of the region's haplotypes."""
    of_parent, of_site = Window.partitionBy("region", "site", "parent"), Window.partitionBy("region", "site")
    return edges.withColumns({"p_child": F.col("n") / F.sum("n").over(of_parent), "p_edge": F.col("n") / F.sum("n").over(of_site)})


def node_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with p (their share of the region's haplotypes, by their own count also at the last site, where there are
    no children to count), parents (sorted), child0 and child1 (-1: none), and siblings: whether a parent has another
    child; true for all of the first site."""
    place = ["region", "site"]
    family = edges.groupBy(*place, "parent").agg(F.count(F.lit(1)).alias("children"))
    up = edges.join(family, [*place, "parent"]).groupBy(*place, F.col("child").alias("node")).agg(F.array_sort(F.collect_list("parent")).alias("parents"), F.max(F.col("children") > 1).alias("siblings"))
    of = lambda a: F.coalesce(F.max(F.when(F.col("allele") == a, F.col("child"))), F.lit(-1)).alias(f"child{a}")
    down = edges.where("parent >= 0").groupBy("region", (F.col("site") - 1).alias("site"), F.col("parent").alias("node")).agg(of(0), of(1))
    out = nodes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*place))).join(up, [*place, "node"]).join(down, [*place, "node"], "left")
    out = out.withColumns({f"child{a}": F.coalesce(f"child{a}", F.lit(-1)) for a in (0, 1)})
    first = F.col("site") == 0
    return out.withColumns({"siblings": first | F.col("siblings"), "parents": F.when(first, F.expr("cast(array() as array<int>)")).otherwise(F.col("parents"))})


def second_relatives(table: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, site, node, cousins) of a node_table(): whether a parent of the node has a sibling, so that the node has
    cousins; true for all nodes of the first two sites, in front of which all are of one family."""
    parents = table.select("region", (F.col("site") + 1).alias("site"), F.col("node").alias("parent"), "siblings")
    found = edges.join(parents, ["region", "site", "parent"]).groupBy("region", "site", F.col("child").alias("node")).agg(F.max("siblings").alias("up"))
    out = table.select("region", "site", "node").join(found, ["region", "site", "node"], "left")
    return out.select("region", "site", "node", ((F.col("site") <= 1) | F.coalesce("up", F.lit(False))).alias("cousins"))


def transitions(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (region, site, parent, child) with the edge's count and conditional probability; 0 where there is none."""
    found = edge_probabilities(edges).select("region", "site", "parent", "child", F.col("n").alias("freq"), F.col("p_child").alias("prob"))
    out = pairs.join(found, ["region", "site", "parent", "child"], "left")
    return out.withColumns({"freq": F.coalesce("freq", F.lit(0).cast("long")), "prob": F.coalesce("prob", F.lit(0.0))})


def edges(haps: DataFrame, sites: int) -> DataFrame:
    """The unmerged graph's edges (region, site, parent, allele, n), the parent being named by its prefix, with
    P(child | parent), P(edge), and whether the child has a sibling, which all of the first site have. Equal haplotypes
    are added up first, so a site costs a row for each distinct haplotype."""
    counts = haps.groupBy("region", "code").agg(F.count(F.lit(1)).alias("n"))
    steps = counts.withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1))))
    bit = F.expr("shiftright(code, site) & 1")
    parent = F.expr("code & (shiftleft(1L, site) - 1)")
    edge = steps.groupBy("region", "site", parent.alias("parent"), bit.alias("allele")).agg(F.sum("n").alias("n"))
    of_parent, of_site = Window.partitionBy("region", "site", "parent"), Window.partitionBy("region", "site")
    siblings = (F.col("site") == 0) | (F.count(F.lit(1)).over(of_parent) > 1)
    return edge.withColumns({"p_child": F.col("n") / F.sum("n").over(of_parent), "p_edge": F.col("n") / F.sum("n").over(of_site), "siblings": siblings})


def summary(edge: DataFrame) -> DataFrame:
    return edge.groupBy("site").agg(F.countDistinct("region", "parent").alias("nodes"), F.count(F.lit(1)).alias("edges"), F.sum("n").alias("haps"))


def level_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By region: mean, greatest and total number of nodes and edges over the sites, and how many haplotypes a node has
    on average."""
    level = lambda t, name: t.groupBy("region", "site").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).groupBy("region").agg(F.avg("k").alias(f"mean_{name}"), F.max("k").alias(f"max_{name}"), F.sum("k").alias(name), F.sum("n").alias(f"{name}_n"))
    out = level(nodes, "nodes").join(level(edges, "edges"), "region")
    return out.select("region", "mean_nodes", "max_nodes", "nodes", "mean_edges", "max_edges", "edges", (F.col("nodes_n") / F.col("nodes")).alias("haps_per_node"))
