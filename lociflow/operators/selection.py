"""Which of a panel's haplotypes stand for a region: blocks of few distinct ones and their cheapest cut, and the people
or haplotypes nearest to a sample or to each other, by likelihood, by mismatches and by switches between two copies.

A region's distinct haplotypes are one row; samples of a region come in rows of bounded size (phasing.chunks). Scores
of all against all are matrix products over blocks of BLOCK rows, of which only the best leave the task: no pair is a
row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genetics import hash_uniform
from . import haplotypes, phasing
from .ranges import spread

#: Rows that are compared with all others at once.
BLOCK = 256
# What a switch and a mismatch cost.
SWITCH, MISMATCH = 2, 2


def block_counts(haps: DataFrame, sites: int) -> DataFrame:
    """(region, start, stop, n, haps): how many distinct haplotypes there are over the sites from start to stop, for all
    pairs of them. In the order read back from stop, a haplotype is a new one where it agrees with the one before it
    only from behind start on; so the divergences of one order, counted, give the numbers of all starts."""
    order = haplotypes.forward_order(haps, sites)
    at = order.groupBy("region", F.col("site").alias("stop"), "div").agg(F.count(F.lit(1)).alias("n"))
    rows = at.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("stop"))))
    counts = rows.groupBy("region", "start", "stop").agg(F.sum(F.when(F.col("div") > F.col("start"), F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("haps"))
    return counts


def cheapest_cut(unique: np.ndarray, haps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each region, given distinct counts by start and stop, the least cost of all its sites and, by site, the first
    site of the block that ends there (itself for a site worked on alone), or -1. A site alone costs its haplotypes
    squared. A block goes on from its first site, which is paid for already: each further site costs four times the
    square of its distinct haplotypes and their product with all, and going over to them twice all squared. Blocks with
    more distinct ones than half of all are not taken."""
    regions, sites, _ = unique.shape
    alone, moved = haps**2, 2 * haps**2
    cost, path = np.empty((regions, sites)), np.zeros((regions, sites), np.int64)
    cost[:, 0] = alone
    for i in range(1, sites):
        cost[:, i], path[:, i] = cost[:, i - 1] + alone, i
        for first in range(i - 1, -1, -1):
            u = unique[:, first, i]
            other = np.where(u > haps / 2, np.inf, cost[:, first] + (4 * u * u + u * haps) * (i - first) + moved)
            better = other < cost[:, i]
            cost[better, i], path[better, i] = other[better], first
    starts = np.full((regions, sites), -1)
    starts[:, 0] = 0
    for r in range(regions):
        at = sites - 1
        while at > 0:
            starts[r, at] = path[r, at]
            at = path[r, at] if path[r, at] < at else at - 1
    return cost[:, -1], starts


def cheapest_blocks(counts: DataFrame, sites: int) -> DataFrame:
    """(region, cost, blocks) of block_counts(): the cheapest cut of a region's sites, as an array of (start, stop)."""
    each = counts.groupBy("region").agg(F.max("haps").alias("haps"), F.array_sort(F.collect_list(F.struct("start", "stop", "n"))).alias("counts"))

    @F.pandas_udf("cost double, blocks array<struct<start:int,stop:int>>")
    def cut(haps: pd.Series, counts: pd.Series) -> pd.DataFrame:
        unique = np.zeros((len(haps), sites, sites))
        for r, rows in enumerate(counts):
            for x in rows:
                unique[r, x["start"], x["stop"]] = x["n"]
        cost, starts = cheapest_cut(unique, haps.to_numpy(float))
        blocks = [[{"start": int(a), "stop": k} for k, a in enumerate(row) if a >= 0] for row in starts.tolist()]
        return pd.DataFrame({"cost": cost, "blocks": blocks})

    return spread(each, "region").withColumn("c", cut("haps", "counts")).select("region", "c.cost", "c.blocks")


def greedy_blocks(counts: DataFrame, sites: int, most: int) -> DataFrame:
    """(region, start, stop, n) of block_counts(): a region's sites from the first on in blocks as long as they hold at
    most `most` distinct haplotypes, one site at least."""
    fits = counts.where((F.col("n") <= most) | (F.col("start") == F.col("stop")))
    each = fits.groupBy("region", "start").agg(F.max(F.struct("stop", "n")).alias("b")).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("start", "b.stop", "b.n"))).alias("all"))
    none = F.expr("cast(array() as array<struct<start:int,stop:int,n:bigint>>)")

    def step(acc, x):
        return F.when(x["start"] != acc["at"], acc).otherwise(F.struct((x["stop"] + 1).alias("at"), F.concat(acc["found"], F.array(x)).alias("found")))

    chain = F.aggregate("all", F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return each.select("region", F.inline(chain))


def people(haps: DataFrame) -> DataFrame:
    """(region, person, code1, code2) of those who have both haplotypes of a region: hap_id is twice the person, plus 0
    or 1."""
    side = lambda k: F.max(F.when(F.col("hap_id") % 2 == k, F.col("code"))).alias(f"code{k + 1}")
    return haps.groupBy("region", F.expr("hap_id div 2").alias("person")).agg(side(0), side(1)).where("code1 IS NOT NULL AND code2 IS NOT NULL")


def _people_rows(haps: DataFrame) -> DataFrame:
    return people(haps).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("person", "code1", "code2"))).alias("people"))


def _bits(codes: np.ndarray, sites: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(sites)) & 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(row, rank, column) of each row's k least scores, ties to the lesser id; infinite ones don't count. ids ascend."""
    for row, s in enumerate(scores):
        for rank, at in enumerate(np.argsort(s, kind="stable")[:k].tolist()):
            if np.isfinite(s[at]):
                yield row, rank + 1, at


def by_likelihood(phreds: DataFrame, haps: DataFrame, sites: int, k: int) -> DataFrame:
    """(region, sample_id, rank, person, loglik): the k people of the panel one of whose haplotypes gives a sample's reads
    (region, sample_id, site, pl0, pl1, pl2) the greatest likelihood, the sample's other allele being drawn by the
    panel's frequencies; ties, to six digits, to the lesser person. Samples of a region without people drop out."""
    share = haps.groupBy("region").agg(F.array(*[F.avg(F.expr(f"1.0D - (shiftright(code, {s}) & 1)")) for s in range(sites)]).alias("ref"))
    rows = spread(phasing.chunks(phreds).join(_people_rows(haps), "region").join(share, "region"), "region", "chunk")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                region = batch.column("region")[r].as_py()
                some, who = phasing.columns(batch.column("people")[r].values), batch.column("samples")[r].values
                ref = batch.column("ref")[r].values.to_numpy()
                ids, reads = who.field("sample_id").to_numpy(), who.field("reads")
                like = np.ones((len(ids), sites, 3))
                found, of = phasing.columns(reads.flatten()), np.repeat(np.arange(len(ids)), np.diff(reads.offsets.to_numpy()))
                like[of, found["site"]] = 10.0 ** (-0.1 * np.stack([found[f"pl{g}"] for g in range(3)], axis=1))
                log = np.log(like[:, :, :2] * ref[:, None] + like[:, :, 1:] * (1 - ref)[:, None])
                one, two = (log[:, :, 0].sum(1)[:, None] + (log[:, :, 1] - log[:, :, 0]) @ _bits(some[c], sites).T for c in ("code1", "code2"))
                score = -np.round(np.maximum(one, two), 6)
                out = [(region, int(ids[a]), rank, int(some["person"][b]), float(-score[a, b])) for a, rank, b in _best(score, some["person"], k)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["region", "sample_id", "rank", "person", "loglik"])

    return rows.mapInArrow(work, "region long, sample_id long, rank int, person long, loglik double")


def longest_run(apart: np.ndarray, sites: int) -> np.ndarray:
    """The longest run of sites without a difference, by halves: bits of runs that are left after shifting them onto
    themselves."""
    left, best = ~apart & ((1 << sites) - 1), np.zeros(apart.shape, np.int64)
    while (left != 0).any():
        best += left != 0
        left &= left >> 1
    return best


def switch_cost(target: np.ndarray, one: np.ndarray, two: np.ndarray, sites: int) -> np.ndarray:
    """By target and person, the least cost of copying the target from the person's two haplotypes, changing between
    them at SWITCH and differing at MISMATCH a site."""
    t, a, b = (_bits(x, sites) for x in (target, one, two))
    first = second = None
    for s in range(sites):
        m1, m2 = (MISMATCH * (t[:, None, s] ^ x[None, :, s]) for x in (a, b))
        first, second = (m1, m2) if first is None else (np.minimum(first, second + SWITCH) + m1, np.minimum(second, first + SWITCH) + m2)
    return np.minimum(first, second)


def nearest_people(haps: DataFrame, sites: int, k: int) -> DataFrame:
    """(region, person, rank, other, switches, mismatches, longest): for each person of a region the k others from whom one
    of its haplotypes is copied at the least cost (ties to the lesser id), the mismatches of their four pairs of
    haplotypes, and the longest run of sites over which a pair agrees."""
    rows = spread(_people_rows(haps), "region")
    names = ["region", "person", "rank", "other", "switches", "mismatches", "longest"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                region, some = batch.column("region")[r].as_py(), phasing.columns(batch.column("people")[r].values)
                ids, own = some["person"], (some["code1"], some["code2"])
                for low in range(0, len(ids), BLOCK):
                    at = slice(low, low + BLOCK)
                    cost = np.minimum(*(switch_cost(c[at], *own, sites) for c in own)).astype(float)
                    cost[np.arange(len(cost)), np.arange(low, low + len(cost))] = np.inf
                    best = list(_best(cost, ids, k))
                    if not best:
                        continue
                    rows_, ranks, others = map(np.array, zip(*best))
                    apart = np.stack([one[at][rows_] ^ two[others] for one in own for two in own])
                    columns = [np.full(len(best), region), ids[at][rows_], ranks, ids[others], cost[rows_, others], np.bitwise_count(apart).sum(0), longest_run(apart, sites).max(0)]
                    yield pa.record_batch([pa.array(x.astype(np.int64)) for x in columns], names=names)

    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def weights(near: DataFrame) -> DataFrame:
    """nearest_people() with `by_mismatch`, one over one more than the mismatches, and `by_match`, the longest run."""
    return near.withColumns({"by_mismatch": 1.0 / (1 + F.col("mismatches")), "by_match": F.col("longest").cast("double")})


def sampled(rows: DataFrame, weight: str, k: int, seed: int, *keys: str, item: str) -> DataFrame:
    """k rows of each key, drawn without replacement in proportion to the weight: those of the least -ln(u) / weight, u
    being set by the seed, the keys and the item alone. Weights of 0 and less are never drawn."""
    u = hash_uniform(seed, *[F.col(c) for c in (*keys, item)])
    rows = rows.where(F.col(weight) > 0).withColumn("__lf_key", -F.log(1 - u) / F.col(weight))
    order = Window.partitionBy(*keys).orderBy("__lf_key", item)
    return rows.withColumn("__lf_rank", F.row_number().over(order)).where(F.col("__lf_rank") <= k).drop("__lf_key", "__lf_rank")
