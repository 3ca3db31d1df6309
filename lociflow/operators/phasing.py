"""Genotypes of low-coverage samples against a haplotype graph: forward and backward sums over pairs of nodes, drawn
haplotypes, and the consensus of several draws.

A region's graph is one row (bounded by its haplotypes times its sites); the samples of a region are dealt into chunks
of bounded size, each joined with that row, so neither a region nor a sample set is in one task. All pairs of nodes are
summed, none is cut: a site costs the product of its two levels' nodes, by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import hash_uniform
from . import haplotypes
from .ranges import spread

#: Samples of a region in one row, and ids of samples where they are taken in runs.
CHUNK, RUN = 256, 1024
#: Numbers that a step of the work holds for all its samples and sites.
PAIRS = 1 << 20
#: Phreds from here on exclude a genotype.
EXCLUDED = 127
#: Seeds are taken as numbers without a sign.
MASK = (1 << 64) - 1


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, nodes, edges): a region's graph as sorted arrays of structs."""
    one = nodes.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("site", "node", "allele", "n"))).alias("nodes"))
    probable = haplotypes.edge_probabilities(edges)
    other = probable.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("site", "parent", "child", "p_child"))).alias("edges"))
    return one.join(other, "region")


def levels(nodes: dict[str, np.ndarray], edges: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By site: the nodes' alleles, their shares of the haplotypes, and P(child | parent) as a matrix. Columns come
    sorted by site and node."""
    out, before = [], 1
    for site in range(int(nodes["site"].max()) + 1):
        here, on = nodes["site"] == site, edges["site"] == site
        share = nodes["n"][here].astype(float)
        step = np.zeros((before, len(share)))
        step[np.maximum(edges["parent"][on], 0), edges["child"][on]] = edges["p_child"][on]
        out.append((nodes["allele"][here].astype(np.int64), share / share.sum(), step))
        before = len(share)
    return out


def columns(structs: pa.StructArray) -> dict[str, np.ndarray]:
    return {f.name: structs.field(f.name).to_numpy(zero_copy_only=False) for f in structs.type}


def penetrance(error: float) -> np.ndarray:
    """By the dose that a pair of nodes holds and the genotype's dose, its probability where each allele is the other
    one with probability `error`."""
    keep = 1.0 - error
    hom, het = (keep * keep, 2.0 * error * keep, error * error), (error * keep, keep * keep + error * error, error * keep)
    return np.array([hom, het, hom[::-1]])


def likelihoods(phreds: np.ndarray) -> np.ndarray:
    """Likelihoods of the doses by sample; excluded ones are 0 unless all are."""
    like = 10.0 ** (-0.1 * phreds)
    found = np.where(phreds < EXCLUDED, like, 0.0)
    return np.where(found.any(axis=-1, keepdims=True), found, like)


def emissions(phreds: np.ndarray, alleles: np.ndarray, error: float = 0.0) -> np.ndarray:
    """By sample (a row of three phreds), the likelihood of each pair of nodes, whose alleles may be misread; excluded
    genotypes count 0 unless all that the pairs may give are."""
    doses = alleles[:, None] + alleles[None, :]
    chance = penetrance(error)
    like = 10.0 ** (-0.1 * phreds)
    found = (np.where(phreds < EXCLUDED, like, 0.0) @ chance.T)[:, doses]
    none = ~found.any(axis=(1, 2))
    found[none] = (like[none] @ chance.T)[:, doses]
    return found


def _scaled(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=(1, 2), keepdims=True)


def mixed(values: np.ndarray, shares: np.ndarray, rate: float) -> np.ndarray:
    """Forward: what a pair of parents passes on, where each of the two may have switched, with probability rate, to a
    node drawn by its share."""
    one, other, whole = values.sum(2), values.sum(1), values.sum((1, 2))
    keep = 1.0 - rate
    switched = one[:, :, None] * shares[None, None, :] + shares[None, :, None] * other[:, None, :]
    return keep * keep * values + keep * rate * switched + rate * rate * whole[:, None, None] * np.outer(shares, shares)


def gathered(values: np.ndarray, shares: np.ndarray, rate: float) -> np.ndarray:
    """Backward: the transpose of mixed()."""
    one, other = values @ shares, shares @ values
    keep = 1.0 - rate
    return keep * keep * values + keep * rate * (one[:, :, None] + other[:, None, :]) + rate * rate * (one @ shares)[:, None, None]


def forward(graph: list, phreds: np.ndarray, rates: np.ndarray, errors: np.ndarray | None = None) -> list[np.ndarray]:
    """By site, the probability of each pair of nodes given the reads so far, for phreds by sample, site and dose."""
    out: list[np.ndarray] = []
    errors = np.zeros(len(graph)) if errors is None else errors
    for site, (alleles, shares, step) in enumerate(graph):
        if not site:
            a = np.outer(shares, shares)[None]
        else:
            a = step.T @ mixed(out[-1], graph[site - 1][1], rates[site]) @ step
        out.append(_scaled(a * emissions(phreds[:, site], alleles, errors[site])))
    return out


def backward(graph: list, phreds: np.ndarray, rates: np.ndarray, errors: np.ndarray | None = None) -> list[np.ndarray]:
    """By site, in proportion to the probability of the later reads given a pair of nodes."""
    errors = np.zeros(len(graph)) if errors is None else errors
    out = [np.ones((len(phreds), *(len(graph[-1][0]),) * 2))]
    for site in range(len(graph) - 1, 0, -1):
        alleles, _, step = graph[site]
        b = step @ (out[0] * emissions(phreds[:, site], alleles, errors[site])) @ step.T
        out.insert(0, _scaled(gathered(b, graph[site - 1][1], rates[site])))
    return out


def posterior(graph: list, phreds: np.ndarray, rates: np.ndarray, errors: np.ndarray | None = None) -> np.ndarray:
    """By sample and site, the probabilities of 0, 1 and 2 alternative alleles given all reads."""
    out = np.empty((len(phreds), len(graph), 3))
    errors = np.zeros(len(graph)) if errors is None else errors
    for site, (a, b) in enumerate(zip(forward(graph, phreds, rates, errors), backward(graph, phreds, rates, errors))):
        doses = graph[site][0][:, None] + graph[site][0][None, :]
        # what the nodes say of the genotype, times what the reads do
        held = a * b if not errors[site] else a * b / np.maximum(emissions(phreds[:, site], graph[site][0], errors[site]), 1e-300)
        by_dose = np.stack([held[:, doses == dose].sum(1) for dose in range(3)], axis=1)
        if errors[site]:
            by_dose = by_dose @ penetrance(errors[site]) * likelihoods(phreds[:, site])
        out[:, site] = by_dose / by_dose.sum(1, keepdims=True)
    return out


def uniforms(seed: int, keys: np.ndarray, site: int) -> np.ndarray:
    """A number from 0 to below 1 for each key at a site, set by seed, key and site alone."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + site * 0xD1B54A32D192ED03) & MASK)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def draw_keys(region: int, ids: list[int], rounds: int) -> np.ndarray:
    """A key for each sample and round."""
    one = np.array([i & MASK for i in ids], np.uint64)
    both = one[:, None] * np.uint64(0x9FB21C651E98DF25) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (both + np.uint64((region & MASK) * 0x165667B19E3779F9 & MASK)).ravel()


def _passed(values: np.ndarray, ways: np.ndarray, of: np.ndarray, child: np.ndarray) -> np.ndarray:
    """By first node and key, the sum over second nodes of a pair's value (of what reads the key has) times the way to the
    child: for all children by one product of matrices, or where that is more, for those that are asked for."""
    at = of * ways.shape[1] + child
    if len(values) * ways.shape[1] <= 4 * len(at):
        return np.ascontiguousarray((values @ ways).transpose(1, 0, 2)).reshape(len(ways), -1)[:, at]
    asked, which = np.unique(at, return_inverse=True)
    u, c = np.divmod(asked, ways.shape[1])
    return (values[u] @ ways.T[c][:, :, None])[:, :, 0].T[:, which.ravel()]


def _picked(weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By column, the place in which the running sum of the weights goes beyond at, and the sum in front of it."""
    sums = weights.cumsum(0)
    # not the end itself, in front of which there may be nothing
    at = np.minimum(at, sums[-1] * (1 - 2.0**-53))
    place = np.minimum((sums <= at).sum(0), len(sums) - 1)
    return place, np.where(place > 0, sums[place - 1, np.arange(len(place))], 0.0)


def draw(graph: list, rates: np.ndarray, seed: int, keys: np.ndarray, ahead: list[np.ndarray], of: np.ndarray | None = None, switches: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two haplotypes (bits by site) for each key, drawn backwards from the forward probabilities, and the sites in
    front of which each has switched. of: by key, which row of the probabilities it has; if it isn't given, the keys are
    those of the rows in order, as many for each. A pair is drawn by one number: first its first node, by the sums over
    the second, then the second by what is left of it. Without `switches` they aren't looked for."""
    n = len(keys)
    of = np.repeat(np.arange(len(ahead[0])), n // len(ahead[0])) if of is None else of
    codes, crossed, pair = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64), None
    for site in range(len(graph) - 1, -1, -1):
        values = ahead[site]
        if pair is None:
            firsts, to = values.sum(2).T[:, of], None
        else:
            step, rate, shares = graph[site + 1][2], rates[site + 1], graph[site][1]
            # by side, what leads from each parent to the child drawn: by the edge, or from a node drawn by its share
            kept, anew = (1.0 - rate) * step, rate * (shares @ step)
            to = kept + anew
            firsts = _passed(values, to, of, pair[:, 1]) * to[:, pair[:, 0]]
        at = uniforms(seed, keys, site) * firsts.sum(0)
        first, before = _picked(firsts, at)
        seconds = values.reshape(-1, values.shape[2]).T[:, of * values.shape[1] + first]
        if to is not None:
            seconds = seconds * to[:, pair[:, 1]] * to[first, pair[:, 0]]
        second, _ = _picked(seconds, np.maximum(at - before, 0.0))
        new = np.stack([first, second], axis=1)
        if pair is not None and switches:
            for k in (0, 1):
                switched = anew[pair[:, k]]
                share = switched / np.maximum(switched + kept[new[:, k], pair[:, k]], 1e-300)
                crossed[:, k] |= (uniforms(seed + 7919 * (k + 1), keys, site) < share).astype(np.int64) << (site + 1)
        pair = new
        codes |= graph[site][0][pair].astype(np.int64) << site
    return codes, crossed


def imputed(codes: np.ndarray, phreds: np.ndarray, errors: np.ndarray, seed: int, keys: np.ndarray) -> np.ndarray:
    """The haplotypes that the reads and the drawn nodes' alleles give together: the genotype is drawn from its
    likelihood times the chance of misread alleles; a heterozygote keeps the order of differing nodes, unless both were
    misread, and has an order drawn for it where they are alike."""
    n = len(keys)
    of = np.repeat(np.arange(len(phreds)), n // len(phreds))
    out = np.zeros_like(codes)
    for site in range(phreds.shape[1]):
        held = (codes >> site) & 1
        weights = penetrance(errors[site])[held.sum(1)] * likelihoods(phreds[:, site])[of]
        bare = ~weights.any(axis=1)  # the reads exclude what the nodes hold
        weights[bare] = likelihoods(phreds[:, site])[of[bare]]
        sums = weights.cumsum(1)
        dose = (sums <= (uniforms(seed + 104729, keys, site) * sums[:, -1])[:, None]).sum(1)
        e = errors[site]
        both = uniforms(seed + 1299709, keys, site) < e * e / (e * e + (1.0 - e) ** 2)
        coin = uniforms(seed + 15485863, keys, site) < 0.5
        first = np.where(held[:, 0] != held[:, 1], held[:, 0] ^ both, coin)
        first = np.where(dose == 1, first, dose // 2)
        out |= np.stack([first, dose - first], axis=1).astype(np.int64) << site
    return out


def imputed_counts(drawn: DataFrame, sites: int, *keys: str) -> DataFrame:
    """(keys, site, matches, mismatches, uncertain, crossovers) of drawn haplotypes (keys, code1, code2, copied1,
    copied2, crossed1, crossed2): by site, how many alleles agree with the nodes they were copied from, and not; how
    many heterozygotes have nodes that differ, so that both agree or neither; and the switches in front of the site."""
    rows = drawn.withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1))))
    bit = lambda c: F.expr(f"cast(shiftright({c}, site) & 1 as int)")
    got, held = bit("code1") + bit("code2"), bit("copied1") + bit("copied2")
    pair = (got == 1) & (held == 1)
    off = F.abs(got - held)
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return rows.groupBy(*keys, "site").agg(total(F.when(pair, 0).otherwise(2 - off), "matches"), total(off, "mismatches"), total(pair, "uncertain"), total(bit("crossed1") + bit("crossed2"), "crossovers"))


def chunks(phreds: DataFrame) -> DataFrame:
    """(region, chunk, samples): the samples' phreds (region, sample_id, site, pl0, pl1, pl2) by region, at most about
    CHUNK samples a row; sites without reads are left to the caller as absent."""
    each = phreds.groupBy("region", "sample_id").agg(F.array_sort(F.collect_list(F.struct("site", "pl0", "pl1", "pl2"))).alias("reads"))
    many = each.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("parts"))
    each = each.join(many, "region").withColumn("chunk", F.pmod(F.xxhash64("sample_id"), F.col("parts")))
    return each.groupBy("region", "chunk").agg(F.array_sort(F.collect_list(F.struct("sample_id", "reads"))).alias("samples"))


def runs(phreds: DataFrame) -> DataFrame:
    """(region, chunk, reads): the samples' phreds (region, sample_id, site, pl0, pl1, pl2) by region and runs of RUN sample
    ids, in any order; sites without reads are left to the caller as absent."""
    rows = spread(phreds.select("region", "sample_id", "site", "pl0", "pl1", "pl2"), "region")
    each = rows.groupBy("region", F.floor(F.col("sample_id") / F.lit(RUN)).alias("chunk"))
    return each.agg(F.collect_list(F.struct("sample_id", "site", "pl0", "pl1", "pl2")).alias("reads"))


def _work(batch: pa.RecordBatch, sites: int) -> Iterator[tuple[int, np.ndarray, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some samples of a row at a time the region, the sample ids, the graph, the distinct phreds by site and dose,
    which of them each sample has, and the rates and errors by site: samples of the same reads have the same sums. Of
    distinct phreds there are as many as keep the pairs of nodes of all sites within PAIRS numbers, one at least."""
    for k in range(batch.num_rows):
        nodes, edges, reads, by_site = (batch.column(c)[k].values for c in ("nodes", "edges", "reads", "by_site"))
        graph = levels(columns(nodes), columns(edges))
        rates, errors = np.zeros(sites), np.zeros(sites)
        own = columns(by_site)
        rates[own["site"]], errors[own["site"]] = own["rate"], own["error"]
        found = columns(reads)
        ids, of = np.unique(found["sample_id"], return_inverse=True)
        phreds = np.zeros((len(ids), sites, 3))
        phreds[of, found["site"]] = np.stack([found[f"pl{g}"] for g in range(3)], axis=1)
        distinct, which = np.unique(phreds.reshape(len(ids), -1), axis=0, return_inverse=True)
        distinct, which = distinct.reshape(-1, sites, 3), which.ravel()
        some = max(1, PAIRS // sum(len(share) ** 2 for _, share, _ in graph))
        for start in range(0, len(distinct), some):
            on = np.flatnonzero((which >= start) & (which < start + some))
            yield batch.column("region")[k].as_py(), ids[on], graph, distinct[start : start + some], which[on] - start, rates, errors


def _rows(phreds: DataFrame, nodes: DataFrame, edges: DataFrame, sites: int, rate: float | DataFrame, error: float) -> DataFrame:
    """The rows that _work() takes; rates are one for all sites, or a table (region, site, rate, error)."""
    rows = runs(phreds).join(graph_rows(nodes, edges), "region")
    if isinstance(rate, DataFrame):
        own = rate.groupBy("region").agg(F.collect_list(F.struct("site", "rate", "error")).alias("by_site"))
        return spread(rows.join(own, "region"), "region", "chunk")
    each = F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), lambda k: F.struct(k.alias("site"), F.lit(float(rate)).alias("rate"), F.lit(float(error)).alias("error")))
    return spread(rows.withColumn("by_site", each), "region", "chunk")


def posteriors(phreds: DataFrame, nodes: DataFrame, edges: DataFrame, sites: int, rate: float | DataFrame = 0.01, error: float = 0.0) -> DataFrame:
    """(region, sample_id, site, p0, p1, p2) for every site of the region, from phreds (region, sample_id, site, pl0,
    pl1, pl2) and the region's graph; sites without reads are flat. rate may be a table (region, site, rate, error).
    Samples of a region without a graph drop out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, graph, reads, of, rates, errors in _work(batch, sites):
                p = posterior(graph, reads, rates, errors)[of].reshape(-1, 3)
                made = {"region": np.full(len(p), region), "sample_id": np.repeat(ids, len(graph)), "site": np.tile(np.arange(len(graph), dtype=np.int32), len(ids))}
                yield pa.record_batch(made | {f"p{g}": np.ascontiguousarray(p[:, g]) for g in range(3)})

    return _rows(phreds, nodes, edges, sites, rate, error).mapInArrow(work, "region long, sample_id long, site int, p0 double, p1 double, p2 double")


def _drawn(batch: pa.RecordBatch, sites: int, rounds: int, seed: int, keep: int | None, switches: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some samples at a time the region, the ids, and by sample, round and side the haplotypes drawn, those they were
    copied from, and the switches."""
    for region, ids, graph, reads, of, rates, errors in _work(batch, sites):
        keys = draw_keys(region, ids.tolist(), rounds)
        if keep is None:
            copied, crossed = draw(graph, rates, seed, keys, forward(graph, reads, rates, errors), np.repeat(of, rounds), switches)
        else:
            kept = [forward_pairs(graph, own, rates, errors, keep) for own in reads]
            each = [draw_pairs(graph, rates, seed, k, kept[u]) for u, k in zip(of.tolist(), keys.reshape(len(ids), rounds))]
            copied, crossed = (np.concatenate(x) for x in zip(*each))
        codes = imputed(copied, reads[of], errors, seed, keys) if errors.any() else copied
        yield region, ids, *(x.reshape(len(ids), rounds, 2) for x in (codes, copied, crossed))


def draws(phreds: DataFrame, nodes: DataFrame, edges: DataFrame, sites: int, rounds: int, rate: float | DataFrame = 0.01, seed: int = 1, error: float = 0.0, keep: int | None = None) -> DataFrame:
    """(region, sample_id, round, code1, code2, copied1, copied2, crossed1, crossed2): haplotypes drawn for each sample,
    the alleles of the nodes they were copied from, and the sites they switched in front of; the same on every run, as
    the seed, region, sample and round alone set the draw. Without errors a genotype is the nodes'. keep: of how many pairs
    of nodes a site's sums are; all of them, if it isn't given."""
    names = ("code1", "code2", "copied1", "copied2", "crossed1", "crossed2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, *found in _drawn(batch, sites, rounds, seed, keep):
                made = {"region": np.full(len(ids) * rounds, region), "sample_id": np.repeat(ids, rounds), "round": np.tile(np.arange(rounds, dtype=np.int32), len(ids))}
                yield pa.record_batch(made | {n: np.ascontiguousarray(x[:, :, k]).ravel() for n, (x, k) in zip(names, ((x, k) for x in found for k in (0, 1)))})

    return _rows(phreds, nodes, edges, sites, rate, error).mapInArrow(work, "region long, sample_id long, round int, " + ", ".join(f"{n} long" for n in names))


def drawn_consensus(phreds: DataFrame, nodes: DataFrame, edges: DataFrame, sites: int, rounds: int, rate: float | DataFrame = 0.01, seed: int = 1, error: float = 0.0, keep: int | None = None) -> DataFrame:
    """consensus() of draws(), by region and sample_id: a task has all of a sample's draws, so they aren't put out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, found, _, _ in _drawn(batch, sites, rounds, seed, keep, switches=False):
                codes, flips, errors = vote(found, sites)
                yield pa.record_batch({"region": np.full(len(ids), region), "sample_id": ids, "code1": np.ascontiguousarray(codes[:, 0]), "code2": np.ascontiguousarray(codes[:, 1]), "flips": flips / rounds, "errors": errors / rounds})

    return _rows(phreds, nodes, edges, sites, rate, error).mapInArrow(work, "region long, sample_id long, code1 long, code2 long, flips double, errors double")


def _most(rows: np.ndarray, first: np.ndarray, second: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest `keep` values of pairs, in falling order to nine digits of the greatest, ties by node."""
    top = rows.max()
    order = np.lexsort((second, first, -np.round(rows / top, 9)))[:keep] if top > 0 else np.arange(0)
    return rows[order], first[order], second[order]


def topped(first: np.ndarray, second: np.ndarray, values: np.ndarray, step: np.ndarray, shares: np.ndarray, rate: float, like: np.ndarray, alleles: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `keep` pairs of parents (their values and nodes) pass on to the pairs of a level's nodes, times the likelihood
    of the pair's dose: the greatest `keep`, exactly. Pairs that edges reach are summed up one by one, at most four for
    each pair of parents. The others' value is a(c) q(d) + q(c) b(d), q being the share of a node that is switched to:
    the rows c are looked at in the order of the most that one can hold, until that is below the keep-th value found."""
    n, stay = len(alleles), 1.0 - rate
    q = shares @ step
    one, two = np.bincount(first, values, len(step)) @ step, np.bincount(second, values, len(step)) @ step
    whole = values.sum()
    a, b = stay * rate * one + 0.5 * rate * rate * whole * q, stay * rate * two + 0.5 * rate * rate * whole * q
    # by edges: a node's children, of which there are two at most
    reached: dict[int, float] = {}
    children = [np.flatnonzero(row) for row in step]
    for i, j, v in zip(first.tolist(), second.tolist(), (stay * stay * values).tolist()):
        for c in children[i].tolist():
            for d in children[j].tolist():
                reached[c * n + d] = reached.get(c * n + d, 0.0) + v * step[i, c] * step[j, d]
    at = np.array(sorted(reached), np.int64)
    c, d = np.divmod(at, n)
    found = (np.array([reached[x] for x in at.tolist()]) + a[c] * q[d] + q[c] * b[d]) * like[alleles[c] + alleles[d]]
    if rate:
        # the most that a row can hold beside what edges give
        best = np.array([max(like[allele + side] for side in set(alleles.tolist())) for allele in (0, 1)])[alleles]
        bound = (a * q.max() + q * b.max()) * best
        for row in np.argsort(-bound, kind="stable").tolist():
            if len(found) >= keep and bound[row] < np.partition(found, -keep)[-keep] * (1 - 1e-8):
                break
            rest = np.setdiff1d(np.arange(n), d[c == row])
            c, d = np.concatenate([c, np.full(len(rest), row)]), np.concatenate([d, rest])
            found = np.concatenate([found, (a[row] * q[rest] + q[row] * b[rest]) * like[alleles[row] + alleles[rest]]])
            found, c, d = _most(found, c, d, max(keep, 4 * keep)) if len(found) > 8 * keep else (found, c, d)
    return _most(found, c, d, keep)


def forward_pairs(graph: list, phreds: np.ndarray, rates: np.ndarray, errors: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """forward() for one sample's phreds by site and dose with the `keep` likeliest pairs of nodes of each site alone:
    their values, which add up to one, and their nodes."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    like = likelihoods(phreds)
    for site, (alleles, shares, step) in enumerate(graph):
        chance = penetrance(errors[site]) @ like[site]
        if not chance[np.unique(alleles[:, None] + alleles[None, :])].any():  # all that the nodes may give is excluded
            chance = penetrance(errors[site]) @ 10.0 ** (-0.1 * phreds[site])
        if site:
            found = topped(out[-1][1], out[-1][2], out[-1][0], step, graph[site - 1][1], rates[site], chance, alleles, keep)
            if not len(found[0]):  # nor do the pairs that were kept lead on
                found = topped(out[-1][1], out[-1][2], out[-1][0], step, graph[site - 1][1], 0.5, chance, alleles, keep)
        else:
            # pairs of the first level, which has a node for each allele
            c, d = np.divmod(np.arange(len(shares) ** 2), len(shares))
            found = _most(shares[c] * shares[d] * chance[alleles[c] + alleles[d]], c, d, keep)
        out.append((found[0] / found[0].sum(), found[1], found[2]))
    return out


def draw_pairs(graph: list, rates: np.ndarray, seed: int, keys: np.ndarray, ahead: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """draw() for one sample, from the pairs that forward_pairs() kept."""
    codes, crossed = np.zeros((len(keys), 2), np.int64), np.zeros((len(keys), 2), np.int64)
    pair = None
    for site in range(len(graph) - 1, -1, -1):
        values, *nodes = ahead[site]
        weights = np.broadcast_to(values, (len(keys), len(values)))
        if pair is not None:
            step, rate, shares = graph[site + 1][2], rates[site + 1], graph[site][1]
            anew = rate * (shares @ step)
            ways = [((1.0 - rate) * step)[nodes[k][None, :], pair[:, k, None]] for k in (0, 1)]
            weights = weights * (ways[0] + anew[pair[:, 0], None]) * (ways[1] + anew[pair[:, 1], None])
            weights = np.where(weights.any(axis=1, keepdims=True), weights, values)
        sums = weights.cumsum(1)
        at = np.minimum((sums <= (uniforms(seed, keys, site) * sums[:, -1])[:, None]).sum(1), len(values) - 1)
        if pair is not None:
            for k in (0, 1):
                switched = anew[pair[:, k]]
                share = switched / np.maximum(switched + ways[k][np.arange(len(keys)), at], 1e-300)
                crossed[:, k] |= (uniforms(seed + 7919 * (k + 1), keys, site) < share).astype(np.int64) << (site + 1)
        pair = np.stack([nodes[0][at], nodes[1][at]], axis=1)
        codes |= graph[site][0][pair].astype(np.int64) << site
    return codes, crossed


def top_pairs(phreds: DataFrame, nodes: DataFrame, edges: DataFrame, sites: int, keep: int, rate: float | DataFrame = 0.01, error: float = 0.0) -> DataFrame:
    """(region, sample_id, site, rank, node1, node2, p): the pairs of nodes that forward_pairs() keeps of each site."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, graph, reads, which, rates, errors in _work(batch, sites):
                kept = [forward_pairs(graph, own, rates, errors, keep) for own in reads]
                sizes = np.array([[len(x[0]) for x in k] for k in kept])
                ends = np.cumsum(sizes.sum(1))
                rows = np.concatenate([np.arange(ends[u] - sizes[u].sum(), ends[u]) for u in which.tolist()])
                each = sizes.sum(1)[which]
                made = {"region": np.full(len(rows), region), "sample_id": np.repeat(ids, each)}
                made["site"] = np.concatenate([np.repeat(np.arange(sizes.shape[1], dtype=np.int32), n) for n in sizes])[rows]
                made["rank"] = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes.ravel()])[rows]
                made |= {n: np.concatenate([x[k] for one in kept for x in one]).astype(np.int32)[rows] for k, n in ((1, "node1"), (2, "node2"))}
                yield pa.record_batch(made | {"p": np.concatenate([x[0] for one in kept for x in one])[rows]})

    return _rows(phreds, nodes, edges, sites, rate, error).mapInArrow(work, "region long, sample_id long, site int, rank int, node1 int, node2 int, p double")


def vote(codes: np.ndarray, sites: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consensus of haplotype pairs with unknown phase, for codes by sample, draw and side: codes by sample and
    side, flips and errors.

    A pair begins turned so that the reference stands first at its first differing site; at a site the commonest of the
    four ordered genotypes wins, the lowest of equals. Where a heterozygote wins, the pairs that voted for its mirror
    image are turned from there on."""
    one, two = (np.ascontiguousarray(codes[:, :, k].T) for k in (0, 1))  # by draw and sample
    apart = one ^ two
    first = apart & -apart  # the first differing site
    turn = (one & first) != 0
    out = np.zeros((len(codes), 2), np.int64)
    flips, errors = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for s in range(sites):
        a, b = (x >> s & 1 != 0 for x in (one, two))
        front, back = np.where(turn, b, a), np.where(turn, a, b)
        kinds = (~front & ~back, ~front & back, front & ~back, front & back)
        counts = np.stack([k.sum(0) for k in kinds])
        best = counts.argmax(0)
        out |= np.stack([best >> 1, best & 1], axis=1) << s
        het = (best == 1) | (best == 2)
        errors += np.where(het, counts[0] + counts[3], len(one) - counts.max(0))
        mirror = ((best == 1) & kinds[2]) | ((best == 2) & kinds[1])
        flips += mirror.sum(0)
        turn ^= mirror
    return out, flips, errors


def consensus(drawn: DataFrame, sites: int, *keys: str) -> DataFrame:
    """keys with code1, code2, and flips and errors as averages over the draws (keys, round, code1, code2)."""

    @F.pandas_udf("code1 long, code2 long, flips double, errors double")
    def voted(pairs: pd.Series) -> pd.DataFrame:
        sizes = pairs.map(len).to_numpy()
        flat = np.concatenate(pairs.to_list()).reshape(-1, 2) if len(pairs) else np.zeros((0, 2), np.int64)
        starts = np.cumsum(sizes) // 2 - sizes // 2
        out = np.zeros((len(pairs), 4))
        codes = np.zeros((len(pairs), 2), np.int64)
        for size in np.unique(sizes).tolist():  # samples of as many draws together
            of = np.flatnonzero(sizes == size)
            rows = starts[of][:, None] + np.arange(size // 2)
            codes[of], flips, errors = vote(flat[rows], sites)
            out[of, 2], out[of, 3] = flips / (size // 2), errors / (size // 2)
        return pd.DataFrame({"code1": codes[:, 0], "code2": codes[:, 1], "flips": out[:, 2], "errors": out[:, 3]})

    each = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", "code1", "code2"))).alias("pairs"))
    flat = F.flatten(F.transform("pairs", lambda x: F.array(x["code1"], x["code2"])))
    return each.withColumn("v", voted(flat)).select(*keys, "v.*")


def initial_haplotypes(post: DataFrame, seed: int = 1, copy: Column | None = None) -> DataFrame:
    """post (…, sample_id, site, p0, p1, p2) with allele1 and allele2, drawn from the genotype's probabilities; a
    heterozygote's phase is one more draw. A draw depends on the seed, sample, site and copy alone."""
    keys = [F.col("sample_id"), F.col("site"), copy if copy is not None else F.lit(0)]
    u, side = hash_uniform(seed, *keys), hash_uniform(seed + 1, *keys) < 0.5
    kind = F.when(u < F.col("p0"), 0).when(u < F.col("p0") + F.col("p1"), 1).otherwise(2)
    rows = post.withColumn("__lf_kind", kind)
    one = F.when(F.col("__lf_kind") == 1, side.cast("int")).otherwise(F.col("__lf_kind") / 2).cast("int")
    return rows.withColumn("allele1", one).withColumn("allele2", (F.col("__lf_kind") - F.col("allele1")).cast("int")).drop("__lf_kind")
