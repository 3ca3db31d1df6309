"""Samples as mosaics of chosen haplotypes: each of a sample's two copies follows one haplotype of a small set, changes to
another, drawn by weight, at each marker's rate, and is misread at its error.

The chosen haplotypes are the sample's own (selection.by_likelihood, or any table), as many for each, so that a block of
samples is worked on at once: arrays of samples times pairs of haplotypes. Sites at which no sample of the block has
reads are skipped, their rates compounded (r + s - r s), and filled in afterwards from the states at their ends. Forward
sums are kept at every square root of the number of sites and made anew between those on the way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phasing, selection
from .ranges import spread

#: Numbers that one site's sums of a block of samples may hold.
PAIRS = 1 << 20


def kept_sites(phreds: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sites at which the phreds (sample, site, dose) of some sample differ, with the last; and the rate in front of
    each of them, over the sites skipped."""
    on = (phreds != phreds[:, :, :1]).any(axis=(0, 2))
    on[-1] = True
    kept = np.flatnonzero(on)
    stay = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(rates[1:], 1 - 1e-15)))])
    return kept, 1.0 - np.exp(np.diff(stay[kept], prepend=stay[kept[0]]))


def moved(values: np.ndarray, weights: np.ndarray, rate: float) -> np.ndarray:
    """Sums of pairs (sample, first, second), each side of which has changed to one drawn by weight (sample, state) at the
    rate."""
    one, two = values.sum(2), values.sum(1)
    switched = one[:, :, None] * weights[:, None, :] + weights[:, :, None] * two[:, None, :]
    both = values.sum((1, 2))[:, None, None] * weights[:, :, None] * weights[:, None, :]
    return (1 - rate) ** 2 * values + (1 - rate) * rate * switched + rate * rate * both


def gathered(values: np.ndarray, weights: np.ndarray, rate: float) -> np.ndarray:
    """The transpose of moved()."""
    one, two = (values * weights[:, None, :]).sum(2), (values * weights[:, :, None]).sum(1)
    both = (one * weights).sum(1)
    return (1 - rate) ** 2 * values + (1 - rate) * rate * (one[:, :, None] + two[:, None, :]) + rate * rate * both[:, None, None]


class Mosaic:
    """Forward sums of samples over pairs of their states (alleles by sample, state and site), kept here and there."""

    def __init__(self, alleles: np.ndarray, weights: np.ndarray, phreds: np.ndarray, rates: np.ndarray, errors: np.ndarray, every: int | None = None):
        self.alleles, self.weights = alleles, weights / weights.sum(1, keepdims=True)
        self.like, self.rates, self.errors = phasing.likelihoods(phreds), rates, errors
        self.sites, self.steps = kept_sites(phreds, rates)
        self.every = every or max(1, round(len(self.sites) ** 0.5))
        self.saved: dict[int, np.ndarray] = {}
        last = None
        for k in range(len(self.sites)):
            last = self._next(k, last)
            if k % self.every == 0 or k == len(self.sites) - 1:
                self.saved[k] = last
        self._between: dict[int, np.ndarray] = {}

    def _next(self, k: int, before: np.ndarray | None) -> np.ndarray:
        w = self.weights
        values = w[:, :, None] * w[:, None, :] if before is None else moved(before, w, self.steps[k])
        return self._scaled(values * self.emission(k))

    @staticmethod
    def _scaled(values: np.ndarray) -> np.ndarray:
        return values / np.maximum(values.sum((1, 2), keepdims=True), 1e-300)

    def emission(self, k: int) -> np.ndarray:
        site = self.sites[k]
        chance = self.like[:, site] @ phasing.penetrance(max(self.errors[site], 1e-6)).T
        dose = self.alleles[:, :, None, site] + self.alleles[:, None, :, site]
        return np.take_along_axis(chance, dose.reshape(len(dose), -1), 1).reshape(dose.shape)

    def at(self, k: int) -> np.ndarray:
        """The sums at the k-th kept site; those between two that are saved are made together."""
        if k in self.saved:
            return self.saved[k]
        if k not in self._between:
            start = k - k % self.every
            self._between, last = {}, self.saved[start]
            for j in range(start + 1, min(start + self.every, len(self.sites))):
                self._between[j] = last = self._next(j, last)
        return self._between[k]

    def marginals(self) -> np.ndarray:
        """By sample, site and state, how often it is copied, of the two copies together: forward sums times what the later
        reads say, at skipped sites from the kept ones on either side."""
        n, many, sites = self.alleles.shape
        out, w = np.empty((n, sites, many)), self.weights
        prior, right = w[:, :, None] * w[:, None, :], np.ones((n, many, many))

        def add(site: int, values: np.ndarray) -> None:
            values = self._scaled(values)
            out[:, site] = values.sum(1) + values.sum(2)

        def rate_of(low: int, high: int) -> float:
            return float(1 - np.prod(1 - self.rates[low + 1 : high + 1]))

        for k in range(len(self.sites) - 1, -1, -1):
            site, before = int(self.sites[k]), int(self.sites[k - 1]) if k else -1
            add(site, self.at(k) * right)
            seen = self._scaled(self.emission(k) * right)
            for skipped in range(before + 1, site):
                left = moved(self.at(k - 1), w, rate_of(before, skipped)) if k else prior
                add(skipped, left * gathered(seen, w, rate_of(skipped, site)))
            right = gathered(seen, w, self.steps[k]) if k else right
        return out

    def draw(self, seed: int, keys: np.ndarray) -> np.ndarray:
        """States by key, side and site; keys are those of the samples in order, as many for each."""
        n, (_, many, sites) = len(keys), self.alleles.shape
        of = np.repeat(np.arange(len(self.alleles)), n // len(self.alleles))
        w, path, pair = self.weights[of], np.empty((n, 2, sites), np.int64), None
        for k in range(len(self.sites) - 1, -1, -1):
            values = self.at(k)[of]
            if pair is not None:
                r = self.steps[k + 1]
                for side in (0, 1):
                    to = r * np.take_along_axis(w, pair[:, side, None], 1) + (1 - r) * (np.arange(many) == pair[:, side, None])
                    values = values * (to[:, :, None] if side == 0 else to[:, None, :])
            sums = values.reshape(n, -1).cumsum(1)
            at = np.minimum((sums <= (phasing.uniforms(seed, keys, int(self.sites[k])) * sums[:, -1])[:, None]).sum(1), many * many - 1)
            new = np.stack(np.divmod(at, many), axis=1)
            path[:, :, self.sites[k]] = new
            if pair is not None:
                self._fill(path, w, int(self.sites[k]), int(self.sites[k + 1]), seed, keys)
            pair = new
        for site in range(self.sites[0] - 1, -1, -1):  # nothing is read in front of the first: steps back, from what was drawn
            self._step(path, w, site, site + 1, None, seed, keys)
        return path

    def _fill(self, path: np.ndarray, w: np.ndarray, low: int, high: int, seed: int, keys: np.ndarray) -> None:
        """The states at skipped sites, from the one in front and the one behind the gap."""
        for site in range(low + 1, high):
            self._step(path, w, site, site - 1, high, seed, keys)

    def _step(self, path: np.ndarray, w: np.ndarray, site: int, near: int, end: int | None, seed: int, keys: np.ndarray) -> None:
        states = np.arange(w.shape[1])
        rate = self.rates[max(site, near)]
        for side in (0, 1):
            values = rate * w + (1 - rate) * (states == path[:, side, near, None])
            if end is not None:
                left = 1 - np.prod(1 - self.rates[site + 1 : end + 1])
                last = path[:, side, end, None]
                values = values * (left * np.take_along_axis(w, last, 1) + (1 - left) * (states == last))
            sums = values.cumsum(1)
            u = phasing.uniforms(seed + 32452843 * (side + 1), keys, site)
            path[:, side, site] = np.minimum((sums <= (u * sums[:, -1])[:, None]).sum(1), w.shape[1] - 1)


def likely_haplotypes(phreds: DataFrame, haps: DataFrame, sites: int, people: int) -> DataFrame:
    """(region, sample_id, hap_id, code, weight): both haplotypes of the people of the panel likeliest to share one with the
    sample, all of one weight. Samples of a region with fewer people have fewer."""
    best = selection.by_likelihood(phreds, haps, sites, people).select("region", "sample_id", "person")
    own = selection.people(haps).select("region", "person", F.inline(F.array(*[F.struct((2 * F.col("person") + k).alias("hap_id"), F.col(f"code{k + 1}").alias("code")) for k in (0, 1)])))
    return best.join(own, ["region", "person"]).select("region", "sample_id", "hap_id", "code", F.lit(1.0).alias("weight"))


def _rows(phreds: DataFrame, chosen: DataFrame, sites: int, rate: float | DataFrame, error: float) -> DataFrame:
    """Rows of at most about CHUNK samples of a region that have as many states, with the region's rates."""
    states = chosen.groupBy("region", "sample_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in chosen.columns if c not in ("region", "sample_id")]))).alias("states"))
    each = phreds.groupBy("region", "sample_id").agg(F.array_sort(F.collect_list(F.struct("site", "pl0", "pl1", "pl2"))).alias("reads")).join(states, ["region", "sample_id"])
    many = each.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(phasing.CHUNK)).alias("parts"))
    each = each.join(many, "region").withColumns({"chunk": F.pmod(F.xxhash64("sample_id"), F.col("parts")), "size": F.size("states")})
    rows = each.groupBy("region", "chunk", "size").agg(F.array_sort(F.collect_list(F.struct("sample_id", "reads", "states"))).alias("samples"))
    if isinstance(rate, DataFrame):
        rows = rows.join(rate.groupBy("region").agg(F.collect_list(F.struct("site", "rate", "error")).alias("by_site")), "region")
    else:
        rows = rows.withColumn("by_site", F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), lambda k: F.struct(k.alias("site"), F.lit(float(rate)).alias("rate"), F.lit(float(error)).alias("error"))))
    return spread(rows, "region", "chunk", "size")


def _work(batch: pa.RecordBatch, sites: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray], Mosaic]]:
    """For some samples of a row at a time the region, their ids, their states' columns (by sample and state), and sums."""
    for r in range(batch.num_rows):
        region, size, who = batch.column("region")[r].as_py(), batch.column("size")[r].as_py(), batch.column("samples")[r].values
        own, rates, errors = phasing.columns(batch.column("by_site")[r].values), np.zeros(sites), np.zeros(sites)
        rates[own["site"]], errors[own["site"]] = own["rate"], own["error"]
        ids, reads, found = who.field("sample_id").to_numpy(), who.field("reads"), phasing.columns(who.field("states").flatten())
        read, of = phasing.columns(reads.flatten()), np.repeat(np.arange(len(ids)), np.diff(reads.offsets.to_numpy()))
        pl = np.zeros((len(ids), sites, 3))
        pl[of, read["site"]] = np.stack([read[f"pl{g}"] for g in range(3)], axis=1)
        found = {n: x.reshape(-1, size) for n, x in found.items()}
        some = max(1, PAIRS // (size * size))
        for low in range(0, len(ids), some):
            at = slice(low, low + some)
            here = {n: x[at] for n, x in found.items()}
            alleles = (here["code"][:, :, None] >> np.arange(sites)) & 1
            yield region, ids[at], here | {"alleles": alleles}, Mosaic(alleles, here["weight"].astype(float), pl[at], rates, errors)


def mosaics(phreds: DataFrame, chosen: DataFrame, sites: int, rounds: int, rate: float | DataFrame = 0.01, error: float = 0.01, seed: int = 1) -> DataFrame:
    """(region, sample_id, round, code1, code2, crossed1, crossed2, sources1, sources2): haplotypes drawn for each sample from its
    reads (region, sample_id, site, pl0, pl1, pl2) and its chosen haplotypes (region, sample_id, hap_id, code, weight), the
    sites in front of which the copied one changes, and which is copied at each site. Samples without chosen haplotypes
    drop out; a sample's draw depends on seed, region, sample and round alone."""
    names = ("code1", "code2", "crossed1", "crossed2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, states, sums in _work(batch, sites):
                keys = phasing.draw_keys(region, ids.tolist(), rounds)
                path, of = sums.draw(seed, keys), np.repeat(np.arange(len(ids)), rounds)
                codes = (np.take_along_axis(states["alleles"][of], path, 1) << np.arange(sites)).sum(2)
                crossed = ((path[:, :, 1:] != path[:, :, :-1]).astype(np.int64) << np.arange(1, sites)).sum(2)
                sources = np.take_along_axis(states["hap_id"][of][:, None, :], path, 2)
                made = {"region": np.full(len(keys), region), "sample_id": np.repeat(ids, rounds), "round": np.tile(np.arange(rounds, dtype=np.int32), len(ids))}
                made |= {n: np.ascontiguousarray(x[:, k]) for n, (x, k) in zip(names, ((x, k) for x in (codes, crossed) for k in (0, 1)))}
                lists = {f"sources{k + 1}": pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(sources[:, k]).ravel()), sites).cast(pa.list_(pa.int64())) for k in (0, 1)}
                yield pa.record_batch(made | lists)

    schema = "region long, sample_id long, round int, " + ", ".join(f"{n} long" for n in names) + ", sources1 array<long>, sources2 array<long>"
    return _rows(phreds, chosen, sites, rate, error).mapInArrow(work, schema)


def case_shares(phreds: DataFrame, chosen: DataFrame, status: DataFrame, sites: int, rate: float | DataFrame = 0.01, error: float = 0.01) -> DataFrame:
    """(region, sample_id, site, share, score): how much of what a sample copies at a site comes from cases, of the people
    whose status (sample_id, status: 1 controls, 2 cases) is known, and that against what it would be by their numbers:
    controls times the cases' share less cases times the controls'. chosen is as in mosaics(); a haplotype is of person
    hap_id div 2. Samples none of whose chosen people has a status drop out."""
    marked = chosen.join(status.select(F.col("sample_id").alias("person"), "status"), F.expr("hap_id div 2") == F.col("person"), "left")
    marked = marked.select("region", "sample_id", "hap_id", "code", "weight", F.coalesce("status", F.lit(0)).cast("int").alias("status"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ids, states, sums in _work(batch, sites):
                copied, kind = sums.marginals(), states["status"][:, None, :]
                control, case = ((copied * (kind == k)).sum(2) for k in (1, 2))
                known = control + case
                share = np.divide(case, known, out=np.zeros_like(case), where=known > 0)
                # a person's two haplotypes count once
                controls, cases = ((states["status"] == k).sum(1)[:, None] / 2 for k in (1, 2))
                score, on = controls * share - cases * (1 - share), (known > 0).ravel()
                made = {"region": np.full(share.size, region), "sample_id": np.repeat(ids, sites), "site": np.tile(np.arange(sites, dtype=np.int32), len(ids)), "share": share.ravel(), "score": score.ravel()}
                yield pa.record_batch({n: x[on] for n, x in made.items()})

    return _rows(phreds, marked, sites, rate, error).mapInArrow(work, "region long, sample_id long, site int, share double, score double")
