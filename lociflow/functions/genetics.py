"""Column expressions: phreds, Hardy-Weinberg priors, penetrance, recombination, bases."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_prob(phred: Column) -> Column:
    return F.pow(F.lit(10.0), phred * F.lit(-0.1))


def hardy_weinberg(ref_freq: Column) -> tuple[Column, Column, Column]:
    """Priors of 0, 1 and 2 alternative alleles."""
    return ref_freq * ref_freq, 2.0 * ref_freq * (1.0 - ref_freq), (1.0 - ref_freq) * (1.0 - ref_freq)


def filled(pl0: Column, pl1: Column, pl2: Column) -> tuple[Column, Column, Column]:
    """If the heterozygote is least, a homozygote more than 30 above it becomes 127; else the one opposite the least
    homozygote does. If both homozygotes are least, the second does."""
    het = (pl1 <= pl0) & (pl1 <= pl2)
    far = lambda p: F.when(p > pl1 + 30, 127).otherwise(p)
    return F.when(het, far(pl0)).when(pl0 <= pl2, pl0).otherwise(127).cast("long"), pl1, F.when(het, far(pl2)).when(pl0 <= pl2, 127).otherwise(pl2).cast("long")


def penetrance(e: Column) -> dict[str, Column]:
    """Probabilities of reading 0, 1, 2 alternative alleles from a homozygote (h) and a heterozygote (t)."""
    keep = 1.0 - e
    return {"h0": keep * keep, "h1": 2.0 * e * keep, "h2": e * e, "t0": e * keep, "t1": keep * keep + e * e, "t2": e * keep}


def penetrance_of(e: Column, held: Column, read: Column) -> Column:
    """penetrance() of a genotype read (0, 1 or 2 alternative alleles) from one that is held, null for other numbers."""
    p = penetrance(e)
    hom = lambda dose: F.when(dose == 0, p["h0"]).when(dose == 1, p["h1"]).when(dose == 2, p["h2"])
    het = F.when(read == 0, p["t0"]).when(read == 1, p["t1"]).when(read == 2, p["t2"])
    return F.when(held == 0, hom(read)).when(held == 1, het).when(held == 2, hom(2 - read))


def recombination(before: Column, here: Column) -> Column:
    """From two places in centimorgans."""
    part = lambda x: F.pow(1.0 + x / 200.0, F.lit(-2.0))
    return F.greatest(part(before) - part(here), F.lit(1e-5))


def kolmogorov_tail(x: Column, terms: int = 10) -> Column:
    """P(K >= x) of Kolmogorov's limit distribution: 1 at 0 and below. Below 1 the theta series is summed, from 1 on the
    alternating one; either needs few terms there."""
    odd = [F.exp(-((2 * k - 1) ** 2) * math.pi**2 / 8 / (x * x)) for k in range(1, terms + 1)]
    signed = [(-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)]
    low = 1.0 - math.sqrt(2 * math.pi) / x * reduce(add, odd)
    return F.when(x <= 0, 1.0).when(x < 1, low).otherwise(2.0 * reduce(add, signed))


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def chromosome_number(name: Column) -> Column:
    """1 and up from `7` or `chr7`; X, Y, XY and MT are 23 to 26; null for other names."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.coalesce(bare.try_cast("int"), F.when(bare == "X", 23).when(bare == "Y", 24).when(bare == "XY", 25).when(bare == "MT", 26))


def two_bit(base: Column) -> Column:
    """0 to 3 for A, C, G and T in either case, else null."""
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when((at >= 0) & (F.length(base) == 1), at)


def likelihood(phreds: Column, first: Column, second: Column) -> Column:
    """The likelihood of two alleles (0 or 1 each) from the phreds of 0, 1 and 2 alternative ones."""
    return phred_prob(F.get(phreds, first + second))


def stored_probability(p: Column) -> Column:
    """A probability as it is kept: at least the smallest normal 32-bit number."""
    return F.greatest(p, F.lit(1.17549435e-38))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 that only the seed and the keys set, wherever a row is."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def panel_ref_freq(info: Column, alts: Column) -> Column:
    """The reference allele's frequency from a panel's INFO: of two alternatives AF is taken as it is, of one as
    1 - AF; without AF, smoothed counts AC and AN; without those 1e-6."""
    number = lambda key: F.get(F.split(F.element_at(info, key), ","), F.lit(0)).try_cast("double")
    af, ac, an = number("AF"), number("AC"), number("AN")
    return F.coalesce(F.when(F.size(alts) > 1, af).otherwise(1.0 - af), 1.0 - (ac + 0.5) / (an + 1.0), F.lit(1e-6))


def settled_error(matches: np.ndarray, mismatches: np.ndarray, uncertain: np.ndarray) -> np.ndarray:
    known = matches + mismatches
    rate = np.divide(mismatches, known, out=np.zeros(len(known)), where=known > 0)
    going = (known > 0) & (uncertain > 0) & (rate > 1e-10)
    while going.any():
        r, u = rate[going], uncertain[going]
        new = (mismatches[going] + 2.0 * u * r * r / (r * r + (1.0 - r) ** 2)) / (known[going] + 2.0 * u)
        rate[going] = new
        going[going] = (np.abs(new - r) > 1e-4 * new) & (new > 1e-10)
    return rate


def error_rate(matches: Column, mismatches: Column, uncertain: Column) -> Column:
    """The share of mismatches, where each of the uncertain pairs holds two mismatches or none: the fixed point of
    r = (mismatches + 2 u r^2 / (r^2 + (1 - r)^2)) / (all + 2 u), by steps until one moves it by no more than 1e-4 of
    itself or it is below 1e-10; 0 where nothing but uncertain pairs was counted."""

    @F.pandas_udf("double")
    def settled(m: pd.Series, x: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(settled_error(*(c.fillna(0).to_numpy(float) for c in (m, x, u))))

    return settled(*(c.cast("double") for c in (matches, mismatches, uncertain)))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)
