"""Windows of markers that overlap, and phase carried over their borders.

Haplotypes are drawn window by window, side by side; each window's two sides come in some order. Two neighbouring
windows share markers: where a sample is heterozygous in both, they say whether the sides agree or are the wrong way
round, and the votes of the shared markers decide whether the later window is turned. A chromosome's turns are the
running parity of its borders' decisions, by ranges of windows (ranges.running_sum), so a chromosome is walked by no
task. A border without a vote (no heterozygote in the overlap, equal votes, or a window that lacks) begins a phase set of
its own. Each marker is written from one window, its core, in whose middle it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sum, spread

#: Windows that a range of a chromosome spans.
RANGE = 4096


def places(markers: DataFrame, sites: int, overlap: int) -> DataFrame:
    """(key, chrom, window, site, core) of markers (key, chrom, ordinal: from 0 on a chromosome): the windows of `sites`
    markers, each `overlap` of which the next has too, that a marker lies in, its site there, and whether it is written
    from there. The last window of a chromosome begins where it reaches the end."""
    if not 0 <= overlap <= sites // 2:
        raise ValueError("windows may share half of their sites at most")
    step = sites - overlap
    # a row a chromosome
    ends = markers.groupBy("chrom").agg(F.greatest(F.lit(0), F.ceil((F.max("ordinal") + 1 - sites) / step)).cast("long").alias("last"))
    rows = markers.select("key", "chrom", "ordinal").join(F.broadcast(ends), "chrom")
    o, last = F.col("ordinal"), F.col("last")
    low, high = F.greatest(F.lit(0), F.ceil((o - sites + 1) / step)).cast("long"), F.least(F.floor(o / step), last)
    core = F.least(F.greatest(F.floor((o - overlap // 2) / step), F.lit(0)), last)
    rows = rows.withColumns({"window": F.explode(F.when(low <= high, F.sequence(low, high))), "core": core})
    return rows.select("key", "chrom", "window", (o - F.col("window") * step).cast("int").alias("site"), (F.col("window") == F.col("core")).alias("core"))


def borders(codes: DataFrame, sites: int, overlap: int, *group: str) -> DataFrame:
    """(group, window, same, other) for each window that has one before it: in how many of the shared markers, where
    both windows' haplotypes (group, window, code1, code2) are heterozygous, their sides agree, and in how many not."""
    step = sites - overlap
    before = codes.select(*group, (F.col("window") + 1).alias("window"), F.expr(f"shiftright(code1, {step})").alias("b1"), F.expr(f"shiftright(code2, {step})").alias("b2"))
    both = codes.join(before, [*group, "window"])
    same, other = _votes(overlap)
    return both.select(*group, "window", same.alias("same"), other.alias("other"))


def _votes(overlap: int) -> tuple[Column, Column]:
    """Of the markers that code1 and code2 share with the window before, b1 and b2: in how many the sides agree, and not."""
    mask = (1 << overlap) - 1
    het = F.expr(f"(code1 ^ code2) & (b1 ^ b2) & {mask}L")
    other = F.expr(f"(code1 ^ b1) & (code1 ^ code2) & (b1 ^ b2) & {mask}L")
    return (F.bit_count(het) - F.bit_count(other)).cast("long"), F.bit_count(other).cast("long")


def carried(windows: DataFrame, votes: DataFrame, *group: str, width: int = RANGE) -> DataFrame:
    """windows (group, window) with `turned`, whether a window's sides change places, and `phase_set`, from 0 on for
    each group, given the borders' votes (group, window, same, other)."""
    known = windows.select(*group, "window").distinct().join(votes, [*group, "window"], "left")
    flip, open_ = (F.col("other") > F.col("same")).cast("int"), (F.coalesce(F.col("other") == F.col("same"), F.lit(True))).cast("int")
    known = known.select(F.struct(*group).alias("g"), "window", F.coalesce(flip, F.lit(0)).alias("flip"), open_.alias("open"))
    known = running_sum(known, "g", "window", "flip", "flips", width)
    known = running_sum(known, "g", "window", "open", "opened", width)
    # the first window of a group opens set 0
    return known.select("g.*", "window", (F.col("flips") % 2 == 1).alias("turned"), (F.col("opened") - 1).alias("phase_set"))


def dealt(rows: DataFrame, *group: str, width: int = RANGE) -> DataFrame:
    """rows (group, window, ...) dealt by group, __lf_group, and range of windows, __lf_range. A range also gets the rows
    of the window in front of its first."""
    at = F.floor(F.col("window") / F.lit(width))
    both = F.when((F.col("window") + 1) % width == 0, F.array(at, at + 1)).otherwise(F.array(at))
    return spread(rows.withColumns({"__lf_range": F.explode(both), "__lf_group": F.struct(*group)}), "__lf_group", "__lf_range")


def joined_ranges(codes: DataFrame, sites: int, overlap: int, *group: str, width: int = RANGE) -> DataFrame:
    """joined() of windows that dealt() has dealt (__lf_group, __lf_range, window, code1, code2, ...). All but one row a range
    stays where it is. Where a group's name is null, windows have no votes."""
    place = ["__lf_group", "__lf_range"]
    by = Window.partitionBy(*place).orderBy("window")
    near = F.lag("window").over(by) == F.col("window") - 1
    for name in group:
        near &= F.col("__lf_group")[name].isNotNull()
    before = {f"b{k}": F.call_function("shiftright", F.lag(f"code{k}").over(by), F.lit(sites - overlap)) for k in (1, 2)}
    rows = codes.withColumns({"__lf_near": near, "__lf_own": F.floor(F.col("window") / F.lit(width)) == F.col("__lf_range")} | before)
    same, other = _votes(overlap)
    voted = lambda c: F.coalesce(F.col("__lf_near") & c, F.lit(False))
    rows = rows.withColumns({"flip": (F.col("__lf_own") & voted(other > same)).cast("long"), "open": (F.col("__lf_own") & ~voted(other != same)).cast("long")}).drop("b1", "b2", "__lf_near")
    ahead = Window.partitionBy("__lf_group").orderBy("__lf_range").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda n: F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_base")
    bases = rows.groupBy(*place).agg(F.sum("flip").alias("flip"), F.sum("open").alias("open")).select(*place, base("flip"), base("open"))
    out = rows.withColumns({n: F.sum(n).over(by) for n in ("flip", "open")}).where("__lf_own").join(bases, place)
    turned = (F.col("flip") + F.col("flip_base")) % 2 == 1
    sides = {f"code{k}": F.when(turned, F.col(f"code{3 - k}")).otherwise(F.col(f"code{k}")) for k in (1, 2)}
    # the first window of a group opens set 0
    out = out.withColumns(sides | {"phase_set": F.col("open") + F.col("open_base") - 1} | {name: F.col("__lf_group")[name] for name in group})
    return out.drop(*place, "__lf_own", "flip", "open", "flip_base", "open_base")


def joined(codes: DataFrame, sites: int, overlap: int, *group: str, width: int = RANGE) -> DataFrame:
    """Haplotypes of windows (group, window, code1, code2) with their sides in one order along each phase set, and
    `phase_set`."""
    return joined_ranges(dealt(codes, *group, width=width), sites, overlap, *group, width=width).select(*codes.columns, "phase_set")
