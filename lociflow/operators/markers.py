"""Marker and sample joins, the genetic map, alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genetics as G
from .ranges import WIDTH, with_neighbours


def fan_out(markers: DataFrame) -> DataFrame:
    """A row for each alternative: `.` stands for the three bases that aren't the reference."""
    bases = F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.col("ref"))
    return markers.withColumn("alt", F.explode(F.when(F.col("alt") == ".", bases).otherwise(F.array("alt"))))


def marker_key(chrom: Column, pos: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), alt)


def shared_markers(panel: DataFrame, target: DataFrame) -> DataFrame:
    """The panel's markers (key, ...) that the target has too, once each, with a dense number in the panel's order
    (column `ordinal`) and one in the target's. A key that a table repeats counts once, with its first ordinal.

    Numbers come from two sorts by range: each row's place in its range, and the sum of the ranges before."""
    first = lambda t: t.groupBy("key").agg(F.min("ordinal").alias("ordinal"))
    both = first(panel).join(first(target).withColumnRenamed("ordinal", "in_target"), "key")
    return _numbered(_numbered(both, "ordinal", "panel_index"), "in_target", "target_index")


def _numbered(rows: DataFrame, by: str, name: str, width: int = 1 << 16) -> DataFrame:
    rows = rows.withColumn("__lf_range", F.floor(F.col(by) / F.lit(width)))
    counts = rows.groupBy("__lf_range").agg(F.count(F.lit(1)).alias("n"))
    # one row for each 65536 ordinals
    before = Window.orderBy("__lf_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__lf_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lf_start"))
    place = F.row_number().over(Window.partitionBy("__lf_range").orderBy(by))
    return rows.withColumn(name, place).join(starts, "__lf_range").withColumn(name, (F.col(name) + F.col("__lf_start") - 1).cast("long")).drop("__lf_range", "__lf_start")


def selected_samples(samples: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Samples (source, sample_idx, sample_id) that are on the include list (sample_id), if it has any row, and not on
    the exclude list. An id that comes again, in the order of source and index, has `_dup` put behind its name."""
    kept = samples
    if include is not None:
        wanted = include.select("sample_id").distinct().withColumn("__lf_in", F.lit(True))
        # an empty list lets all through
        none = F.broadcast(wanted.agg((F.count(F.lit(1)) == 0).alias("__lf_all")))
        kept = kept.join(wanted, "sample_id", "left").join(none).where("__lf_in OR __lf_all").drop("__lf_in", "__lf_all")
    if exclude is not None:
        kept = kept.join(exclude.select("sample_id").distinct(), "sample_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("source", "sample_idx"))
    return kept.withColumn("person", F.when(nth > 1, F.concat("sample_id", F.lit("_dup"))).otherwise(F.col("sample_id")))


def interpolated(sites: DataFrame, genetic_map: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each site's distance: as-of on both sides by one sorted union, linear between, clamped to the first and last
    point; null on a chromosome without points. A chromosome is cut into ranges of `width` positions."""
    points = genetic_map.select("chrom", F.col("bp").alias("pos"), F.struct("bp", "cm").alias("point"), F.lit(None).cast("long").alias("site"))
    rows = sites.select("chrom", "pos", F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.col("site").cast("long").alias("site")).unionByName(points)
    # points at a site's position go before it for `before` and count for `after` too
    rows = with_neighbours(rows, "chrom", [F.col("pos"), F.col("point").isNull()], "pos", F.col("point"), width).where("site IS NOT NULL")
    low, high, pos = F.col("before"), F.col("after"), F.col("pos")
    inside = low["cm"] + (pos - low["bp"]) * (high["cm"] - low["cm"]) / (high["bp"] - low["bp"])
    cm = F.when(low["bp"] == pos, low["cm"]).when(high["bp"] > low["bp"], inside)
    return rows.select("site", "chrom", "pos", F.coalesce(cm, low["cm"], high["cm"]).alias("cm"))


def rates(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """The recombination rate between each site and the one before it on its chromosome; the first has none."""
    rows = with_neighbours(placed, "chrom", [F.col("pos"), F.col("site")], "pos", F.struct("cm"), width, strict=True)
    before = F.col("before")["cm"]
    return rows.where("before IS NOT NULL").select("site", G.recombination(before, F.col("cm")).alias("rate"))


def theta(markers: DataFrame, genetic_map: DataFrame | None = None, default: float = 0.01) -> DataFrame:
    """(site, rate): from the map's distances, or the default where there is no map or no point on the chromosome; the
    first site of a chromosome has the default."""
    if genetic_map is None:
        return markers.select("site", F.lit(default).alias("rate"))
    found = rates(interpolated(markers, genetic_map).where("cm IS NOT NULL"))
    return markers.select("site").join(found, "site", "left").withColumn("rate", F.coalesce("rate", F.lit(default)))


def gaps(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(site, distance): how far each site lies from the one before it on its chromosome; the first has none."""
    rows = with_neighbours(placed, "chrom", [F.col("pos"), F.col("site")], "pos", F.struct("cm"), width, strict=True)
    return rows.where("before IS NOT NULL").select("site", (F.col("cm") - F.col("before")["cm"]).alias("distance"))


def updated_theta(counts: DataFrame, haplotypes: int) -> DataFrame:
    """(site, theta) from crossovers counted by interval (site, crossovers, and distance if it is known): intervals of
    more than one have their own rate, the others share one, of their crossovers and one more, by interval or by
    distance. The shared rate is a sum over a grouping, joined as one row."""
    few, known = F.col("crossovers") <= 1, "distance" in counts.columns
    length = F.coalesce(F.sum("distance"), F.lit(0.0)) if known else F.count(F.lit(1))
    pool = counts.where(few).agg((F.coalesce(F.sum("crossovers"), F.lit(0)) + 1).alias("n"), length.alias("length"))
    pool = pool.select((F.col("n") / (F.when(F.col("length") > 0, F.col("length")).otherwise(1) * F.lit(float(haplotypes)))).alias("base"))
    shared = F.col("base") * F.col("distance") if known else F.col("base")
    return counts.join(F.broadcast(pool)).select("site", F.when(few, shared).otherwise(F.col("crossovers") / F.lit(float(haplotypes))).alias("theta"))


def updated_error(counts: DataFrame) -> DataFrame:
    """(site, error) from counted alleles (site, matches, mismatches, uncertain: pairs that hold two mismatches or none):
    sites of two mismatches at most share the rate of all such sites, the others have their own."""
    few, names = F.col("mismatches") <= 2, ("matches", "mismatches", "uncertain")
    pool = counts.where(few).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    pool = pool.select(G.error_rate(*map(F.col, names)).alias("base"))
    own = G.error_rate(*map(F.col, names))
    return counts.join(F.broadcast(pool)).select("site", F.when(few, F.col("base")).otherwise(own).alias("error"))


def resolved_alt(ref: Column, a1: Column, a2: Column, flip: bool = True) -> Column:
    """The allele that isn't the reference, also on the other strand if `flip`; `.` if neither strand has the
    reference, or where the other allele is missing (`0`)."""
    pairs = [(a1, a2), (a2, a1)]
    if flip:
        c1, c2 = G.complement(a1), G.complement(a2)
        pairs += [(c1, c2), (c2, c1)]
    out = F.lit(".")
    for one, other in reversed(pairs):
        out = F.when(one == ref, F.when(other == "0", ".").otherwise(other)).otherwise(out)
    return out
