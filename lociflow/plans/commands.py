"""The three jobs a user runs on files: index a phased panel, phase low-coverage samples against it, and refine both
together in rounds. Tables pass from step to step as Parquet under the output folder, so that a lost executor costs the
step it worked on; nothing whole comes to the driver but file headers.

A panel is cut into windows of consecutive markers of a chromosome that overlap (operators/stitching.py), called regions
here; a haplotype of a region is one whole number. Phase is carried over the borders, and a phase set ends only where
two windows share no heterozygote of a sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..operators import genotypes, haplotypes, markers, mosaic, phasing, stitching
from ..operators.ranges import numbered
from ..sources import sinks, vcf

#: Markers of a region, at most 62 for a whole number.
SITES = 16
#: Sites that nodes of the graph look back.
WINDOW = 8
#: Rates learned from counts are no lower.
FLOOR = 1e-5


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _overlap(sites: int, overlap: int | None) -> int:
    return sites // 2 if overlap is None else overlap


def marker_places(table: DataFrame, sites: int, overlap: int) -> DataFrame:
    """(key, chrom, window, site, core, region) of a table's markers."""
    return stitching.places(table, sites, overlap).withColumn("region", F.xxhash64("chrom", "window"))


def phased_codes(calls: DataFrame, places: DataFrame) -> DataFrame:
    """(region, hap_id, code) of the phased calls (key, sample_idx, genotype)."""
    alleles = vcf.haplotype_calls(calls, "key", "sample_idx").join(places.select("key", "region", "site"), "key")
    alleles = alleles.groupBy("region", "sample_idx", "hap", "site").agg(F.max("allele").alias("allele"))
    return alleles.groupBy("region", (F.col("sample_idx") * 2 + F.col("hap")).cast("long").alias("hap_id")).agg(F.sum(F.expr("shiftleft(cast(allele as bigint), site)")).alias("code"))


def panel_tables(spark: SparkSession, path: str, include: DataFrame | None = None, exclude: DataFrame | None = None, sites: int = SITES, overlap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A phased VCF's markers (key, chrom, pos, ref, alt, ref_freq, ordinal), their places (key, chrom, window, site,
    core, region) and haplotypes (region, hap_id, code). Records of several or longer alternatives are left out; of a
    repeated key the first by id stands. A missing call counts as the reference allele."""
    lines = vcf.lines(spark, path)
    vcf.header(lines)
    records = vcf.biallelic(vcf.records(lines)).withColumn("alt", F.col("alts")[0]).withColumn("key", markers.marker_key(F.col("chrom"), F.col("pos"), F.col("alt")))
    one = records.groupBy("key").agg(F.min_by(F.struct("chrom", "pos", "id", "ref", "alt", "alts", "info"), F.coalesce("id", F.lit(""))).alias("r"))
    table = one.select("key", "r.chrom", "r.pos", "r.ref", "r.alt", G.panel_ref_freq(F.col("r.info"), F.col("r.alts")).alias("ref_freq"))
    table = numbered(table, "chrom", "pos", [F.col("pos"), F.col("alt")], "ordinal")
    places = marker_places(table, sites, _overlap(sites, overlap))
    names = markers.selected_samples(vcf.samples(lines).withColumn("source", F.lit(0)), include, exclude).select("sample_idx")
    calls = vcf.calls(records, "key", "id").join(names, "sample_idx", "left_semi")
    return table, places, phased_codes(calls, places)


def marker_rates(table: DataFrame, rate: float, error: float, genetic_map: DataFrame | None = None, crossovers: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(key, rate, error) of the markers (key, chrom, pos, ordinal): the chance of a switch between a marker and the one
    before it, from a genetic map (chrom, bp, cm), or from a crossover map (ordinal, rate), whose n-th rate is of the
    interval behind the n-th marker in the order of chromosome and position; and the chance of a misread allele, from an
    error map (ordinal, rate) likewise. What a map lacks has the given rates."""
    found = markers.theta(table.select(F.xxhash64("key").alias("site"), "chrom", "pos"), genetic_map, rate)
    out = table.join(found.withColumnRenamed("rate", "by_map"), F.xxhash64("key") == F.col("site")).drop("site")
    # a row a chromosome
    ahead = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).select("chrom", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    out = out.join(F.broadcast(starts), "chrom").withColumn("at", F.col("start") + F.col("ordinal"))
    for given, name, shift in ((crossovers, "crossover", 1), (errors, "misread", 0)):
        if given is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            out = out.join(given.select((F.col("ordinal") + shift).alias("at"), F.col("rate").alias(name)), "at", "left")
    return out.select("key", F.coalesce("crossover", "by_map").alias("rate"), F.coalesce("misread", F.lit(float(error))).alias("error"))


def placed_rates(rates: DataFrame, places: DataFrame) -> DataFrame:
    return places.join(rates, "key").select("region", "site", "rate", "error")


def index(spark: SparkSession, panel: str, out: str, include: DataFrame | None = None, exclude: DataFrame | None = None, sites: int = SITES, window: int = WINDOW, overlap: int | None = None) -> None:
    """The panel's markers, their places, haplotypes and graph as Parquet: out/markers, out/places, out/haplotypes,
    out/nodes, out/edges."""
    table, places, codes = panel_tables(spark, panel, include, exclude, sites, overlap)
    _kept(table, f"{out}/markers")
    _kept(places, f"{out}/places")
    nodes, edges = haplotypes.graph(_kept(codes, f"{out}/haplotypes"), sites, window)
    _kept(nodes, f"{out}/nodes")
    _kept(edges, f"{out}/edges")


def target_samples(spark: SparkSession, path: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(sample_idx, sample_id) of a VCF's samples that are on the one list, if it has any row, and not on the other."""
    lines = vcf.lines(spark, path)
    vcf.header(lines)
    return markers.selected_samples(vcf.samples(lines).withColumn("source", F.lit(0)), include, exclude).select("sample_idx", "sample_id")


def target_calls(spark: SparkSession, path: str, table: DataFrame, samples: DataFrame) -> DataFrame:
    """The calls of an unphased VCF at a panel's markers, by key. `.` as the alternative stands for any base."""
    records = markers.fan_out(vcf.biallelic(vcf.records(vcf.lines(spark, path))).withColumn("alt", F.col("alts")[0]))
    records = records.withColumn("key", markers.marker_key(F.col("chrom"), F.col("pos"), F.col("alt"))).join(table.select("key"), "key", "left_semi")
    return vcf.calls(records, "key").join(samples.select("sample_idx"), "sample_idx", "left_semi")


def target_phreds(calls: DataFrame, het: tuple[int, int, int] = (100, 0, 100)) -> DataFrame:
    """(key, sample_id, pl0, pl1, pl2): sample_id is the sample's number; a sample without PL, GL or GT at a marker has
    no row. Phreds are filled and capped as the panel's graph takes them; of a marker that comes twice for a sample, the
    lowest stand."""
    found = calls.withColumn("pl", vcf.phreds(F.col("fields"), het)).where("pl IS NOT NULL")
    raw = [F.get("pl", F.lit(k)) for k in range(3)]
    capped = [F.least(p, F.lit(phasing.EXCLUDED)).cast("long").alias(f"pl{k}") for k, p in enumerate(G.filled(*raw))]
    found = found.select("key", F.col("sample_idx").cast("long").alias("sample_id"), *capped)
    return found.groupBy("key", "sample_id").agg(F.min(F.struct("pl0", "pl1", "pl2")).alias("p")).select("key", "sample_id", "p.*")


def asked_phreds(phreds: DataFrame, places: DataFrame, samples: DataFrame) -> DataFrame:
    """The phreds by region and site, with a flat row for each sample in each region where another sample has reads, so
    that every line has all samples: their genotypes there are the panel's. Samples times regions rows, each of which is
    a result's. The samples' numbers come from the file's header."""
    found = phreds.join(places.select("key", "region", "site"), "key").select("region", "sample_id", "site", "pl0", "pl1", "pl2")
    every = found.select("region").distinct().withColumn("sample_id", F.explode(F.lit([r.sample_idx for r in samples.collect()]).cast("array<long>")))
    bare = every.join(found.select("region", "sample_id").distinct(), ["region", "sample_id"], "left_anti")
    return found.unionByName(bare.select("region", "sample_id", F.lit(0).alias("site"), *[F.lit(0).cast("long").alias(f"pl{k}") for k in range(3)]))


def genotype_lines(posteriors: DataFrame, phreds: DataFrame, table: DataFrame, places: DataFrame, rates: DataFrame, log10: bool = True) -> DataFrame:
    """(chrom, pos, value): VCF lines of a table's markers with GT:PL:GP by sample, GT the likeliest genotype and GP its
    probabilities' logs (base ten, or natural), and in INFO the frequency, mean best posterior, r squared and the rates."""
    core = places.where("core").select("key", "region", "site")
    full = posteriors.join(core, ["region", "site"]).join(phreds, ["key", "sample_id"], "left")
    gt = F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), genotypes.best() + 1)
    pl = F.concat_ws(",", *[F.coalesce(F.col(f"pl{k}"), F.lit(0)).cast("string") for k in range(3)])
    log = F.log10 if log10 else F.log
    gp = F.concat_ws(",", *[F.format_string("%.3f", log(G.stored_probability(F.col(f"p{k}")))) for k in range(3)])
    values = full.select("key", F.col("sample_id").alias("sample_idx"), F.concat_ws(":", gt, pl, gp).alias("text"))
    about = genotypes.marker_info(full.select(F.col("key").alias("site"), "p0", "p1", "p2")).withColumnRenamed("site", "key").join(rates, "key")
    number = lambda c: F.format_string("%.4f", F.col(c))
    info = F.map_from_arrays(F.array(*map(F.lit, ("LDAF", "AVGPOST", "RSQ", "ERATE", "THETA"))), F.array(F.format_string("%.4f", 1 - F.col("freq")), *map(number, ("avg_post", "rsq", "error", "rate"))))
    rows = table.join(about, "key").select("key", "chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(-1.0).alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"))
    return sinks.record_lines(rows, values, "GT:PL:GP")


def consensus_lines(consensus: DataFrame, table: DataFrame, places: DataFrame, sites: int, overlap: int) -> DataFrame:
    """(chrom, pos, value): VCF lines with phased GT and phase set from the windows' haplotypes (region, sample_id, code1,
    code2), put in one order along the chromosomes, and AC, AN, AF."""
    windows = consensus.join(places.select("region", "chrom", "window").distinct(), "region").select("chrom", "window", "sample_id", "code1", "code2")
    whole = stitching.joined(windows, sites, overlap, "chrom", "sample_id")
    each = whole.join(places.where("core").select("key", "chrom", "window", "site"), ["chrom", "window"])
    a, b = (F.expr(f"cast(shiftright(code{k}, site) & 1 as int)") for k in (1, 2))
    each = each.select("key", F.col("sample_id").alias("sample_idx"), a.alias("a"), b.alias("b"), (F.col("phase_set") + 1).alias("ps"))
    counts = each.groupBy("key").agg(F.sum(F.col("a") + F.col("b")).alias("ac"), (2 * F.count(F.lit(1))).alias("an"))
    text = lambda c: F.col(c).cast("string")
    info = F.map_from_arrays(F.array(*map(F.lit, ("AC", "AN", "AF"))), F.array(text("ac"), text("an"), F.format_string("%.4f", F.col("ac") / F.col("an"))))
    rows = table.join(counts, "key").select("key", "chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(-1.0).alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"))
    return sinks.record_lines(rows, each.select("key", "sample_idx", F.concat(F.concat_ws("|", "a", "b"), F.lit(":"), "ps").alias("text")), "GT:PS")


def phase(spark: SparkSession, target: str, panel: str, out: str, sites: int = SITES, rate: float = 0.01, error: float = 0.01, draws: int = 5, seed: int = 1, overlap: int | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, genetic_map: DataFrame | None = None, crossovers: DataFrame | None = None, errors: DataFrame | None = None, keep: int | None = None, people: int | None = None) -> None:
    """The target's genotypes given the indexed panel (a folder from index(), with the same sites and overlap):
    out/genotypes and out/consensus, each a folder of text parts that read in order are a VCF. include and exclude
    (sample_id) choose the target's samples; rates are as marker_rates() takes them; keep bounds
    the pairs of nodes whose sums haplotypes are drawn from; people has them drawn as mosaics of that many people's
    haplotypes, a sample's likeliest, instead. Markers of a region in which no
    sample has reads are left out."""
    read = lambda name: spark.read.parquet(f"{panel}/{name}")
    table, places, nodes, edges = map(read, ("markers", "places", "nodes", "edges"))
    samples = target_samples(spark, target, include, exclude)
    rates = _kept(marker_rates(table, rate, error, genetic_map, crossovers, errors), f"{out}/tables/rates")
    phreds = _kept(target_phreds(target_calls(spark, target, table, samples)), f"{out}/tables/phreds")
    asked = _kept(asked_phreds(phreds, places, samples), f"{out}/tables/asked")
    own = placed_rates(rates, places)
    post = _kept(phasing.posteriors(asked, nodes, edges, sites, own), f"{out}/tables/posteriors")
    header = sinks.header_lines(vcf.meta(vcf.lines(spark, target)), samples)
    sinks.write(spark, header, genotype_lines(post, phreds, table, places, rates), f"{out}/genotypes")
    if people:
        drawn = mosaic.mosaics(asked, mosaic.likely_haplotypes(asked, read("haplotypes"), sites, people), sites, draws, own, seed=seed)
    else:
        drawn = phasing.draws(asked, nodes, edges, sites, draws, own, seed, keep=keep)
    merged = _kept(phasing.consensus(drawn, sites, "region", "sample_id"), f"{out}/tables/consensus")
    sinks.write(spark, header, consensus_lines(merged, table, places, sites, _overlap(sites, overlap)), f"{out}/consensus")


def guessed_haplotypes(phreds: DataFrame, table: DataFrame, places: DataFrame, samples: DataFrame, seed: int, copies: int) -> DataFrame:
    """(region, hap_id, code): for each sample `copies` pairs of haplotypes drawn site by site from the panel's
    frequencies and the reads; hap_id counts down from -1 - 2 * copies * sample."""
    idx = F.explode(F.lit([r.sample_idx for r in samples.collect()]).cast("array<long>"))
    every = table.select("key", "ref_freq").withColumn("sample_id", idx).join(phreds, ["key", "sample_id"], "left")
    raw = [p * G.phred_prob(F.coalesce(f"pl{k}", F.lit(0))) for k, p in enumerate(G.hardy_weinberg(F.col("ref_freq")))]
    total = raw[0] + raw[1] + raw[2]
    post = every.select("key", "sample_id", F.xxhash64("key").alias("site"), *[(w / total).alias(f"p{k}") for k, w in enumerate(raw)]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    drawn = phasing.initial_haplotypes(post, seed, F.col("copy")).drop("site").join(places.select("key", "region", "site"), "key")
    code = lambda c: F.sum(F.expr(f"shiftleft(cast({c} as bigint), site)"))
    drawn = drawn.groupBy("region", "sample_id", "copy").agg(code("allele1").alias("one"), code("allele2").alias("two"))
    at = 2 * (F.col("sample_id") * copies + F.col("copy"))
    return drawn.select("region", F.inline(F.array(F.struct((-1 - at).alias("hap_id"), F.col("one").alias("code")), F.struct((-2 - at).alias("hap_id"), F.col("two").alias("code")))))


def updated_rates(counts: DataFrame, rates: DataFrame, haplotypes: int) -> DataFrame:
    """(key, rate, error) learned from counts (key, first, matches, mismatches, uncertain, crossovers, and distance if it is known); the first marker
    of a chromosome, in front of which nothing switches, keeps its rate."""
    known = ["distance"] if "distance" in counts.columns else []
    theta = markers.updated_theta(counts.where("NOT first").select(F.col("key").alias("site"), "crossovers", *known), haplotypes).withColumnRenamed("site", "key")
    error = markers.updated_error(counts.select(F.col("key").alias("site"), "matches", "mismatches", "uncertain")).withColumnRenamed("site", "key")
    out = rates.join(theta, "key", "left").join(error.withColumnRenamed("error", "learned"), "key", "left")
    least = lambda c: F.greatest(c, F.lit(FLOOR))
    return out.select("key", F.coalesce(least(F.col("theta")), "rate").alias("rate"), F.coalesce(least(F.col("learned")), "error").alias("error"))


def iterative(
    spark: SparkSession, target: str, panel: str, out: str, rounds: int = 4, burn_in: int = 1, sites: int = SITES, window: int = WINDOW, rate: float = 0.01, seed: int = 1,
    include: DataFrame | None = None, exclude: DataFrame | None = None, overlap: int | None = None, error: float = 0.01, start: str = "panel", copies: int = 0, learn: bool = True, last_draws: int = 5,
    genetic_map: DataFrame | None = None, crossovers: DataFrame | None = None, errors: DataFrame | None = None, include_targets: DataFrame | None = None, exclude_targets: DataFrame | None = None, keep: int | None = None,
) -> None:
    """Panel and target refined together: each round builds the graph over the panel's haplotypes and those drawn for
    the target in the round before, draws anew, and learns the markers' switch and error rates from what was drawn
    (unless told not to). The first round's graph holds the panel alone (start `panel`), or also haplotypes drawn from
    the panel's frequencies (`random`), or the target's own phased calls (`phased`); `copies` more drawn pairs a sample
    stay in it for all rounds. out/consensus is the VCF of the draws after the first burn_in, of which there are
    last_draws where one round is left; out/genotypes that of the last round's posteriors; out/dosages and out/info hold
    what the draws say (operators/genotypes.draw_dosages)."""
    if start not in ("panel", "random", "phased"):
        raise ValueError(f"start is panel, random or phased, not {start}")
    shared = _overlap(sites, overlap)
    table, places, codes = panel_tables(spark, panel, include, exclude, sites, shared)
    table, places, codes = (_kept(t, f"{out}/tables/{n}") for t, n in ((table, "markers"), (places, "places"), (codes, "haplotypes")))
    samples = target_samples(spark, target, include_targets, exclude_targets)
    calls = target_calls(spark, target, table, samples)
    phreds = _kept(target_phreds(calls, (127, 0, 127)), f"{out}/tables/phreds")
    asked = _kept(asked_phreds(phreds, places, samples), f"{out}/tables/asked")
    rates = _kept(marker_rates(table, rate, error, genetic_map, crossovers, errors), f"{out}/tables/rates")
    guess = lambda n, s: guessed_haplotypes(phreds, table, places, samples, s, n)
    if copies:
        # numbered apart from the panel's, and from those below 0 that the rounds draw
        codes = _kept(codes.unionByName(guess(copies, seed + 1000).withColumn("hap_id", (F.lit(1 << 40) - F.col("hap_id")).cast("long"))), f"{out}/tables/copies")
    known = codes
    if start == "random":
        known = codes.unionByName(guess(1, seed + 2000))
    elif start == "phased":
        known = codes.unionByName(phased_codes(calls, places).withColumn("hap_id", -1 - F.col("hap_id")))
    drawn, n = [], samples.count()
    for k in range(rounds):
        nodes, edges = haplotypes.graph(known, sites, window)
        nodes, edges = _kept(nodes, f"{out}/tables/nodes-{k}"), _kept(edges, f"{out}/tables/edges-{k}")
        own, single = placed_rates(rates, places), rounds - burn_in <= 1 and k == rounds - 1
        new = _kept(phasing.draws(asked, nodes, edges, sites, last_draws if single else 1, own, seed + k, keep=keep), f"{out}/tables/round-{k}")
        if k >= burn_in or k == rounds - 1:
            drawn.append(new if single else new.withColumn("round", F.lit(k)))
        if k == rounds - 1:
            break
        if learn:
            core = places.where("core").select("key", "region", "site", ((F.col("window") == 0) & (F.col("site") == 0)).alias("first"))
            counts = phasing.imputed_counts(new, sites, "region").join(core, ["region", "site"])
            if genetic_map is not None:
                placed = markers.interpolated(table.select(F.xxhash64("key").alias("site"), "chrom", "pos"), genetic_map)
                apart = markers.gaps(placed.where("cm IS NOT NULL")).withColumnRenamed("site", "id")
                counts = counts.join(apart, F.xxhash64("key") == F.col("id"), "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
            rates = _kept(updated_rates(counts, rates, 2 * n), f"{out}/tables/rates-{k}")
        # the target's haplotypes are numbered below 0, apart from the panel's
        known = codes.unionByName(new.select("region", F.inline(F.array(F.struct((-2 * F.col("sample_id") - 1).alias("hap_id"), F.col("code1").alias("code")), F.struct((-2 * F.col("sample_id") - 2).alias("hap_id"), F.col("code2").alias("code"))))))
    header = sinks.header_lines(vcf.meta(vcf.lines(spark, target)), samples)
    every = reduce(DataFrame.unionByName, drawn)
    merged = _kept(phasing.consensus(every, sites, "region", "sample_id"), f"{out}/tables/consensus")
    sinks.write(spark, header, consensus_lines(merged, table, places, sites, shared), f"{out}/consensus")
    post = _kept(phasing.posteriors(asked, nodes, edges, sites, own), f"{out}/tables/posteriors")
    sinks.write(spark, header, genotype_lines(post, phreds, table, places, rates), f"{out}/genotypes")
    doses = genotypes.draw_dosages(every, sites, "region").join(places.where("core").select("key", "region", "site"), ["region", "site"]).drop("region", "site")
    doses = _kept(doses, f"{out}/dosages")
    _kept(genotypes.marker_info(doses.withColumnRenamed("key", "site")).withColumnRenamed("site", "key"), f"{out}/info")
