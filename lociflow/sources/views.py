"""Genotype-shaped views, each over its whole table. WITH holds the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running_sum

#: Sites a region; a region's haplotype is one whole number, a bit a site.
SITES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Allele read counts by sample and site."""
    one = lambda s: F.sum((F.col("l_linestatus") == s).cast("long"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("site")).agg(one("O").alias("n_ref"), one("F").alias("n_alt"))


def phreds(spark: SparkSession, d: str) -> DataFrame:
    cap = lambda c: F.least(F.lit(127).cast("long"), c)
    r, a = F.col("n_ref"), F.col("n_alt")
    return reads(spark, d).withColumns({"pl0": cap(20 * a), "pl1": cap(3 * (r + a)), "pl2": cap(20 * r)})


def markers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    letter = lambda s: F.substring(F.lit(s), (1 + k % 4).cast("int"), F.lit(1))
    return table(spark, d, "part").select(k.alias("site"), F.concat(F.lit("chr"), (1 + k % 3).cast("string")).alias("chrom"), (k * 1000 + F.col("p_size")).alias("pos"), letter("ACGT").alias("ref"), F.when(k % 11 == 0, ".").otherwise(letter("CGTA")).alias("alt"))


def genetic_map(spark: SparkSession, d: str) -> DataFrame:
    """Each site's place and cumulated distance on its chromosome."""
    k = F.col("p_partkey")
    chrom = F.concat(F.lit("chr"), (1 + k % 3).cast("string"))
    every = table(spark, d, "part").select(chrom.alias("chrom"), (k * 1000).alias("bp"), "p_size")
    return running_sum(every, "chrom", "bp", "p_size", "sum").select("chrom", "bp", (F.col("sum") * F.lit(0.01)).alias("cm"))


def haplotypes(spark: SparkSession, d: str) -> DataFrame:
    """(region, hap_id, code): bit s of code is the allele at the region's site s."""
    k = F.col("l_partkey")
    allele = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long")
    rows = table(spark, d, "lineitem").select(F.expr(f"l_partkey div {SITES}").alias("region"), (F.col("l_suppkey") * 2 + F.col("l_linenumber") % 2).alias("hap_id"), F.call_function("shiftleft", allele, (k % SITES).cast("int")).alias("bit"))
    # the greatest allele of each site, added up over the sites
    return rows.groupBy("region", "hap_id").agg(F.bit_or("bit").alias("code"))


def status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(2).alias("status"))


def regional_phreds(spark: SparkSession, d: str) -> DataFrame:
    """phreds by region and the region's site, as haplotypes() cuts them."""
    return phreds(spark, d).select("sample_id", F.expr(f"site div {SITES}").alias("region"), (F.col("site") % SITES).cast("int").alias("site"), "pl0", "pl1", "pl2")


def vcf_lines(spark: SparkSession, d: str) -> DataFrame:
    """A VCF line for each marker with reads, with the samples that read it: GT, DP and PL for every third pair of
    sample and site, GL for the next, GT alone for the others; samples without a reference read are phased."""
    n, r, a = F.col("n_ref") + F.col("n_alt"), F.col("n_ref"), F.col("n_alt")
    kind = (F.col("sample_id") + F.col("site")) % 3
    gt = F.when(n < 1, "./.").when(a == 0, "0/0").when(r == 0, "1|1").otherwise("1/0")
    tens = lambda c: F.concat(F.when(c > 0, "-").otherwise(""), F.floor(c / 10).cast("string"), F.lit("."), (c % 10).cast("string"))
    triple = lambda to: F.concat_ws(",", *[to(F.col(f"pl{i}")) for i in range(3)])
    pl, gl = F.when(kind == 0, triple(lambda c: c.cast("string"))).otherwise(""), F.when(kind == 1, triple(tens)).otherwise("")
    text = F.when(n < 1, "./.").otherwise(F.concat_ws(":", gt, n.cast("string"), pl, gl))
    each = phreds(spark, d).select("site", "sample_id", text.alias("text"), "n_alt", n.alias("n"))
    rows = each.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "text"))), lambda x: x["text"]).alias("texts"), F.sum("n_alt").alias("ac"), F.sum("n").alias("an"))
    m = markers(spark, d).join(rows, "site")
    k = F.col("site")
    info = F.when(k % 3 == 0, F.concat(F.lit("AF=0."), (k % 10).cast("string"), F.lit(";DB"))).when(k % 3 == 1, F.concat(F.lit("AC="), "ac", F.lit(";AN="), "an", F.lit(";NS=1;AC=9"))).otherwise(".")
    qual = F.when(k % 2 == 0, ".").otherwise(F.concat((k % 100).cast("string"), F.lit(".25")))
    fixed = ["chrom", F.col("pos").cast("string"), F.concat(F.lit("m"), k.cast("string")), F.lower("ref"), F.lower("alt"), qual, F.lit("PASS"), info, F.lit("GT:DP:PL:GL")]
    return m.select(F.concat_ws("\t", *fixed, "texts").alias("value"))


WITH = f"""WITH reads AS (SELECT l_suppkey AS sample_id, l_partkey AS site, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS n_ref,
  sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_alt FROM lineitem GROUP BY 1, 2),
phreds AS (SELECT *, least(127, 20 * n_alt)::BIGINT AS pl0, least(127, 3 * (n_ref + n_alt))::BIGINT AS pl1, least(127, 20 * n_ref)::BIGINT AS pl2 FROM reads),
markers AS (SELECT p_partkey AS site, 'chr' || (1 + p_partkey % 3) AS chrom, p_partkey * 1000 + p_size AS pos, substr('ACGT', (1 + p_partkey % 4)::INT, 1) AS ref,
  CASE WHEN p_partkey % 11 = 0 THEN '.' ELSE substr('CGTA', (1 + p_partkey % 4)::INT, 1) END AS alt FROM part),
genetic_map AS (SELECT 'chr' || (1 + p_partkey % 3) AS chrom, p_partkey * 1000 AS bp, sum(p_size) OVER (PARTITION BY 1 + p_partkey % 3 ORDER BY p_partkey)::DOUBLE * 1e-2 AS cm FROM part),
alleles AS (SELECT l_partkey // {SITES} AS region, l_suppkey * 2 + l_linenumber % 2 AS hap_id, l_partkey % {SITES} AS site, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS allele FROM lineitem GROUP BY 1, 2, 3),
haplotypes AS (SELECT region, hap_id, sum(allele << site)::BIGINT AS code FROM alleles GROUP BY 1, 2),
status AS (SELECT s_suppkey AS sample_id, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS status FROM supplier)
"""
