"""VCF text from typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vcf import COLUMNS


def joined(items: Column, separator: str, default: str) -> Column:
    """The items that aren't empty; the default where there is none."""
    some = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) > 0, F.array_join(some, separator)).otherwise(default)


def joined_info(info: Column, *order: str) -> Column:
    """A map as INFO: the ordered keys first, then the others by name; a flag stands alone, an empty map is `.`."""
    keys = F.concat(F.filter(F.array(*map(F.lit, order)), lambda k: F.map_contains_key(info, k)) if order else F.expr("cast(array() as array<string>)"), F.array_sort(F.array_except(F.map_keys(info), F.array(*map(F.lit, order)) if order else F.expr("cast(array() as array<string>)"))))
    value = lambda k: F.element_at(info, k)
    return joined(F.transform(keys, lambda k: F.when(value(k) == "", k).otherwise(F.concat(k, F.lit("="), value(k)))), ";", ".")


def quality(qual: Column) -> Column:
    return F.when(qual.isNull() | (qual < 0), ".").otherwise(F.format_string("%.0f", qual.cast("double")))


def genotype_text(genotype: Column) -> Column:
    """GT of a packed genotype."""
    a, b = (F.shiftright(genotype, k).bitwiseAND(F.lit(0x7F)).cast("string") for k in (8, 0))
    sign = F.when(genotype.bitwiseAND(F.lit(1 << 15)) != 0, "|").otherwise("/")
    return F.when(genotype.isNull() | (genotype == 0xFFFF), "./.").when(genotype.bitwiseAND(F.lit(0xFF)) == 0xFF, a).otherwise(F.concat(a, sign, b))


def hard_call_phreds(genotype: Column, step: int) -> Column:
    """PL of a hard call: step and twice it for the other genotypes; 0,0,0 for missing and haploid ones."""
    doses = F.shiftright(genotype, 8).bitwiseAND(F.lit(0x7F)) + genotype.bitwiseAND(F.lit(0x7F))
    low, high = str(step), str(2 * step)
    none = genotype.isNull() | (genotype == 0xFFFF) | (genotype.bitwiseAND(F.lit(0xFF)) == 0xFF)
    return F.when(none, "0,0,0").when(doses == 0, f"0,{low},{high}").when(doses == 1, f"{low},0,{low}").otherwise(f"{high},{low},0")


def header_lines(meta: DataFrame, samples: DataFrame) -> list[str]:
    """The `##` lines of meta (key, value) and the column line of the samples (sample_idx, sample_id) to be written. Both
    are as small as a file's header."""
    first = [f"##{r.key}={r.value if r.value is not None else '<na>'}" for r in meta.collect()]
    names = [r.sample_id for r in samples.orderBy("sample_idx").collect()]
    return [*first, "\t".join([*COLUMNS, *(["FORMAT", *names] if names else [])])]


def record_lines(sites: DataFrame, values: DataFrame | None = None, format: str = "GT") -> DataFrame:
    """(chrom, pos, value): a line for each record (key, chrom, pos, id, ref, alts, qual, filters, info), with the values
    (key, sample_idx, text) of its samples in their order. A site's samples are one row, as a line is."""
    fixed = [F.col("chrom"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref"), joined(F.col("alts"), ",", "."), quality(F.col("qual")), joined(F.col("filters"), ";", "PASS"), joined_info(F.col("info"))]
    if values is None:
        return sites.select("chrom", "pos", F.concat_ws("\t", *fixed).alias("value"))
    each = values.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "text"))), lambda x: x["text"]).alias("__lf_texts"))
    return sites.join(each, "key").select("chrom", "pos", F.concat_ws("\t", *fixed, F.lit(format), "__lf_texts").alias("value"))


def site_counts(calls: DataFrame, *keys: str) -> DataFrame:
    """AC, AN and NS by keys from packed genotypes: alleles other than the reference, all alleles, and samples called."""
    g = F.when(F.col("genotype") != 0xFFFF, F.col("genotype"))
    a, b = F.shiftright(g, 8).bitwiseAND(F.lit(0x7F)), g.bitwiseAND(F.lit(0xFF))
    second = F.when(b == 0xFF, 0).otherwise((b > 0).cast("int"))
    zero = F.lit(0).cast("long")
    return calls.groupBy(*keys).agg(F.coalesce(F.sum((a > 0).cast("int") + second), zero).alias("ac"), (2 * F.count(g)).alias("an"), F.count(g).alias("ns"))


def write(spark: SparkSession, header: list[str], rows: DataFrame, path: str) -> None:
    """A folder of text parts that read in order of name give one VCF: the header in the first, then the lines sorted by
    chromosome and position over all parts, by a range shuffle."""
    top = spark.createDataFrame([("", -1, k, line) for k, line in enumerate(header)], "chrom string, pos int, k int, value string")
    every = top.unionByName(rows.select("chrom", F.col("pos").cast("int").alias("pos"), F.lit(0).alias("k"), "value"))
    every.repartitionByRange("chrom", "pos", "k").sortWithinPartitions("chrom", "pos", "k").select("value").write.text(path)
