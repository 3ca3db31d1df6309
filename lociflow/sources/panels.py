"""Phased panels as text: a legend (name, position, two alleles; a header line) and haplotypes (a line each of 0s and 1s
with blanks between), read as tables and written back. Lines are numbered as their splits come, which needs no order of
the whole file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines that aren't blank."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).where("value != ''")


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    # a line's number has its split in front: a range a split
    return numbered(rows.withColumn("__lf_file", F.lit(0)), "__lf_file", "line", [F.col("line")], name, 1 << 33).drop("__lf_file", "line")


def legend(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, pos, allele0, allele1). A line of another count of words, or a name that comes twice, is an error."""
    rows = _lines(spark, path)
    first = rows.agg(F.min("line")).first()[0]
    rows = rows.where(F.col("line") != F.lit(first)) if first is not None else rows
    words = F.split("value", r"\s+")
    right = F.when(F.size(words) == 4, words).otherwise(F.raise_error(F.concat(F.lit("a legend line has four words: "), "value")).cast("array<string>"))
    rows = rows.withColumn("w", right).select("line", F.col("w")[0].alias("name"), F.col("w")[1].try_cast("double").alias("pos"), F.col("w")[2].alias("allele0"), F.col("w")[3].alias("allele1"))
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"marker {twice.name} comes twice")
    return _in_order(rows, "ordinal")


def haplotypes(spark: SparkSession, path: str, markers: int) -> DataFrame:
    """(hap_id, alleles): a string of 0s and 1s, one for each of the markers, of which the legend says how many there are; a
    line of another length, or with other characters, is an error."""
    rows = _lines(spark, path)
    bare = F.replace("value", F.lit(" "), F.lit(""))
    fits = (F.length("value") == 2 * markers - 1) & F.col("value").rlike("^[01 ]+$") & ~F.col("value").rlike("[01]{2}|  ")
    wrong = F.raise_error(F.concat(F.lit(f"a haplotype is {markers} alleles, 0 or 1, with blanks between: "), F.substring("value", 1, 60))).cast("string")
    return _in_order(rows.select("line", F.when(fits, bare).otherwise(wrong).alias("alleles")), "hap_id")


def long_form(haps: DataFrame) -> DataFrame:
    """(hap_id, ordinal, allele) of haplotypes()."""
    return haps.select("hap_id", F.posexplode(F.split("alleles", "")).alias("ordinal", "allele")).where("allele != ''").withColumn("allele", F.col("allele").cast("int"))


def legend_lines(markers: DataFrame) -> DataFrame:
    """(at, value): the header and a line for each marker (ordinal, name, pos, allele0, allele1)."""
    top = markers.sparkSession.createDataFrame([(-1, "rs position a0 a1")], "at long, value string")
    place = F.when(F.col("pos") == F.floor("pos"), F.col("pos").cast("long").cast("string")).otherwise(F.col("pos").cast("string"))
    return top.unionByName(markers.select(F.col("ordinal").cast("long").alias("at"), F.concat_ws(" ", "name", place, "allele0", "allele1").alias("value")))


def haplotype_lines(haps: DataFrame) -> DataFrame:
    """(at, value): a line for each haplotype (hap_id, alleles)."""
    return haps.select(F.col("hap_id").cast("long").alias("at"), F.array_join(F.filter(F.split("alleles", ""), lambda c: c != ""), " ").alias("value"))


def write(lines: DataFrame, path: str) -> None:
    """A folder of text parts that read in order of name give the file."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
