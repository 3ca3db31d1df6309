"""Two panels' allele labels brought together, marker by marker: numbers read as bases, and labels of the other strand
turned where that is beyond doubt. A marker's labels are one small row; genotypes are joined with what is decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import complement

NUMBERS = "1234"


def _all_in(items: Column, of: Column) -> Column:
    return F.size(F.array_except(items, of)) == 0


def decisions(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, label, to, action) for each label of a sample's markers (key, label) that the panel (key, allele0, allele1) has
    too; `to` is the label it stands for, null where the marker's genotypes must be dropped.

    Labels that the panel doesn't have are new. If there are two at most, all of them numbers 1 to 4, they are the bases
    A, C, G and T (renamed). If there are then more than two labels in all and some of them new, and the sample has none of
    the panel's own, one new label that is the complement of one of the panel's, or two that are the complements of the
    panel's two and not each other's, are turned (flipped); else they are a mismatch. New labels with which there are no
    more than two in all are kept."""
    found = labels.where("label IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("seen"))
    rows = panel.select("key", F.array_distinct(F.array_compact(F.array("allele0", "allele1"))).alias("own")).join(found, "key")
    new = F.array_except("seen", "own")
    numbers = (F.size(new) > 0) & (F.size(new) <= 2) & F.forall(new, lambda x: x.rlike(f"^[{NUMBERS}]$"))
    rows = rows.withColumn("renamed", numbers)
    base = lambda x: F.when(F.col("renamed") & ~F.array_contains("own", x), F.translate(x, NUMBERS, "ACGT")).otherwise(x)
    rows = rows.withColumn("named", F.transform("seen", base))
    rows = rows.withColumn("new", F.array_distinct(F.array_except("named", "own"))).withColumn("many", F.size(F.array_union("own", "named")) > 2)
    turned = F.transform("new", lambda x: complement(x))
    one_letter = F.forall("new", lambda x: x.rlike("^[ACGT]$"))
    apart = (F.size("new") < 2) | (turned[0] != F.try_element_at("new", F.lit(2)))
    fits = one_letter & (F.size("new") <= 2) & apart & _all_in(turned, F.col("own")) & ~F.arrays_overlap("named", "own")
    rows = rows.withColumn("open", F.col("many") & (F.size("new") > 0)).withColumn("flipped", F.col("open") & fits)
    action = F.when(F.col("open") & ~F.col("flipped"), "mismatch").when(F.col("renamed") & F.col("flipped"), "renamed, flipped").when(F.col("renamed"), "renamed").when(F.col("flipped"), "flipped").when(F.size("new") > 0, "kept").otherwise("same")
    each = rows.withColumn("action", action).select("key", "action", "flipped", F.explode(F.arrays_zip(F.col("seen").alias("label"), F.col("named").alias("to"))).alias("x"))
    to = F.when(F.col("action") != "mismatch", F.when(F.col("flipped"), complement(F.col("x.to"))).otherwise(F.col("x.to")))
    return each.select("key", F.col("x.label").alias("label"), to.alias("to"), "action")


def relabelled(genotypes: DataFrame, decided: DataFrame, *columns: str) -> DataFrame:
    """genotypes (key, ...) with the labels in the columns replaced as decided; null where they are to be dropped."""
    for c in columns:
        names = decided.select("key", F.col("label").alias(c), F.col("to").alias("__lf_to"))
        genotypes = genotypes.join(names, ["key", c], "left").withColumn(c, F.col("__lf_to")).drop("__lf_to")
    return genotypes
