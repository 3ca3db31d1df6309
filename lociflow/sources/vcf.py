"""VCF text as typed tables, and the small side files: id lists, genetic maps, rate maps, site files.

A table of lines has one column, `value`, as spark.read.text gives it (gzip included); nothing here needs the file
itself, so lines made by Spark are read alike. Sample columns are exploded to one row a sample and site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..operators.ranges import numbered

# The names of the first columns.
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
#: The packed genotype of a missing call, and the second allele of a haploid one.
MISSING, HAPLOID = 0xFFFF, 0xFF
EMPTY = "cast(array() as array<string>)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def meta(rows: DataFrame) -> DataFrame:
    """(key, value) of the `##` lines, split at the first `=`; without one the value is empty."""
    text = F.expr("substring(value, 3)")
    at = F.instr(text, "=")
    return rows.where(F.col("value").startswith("##")).select(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("key"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("value"))


def header(rows: DataFrame) -> list[str]:
    """The names of the header line, checked: the first eight, and FORMAT where there are samples."""
    found = rows.where(F.col("value").startswith("#C")).first()
    if found is None:
        raise ValueError("no header line")
    names = found.value.split("\t")
    if tuple(names[:8]) != COLUMNS or len(names) > 8 and names[8] != "FORMAT":
        raise ValueError(f"not a VCF header: {names[:9]}")
    return names


def samples(rows: DataFrame) -> DataFrame:
    """(sample_idx, sample_id) in the header's order."""
    names = F.slice(F.split("value", "\t"), 10, 1 << 30)
    return rows.where(F.col("value").startswith("#C")).select(F.posexplode(names).alias("sample_idx", "sample_id"))


def parsed_info(info: Column) -> Column:
    """INFO as a map; a flag's value is empty, `.` gives an empty map. Of a repeated key the first stands."""
    items = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    key = lambda x: F.split(x, "=", 2)[0]
    keys = F.array_distinct(F.transform(items, key))
    first = lambda k: F.element_at(F.filter(items, lambda x: key(x) == k), 1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.get(F.split(first(k), "=", 2), F.lit(1)), F.lit(""))))


def records(rows: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filters, info, format, values) of the site lines. A position that is no number
    is 0, a quality `.` or of another kind -1; bases are in capitals. Short lines have nulls where columns lack."""
    part = F.split("value", "\t")
    at = lambda k: F.get(part, F.lit(k))
    sites = rows.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return sites.select(
        at(0).alias("chrom"),
        F.coalesce(at(1).try_cast("int"), F.lit(0)).alias("pos"),
        at(2).alias("id"),
        F.upper(at(3)).alias("ref"),
        F.split(F.upper(at(4)), ",").alias("alts"),
        F.coalesce(F.when(at(5) != ".", at(5).try_cast("float")), F.lit(-1.0).cast("float")).alias("qual"),
        F.split(at(6), ";").alias("filters"),
        parsed_info(at(7)).alias("info"),
        F.split(at(8), ":").alias("format"),
        F.slice(part, 10, 1 << 30).alias("values"),
    )


def packed_genotype(text: Column, chrom: Column) -> Column:
    """phased << 15 | first << 8 | second of a GT; unphased alleles are sorted; `.` on either side is missing. One
    allele alone is haploid beyond the autosomes, and an error on them."""
    phased, cut = text.contains("|"), F.split(text, "[|/]")
    a, b = F.get(cut, F.lit(0)).try_cast("int"), F.get(cut, F.lit(1)).try_cast("int")
    number = lambda x: F.coalesce(x, F.lit(0))  # noqa: E731  other text counts as 0
    first = F.when(phased, number(a)).otherwise(F.least(number(a), number(b)))
    second = F.when(phased, number(b)).otherwise(F.greatest(number(a), number(b)))
    pair = F.shiftleft(first, 8).bitwiseOR(second).bitwiseOR(F.when(phased, 1 << 15).otherwise(0))
    alone = F.when(G.chromosome_number(chrom) >= 23, F.shiftleft(number(a), 8).bitwiseOR(F.lit(HAPLOID))).otherwise(F.raise_error(F.concat(F.lit("cannot parse the genotype "), text, F.lit(" at chromosome "), chrom)).cast("int"))
    missing = text.isNull() | text.startswith(".") | (F.substring(text, 3, 1) == ".")
    return F.when(missing, MISSING).when(F.size(cut) < 2, alone).otherwise(pair)


def calls(sites: DataFrame, *keep: str, least_depth: int = 0, least_quality: int = 0) -> DataFrame:
    """A row for each sample of each record: the columns to keep, sample_idx, fields (a map by FORMAT key), genotype
    (packed), dosage (DS; null if missing), depth (DP, else GD) and quality (GQ). `./.` and `.` are missing, with empty
    fields; another count of values than FORMAT has is an error. A call below the least depth or quality is missing."""
    rows = sites.select("chrom", *[c for c in keep if c != "chrom"], "format", F.posexplode("values").alias("sample_idx", "text"))
    cut = F.split("text", ":")
    none = F.col("text").isin("./.", ".")
    right = F.size(cut) == F.size("format")
    fields = F.when(none, F.map_from_arrays("format", F.transform("format", lambda k: F.when(k == F.col("format")[0], "./.").otherwise(""))))
    wrong = F.raise_error(F.concat(F.lit("values and FORMAT differ in number: "), "text")).cast("map<string,string>")
    rows = rows.withColumn("fields", fields.when(right, F.map_from_arrays("format", F.when(right, cut).otherwise(F.col("format")))).otherwise(wrong))
    field = lambda k: F.element_at("fields", k)
    rows = rows.withColumns({"depth": F.coalesce(field("DP"), field("GD")).try_cast("int"), "quality": field("GQ").try_cast("int")})
    low = F.lit(False)
    for name, least in (("depth", least_depth), ("quality", least_quality)):
        if least > 0:
            low = low | F.coalesce(F.col(name) < least, F.lit(False))
    genotype = F.when(low, MISSING).otherwise(packed_genotype(field("GT"), F.col("chrom")))
    dosage = F.when(field("DS").startswith("."), None).otherwise(field("DS").try_cast("float"))
    return rows.select(*keep, "sample_idx", "fields", genotype.alias("genotype"), dosage.alias("dosage"), "depth", "quality")


def phreds(fields: Column, het: tuple[int, int, int] = (100, 0, 100)) -> Column:
    """Phreds of 0, 1 and 2 alternative alleles from PL, else GL (times -10, cut to whole numbers), else the fixed ones
    of GT; null without any of them or where numbers lack. A negative one is an error."""
    field = lambda k: F.element_at(fields, k)
    three = lambda text, to: F.transform(F.slice(F.split(text, ","), 1, 3), to)
    pl = three(field("PL"), lambda x: x.try_cast("int"))
    gl = three(field("GL"), lambda x: (x.try_cast("double") * -10.0).cast("int"))
    cut = F.split(field("GT"), "[|/]")
    doses = F.get(cut, F.lit(0)).try_cast("int") + F.get(cut, F.lit(1)).try_cast("int")
    fixed = lambda p: F.array(*map(F.lit, p))
    gt = F.when(doses == 0, fixed((0, 100, 127))).when(doses == 1, fixed(het)).when(doses >= 2, fixed((127, 100, 0)))
    found = F.coalesce(F.when(field("PL") != "", pl), F.when(field("GL") != "", gl), gt)
    whole = (F.size(found) == 3) & ~F.exists(found, lambda x: x.isNull())
    bad = F.exists(found, lambda x: x < 0)
    return F.when(whole, F.when(bad, F.raise_error(F.lit("negative PL or positive GL")).cast("array<int>")).otherwise(found))


def haplotype_calls(found: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep with hap (0, 1) and allele of phased calls; missing ones drop out."""
    part = lambda shift: F.shiftright(F.col("genotype"), shift).bitwiseAND(F.lit(0x7F))
    both = F.array(F.struct(F.lit(0).alias("hap"), part(8).alias("allele")), F.struct(F.lit(1).alias("hap"), part(0).alias("allele")))
    return found.where(F.col("genotype") != MISSING).select(*keep, F.inline(both))


def biallelic(sites: DataFrame) -> DataFrame:
    """Records of one base and one alternative base (or `.`)."""
    return sites.where((F.length("ref") == 1) & (F.size("alts") == 1) & (F.length(F.col("alts")[0]) == 1))


def info_or(info: Column, key: str, default: str) -> Column:
    return F.coalesce(F.element_at(info, key), F.lit(default))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id) of a file with one id a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("sample_id")).where("sample_id != ''")


def _words(spark: SparkSession, path: str) -> DataFrame:
    """(line, words): lines numbered in file order, which one split after another gives."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("words")).where("words[0] != ''")


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, bp, cm) of a file of chromosome, position and centimorgans under a header; of a repeated position the
    last stands."""
    rows = _words(spark, path)
    rows = rows.select("line", F.concat(F.lit("chr"), F.get("words", F.lit(0))).alias("chrom"), F.get("words", F.lit(1)).try_cast("long").alias("bp"), F.get("words", F.lit(2)).try_cast("double").alias("cm")).where("bp IS NOT NULL AND cm IS NOT NULL")
    return rows.groupBy("chrom", "bp").agg(F.max_by("cm", "line").alias("cm"))


def rate_map(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, rate): the second word of each line after the header, in order from 0."""
    rows = _words(spark, path)
    first = rows.agg(F.min("line")).first()[0]
    rows = rows.where(F.col("line") != F.lit(first)) if first is not None else rows
    # a line's number has its split in front: a range a split
    rows = numbered(rows.withColumn("file", F.lit(0)), "file", "line", [F.col("line")], "ordinal", 1 << 33)
    return rows.select("ordinal", F.get("words", F.lit(1)).try_cast("double").alias("rate"))


def site_file(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, ref_freq, rate) of a panel's site file."""
    at = lambda k, kind, name: F.get("words", F.lit(k)).try_cast(kind).alias(name)
    return _words(spark, path).select(*[at(k, kind, n) for k, (n, kind) in enumerate((("chrom", "string"), ("pos", "int"), ("ref", "string"), ("alt", "string"), ("ref_freq", "double"), ("rate", "double")))])
