"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of word counts,
a cut at each source's exact budget, whole passes first where a budget exceeds the source.

A document's key is the md5 of its doc_id and its text's md5, so that rows of one doc_id, or of none, spread too. A range of keys (a fixed count of equal ranges of the key's first hex
digits, which md5 fills evenly) is the unit of the sort and of the first prefix sum; the sums of the ranges, at most
`16 ** digits` a source, are added up by source, and each document's start is its range's start plus the sum before
it in its range. A hot source thus spreads over all its ranges.

Edge cases: a null or empty text has size 0 and is taken 0 words. A null source is a source, last in the order of
weights. Null doc_ids are a doc_id. Only rows alike in doc_id, source and text share a key: they are added up before
anything is sorted, and numbered only where the cut falls among them, which leaves the result's rows the same. Extra columns are kept; mix() replaces those with the name of a
result column, mixed() hands them on. If all sizes are 0, all targets are 0. An empty table gives an empty result. The
weights are set by windows over one row a source, in one task: sources are taken to be far fewer than documents.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
RESULT = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target): `share` times all words by weight, none above `most` times its source, the
    excess shared anew by weight until none is above.

    That limit is a water level: target = min(most * size, level * weight). Sorted by most * size / weight, the
    sources below the level are a prefix; the level follows from whole-number sums, so that it is exact but for one
    division. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", pick.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # the first source that stays below its cap sets the level; if none does, every source is at its cap
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)
    out = levels.withColumn("at", first.getField("level"))
    return out.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def order_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame) -> DataFrame:
    """docs with __lf_size (words) and __lf_key (order), instead of any columns of that name."""
    return docs.withColumns({"__lf_size": n_words(F.col("text")), "__lf_key": order_key(F.col("doc_id"), F.col("text"))})


def shares(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, digits: int = 3) -> DataFrame:
    """Rows of sized() with __lf_total (its source's words), __lf_target (its source's) and __lf_taken: the words of it
    that the mix holds, repeats counted. The document at the budget's end is cut there, so that the words taken of a
    source are its target, rounded to whole words."""
    size, key, part, src = "__lf_size", "__lf_key", "__lf_part", "__lf_src"
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    keyed = rows.withColumn("__lf_place", F.concat(F.col(key), source))
    # rows alike in all that counts are one row here, with their number
    keys = keyed.groupBy("__lf_place").agg(F.count(F.lit(1)).alias("__lf_n"), F.max(size).alias("__lf_each"), F.max("source").alias("source"))
    keys = keys.withColumns({src: F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), part: F.substring("__lf_place", 1, digits), "__lf_all": F.col("__lf_n") * F.col("__lf_each")})
    keys = stored(keys, "keys")
    # a row for each range of each source, read twice
    parts = stored(keys.groupBy(src, part).agg(F.sum("__lf_all").alias("__lf_sum"), F.max("source").alias("source")), "ranges")
    goal = targets(parts.groupBy("source").agg(F.sum("__lf_sum").alias("source_size")), weights, share, most)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(src), F.col("source_size").alias("__lf_total"), F.col("target").alias("__lf_target"))
    ahead = Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(src, part, F.coalesce(F.sum("__lf_sum").over(ahead), F.lit(0)).alias("__lf_start")).join(goal, src)
    within = Window.partitionBy(src, part).orderBy("__lf_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("__lf_before", F.coalesce(F.sum("__lf_all").over(within), F.lit(0))).join(starts, [src, part])
    passes = F.expr("CASE WHEN __lf_total > 0 THEN cast(round(__lf_target) as bigint) div __lf_total ELSE 0L END")
    left = F.round("__lf_target").cast("long") - passes * F.col("__lf_total") - F.col("__lf_start") - F.col("__lf_before")
    # words of the key's rows before the cut, and whether the cut is among them
    some = F.least(F.greatest(left, F.lit(0)), F.col("__lf_all"))
    table = stored(placed.select("__lf_place", "__lf_n", "__lf_total", "__lf_target", passes.alias("__lf_passes"), some.alias("__lf_some"), ((some > 0) & (some < F.col("__lf_all")) & (F.col("__lf_n") > 1)).alias("__lf_cut")), "placed")
    joined = spread_join(keyed, table.drop("__lf_n"), "__lf_place", table.select("__lf_place", F.col("__lf_n").alias("n")))
    # of a source's alike rows that hold its cut, one key at most, each is told apart by a number
    nth = F.row_number().over(Window.partitionBy("__lf_place").orderBy("__lf_place")) - 1
    apart = joined.where("__lf_cut").withColumn("__lf_nth", nth).withColumn("__lf_own", F.least(F.greatest(F.col("__lf_some") - F.col("__lf_nth") * F.col(size), F.lit(0)), F.col(size))).drop("__lf_nth")
    whole = joined.where("NOT __lf_cut").withColumn("__lf_own", F.least(F.col("__lf_some"), F.col(size)))
    out = whole.unionByName(apart).withColumn("__lf_taken", (F.col("__lf_passes") * F.col(size) + F.col("__lf_own")).cast("long"))
    return out.drop(key, "__lf_place", "__lf_passes", "__lf_some", "__lf_cut", "__lf_own")


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"__lf_size": "size", "__lf_total": "source_size", "__lf_target": "target", "__lf_taken": "taken"})


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target and taken."""
    return named(shares(sized(docs.drop(*RESULT)), **how))


def first_words(texts, counts):
    """Each text up to the end of its first n words."""
    word = re.compile(WORD)
    for text, n in zip(texts, counts):
        end = 0
        for k, m in enumerate(word.finditer(text)):
            if k == n:
                break
            end = m.end()
        yield text[:end]


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as its whole passes, and, if the budget ends in
    it, once more up to its last word within the budget. Documents of no words are in no mix's budget and stay once."""
    @F.pandas_udf("string")
    def head(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else next(first_words([t], [int(k)])) for t, k in zip(text, n.fillna(0))], dtype="object")

    size, taken = F.col("__lf_size"), F.col("__lf_taken")
    whole = F.when(size > 0, F.expr("__lf_taken div __lf_size")).otherwise(F.lit(1))
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0))
    out = shares(sized(docs), **how).withColumns({"__lf_whole": whole, "__lf_rest": rest})
    out = out.withColumn("__lf_times", (F.col("__lf_whole") + (F.col("__lf_rest") > 0).cast("int")).cast("int"))
    out = out.withColumn("__lf_copy", F.explode(F.expr("CASE WHEN __lf_times > 0 THEN sequence(1, __lf_times) ELSE array() END")))
    partial = F.col("__lf_copy") > F.col("__lf_whole")
    text = F.when(partial, head(F.when(partial, F.col("text")), F.col("__lf_rest"))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns)


def sql(weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> str:
    """The query in DuckDB's SQL: plain windows instead of ranges, and the excess found by the water level."""
    w = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + str(len(weights)) + "".join(f" WHEN {k} THEN {x}" for k, x in enumerate(weights)) + " END"
    return f"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, {w} AS w, source_size * {most} AS cap FROM s),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * {share}::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev
  FROM ranked WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT lev FROM levels WHERE lev * w <= cap ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1) * w), cap::DOUBLE) AS target FROM levels),
placed AS (SELECT d.doc_id, d.size, g.source_size, g.target,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (round(target)::BIGINT // source_size) * size + least(greatest(round(target)::BIGINT % source_size - start, 0), size) END::BIGINT AS taken FROM placed"""
