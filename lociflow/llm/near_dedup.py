"""MinHash near-dedup with ProbMinHash signatures, banding, exact verification and connected components.

A document's distinct shingles (five words; all words, if it has fewer) weigh one each, however often they occur in
it, because a link is verified on sets: other weights would make the bands miss pairs that differ in repeated
passages. Each shingle starts a Poisson process whose rate is its weight; each arrival falls on a register drawn by
hash, and a register keeps the shingle that arrives first. Two signatures agree in a register with the probability
Jaccard similarity, which for equal weights is the Jaccard similarity of the sets. Arrivals are drawn in order and stop at a time by which the registers are
expected to be full; the few documents with an empty register go on with the time doubled. Whatever arrives later
than a register's first cannot change it, so the early end is exact.

Bands of `rows` registers are hashed. Documents that share a band are candidates; a pair is a link if the Jaccard
similarity of its shingle sets is at least `least`. Classes are the connected components of links.

Only distinct word sequences take part (equal ones form one node). In each band bucket, every node is first checked
against the bucket's pivot, the node that meets most others in all buckets: a number of pairs that grows with the rows, not with their square. After the
components of those links, the only pairs that can still matter are those of different classes in one bucket; of
these, exactly the ones are checked that share one of the rare shingles that similar sets must share (prefix filter)
and whose sizes, less the shingles that no other such document has, allow the similarity. Buckets, copies and classes
with a large share of the rows are dealt over several tasks where they are joined. So no link between different classes is lost and copies aren't expanded.

Edge cases: a null text counts as empty; texts without words are one class. Repeated rows are in one class. A null
doc_id takes part; the class is named by its smallest doc_id that isn't null. near_dedup() leaves extra columns out,
keep_one() hands them on. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, small, spread_join, stored
from .words import Hashes, blocks, chain, mix64, texts

#: Words of parity bits of a text's shingles.
MARKS = 8
#: Bytes of text whose shingles are held at once.
BLOCK = 1 << 20
RESULT = ("class_id", "class_size", "kept")


@dataclass(frozen=True)
class Settings:
    words: int = 5
    least: float = 0.8
    bands: int = 32
    rows: int = 5


def word_key(text: Column) -> Column:
    """Equal for texts with the same words: MD5 of the words with single spaces."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))))


def shingles(words: list[list[bytes]], n: int, cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts and the place of the text each is of; one of all words for shorter texts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(lengths.sum()), np.uint64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    for w, a in zip(words, at):
        flat[a : a + len(w)] = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    doc = np.repeat(np.arange(len(words)), lengths)
    if len(flat) >= n:
        whole = doc[: len(flat) - n + 1] == doc[n - 1 :]
        keys = mix64(flat[: len(flat) - n + 1])
        for k in range(1, n):
            keys = chain(keys, flat[k : len(flat) - n + 1 + k])
        keys, docs = keys[whole], doc[: len(flat) - n + 1][whole]
    else:
        keys, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero(lengths < n)
    if len(short):
        more = np.array([cache[b"\n" + b" ".join(words[i])] for i in short], np.uint64)
        keys, docs = np.concatenate((keys, more)), np.concatenate((docs, short))
    return keys, docs


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, shingle), by text."""
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def prob_minhash(keys: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The signatures (n texts by registers) of weighted shingles: docs are sorted places from 0 to n - 1."""
    total = np.bincount(docs, weights, n)
    until = np.where(total > 0, 6.0 * registers / np.maximum(total, 1), 0.0)
    signature = np.zeros((n, registers), np.uint64)
    todo = np.flatnonzero(total > 0)
    # a text of one shingle has it in every register
    one = np.bincount(docs, minlength=n) == 1
    signature[docs[one[docs]]] = keys[one[docs], None]
    todo = todo[~one[todo]]
    while len(todo):
        place = np.full(n, -1, np.int64)
        place[todo] = np.arange(len(todo))
        mine = np.flatnonzero(place[docs] >= 0)
        k, d, rate, stop = keys[mine], place[docs[mine]], weights[mine].astype(float), until[docs[mine]]
        first = np.full(len(todo) * registers, np.inf)
        holder = np.zeros(len(todo) * registers, np.uint64)
        time, state = np.zeros(len(k)), k
        while len(k):
            state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
            on = time <= stop
            k, d, rate, stop, time, state = k[on], d[on], rate[on], stop[on], time[on], state[on]
            at = d * registers + (mix64(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, at, time)
            best = first[at] == time
            holder[at[best]] = k[best]
        full = np.isfinite(first).reshape(-1, registers).all(axis=1)
        signature[todo[full]] = holder.reshape(-1, registers)[full]
        todo = todo[~full]
        until[todo] *= 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = chain(key, signature[:, b * rows + r])
        out[:, b] = key
    return out


def parities(keys: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """64 * MARKS bits a text: whether an odd number of its shingles fall on the bit. Two texts differ in at most as
    many bits as there are shingles in only one of them."""
    place = mix64(keys ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(64 * MARKS)
    bits = np.zeros(n * MARKS, np.uint64)
    np.bitwise_xor.at(bits, docs * MARKS + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return bits.reshape(n, MARKS)


def _sign(batches: Iterator[pa.RecordBatch], how: Settings) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for block in blocks(batches, size=BLOCK):
        n = block.num_rows
        keys, docs = distinct(*shingles([t.split() for t in texts(block)], how.words, cache))
        bands = band_keys(prob_minhash(keys, docs, np.ones(len(keys)), n, how.bands * how.rows), how.bands, how.rows)
        offsets = np.arange(0, (n + 1) * how.bands, how.bands, dtype=np.int32)
        sizes = np.bincount(docs, minlength=n).astype(np.int32)
        yield pa.record_batch([block.column("doc_id"), block.column("word_key"), pa.array(sizes), pa.ListArray.from_arrays(offsets, bands.ravel().view(np.int64))], names=["doc_id", "word_key", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], how: Settings) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for block in blocks(batches, size=BLOCK):
        keys, docs = distinct(*shingles([t.split() for t in texts(block)], how.words, cache))
        n = block.num_rows
        offsets = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n)))).astype(np.int32)
        at = np.arange(0, (n + 1) * MARKS, MARKS, dtype=np.int32)
        yield pa.record_batch([block.column("id"), pa.ListArray.from_arrays(offsets, keys.view(np.int64)), pa.ListArray.from_arrays(at, parities(keys, docs, n).ravel().view(np.int64))], names=["id", "grams", "marks"])


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return both.where(F.col("common") >= least * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b")


def classes(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """A stored table (doc_id, word_key, root) with a row for each row of docs: root is its class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", word_key(F.col("text")).alias("word_key"), "text")
    signed = stored(keyed.mapInArrow(lambda b: _sign(b, how), f"doc_id {kind}, word_key binary, n int, bands array<long>"), "signed")
    distinct = signed.groupBy("word_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "nodes")

    rows = nodes.select("id", F.explode("bands").alias("band"))
    buckets = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    sizes = buckets.select("band", F.col("size").alias("n"))
    members = stored(spread_join(rows, buckets, "band", sizes), "members")
    # the node that meets most others is each bucket's pivot: a group's original rather than one of its edits
    central = members.groupBy("id").agg(F.sum("size").alias("met"))
    pivots = members.join(central, "id").groupBy("band").agg(F.max(F.struct("met", "id")).getField("id").alias("pivot"))
    members = stored(spread_join(members, stored(pivots, "pivots"), "band", sizes).select("band", "id", "pivot"), "members")
    some = members.select("id").distinct().join(nodes.select("id", "doc_id", "word_key"), "id")
    some = small(stored(some.select("id", "doc_id", F.col("word_key").alias("key")), "some"))
    texts_of = docs.select("doc_id", "text", word_key(F.col("text")).alias("__lf_key")).alias("d").join(some.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.__lf_key = s.key"))
    sets = texts_of.select("id", "text").mapInArrow(lambda b: _sets(b, how), "id long, grams array<long>, marks array<long>")
    sets = stored(sets.groupBy("id").agg(F.first(F.struct("grams", "marks")).alias("s")).select("id", "s.grams", "s.marks"), "sets")

    tried = members.where("id != pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    links = stored(_linked(tried, sets, how.least), "links")
    roots = components(links)

    named = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    named = stored(named, "named")
    mixed = stored(named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band"), "mixed")
    left = spread_join(named, mixed, "band", sizes, "left_semi").select("id", "root").distinct()
    # two similar sets of n and m shingles share ceil(least / (1 + least) * (n + m)) of them, so that in any common order
    # the first shared one stands early in both. Shingles of one class only come first, as they are never shared; then
    # the rare ones. The smaller set needs a shorter start than the larger one (indexed and probing prefixes).
    grams = stored(left.join(sets.select("id", "grams"), "id").select("id", "root", F.size("grams").alias("n"), F.explode("grams").alias("g")), "grams")
    often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = F.col("low") < F.col("high")
    of_id = Window.partitionBy("id")
    ranked = grams.join(often, "g").withColumns({"place": F.row_number().over(of_id.orderBy(shared, "df", "g")), "met": F.sum(shared.cast("int")).over(of_id)})
    start = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    prefix = ranked.where(shared & (F.col("place") <= start(how.least)) & (F.col("met") >= F.col("n") * how.least - 1e-9)).select("g", "id", "root", "n", "place")
    prefix = stored(prefix.join(sets.select("id", "marks"), "id"), "prefix")
    common = how.least / (1 + how.least)
    # a frequent shingle's rows aren't copied to several tasks, which would cost more rows than they are: where its
    # partition is large, adaptive execution splits it by the files it comes from
    x, y = prefix.alias("x"), prefix.where(F.col("place") <= start(2 * common)).alias("y")
    apart = " + ".join(f"bit_count(x.marks[{k}] ^ y.marks[{k}])" for k in range(MARKS))
    cross = x.join(
        y,
        F.expr(f"""x.g = y.g AND x.root != y.root AND (y.n < x.n OR y.n = x.n AND y.id < x.id)
            AND least(x.n - x.place, y.n - y.place) + 1 >= {common!r}D * (x.n + y.n) - 1e-9D
            AND {apart} <= {1 - 2 * common!r}D * (x.n + y.n) + 1e-9D"""),
    ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = _linked(cross.join(tried, ["a", "b"], "left_anti"), sets, how.least)
    roots = components(stored(links.union(more), "links"))
    of_key = nodes.select("id", "word_key").join(roots.withColumnRenamed("node", "id"), "id", "left").select("word_key", F.coalesce("root", "id").alias("root"))
    copies = nodes.select("word_key", F.col("copies").alias("n"))
    return stored(spread_join(signed.select("doc_id", "word_key"), stored(of_key, "of_key"), "word_key", copies), "classes")


def near_dedup(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for each row of docs: the class's smallest doc_id, its number of rows, and
    whether this is the row of the class that stays."""
    rows, heads = _heads(docs, how)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("word_key") == F.col("head_key"))
    out = spread_join(rows, heads, "root", heads.select("root", F.col("class_size").alias("n"))).withColumn("kept", first)
    order = Window.partitionBy("root", "doc_id").orderBy("word_key")
    again = out.where(first & (F.col("same") > 1)).withColumn("kept", F.row_number().over(order) == 1)
    return out.where(~first | (F.col("same") == 1)).unionByName(again).select("doc_id", *RESULT)


def _heads(docs: DataFrame, how: Settings) -> tuple[DataFrame, DataFrame]:
    rows = classes(docs, how)
    each = rows.groupBy("root", "doc_id", "word_key").agg(F.count(F.lit(1)).alias("same"))
    heads = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "word_key", "same")).alias("m"), F.sum("same").alias("class_size"))
    return rows, stored(heads.select("root", F.col("m.doc_id").alias("class_id"), F.col("m.word_key").alias("head_key"), F.col("m.same").alias("same"), "class_size"), "heads")


def keep_one(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """docs with one row of each class: that of its smallest doc_id."""
    rows, heads = _heads(docs, how)
    rows = spread_join(rows, heads.where("class_size > 1"), "root", heads.select("root", F.col("class_size").alias("n")))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("word_key") == F.col("head_key"))
    gone = stored(rows.where(~first).select("doc_id", F.col("word_key").alias("key")).distinct(), "gone")
    twice = stored(rows.where(first & (F.col("same") > 1)).select("doc_id", F.col("word_key").alias("key")).distinct(), "twice")
    keyed = docs.withColumn("__lf_key", word_key(F.col("text")))
    is_in = lambda t: F.expr("d.doc_id <=> t.doc_id AND d.__lf_key = t.key")
    left = keyed.alias("d").join(small(gone).alias("t"), is_in(gone), "left_anti")
    once = left.alias("d").join(small(twice).alias("t"), is_in(twice), "left_anti")
    again = left.alias("d").join(small(twice).alias("t"), is_in(twice), "left_semi").dropDuplicates(["doc_id", "__lf_key"])
    return once.unionByName(again).select(*docs.columns)
