"""Conversation prefix trie: which conversations share which first turns, without shuffling what no two share.

A prefix's digest is a polynomial in its turns' hashes, modulo a prime and in four bases at once (124 bits, and the
depth beside them), so that it is a running sum over the turns, which long conversations compute in blocks. A count-min
sketch of all prefix digests is built where the prefixes are: a task sends the cells it has met, once or more often, and
the cells' counts stop at two. An estimate of one proves that no other conversation has the prefix, so the node is
written out from the row at hand (as its parent is, if that is proved too). Only prefixes that may be shared are
grouped, by their whole digest.

What a node needs of its subtree is summed up without walking the tree: a node's saved tokens belong to its smallest
member, a leaf to its own smallest member, and sums from a conversation's end back to a depth are what it adds to its
prefix of that depth.

Scale: the sketch has four cells a prefix and row, at most 2^27 (16 MB of bits a row on the driver and the executors);
beyond that more prefixes go the exact way, with the same result. Turns are numbered in ranges of (conversation, turn,
role, text), and running sums carried over blocks of WIDTH turns, so no conversation is in one task. A prefix of many
conversations is counted before the shuffle and dealt over tasks where joined; its members' ids are sorted in ranges,
and their hash, which must be read in order, streams over runs of them.

Edge cases: null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out.
Turns are ordered with nulls first, ties by role and text; repeated rows are turns of their own. Conversations without
turns after rebuilding are members of the root. Texts of any length are read whole. Extra columns are ignored. An
empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, small, spread_join, stored
from .words import mix64

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a base, and the most turns taken of it.
EVERY, MOST = 20, 4
#: Turns of a conversation whose running sums are one window.
WIDTH = 4096
#: Characters of a text by which ranges are cut; sorting reads it whole.
HEAD = 64
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 742_938_285, 1_583_458_089, 397_204_094)
#: Rows of the sketch, least and greatest number of their cells (powers of two), cells a prefix, and cells of a slice.
ROWS, LEAST, GREATEST, ROOMY, SLICE = 2, 1 << 16, 1 << 27, 4, 1 << 16
#: Bytes of joined ids that are passed on at once.
RUN = 1 << 16
KEY = "struct<depth:int,a:bigint,b:bigint>"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, words) for each turn: its place in its conversation, from 0, the hash of its role and text,
    and the words of its text."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = rows.withColumns({"mark": mark, "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    key = ["conv_id", "turn", "role"]
    ordered = rows.repartitionByRange(*key, F.substring("text", 1, HEAD)).sortWithinPartitions(*key, "text")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
            starts = np.where(new, np.arange(len(ids)), 0)
            pos = np.arange(len(ids)) - np.maximum.accumulate(starts)
            runs = np.cumsum(new)
            pos[runs == 0] += at
            own = (runs + (last is not None) <= 1) & first  # the range's first conversation may have begun before
            last, at, first = ids[-1], int(pos[-1]) + 1, bool(own[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(pos.astype(np.int64)), pa.array(own), batch.column("mark"), batch.column("words")], names=["conv_id", "part", "at", "first", "mark", "words"])

    found = stored(ordered.select("conv_id", "mark", "words").mapInArrow(place, "conv_id long, part long, at long, first boolean, mark binary, words long"), "turns")
    # conversations that begin a range, one a range: how many turns they have in the ranges before
    heads = found.where("first AND at = 0").select("conv_id").distinct()
    counts = found.join(F.broadcast(heads), "conv_id").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("conv_id", "part", F.sum("n").over(ahead).alias("offset")).where("offset > 0"), "offsets")
    pos = F.col("at") + F.coalesce("offset", F.lit(0))
    return found.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "mark", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of others: (conv_id, depth, len, mark, words) for each turn, and (conv_id, len)
    for each conversation. A conversation c has the first h turns of c - c % 20 and its own behind its first h."""
    rows = stored(numbered(turns), "numbered")
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST, F.col("conv_id") - F.col("conv_id") % EVERY
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": base})
    first = rows.where((F.col("conv_id") % EVERY == 0) & (F.col("pos") < MOST - 1)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "mark", "words"))).alias("lent"))  # three turns at most
    lent = F.slice(F.coalesce("lent", F.expr("cast(array() as array<struct<pos:bigint,mark:binary,words:bigint>>)")), F.lit(1), F.col("h").cast("int"))
    convs = sizes.join(first, "base", "left").withColumn("lent", lent)
    convs = convs.withColumn("len", F.size("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "n", "h", "len", "lent"), "rebuilt")
    taken = convs.select("conv_id", "len", F.posexplode("lent").alias("k", "t")).select("conv_id", (F.col("k") + 1).alias("depth"), "len", "t.mark", "t.words")
    own = spread_join(rows, convs.select("conv_id", "h", "len", F.size("lent").alias("k")), "conv_id", convs.select("conv_id", "n"))
    own = own.where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).cast("int").alias("depth"), "len", "mark", "words")
    return taken.unionByName(own), convs.select("conv_id", "len")


def running(rows: DataFrame, names: list[str], down: bool = False) -> DataFrame:
    """rows (conv_id, depth, len, names) with running sums, by depth or from the greatest depth down, in place of the
    names. Sums of PRIME's remainders may be taken modulo PRIME."""
    block = F.floor(F.col("depth") / WIDTH)
    rows = rows.withColumn("block", block)
    order = F.col("depth").desc() if down else F.col("depth")
    within = Window.partitionBy("conv_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.where(F.col("len") >= WIDTH).groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    ahead = Window.partitionBy("conv_id").orderBy(F.col("block").desc() if down else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = stored(sums.select("conv_id", "block", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_before") for n in names]), "carried")
    out = rows.withColumns({n: F.sum(n).over(within) for n in names}).join(small(carry), ["conv_id", "block"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in names}).drop("block", *[f"{n}_before" for n in names])


def terms(mark: pd.Series, depth: pd.Series) -> pd.DataFrame:
    """The polynomials' terms: a turn's hash times the base to the depth."""
    hashes = np.frombuffer(b"".join(mark), ">u4").astype(np.uint64).reshape(-1, len(BASES)) % PRIME
    found = {}
    for k, base in enumerate(BASES):
        power, square, left = np.ones(len(depth), np.uint64), np.uint64(base), depth.to_numpy().astype(np.uint64)
        while left.any():
            power = np.where(left & np.uint64(1), power * square % PRIME, power)
            square, left = square * square % np.uint64(PRIME), left >> np.uint64(1)
        found[f"x{k}"] = (hashes[:, k] * power % PRIME).astype(np.int64)
    return pd.DataFrame(found)


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, len, words, key, up) for each prefix: its digest and that of the prefix without its last turn."""
    names = [f"x{k}" for k in range(len(BASES))]
    term = F.pandas_udf(terms, ", ".join(f"{n} long" for n in names))("mark", "depth")
    rows = turns.withColumn("x", term).select("conv_id", "depth", "len", "words", "x.*")
    sums = running(rows.withColumns({f"t{k}": F.col(n) for k, n in enumerate(names)}), names)
    pair = lambda hi, lo: F.shiftleft(hi, 32).bitwiseOR(lo)
    here = [F.col(n) % PRIME for n in names]
    above = [F.pmod(F.col(n) - F.col(f"t{k}"), F.lit(PRIME)) for k, n in enumerate(names)]
    of = lambda depth, x: F.struct(depth.cast("int").alias("depth"), pair(x[0], x[1]).alias("a"), pair(x[2], x[3]).alias("b"))
    return sums.select("conv_id", "depth", "len", "words", of(F.col("depth"), here).alias("key"), of(F.col("depth") - 1, above).alias("up"))


def cells(depth: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """The sketch's cell of each key in each row."""
    h = mix64(mix64(a.astype(np.uint64)) ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + depth.astype(np.uint64)))
    return [(h >> np.uint64(32 * r) & np.uint64(width - 1)).astype(np.int64) for r in range(ROWS)]


def _struct(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in batch.column(name).flatten()]


def sketch(prefixes: DataFrame, width: int) -> dict[int, bytes]:
    """The count-min sketch of the keys, for estimates up to two: for each slice of SLICE cells, rows one after the
    other, the bits of the cells that were met more than once. A task sends a slice's cells once each."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.concatenate([c + r * width for r, c in enumerate(cells(*_struct(b, "key"), width))]) for b in batches if b.num_rows]
        if not found:
            return
        cell, n = np.unique(np.concatenate(found), return_counts=True)
        ends = np.flatnonzero(np.diff(cell // SLICE)) + 1
        cuts = list(zip([0, *ends], [*ends, len(cell)]))
        once = [(cell[i:j] % SLICE)[n[i:j] == 1].astype("<u4").tobytes() for i, j in cuts]
        more = [(cell[i:j] % SLICE)[n[i:j] > 1].astype("<u4").tobytes() for i, j in cuts]
        yield pa.RecordBatch.from_arrays([pa.array([int(cell[i] // SLICE) for i, _ in cuts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slice", "once", "more"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, twice = None, None, None
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "bits"])
        for batch in batches:
            for k, once, more in zip(*(batch.column(n).to_pylist() for n in ("slice", "once", "more"))):
                if k != at:
                    if at is not None:
                        yield bits()
                    at, seen, twice = k, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                one, two = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                twice[one] |= seen[one]
                seen[one] = True
                seen[two] = twice[two] = True
        if at is not None:
            yield bits()

    sent = prefixes.select("key").mapInArrow(met, "slice long, once binary, more binary")
    slices = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(added, "slice long, bits binary")
    return {r["slice"]: bytes(r["bits"]) for r in slices.collect()}  # ROWS * width bits


def screened(prefixes: DataFrame) -> DataFrame:
    """prefixes (a stored table) with `alone` and `up_alone`: whether the sketch's estimate of the key, and of the key
    above, is one."""
    spark = prefixes.sparkSession
    n = prefixes.count()
    width = min(GREATEST, max(LEAST, 1 << (ROOMY * n).bit_length()))
    shared = spark.sparkContext.broadcast(sketch(prefixes, width))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ROWS * width // 8, np.uint8)
        for k, x in shared.value.items():
            bits[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(x, np.uint8)
        one = lambda key: ~np.all([bits[(c + r * width) >> 3] >> (7 - (c & 7)) & 1 for r, c in enumerate(cells(*key, width))], axis=0)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one(_struct(batch, "key"))), pa.array(one(_struct(batch, "up")))], names=[*batch.schema.names, "alone", "up_alone"])

    out = prefixes.mapInArrow(screen, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields) + ", alone boolean, up_alone boolean")
    return out.withColumn("up_alone", F.col("up_alone") & (F.col("depth") > 1))


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of a key's ids, in numeric order, with commas between."""
    fields = ["key.depth", "key.a", "key.b"]
    rows = ends.select(*fields, "conv_id").repartitionByRange("depth", "a", "b", "conv_id").sortWithinPartitions("depth", "a", "b", "conv_id")
    names = ["depth", "a", "b"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, size, out = None, [], 0, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*names, "first", "run"])
        for batch in batches:
            for *key, conv in zip(*(batch.column(n).to_pylist() for n in (*names, "conv_id"))):
                if ids and (key != at or size > RUN):
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                at = key
                ids.append(conv)
                size += 20
            if len(out) > 1000:
                yield made()
                out = []
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
        if out:
            yield made()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hasher, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[*names, "ends_sha256"])
        for batch in batches:
            for *key, run in zip(*(batch.column(n).to_pylist() for n in (*names, "run"))):
                if key == at:
                    hasher.update(b"," + run.encode())
                    continue
                if hasher is not None:
                    out.append((*at, hasher.hexdigest()))
                at, hasher = key, hashlib.sha256(run.encode())
            if len(out) > 10_000:
                yield made()
                out = []
        if hasher is not None:
            out.append((*at, hasher.hexdigest()))
        if out:
            yield made()

    parts = rows.mapInArrow(runs, "depth int, a long, b long, first long, run string")
    parts = parts.repartition(*names).sortWithinPartitions(*names, "first")
    return parts.mapInArrow(hashes, "depth int, a long, b long, ends_sha256 string").select(F.struct(*names).alias("key"), "ends_sha256")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node over turns
    (conv_id, depth, len, mark, words) of convs (conv_id, len)."""
    empty = F.sha2(F.lit(""), 256)
    prefixes = stored(digested(turns), "prefixes")
    rows = stored(screened(prefixes), "screened")
    alone, shared = rows.where("alone"), rows.where("NOT alone")
    edge = alone.where("NOT up_alone")
    nodes = shared.groupBy("key").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.min("up").alias("up"), F.max("up_alone").alias("up_alone"))
    nodes = stored(nodes, "nodes")
    children = nodes.select("up").unionByName(edge.select("up")).groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children, "children")
    nodes = stored(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "grown")

    # what each conversation adds to its shared prefixes
    known = spread_join(shared, nodes.select("key", "least", "n", "n_children", F.col("words").alias("node_words")), "key", nodes.select("key", "n"))
    mine = F.col("least") == F.col("conv_id")
    saved, leaf = F.when(mine, (F.col("n") - 1) * F.col("node_words")).otherwise(F.lit(0)), mine & (F.col("depth") == F.col("len")) & (F.col("n_children") == 0)
    gives = known.select("conv_id", "depth", "len", "key", saved.alias("saved"), leaf.cast("long").alias("leaves"))
    tails = alone.where("depth = len").select("conv_id", "depth", "len", F.lit(None).cast(KEY).alias("key"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    gives = stored(gives.unionByName(tails), "gives")
    below = running(gives, ["saved", "leaves"], down=True).where("key IS NOT NULL").groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    whole = convs.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    above = nodes.select("key", F.col("least").alias("over"))
    by_up = children.select("key", F.col("n_children").alias("n"))
    number = lambda c: c.cast("long")

    def parents(rows: DataFrame) -> DataFrame:
        """rows with `over`, the conv_id of the node `up`."""
        low = rows.where("up.depth = 0").withColumn("over", F.lit(whole.root).cast("long"))
        high = rows.where("up.depth > 0 AND NOT up_alone").withColumnsRenamed({"key": "own", "up": "key"})
        return low.unionByName(spread_join(high, above, "key", by_up).withColumnsRenamed({"key": "up", "own": "key"}))

    lone = alone.where("up_alone").withColumn("over", F.col("conv_id")).drop("alone", "up_alone")
    lone = lone.unionByName(parents(edge).drop("alone", "up_alone"))
    ends = F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty)
    lone = lone.select("conv_id", number(F.col("depth")).alias("depth"), F.col("over").alias("parent_conv_id"), number(F.lit(1)).alias("n_convs"), number(F.col("depth") < F.col("len")).alias("n_children"), number(F.lit(1)).alias("n_leaves"), number(F.lit(0)).alias("saved_tokens"), ends.alias("ends_sha256"))
    # an estimate above one may be too high: a node that is not proved to have one member may lie below one that is
    under = nodes.where("up_alone").withColumn("over", F.col("least"))
    joint = parents(nodes).unionByName(under).join(below, "key", "left").join(hashed_ids(shared.where("depth = len").select("key", "conv_id")), "key", "left")
    joint = joint.select(F.col("least").alias("conv_id"), number(F.col("key.depth")).alias("depth"), F.col("over").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    if not whole.n:
        return joint
    # the root
    grown = children.where("key.depth = 0").agg(F.sum("n_children")).first()[0] or 0
    below = gives.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).first()
    key = F.struct(F.lit(0).alias("depth"), number(F.lit(0)).alias("a"), number(F.lit(0)).alias("b")).alias("key")
    none = hashed_ids(convs.where("len = 0").select(key, "conv_id")).first()
    root = (whole.root, 0, None, whole.n, grown, below.leaves or 1, below.saved or 0, none.ends_sha256 if none else hashlib.sha256().hexdigest())
    return joint.unionByName(lone).unionByName(turns.sparkSession.createDataFrame([root], joint.schema))


def sql() -> str:
    """The query in DuckDB's SQL: prefixes as texts of turn hashes; a node's ancestors are its smallest member's prefixes."""
    return f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, md5(length(role) || ':' || role || text) AS mark,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM t),
i AS (SELECT DISTINCT conv_id FROM t),
c AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % {MOST} AS h, conv_id - conv_id % {EVERY} AS base FROM i, crc_table),
r AS (SELECT c.conv_id, 0 AS own, o.pos, o.mark, o.words FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.mark, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
d AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS len FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, depth, path, left(path, length(path) - 32) AS up, words, depth = len AS ends FROM d
  UNION ALL SELECT conv_id, 0, '', NULL, 0, NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = c.conv_id) FROM c),
n AS (SELECT path, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path),
x AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
k AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN x USING (path)),
s AS (SELECT m.path, sum(k.saved) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves FROM k JOIN m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.path)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path) LEFT JOIN n p ON p.path = k.up"""
