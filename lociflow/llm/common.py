"""What the operators of this subpackage share: shared scratch tables, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a narrow table (a few machine words each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode
    (tests), and an error on a cluster, whose executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lociflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def temporary(spark: SparkSession, path: str) -> None:
    """Has a folder of the shared one deleted when the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: later jobs survive the loss of any executor, and nothing is computed twice. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lociflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a stored, narrow table of at most that many rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than this share of the rows is dealt over SALTS partitions; there are fewer than 1 / HOT such keys.
HOT, SALTS = 1 / 500, 32


def row_hash(df: DataFrame) -> Column:
    """A hash of a row, over the columns that can be hashed."""
    return F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def dealt(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and table with __lf_salt, to be joined by key and that. counts (key, n) says how many rows a key has; the
    keys above the HOT share, a bounded list, are found from it and broadcast: rows that have them are dealt over
    SALTS partitions, and their table rows copied to each."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") > max(1000.0, HOT * total)).select(key, F.lit(SALTS).alias("__lf_deal")))
    salt = F.when(F.col("__lf_deal").isNull(), 0).otherwise(F.pmod(row_hash(rows), F.lit(SALTS)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__lf_deal", F.lit(1)) - 1))
    one, other = (x.join(hot, key, "left").withColumn("__lf_salt", c).drop("__lf_deal") for x, c in ((rows, salt), (table, copies)))
    return one, other


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a stored table by key, where a few keys may hold much of the rows: by broadcast if the table's
    checked size allows it, else as dealt() deals them."""
    if (near := small(table)) is not table:
        return rows.join(near, key, how)
    one, other = dealt(rows, table, key, counts)
    return one.join(other, [key, "__lf_salt"], how).drop("__lf_salt")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of an edge table (a, b): root is the least node of the connected component.

    Each round gives a node the least label among its own and its neighbours' and then jumps to the label's own
    label, so that chains halve; it ends when no label changes, which it must, as labels only fall and there are
    finitely many. Labels are stored tables, no node list leaves the executors, and minima are combined before the
    shuffle, so that a node with many edges costs one row a task. Edges with a null end and loops are ignored; an empty
    table gives an empty result.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = stored(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("root"), F.col("root").alias("was")), "labels")
        moved = new.where("root != was").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels


#: For the SQL twins: a table `crc_table` of one row, and the unsigned CRC-32 of an ASCII text where it is joined.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS crcs)"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
