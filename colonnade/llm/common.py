"""What the training-data operators share: scratch tables, Arrow batches, word tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python.  Whole texts are passed, so the batch, not the
#: partition, bounds a worker's memory.
BATCH_ROWS = 1000

#: Largest table (in rows of 8 to 16 bytes) that an operator ships to every executor after
#: counting it; larger ones go through a shuffled join.
BROADCAST_ROWS = 2_000_000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are bounded tighter already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class Scratch:
    """Tables written to the shared checkpoint folder, so that a lost executor costs nothing.

    ``table`` writes a DataFrame once and returns it as read back: later uses neither
    recompute it nor depend on executor-local blocks.  ``drop`` removes tables that no
    remaining plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="colonnade-")  # one machine: nothing else to share with
            spark.sparkContext.setCheckpointDir(folder)
        self.root = f"{folder.rstrip('/')}/colonnade-{uuid.uuid4().hex}"
        self.count, self.live = 0, {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if self.live.pop(t.scratch_path, None) is not None:
                path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
                path.getFileSystem(conf).delete(path, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but these, which the returned plan still reads."""
        kept = {t.scratch_path for t in tables}
        self.drop(*[t for path, t in self.live.items() if path not in kept])


#: A key counts as hot from LEAST_HOT rows on, and from the share of rows that HOT_KEYS
#: keys at most can have.
LEAST_HOT, HOT_KEYS = 2000, 100_000


def met_by(left: DataFrame, right: DataFrame, on: list[str], n: str) -> DataFrame:
    """``left`` joined with ``right``, which has a row per key with ``n``, the key's rows in ``left``.

    Hot keys, at most HOT_KEYS, are met where their rows are, by a broadcast; only the
    rows of all others are exchanged.  Both sides are read more than once.
    """
    least = max(LEAST_HOT, left.count() // HOT_KEYS)
    hot, rest = F.broadcast(right.where(F.col(n) >= least)), right.where(F.col(n) < least)
    cold = left.join(F.broadcast(right.where(F.col(n) >= least).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(cold.join(rest, on))


def row_of(df: DataFrame):
    """All columns of ``df`` as one struct column ``_row``, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("_row")


def unpacked(columns: list[str], **made) -> list:
    """The fields ``columns`` of ``_row`` as columns again, those in ``made`` replaced."""
    return [made[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in columns]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def word_lists(texts: list[str]) -> list[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as UTF-8, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly A-Z and exactly the six
    characters of that class.
    """
    return [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]


class WordTable(dict):
    """word -> value, computed once per word and worker; emptied when it reaches ``most``."""

    def __init__(self, make, most: int = 1_000_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def hash64(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b); component is the least id.

    Alternating large-star and small-star rounds over the whole edge set: each round is a
    partially aggregated minimum and a join, each halves the distance to the least node
    or better, and the edge table never grows.  Rounds end when an edge set repeats.
    Only three numbers per round reach the driver.
    """
    cur = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: of a node's lower neighbours, all and the node itself hang on the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = scratch.table(small.where("a <> b").distinct())
        scratch.drop(cur)
        cur = new
        got = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if got == sign:
            break
        sign = got
    members = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    roots = cur.select(F.col("b").alias("id")).distinct()
    return members.union(roots.join(members, "id", "left_anti").select("id", F.col("id").alias("component")))
