"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of an Arrow batch that a function works on at once.
SMALL = 2 << 20
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master (tests) gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/siltstone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete a table that shared_table() wrote and that nothing will read again."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column end to end as bytes, and len + 1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def small(batches: Iterator[pa.RecordBatch], most: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about `most` bytes: slices of the given ones, nothing is copied. What a function makes of one,
    and Spark reads from it, stays as small, however long the texts of Spark's batches of 10,000 rows are."""
    for b in batches:
        step = max(1, int(b.num_rows * most // max(most, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def runs(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes each (a longer text is a range of its own)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, edges (a, b) of longs: one row (node, component) for each node that has
    an edge; component is the smallest node reachable.

    Alternating large and small stars: each round points every node at the smallest node seen around it. All
    rounds are grouped minima and joins; each is written to the shared folder. Equal nodes and repeated edges are fine.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        u, v = (F.greatest("a", "b"), F.least("a", "b"))
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(u.alias("a"), v.alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = shared_table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    was = told(now)
    while was[0]:
        new = shared_table(star(star(now, True), False))
        drop_shared(now)
        now, state = new, told(new)
        if state == was:
            break
        was = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
