"""Cutting payloads into blocks: fixed sizes, changes of content, content-defined splits, and job grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import per_payload

BLOCK = 128 << 10
# Least and most bytes of a compression job, and bytes that all jobs of an epoch may hold while they wait.
JOB_LEAST, JOB_MOST, JOB_BUFFER = 1 << 20, 1 << 30, 256 << 20


def fixed_blocks(payloads: DataFrame, block: int = BLOCK) -> DataFrame:
    """payload_id, block_no, byte_offset, size: a payload cut every `block` bytes; an empty one has no block."""
    last = F.floor((F.col("n_bytes") - 1) / block).cast("int")
    rows = payloads.where("n_bytes > 0").select("payload_id", "n_bytes", F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    at = F.col("block_no").cast("long") * block
    return rows.select("payload_id", "block_no", at.alias("byte_offset"), F.least(F.lit(block), F.col("n_bytes") - at).cast("long").alias("size"))


def chunk_distances(payloads: DataFrame, chunk: int = 1024) -> DataFrame:
    """payload_id, chunk_no, distance of each full chunk's byte counts to the chunk's before it, scaled by both sizes."""
    def solve(data):
        n = len(data) // chunk
        if n < 2:
            return [], []
        counts = np.bincount((np.arange(n * chunk) // chunk << 8) + data[: n * chunk], minlength=n << 8).reshape(n, 256)
        return np.arange(1, n, dtype=np.int32), np.abs(np.diff(counts, axis=0)).sum(1) * chunk

    return per_payload(payloads, "payload_id", solve, "chunk_no int, distance long")


def content_changes(payloads: DataFrame, chunk: int = 1024, least: float = 0.6) -> DataFrame:
    """payload_id, byte_offset: where a payload's content changes: between neighbouring full chunks whose byte counts differ in a share of
    `least` or more of what they could differ in. Payloads of fewer than two chunks have none."""
    found = chunk_distances(payloads, chunk).where(F.col("distance") >= F.lit(least) * 2 * chunk * chunk)
    return found.select("payload_id", (F.col("chunk_no").cast("long") * chunk).alias("byte_offset"))


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 pseudo-random 64-bit values by rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h = (h << 1) + table[byte] at each byte. A byte's share is shifted out after 64 steps, so six doublings give it all."""
    h = gear_table()[data]
    for k in range(6):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint64(step)) if len(h) > step else h[step:]
    return h


def content_splits(payloads: DataFrame, bits: int = 6) -> DataFrame:
    """payload_id, split (byte offset after it), hash: content-defined splits, about one in 2**bits bytes, from the 64 bytes before."""
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def solve(data):
        h = gear_hashes(data)
        at = np.flatnonzero((h[63:] & mask) == 0) + 63
        return at + 1, h[at].view(np.int64)

    return per_payload(payloads, "payload_id", solve, "split long, hash long")


def job_size(n: Column, workers: int, overlap: int) -> Column:
    """Bytes of a compression job: half a worker's share, rounded up, at least 1 MiB and the overlap, at most 1 GiB."""
    share = F.floor((n + (2 * workers - 1)) / (2 * workers)).cast("long")
    return F.least(F.lit(JOB_MOST), F.greatest(share, F.lit(max(JOB_LEAST, overlap)))).cast("long")


def level_job_size(strategy: Column, n: Column, workers: int, overlap: int) -> Column:
    """As job_size(); the binary-tree lazy strategy has four overlaps for a job, however many workers there are."""
    pinned = min(JOB_MOST, max(JOB_LEAST, 4 * overlap))
    return F.when(strategy == "btlazy", F.lit(pinned).cast("long")).otherwise(job_size(n, workers, overlap))


def jobs(payloads: DataFrame, workers: int = 8, overlap: int = 1 << 18) -> DataFrame:
    """payload_id, job_size, n_jobs."""
    size = job_size(F.col("n_bytes"), workers, overlap)
    return payloads.select("payload_id", size.alias("job_size"), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / size)).cast("long").alias("n_jobs"))


def growing_jobs(spark: SparkSession, overlap: int = 1 << 18, jobs_of_epoch: int = 8, epochs: int = 12) -> DataFrame:
    """epoch, byte_offset, job_size: the grid of a stream of unknown length. Each epoch has as many equal jobs; their size doubles from epoch
    to epoch, up to what the buffer of an epoch can hold."""
    cap = max(JOB_LEAST, max(0, JOB_BUFFER - overlap) // jobs_of_epoch)
    first = min(cap, max(JOB_LEAST, overlap))
    size = F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(2.0), F.least(F.col("epoch"), F.lit(30)))).cast("long")
    rows = spark.range(epochs).select(F.col("id").cast("int").alias("epoch")).withColumn("job_size", size)
    # as many rows as there are epochs, so one window is small
    before = F.coalesce(F.sum(F.col("job_size") * jobs_of_epoch).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("epoch", before.cast("long").alias("byte_offset"), "job_size")
