"""Streams of payload chunks: encoding and decoding in micro-batches, running offsets and adaptive levels as keyed state.

A chunk row is (stream_id, chunk_no, content, is_last). Every chunk becomes a frame of its own, so a stream's frames can be
decoded one after the other by any decoder, and what must be kept between batches is a few numbers, not a codec's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.codec import compressor, decompressor
from siltstone.plans.levels import verdict

CHUNK = 8 << 20


def chunked(payloads: DataFrame, size: int = CHUNK) -> DataFrame:
    """Payloads as chunk rows: stream_id, chunk_no, content, is_last. An empty payload is one empty last chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / size)).cast("int")
    rows = payloads.withColumn("n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.substring(F.coalesce("content", F.lit(b"")), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size))
    return rows.select(F.col("payload_id").cast("string").alias("stream_id"), F.col("chunk_no").cast("long").alias("chunk_no"), part.alias("content"), (F.col("chunk_no") == F.col("n") - 1).alias("is_last"))


def encode_stream(chunks: DataFrame, level: int = 3, checksum: bool = True) -> DataFrame:
    """chunks with content compressed, one frame each. Works on batch and on streaming DataFrames; no state."""
    return chunks.withColumn("content", compressor(level, checksum)("content"))


def decode_stream(chunks: DataFrame) -> DataFrame:
    """chunks with content restored, and the error of those that can't be."""
    out = chunks.withColumn("d", decompressor()("content"))
    return out.withColumn("content", F.col("d.content")).withColumn("error", F.col("d.error")).drop("d")


def running_totals(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of stream_id, chunks, bytes, finished: totals of each stream so far, once per micro-batch that has chunks of
    it. A finished stream's state is dropped; with a timeout, so is that of a stream without chunks for that long."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, size = state.get
            state.remove()
            yield pd.DataFrame({"stream_id": [key[0]], "chunks": [n], "bytes": [size], "finished": [False]})
            return
        n, size = state.get if state.exists else (0, 0)
        done = False
        for f in frames:
            n, size = n + len(f), size + int(f["n"].sum())
            done |= bool(f["is_last"].any())
        if done:
            state.remove() if state.exists else None
        else:
            state.update((n, size))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"stream_id": [key[0]], "chunks": [n], "bytes": [size], "finished": [done]})

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    sized = chunks.select("stream_id", F.octet_length("content").cast("long").alias("n"), "is_last")
    return sized.groupBy("stream_id").applyInPandasWithState(update, "stream_id string, chunks long, bytes long, finished boolean", "chunks long, bytes long", "update", kind)


def adaptive_stream(timings: DataFrame, start: int = 3, least: int = 1, most: int = 19) -> DataFrame:
    """A streaming DataFrame of stream_id, chunk_no, level from timings (stream_id, chunk_no, read_ns, encode_ns, output_ns): the level
    that follows each chunk, kept as one number per stream. Chunks of one micro-batch are taken in order of chunk_no."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values("chunk_no")
        levels = []
        for step in rows["step"]:
            level = max(least, min(most, level + int(step)))
            levels.append(level)
        state.update((level,))
        yield pd.DataFrame({"stream_id": key[0], "chunk_no": rows["chunk_no"].to_numpy(), "level": levels})

    said = verdict(*(F.col(c) for c in ("read_ns", "encode_ns", "output_ns")))
    steps = timings.select("stream_id", "chunk_no", F.when(said == "slower", 1).when(said == "faster", -1).otherwise(0).alias("step"))
    return steps.groupBy("stream_id").applyInPandasWithState(update, "stream_id string, chunk_no long, level int", "level int", "append", GroupStateTimeout.NoTimeout)
