"""Plan-time decisions: compression levels, lanes, and the adaptive level rule."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Level, strategy, window log, long-distance matching.
LEVELS = (
    (0, "stored", 17, False), (1, "fast", 19, True), (2, "fast", 20, True), (3, "dfast", 21, True), (4, "dfast", 21, True), (5, "row", 21, False), (6, "row", 21, False), (7, "row", 21, False), (8, "row", 21, False), (9, "chain", 26, True),
    (10, "row", 22, False), (11, "row", 22, False), (12, "row", 22, False), (13, "btlazy", 26, True), (14, "btlazy", 26, True), (15, "btlazy", 26, True),
    (16, "opt", 26, True), (17, "opt", 26, True), (18, "opt", 26, True), (19, "opt", 26, True), (20, "opt", 24, False), (21, "opt", 25, False), (22, "opt", 26, False),
)


def level_table(spark: SparkSession) -> DataFrame:
    """level, strategy, window_log, long_distance."""
    return spark.createDataFrame(LEVELS, "level int, strategy string, window_log int, long_distance boolean")


def adjusted_window_log(window_log: Column, n_bytes: Column) -> Column:
    """The window of a level shrunk to a known size: no larger than the next power of two, at least 1 KiB."""
    need = F.when(n_bytes > 1, F.length(F.bin(n_bytes - 1))).otherwise(0)
    return F.greatest(F.lit(10), F.least(window_log, need))


# Sizes under which levels change their strategy, for level 4 and for others; distinct bytes of a head from which they do; the
# smallest window with long-distance matching.
SMALL_FOUR, SMALL, SMALL_DISTINCT, DISTANT = 16 << 10, 128 << 10, 48, 1 << 25


def small_strategy(level: Column, strategy: Column, n_bytes: Column, head_distinct: Column) -> Column:
    """The strategy of a level for a payload of known size: small ones with a wide head go to a binary tree at levels 4 to 10, and all small ones to
    the optimal parser at levels 11 to 17."""
    wide = head_distinct >= SMALL_DISTINCT
    tree = wide & (((level == 4) & (n_bytes <= SMALL_FOUR)) | (level.between(5, 10) & (n_bytes <= SMALL)))
    return F.when(tree, "btlazy").when(level.between(11, 17) & (n_bytes <= SMALL), "opt").otherwise(strategy)


def matches_far(long_distance: Column, window: Column, allowed: Column) -> Column:
    """Whether long-distance matches are searched for: the level has them, they are allowed, and the window is large enough."""
    return long_distance & allowed & (window >= DISTANT)


def patch_window_log(n_bytes: Column) -> Column:
    """Window for compressing against a reference of n bytes: it must reach over all of it, from 10 to 27."""
    return F.greatest(F.lit(10), F.least(F.lit(27), F.length(F.bin(F.greatest(n_bytes, F.lit(1))))))


def patch_decode_bound(limit: Column, n_bytes: Column) -> Column:
    """Largest window that decoding against a reference of n bytes must allow."""
    return F.greatest(limit, n_bytes)


def consecutive_lanes(payloads: DataFrame, lanes: int) -> DataFrame:
    """payload_id, lane: the i-th of n payloads, by id, is in lane i * lanes div n. Ids are numbered by range, so no task gets all."""
    n = payloads.count()
    numbered = numbered_rows(payloads.select("payload_id"), "payload_id")
    return numbered.select("payload_id", F.expr(f"cast(row_no * {lanes} div {max(1, n)} as int)").alias("lane"))


#: Rows of a range that is numbered in one task.
ROWS_OF_RANGE = 2_000_000


def _place(key: Column, cuts: list) -> Column:
    """How many of the sorted cuts are less than key, by a tree of comparisons as deep as their logarithm."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key > cuts[middle], between(middle + 1, hi)).otherwise(between(lo, middle))

    return between(0, len(cuts))


def numbered_rows(rows: DataFrame, key: str) -> DataFrame:
    """rows with row_no from 0 in order of key: numbers within ranges of it, plus the counts of the ranges before."""
    ranges = max(64, -(-rows.count() // ROWS_OF_RANGE))
    cuts = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.3 / ranges)))
    # the number of cuts below a key, by halving: a range's number is its place among the sorted cuts
    placed = rows.withColumn("part", _place(F.col(key), cuts))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    return own.join(before.select("part", "before"), "part").withColumn("row_no", F.col("own") + F.col("before")).drop("part", "own", "before")


def heaviest_first_lanes(weights: list[int], lanes: int) -> list[int]:
    """Lane of each weight: heaviest first (ties: earlier), each to the lightest lane (ties: lower). For the frames of one plan."""
    load, out = [0] * lanes, [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        lane = min(range(lanes), key=lambda k: (load[k], k))
        out[i] = lane
        load[lane] += weights[i]
    return out


def verdict(read: Column, encode: Column, output: Column) -> Column:
    """What the timings of a chunk say: 'slower' (raise the level) if waiting for input or output outweighs encoding by an eighth,
    'faster' if encoding outweighs both by a 32nd, else 'keep'."""
    wait = F.greatest(read, output)
    return F.when(wait * 8 >= encode * 9, "slower").when(encode * 32 >= wait * 33, "faster").otherwise("keep")


def adaptive_levels(timings: DataFrame, start: int = 3, least: int = 1, most: int = 19) -> DataFrame:
    """stream_id, levels: the level after each chunk (chunk_no, read_ns, encode_ns, output_ns): one step up or down by verdict, within
    bounds. A fold over each stream's chunks."""
    step = F.when(F.col("verdict") == "slower", 1).when(F.col("verdict") == "faster", -1).otherwise(0)
    rows = timings.withColumn("verdict", verdict(*(F.col(c) for c in ("read_ns", "encode_ns", "output_ns"))))
    steps = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", step.alias("step")))).alias("s")).select("stream_id", F.col("s.step").alias("steps"))

    @F.pandas_udf("array<int>")
    def walked(steps: pd.Series) -> pd.Series:
        def one(own):
            level, out = start, []
            for s in own.tolist():
                level = max(least, min(most, level + s))
                out.append(level)
            return out

        return steps.map(one)

    return steps.select("stream_id", walked("steps").alias("levels"))
