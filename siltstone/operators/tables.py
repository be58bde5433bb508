"""Entropy coding tables from histograms: normalised counts, Huffman code lengths, and the choice between tables.

Input are histogram rows (group columns, symbol, n); a group has at most 256 symbols, so each group is one small task and
millions of groups run in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_log(n: Column, max_symbol: Column, most: int = 9) -> Column:
    """Accuracy of a table: two bits under the number of symbols, enough for the alphabet, from 5 to `most`."""
    bits = F.length(F.bin(F.greatest(n - 1, F.lit(1)))) - 1
    least = F.least(F.length(F.bin(F.greatest(n, F.lit(1)))), F.length(F.bin(F.greatest(max_symbol, F.lit(1)))) + 1)
    return F.least(F.lit(most), F.greatest(F.lit(5), least, F.least(bits - 2, F.lit(most))))


def literal_log(n: Column, max_symbol: Column) -> Column:
    """Longest code of a literals table: one bit under the number of literals, but enough for the alphabet, from 5 to 11."""
    bits = F.greatest(F.length(F.bin(F.greatest(n - 1, F.lit(1)))) - 2, F.lit(0))
    least = F.least(F.length(F.bin(n)), F.length(F.bin(F.greatest(max_symbol, F.lit(1)))) + 1)
    return F.least(F.lit(11), F.greatest(F.lit(5), least, F.least(F.lit(11), bits)))


def flat_counts(histogram: DataFrame, *by: str) -> DataFrame:
    """histogram (symbol, n) with norm: one state for each symbol that occurs and the rest of a power of two, 32 or more, to the most frequent
    one (the smallest of equals). A table that always can be made."""
    whole = Window.partitionBy(*by)
    live = F.count(F.when(F.col("n") > 0, 1)).over(whole)
    top = F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("symbol").alias("symbol")))).over(whole)["symbol"]
    states = F.greatest(F.lit(32), F.pow(F.lit(2.0), F.length(F.bin(F.greatest(live - 1, F.lit(1)))))).cast("long")
    return histogram.withColumn("norm", F.when(F.col("n") > 0, 1).otherwise(0) + F.when(F.col("symbol") == top, states - live).otherwise(0))


def keeps_table(description: Column, n_literals: Column, old_bytes: Column, new_bytes: Column) -> Column:
    """Whether literals are coded with the table of the block before: where a new one's description hardly pays, or old costs no more than both."""
    return (description + 12 >= n_literals) | (old_bytes <= description + new_bytes)


def normalize(counts: np.ndarray, log: int) -> np.ndarray:
    """Counts scaled to a sum of 2**log: at least 1 for each symbol that occurs, the rest to the largest; where that would
    take too much from it, by largest remainders."""
    n, goal = int(counts.sum()), 1 << log
    if not n:
        return np.zeros_like(counts)
    if (counts > 0).sum() > goal:
        raise ValueError("more symbols than states")
    exact = counts * goal
    out = np.where(counts > 0, np.maximum(1, exact // n), 0)
    top, rest = int(counts.argmax()), goal - int(out.sum())
    if rest >= 0 or out[top] + rest >= max(1, out[top] // 2):
        out[top] += rest
    else:
        while rest < 0:
            over = np.where(out > 1, out * n - exact, np.iinfo(np.int64).min)
            out[int(over.argmax())] -= 1
            rest += 1
    return out


def code_lengths(counts: np.ndarray, most: int = 11) -> np.ndarray:
    """Huffman code lengths of at most `most` bits (0: absent symbol), the Kraft sum repaid from the least frequent."""
    live = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(live) < 2:
        out[live] = 1
        return out
    heap = [(int(counts[s]), int(s), (int(s),)) for s in live]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    out = np.minimum(out, most)
    order = sorted(live.tolist(), key=lambda s: (counts[s], s))
    spent = sum(1 << (most - int(out[s])) for s in live)
    while spent > 1 << most:  # lengthen the rarest code that can be
        s = max((s for s in order if out[s] < most), key=lambda s: (out[s], -counts[s]))
        spent -= 1 << (most - int(out[s]) - 1)
        out[s] += 1
    for s in reversed(order):  # shorten the most frequent codes that fit
        while out[s] > 1 and spent + (1 << (most - int(out[s]))) <= 1 << most:
            spent += 1 << (most - int(out[s]))
            out[s] -= 1
    return out


def _by_group(hist: DataFrame, by: tuple[str, ...], solve, name: str) -> DataFrame:
    kinds = dict(hist.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("symbol")
        counts = np.zeros(int(frame["symbol"].max()) + 1, np.int64)
        counts[frame["symbol"].to_numpy()] = frame["n"].to_numpy()
        return frame.assign(**{name: solve(counts)[frame["symbol"].to_numpy()].astype(np.int32)})[[*by, "symbol", "n", name]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "symbol", "n")) + f", {name} int"
    return hist.select(*by, "symbol", "n").groupBy(*by).applyInPandas(run, schema)


def normalized_counts(hist: DataFrame, *by: str, log: int = 11) -> DataFrame:
    """hist with norm: each group's counts scaled to 2**log."""
    return _by_group(hist, by, lambda c: normalize(c, log), "norm")


def huffman_lengths(hist: DataFrame, *by: str, most: int = 11) -> DataFrame:
    """hist with bits: each group's Huffman code lengths."""
    return _by_group(hist, by, lambda c: code_lengths(c, most), "bits")


def coded_size(lengths: DataFrame, *by: str) -> DataFrame:
    """by, n, coded_bits: what the groups' symbols take with their code lengths."""
    return lengths.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("bits")).cast("long").alias("coded_bits"))


def uncovered(hist: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """Symbols of hist that an earlier table (by, symbol) can't code: where there are none, it can be used again."""
    return hist.join(table.select(*by, "symbol"), [*by, "symbol"], "left_anti")


def table_mode(n_symbols: Column, repeat_bits: Column, predefined_bits: Column, fresh_bits: Column) -> Column:
    """How to send a table: rle for one symbol, else the cheapest of repeat, predefined and fse (null: not possible), in this order
    on ties."""
    far = F.lit(1 << 60)
    r, p, f = F.coalesce(repeat_bits, far), F.coalesce(predefined_bits, far), F.coalesce(fresh_bits, far)
    return F.when(n_symbols == 1, "rle").when((r <= p) & (r <= f), "repeat").when(p <= f, "predefined").otherwise("fse")
