"""Byte statistics of payloads: histograms, order-0 entropy, and the decisions that follow from them.

Counting runs as one Arrow function per payload (an array of 256 counts); everything after it is built-in expressions on
that array, so no byte is ever a row and nothing is shuffled except what is grouped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import byte_counts, distinct, entropy_bits, per_payload, per_run, strided_counts, total

#: Bits a fresh literals table is taken to cost, and the share of a payload that saving must exceed.
DESCRIPTION_BITS, SAVING = 160.0, 0.02
PROBE, WIDE = 4096, 128


def histograms(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("counts", byte_counts("content"))


def byte_histogram(payloads: DataFrame) -> DataFrame:
    """byte, n over all payloads: 256 rows at most are shuffled for each run of payloads."""
    def solve(data, off):
        counts = np.bincount(data, minlength=256)
        at = np.flatnonzero(counts)
        return at.astype(np.int32), counts[at].astype(np.int64)

    return per_run(payloads, solve, "byte int, n long").groupBy("byte").agg(F.sum("n").cast("long").alias("n"))


def payload_entropy(payloads: DataFrame) -> DataFrame:
    """Distinct bytes, entropy in bits, and whether the payload is worth entropy coding. An empty payload is stored."""
    rows = histograms(payloads).withColumn("n_distinct", distinct(F.col("counts"))).withColumn("bits", entropy_bits(F.col("counts")))
    return rows.withColumn("stored", stored(F.col("bits"), F.col("n_bytes")))


def stored(bits: Column, n: Column, description: float = DESCRIPTION_BITS) -> Column:
    """The literal gate: coding n bytes at this entropy would save too little."""
    return bits + description + n * SAVING >= n * 8.0


def sampled_distinct(payloads: DataFrame, target: int = 11) -> DataFrame:
    """Distinct bytes among every ((n >> target) | 1)-th byte."""
    return payloads.withColumn("n_distinct", distinct(strided_counts(target)("content")))


def wide_alphabet(payloads: DataFrame, probe: int = PROBE, least: int = WIDE) -> DataFrame:
    """wide: whether the first, middle or last `probe` bytes have `least` distinct values. Shorter payloads are probed whole."""
    @F.pandas_udf("int")
    def most(content: pd.Series) -> pd.Series:
        def one(b):
            data = np.frombuffer(b or b"", np.uint8)
            starts = (0, max(0, len(data) // 2 - probe // 2), max(0, len(data) - probe))
            return max(np.count_nonzero(np.bincount(data[s : s + probe], minlength=256)) for s in starts)

        return content.map(one)

    return payloads.withColumn("wide", most("content") >= least)


def uniform(payloads: DataFrame) -> DataFrame:
    """uniform: whether all bytes are equal; an empty payload is."""
    return histograms(payloads).withColumn("uniform", distinct(F.col("counts")) <= 1)


def block_entropy(payloads: DataFrame, block: int = 1 << 17) -> DataFrame:
    """payload_id, block_no, n_bytes, n_distinct, bits of each block of a payload."""
    def solve(data):
        out = []
        for k, at in enumerate(range(0, len(data), block)):
            own = data[at : at + block]
            counts = np.bincount(own, minlength=256)
            counts = counts[counts > 0]
            out.append((k, len(own), len(counts), float(len(own) * np.log2(len(own)) - (counts * np.log2(counts)).sum())))
        return out

    return per_payload(payloads, "payload_id", solve, "block_no int, n_bytes long, n_distinct int, bits double")


def fixed_point_bits(counts: Column) -> Column:
    """Entropy cost of a histogram in whole bits, from a table of 256 inverse-probability logarithms scaled by 256: exact
    integers, so equal wherever it is computed."""
    n = total(counts)
    table = F.array(*[F.lit(inverse_log(k)) for k in range(257)])
    parts = F.aggregate(
        F.filter(counts, lambda c: c > 0), F.lit(0).cast("long"),
        lambda a, c: a + c.cast("long") * F.element_at(table, F.greatest(F.lit(1), F.floor(c.cast("long") * 256 / n).cast("int")) + 1),
    )
    return F.floor(parts / 256).cast("long")


def inverse_log(k: int) -> int:
    """256 * -log2(k / 256), rounded down; probability 0 counts as 1 / 256."""
    from math import log2

    return int(256 * (8 - log2(max(1, k))))


def geometric_mean_delta(pairs: DataFrame, ours: str, theirs: str, *by: str) -> DataFrame:
    """exp(mean(ln(ours / theirs))) - 1 for each group."""
    return pairs.where((F.col(ours) > 0) & (F.col(theirs) > 0)).groupBy(*by).agg((F.exp(F.avg(F.log(F.col(ours) / F.col(theirs)))) - 1).alias("delta"), F.count("*").alias("n"))
