"""Decisions before encoding, from samples of a payload: is it worth coding, and which search suits it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import distinct, grams, per_payload, strided_counts

# Sizes from which samples decide, distinct bytes and bits per byte that count as incompressible, the bits that coding
# costs in any case and the bits a byte that it must save.
GATE_BYTES, SEARCH_BYTES, SAMPLES, DENSE, SLACK, DESCRIPTION, SAVING = 8192, 16 << 10, 1024, 208, 0.12, 160.0, 0.02
# Bytes of a head, distinct bytes in its sample for rows with a tree and for rows; distinct bytes of a wide alphabet; samples
# and distinct bytes that tell small dense payloads apart; share of samples that repeat from afar.
HEAD, ROW_HEAD, ROW, WIDE, SMALL_DENSE, FAR_SHARE = 8192, 96, 48, 128, ((128, 20), (512, 42)), 12


def _corrected_bits(sample: np.ndarray) -> tuple[int, float]:
    """Distinct bytes of a sample, and its entropy a byte, corrected for its size: half a bit of information for each further symbol."""
    counts = np.bincount(sample, minlength=256)
    counts = counts[counts > 0]
    total = counts.sum()
    return len(counts), np.log2(total) - (counts * np.log2(counts)).sum() / total + (len(counts) - 1) / (2 * np.log(2) * total)


def judged(payloads: DataFrame) -> DataFrame:
    """payload_id, stored, skipped: whether about 1024 evenly spaced bytes look random enough to store a payload's literals; and whether match
    search can be left out, as no 8 bytes at every ((n >> 11) | 1)-th place repeat, the alphabet is wide and the bytes there have nearly eight
    bits of entropy each. Payloads under GATE_BYTES are never stored by sample, those under SEARCH_BYTES always searched."""
    def solve(data):
        n, stored, skipped = len(data), False, False
        if n >= GATE_BYTES:
            distinct, bits = _corrected_bits(data[:: n // SAMPLES])
            stored = bool(distinct > DENSE and bits + DESCRIPTION / n + SAVING + SLACK >= 8.0)
        if n >= SEARCH_BYTES:
            stride = (n >> 11) | 1
            g = grams(data, 8)[::stride]
            distinct, bits = _corrected_bits(data[::stride])
            skipped = bool(len(np.unique(g)) == len(g) and distinct >= ROW_HEAD and bits + SLACK >= 8.0)
        return [(stored, skipped)]

    return per_payload(payloads, "payload_id", solve, "stored boolean, skipped boolean")


def store_of(head_distinct: Column) -> Column:
    """Storage of match candidates by the distinct bytes of a payload's head: rows, rows with a tree for the head, or chains."""
    return F.when(head_distinct >= ROW_HEAD, "row").when(head_distinct >= ROW, "row_head").otherwise("chain")


def stores(payloads: DataFrame, head: int = HEAD) -> DataFrame:
    """payloads with head_distinct, among every ((n >> 11) | 1)-th byte of its first `head`, and store. The head is what the decision is about:
    it is made before the rest is seen."""
    n = distinct(strided_counts(11)(F.substring("content", 1, head)))
    return payloads.withColumn("head_distinct", n).withColumn("store", store_of(F.col("head_distinct")))


def light_attempts(head_distinct: Column) -> Column:
    """Whether a narrow head makes a row search with few attempts enough."""
    return head_distinct < ROW


def far_distinct(payloads: DataFrame, most: int = WIDE, probe: int = 4096) -> DataFrame:
    """payload_id, n_distinct: distinct bytes among every eighth one, `most` at most; 0 if the first `probe` bytes are all equal."""
    def solve(data):
        if not len(data) or (data[:probe] == data[0]).all():
            return [(0,)]
        return [(min(most, int(np.count_nonzero(np.bincount(data[::8], minlength=256)))),)]

    return per_payload(payloads, "payload_id", solve, "n_distinct int")


def small_dense(payloads: DataFrame) -> DataFrame:
    """payload_id, dense: whether even samples of a payload have as many distinct bytes as SMALL_DENSE asks: more than 20 of 128, and 42 of 512."""
    (few, narrow), (many, wide) = SMALL_DENSE

    def solve(data):
        a, b = (int(np.count_nonzero(np.bincount(data[:: max(1, len(data) // n)], minlength=256))) for n in (few, many))
        return [(a > narrow and b >= wide,)]

    return per_payload(payloads, "payload_id", solve, "dense boolean")


def head_repeats(payloads: DataFrame, head: int = HEAD, least: int = WIDE) -> DataFrame:
    """payload_id, parses: whether a head with a wide alphabet repeats eight bytes at two of every ((n >> 11) | 1)-th of its places."""
    def solve(data):
        own = data[:head]
        stride = (len(own) >> 11) | 1
        g = grams(own, 8)[::stride]
        return [(bool(np.count_nonzero(np.bincount(own[::stride], minlength=256)) >= least and len(np.unique(g)) < len(g)),)]

    return per_payload(payloads, "payload_id", solve, "parses boolean")


def far_repeats(payloads: DataFrame, reach: int, stride: int = 4096) -> DataFrame:
    """payload_id, samples, far, dominant: of the eight bytes at every stride-th place, how many were last sampled `reach` bytes back or more,
    and whether that is a twelfth of them. Payloads with no sample count as dominant."""
    def solve(data):
        g = grams(data, 8)[::stride]
        order = np.argsort(g, kind="stable")
        gap = order[1:] - order[:-1]
        far = int(((g[order][1:] == g[order][:-1]) & (gap >= max(1, reach // stride))).sum())
        return [(len(g), far, far * FAR_SHARE >= len(g))]

    return per_payload(payloads, "payload_id", solve, "samples long, far long, dominant boolean")


def reach(keep: Column, shrink: Column) -> Column:
    """Whether to search nearer: 'shrink' if that costs at least 2 % less."""
    return F.when(shrink * 50 <= keep * 49, "shrink").otherwise("keep")


def block_kind(uniform: Column, stored: Column, n: Column, compressed: Column) -> Column:
    """How a block is sent: rle if all bytes are equal, raw if it is judged or turns out not to shrink, else compressed."""
    return F.when(uniform & (n > 0), "rle").when(stored | (compressed >= n), "raw").otherwise("compressed")
