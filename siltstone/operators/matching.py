"""Match statistics: for each position of a payload, earlier positions with the same bytes.

"The latest earlier position with the same k bytes" is an as-of self-join. Both sides are the same payload, so it is
solved where the payload is: one sort of its k-byte values, no shuffle, one task per group of payloads. Repeats between
payloads (twins, long-distance matches) do shuffle, but only the hashes of windows.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import grams, per_payload
from siltstone.functions.codes import offset_code
from siltstone.operators.chunking import gear_hashes


#: Candidates that a split is compared with, the newest: the rows of the search table's buckets.
CANDIDATES = 16


def previous(data: np.ndarray, k: int) -> np.ndarray:
    """For each position the latest earlier one with the same k bytes, or -1."""
    g = grams(data, k)
    order = np.argsort(g, kind="stable")
    out = np.full(len(g), -1, np.int64)
    same = g[order][1:] == g[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def match_length(data: bytes, pos: int, cand: int) -> int:
    """How many bytes at pos equal those at the earlier cand."""
    n, step = 0, 16
    while step:
        if pos + n + step <= len(data) and data[pos + n : pos + n + step] == data[cand + n : cand + n + step]:
            n += step
            step *= 2
        else:
            step //= 2
    return n


def candidates(payloads: DataFrame, k: int = 5) -> DataFrame:
    """payload_id, pos, prev: each position with an earlier one with the same k bytes, the latest."""
    def solve(data):
        prev = previous(data, k)
        at = np.flatnonzero(prev >= 0)
        return at, prev[at]

    return per_payload(payloads, "payload_id", solve, "pos long, prev long")


def candidate_summary(payloads: DataFrame, k: int = 5, near: int = 4096) -> DataFrame:
    """payload_id, positions, matched, near, distance: how many positions have a candidate, one at most `near` back, and the sum of
    distances."""
    def solve(data):
        prev = previous(data, k)
        back = (np.arange(len(prev)) - prev)[prev >= 0]
        return [(len(prev), len(back), int((back <= near).sum()), int(back.sum()))]

    return per_payload(payloads, "payload_id", solve, "positions long, matched long, near long, distance long")


def newest_candidates(payloads: DataFrame, k: int = 5, depth: int = 4) -> DataFrame:
    """payload_id, n_candidates, n: how many positions have 1 to `depth` candidates among the newest `depth`."""
    def solve(data):
        g = grams(data, k)
        order = np.argsort(g, kind="stable")
        first = np.searchsorted(g[order], g[order], "left")
        counts = np.bincount(np.minimum(np.arange(len(g)) - first, depth), minlength=depth + 1)
        return [(c, int(n)) for c, n in enumerate(counts.tolist()) if c and n]

    return per_payload(payloads, "payload_id", solve, "n_candidates int, n long")


def pays(length: int, distance: int, repeat: bool = False) -> bool:
    """codes.pays_for_offset() of numbers."""
    return repeat or 4 * length >= distance.bit_length() - 1 + 7


def greedy_sequences(payloads: DataFrame, k: int = 5, window: int = 1 << 22) -> DataFrame:
    """payload_id, seq_no, ll, ml, distance, repeat: a greedy parse over newest candidates. The last literals of a payload make a
    row with ml 0. A parse is an ordered fold over one payload, hence a loop over its matches."""
    def solve(data):
        prev, raw = previous(data, k), data.tobytes()
        at = np.flatnonzero((prev >= 0) & (np.arange(len(prev)) - prev <= window))
        back, at = (at - prev[at]).tolist(), at.tolist()
        out, anchor, last, i = [], 0, [1, 4, 8], 0
        while i < len(at):
            p, d = at[i], back[i]
            n = match_length(raw, p, p - d)
            if not pays(n, d, d in last):
                i += 1
                continue
            out.append((len(out), p - anchor, n, d, d in last))
            last = [d] + [x for x in last if x != d][:2]
            anchor = p + n
            i = bisect.bisect_left(at, anchor, i + 1)
        if anchor < len(raw) or not raw:
            out.append((len(out), len(raw) - anchor, 0, 0, False))
        return out

    return per_payload(payloads, "payload_id", solve, "seq_no int, ll int, ml int, distance long, repeat boolean")


def parse_prefixes(sequences: DataFrame) -> DataFrame:
    """sequences with literals_before and matched_before: running sums over a payload's sequences."""
    w = Window.partitionBy("payload_id").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, -1)
    return sequences.withColumns({f"{name}_before": F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for name, c in (("literals", "ll"), ("matched", "ml"))})


def offset_spectrum(payloads: DataFrame, k: int = 5) -> DataFrame:
    """bucket, n: positions by floor(log2(distance to the latest candidate)), over all payloads."""
    def solve(data):
        prev = previous(data, k)
        back = (np.arange(len(prev)) - prev)[prev >= 0]
        counts = np.bincount(np.frexp(back.astype(float))[1] - 1, minlength=1) if len(back) else np.zeros(0, int)
        return [(b, int(n)) for b, n in enumerate(counts.tolist()) if n]

    return per_payload(payloads, "payload_id", solve, "bucket int, n long").groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))


def matched_spectrum(sequences: DataFrame) -> DataFrame:
    """bucket, n, bytes: matches and matched bytes by offset code, over a parse."""
    return sequences.where("ml > 0").groupBy(offset_code(F.col("distance")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("ml").cast("long").alias("bytes"))


def twins(payloads: DataFrame, window: int = 64) -> DataFrame:
    """window hash (md5), n: aligned windows that occur more than once in all payloads. Hashes are counted before the shuffle."""
    at = F.sequence(F.lit(0), F.floor(F.octet_length("content") / window).cast("int") - 1)
    rows = payloads.where(F.octet_length("content") >= window).select("content", F.explode(at).alias("i"))
    return rows.groupBy(F.md5(F.substring("content", (F.col("i") * window + 1).cast("int"), F.lit(window))).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


def long_distance(payloads: DataFrame, bits: int = 6, least: int = 64, reach: int = 1 << 27) -> DataFrame:
    """payload_id, split, distance, length: for each content-defined split that was seen before in the payload, from 1 to `reach` bytes back,
    the candidate whose bytes run on the longest after the split, the farthest of equally long ones; matches of less than `least` bytes, counted from
    64 bytes before the split, are none. Candidates are the newest CANDIDATES splits with the same 64 bytes before them, as a bucket of a search table holds."""
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def solve(data):
        h = gear_hashes(data)
        at = np.flatnonzero((h[63:] & mask) == 0) + 64
        raw, seen, out = data.tobytes(), {}, []
        for p in at.tolist():
            own, best = seen.setdefault(raw[p - 64 : p], []), (0, 0)
            for q in own[-CANDIDATES:]:
                if p - q <= reach and (n := 64 + match_length(raw, p, q)) > best[0]:
                    best = (n, p - q)
            own.append(p)
            if best[0] >= least:
                out.append((p, best[1], best[0]))
        return out

    return per_payload(payloads, "payload_id", solve, "split long, distance long, length long")


def resolve_repeats(sequences: DataFrame) -> DataFrame:
    """payload_id, offsets: true offsets of sequences (seq_no, ll, of_value) that may name one of the last three (values 1 to 3, shifted
    when ll is 0). An ordered fold, as an aggregate over each payload's sequences."""
    rows = sequences.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("seq_no", "ll", F.col("of_value").cast("long").alias("v")))).alias("s"))
    start = F.struct(F.array(*[F.lit(x).cast("long") for x in (1, 4, 8)]).alias("last"), F.array().cast("array<long>").alias("out"))

    def step(acc, s):
        slot = s["v"] + F.when(s["ll"] == 0, 1).otherwise(0)
        a, b, c = (F.element_at(acc["last"], k) for k in (1, 2, 3))
        offset = F.when(s["v"] > 3, s["v"] - 3).when(slot == 1, a).when(slot == 2, b).when(slot == 3, c).otherwise(a - 1)
        last = F.when((s["v"] <= 3) & (slot == 1), F.array(a, b, c)).when((s["v"] <= 3) & (slot == 2), F.array(b, a, c)).otherwise(F.array(offset, a, b))
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(offset)).alias("out"))

    return rows.select("payload_id", F.aggregate("s", start, step, lambda acc: acc["out"]).alias("offsets"))
