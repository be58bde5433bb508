"""Compression dictionaries: k-mer counts, choice of segments, sweep over segment sizes, finished dictionaries.

Counting is a grouped sum over k-mers that were counted within each sample first. Choosing segments is sequential, since
each choice takes its k-mers out of the table, so it runs once per candidate segment size on a training set of stated
size; the candidates run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import grams, per_run

#: Segment sizes tried; bytes of samples that a training set may hold.
SIZES, TRAINING_BYTES, K = (50, 537, 1024, 1511, 2000), 8 << 20, 8


def kmer_counts(samples: DataFrame, least: int = 1) -> DataFrame:
    """kmer (8 bytes, little-endian long), n: k-mers within samples, over all of them, at least `least` times. Counted over runs of
    samples first, so a row is shuffled for each distinct k-mer of a run."""
    def solve(data, off):
        g = grams(data, K)
        inside = np.ones(len(g), bool)
        for border in off[1:-1]:
            inside[max(0, border - K + 1) : border] = False
        values, counts = np.unique(g[inside], return_counts=True)
        return values.view(np.int64), counts.astype(np.int64)

    each = per_run(samples, solve, "kmer long, n long")
    return each.groupBy("kmer").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)


def select_segments(body: np.ndarray, k: int, size: int) -> bytes:
    """A dictionary of about `size` bytes: epoch by epoch the k-byte segment whose distinct k-mers are the most frequent, its k-mers
    then counting as zero; filled from the back, until ten epochs in a row give nothing."""
    g = grams(body, K)
    if not len(g):
        return b""
    _, which, counts = np.unique(g, return_inverse=True, return_counts=True)
    score = counts.astype(np.int64)
    order = np.argsort(which, kind="stable")
    before = np.full(len(g), -1, np.int64)
    same = which[order][1:] == which[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    span = max(1, k - K + 1)
    epochs = max(1, min(size // k, len(g) // span))
    width, out, room, idle, epoch = len(g) // epochs, [], size, 0, 0
    while room > 0 and idle < 10:
        begin = epoch % epochs * width
        end = min(len(g), begin + width)
        epoch += 1
        if epoch > 4 * epochs + 10:
            break
        # the value of a window counts each k-mer once: at its last position inside the window
        gain = score[which[begin:end]]
        prev = np.maximum(before[begin:end] - begin, -1)
        n = end - begin
        value = np.zeros(n + 1, np.int64)
        # position j adds gain to windows that start after its previous occurrence, from max(j - span, prev) + 1 up to j
        j = np.arange(n)
        start = np.maximum(np.maximum(j - span + 1, prev + 1), 0)
        np.add.at(value, start, gain)
        np.add.at(value, j + 1, -gain)
        value = np.cumsum(value[:-1])[: max(1, n - span + 1)]
        best = int(value.argmax())
        if value[best] == 0:
            idle += 1
            continue
        idle = 0
        inside = which[begin + best : begin + best + span]
        live = np.flatnonzero(score[inside] > 0)
        part = body[begin + best + live[0] : begin + best + live[-1] + K][:room]
        score[inside] = 0
        out.append(part.tobytes())
        room -= len(part)
    return b"".join(reversed(out))


def _hashed() -> Column:
    return F.pmod(F.xxhash64("payload_id"), F.lit(1_000_003))


def training_set(samples: DataFrame, most: int = TRAINING_BYTES) -> DataFrame:
    """payload_id, content, held: samples drawn by a hash of payload_id up to about `most` bytes, every fourth held out. A trainer
    looks at a sample of the corpus by design; the bound is this parameter."""
    total = samples.agg(F.sum("n_bytes")).first()[0] or 0
    share = min(1.0, most / max(1, total))
    hashed = _hashed()
    return samples.where(hashed < share * 1_000_003).where("n_bytes > 0").select("payload_id", "content", (hashed % 4 == 3).alias("held"))


def train(samples: DataFrame, size: int = 16 << 10, sizes: tuple[int, ...] = SIZES, level: int = 3) -> DataFrame:
    """k, eval_bytes, dict_bytes, content: for each viable segment size the dictionary and the compressed size of all held-out
    samples of the table (every fourth by hash) with it, the best first (ties: smaller k)."""
    ks = F.explode(F.array(*[F.lit(k) for k in sizes if K <= k <= size]))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("payload_id")
        held = frame["held"].to_numpy(bool)
        if held.all() or not held.any():
            held = np.zeros(len(frame), bool)
        body = np.frombuffer(b"".join(frame["content"][~held]), np.uint8)
        k = int(key[0])
        made = select_segments(body, k, size) if len(body) >= k else b""
        return pd.DataFrame({"k": [k], "dict_bytes": [len(made)], "content": [made]})

    # one row for each k, at most `size` bytes: computed once, and sent to every task
    made = training_set(samples).withColumn("k", ks).groupBy("k").applyInPandas(run, "k int, dict_bytes int, content binary").collect()
    spark = samples.sparkSession
    given = [(r["k"], bytes(r["content"])) for r in made]

    def sizes_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        coders = [(k, z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(d) if len(d) >= 8 else None)) for k, d in given]
        ks = pa.array([k for k, _ in coders], pa.int32())
        for b in batches:
            total = np.zeros(len(coders), np.int64)
            for content in b.column("content"):
                content = content.as_py()
                total += [len(c.compress(content)) for _, c in coders]
            yield pa.RecordBatch.from_arrays([ks, pa.array(total)], ["k", "eval_bytes"])

    filled = samples.where("n_bytes > 0").select("content", (_hashed() % 4 == 3).alias("held"))
    n, held = filled.agg(F.count("*"), F.count(F.when(F.col("held"), 1))).first()
    tested = filled.where("held") if 0 < held < n else filled
    sums = tested.select("content").mapInArrow(sizes_with, "k int, eval_bytes long").groupBy("k").agg(F.sum("eval_bytes").cast("long").alias("eval_bytes"))
    found = spark.createDataFrame([(k, len(d), bytearray(d)) for k, d in given], "k int, dict_bytes int, content binary")
    return found.join(sums, "k").select("k", "eval_bytes", "dict_bytes", "content").orderBy("eval_bytes", "k")


def sample_dictionaries(n: int, size: int = 2048) -> dict[int, bytes]:
    """n small dictionaries of made-up lines, by their ids: 40001 and on."""
    import zstandard as z

    out = {}
    for k in range(n):
        rng = np.random.default_rng(k)
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(200)]
        lines = [" ".join(words[w] for w in rng.zipf(1.5, 30) % 200).encode() for _ in range(400)]
        out[40001 + k] = z.train_dictionary(size, lines, dict_id=40001 + k, level=3).as_bytes()
    return out


def dictionary_kind(content: bytes) -> tuple[str, int]:
    """('formatted', id) by the dictionary magic 0xEC30A437; anything else, and all under 8 bytes, is ('raw', 0)."""
    if len(content) >= 8 and content[:4] == bytes.fromhex("37A430EC"):
        return "formatted", int.from_bytes(content[4:8], "little")
    return "raw", 0
