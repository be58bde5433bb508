"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled text train an additive model over binned text statistics by minimising the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Negative labels are never read.

1. The statistics of every document are written once.
2. A plain classifier of positives against unlabelled rows gives the class prior: the share of unlabelled rows over a score, divided by that of
   positives, is never less than the prior but for chance and comes near it where hardly any negatives are; the score at which that
   ratio, with an allowance for chance, is the least is taken (best-bin estimation). Shares of unlabelled rows are those of all rows.
3. The risk is minimised on a bounded sample first, then in PASSES steps with the gradient of all unlabelled rows.
4. Scores are shifted so that their mean over all unlabelled rows is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, flat_bytes, shared_table
from .shingles import word_hashes

#: Positives, and unlabelled rows, in the sample that training begins with: its bound. All unlabelled rows take part in the PASSES after it.
ROWS = 4000
BINS, STEPS, RATE, DECAY, THRESHOLD, PASSES, LAST_RATE = 24, 400, 0.05, 1e-4, 0.7, 6, 0.01
#: Raw scores are counted in cells from -LIMIT to LIMIT; standard errors that the prior's ratio is judged with, and the share of positives it needs.
CELLS, LIMIT, SURE, SEEN = 2400, 30.0, 2.0, 0.6
_KIND = np.zeros(256, np.uint8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 sentence mark, 7 comma, 8 beyond ASCII, 9 control, 10 column mark, 11 bracket, 12 slash, 13 quote, 14 hyphen, 15 exclamation
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\v\f", 4), ("\n", 5), (".?", 6), (",;:", 7), ("|", 10), ("()[]{}<>", 11), ("/\\@_=", 12), ("\"'`", 13), ("-", 14), ("!", 15)):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = 8
_KIND[:9] = 9
NAMES = ("log bytes", "log words", "log lines", "word length", "distinct words", "top word", "top three words", "repeated pairs", "line length", "lines ending a sentence", "distinct lines", *(f"kind {k}" for k in range(16)), "upper of letters", "words with a symbol", "capitals after lower")


def statistics(data: np.ndarray) -> np.ndarray:
    """Statistics of one text (UTF-8 bytes)."""
    n = len(data)
    if not n:
        return np.zeros(len(NAMES), np.float32)
    kind = _KIND[data]
    kinds = np.bincount(kind, minlength=16)
    w = word_hashes(data)
    words = max(1, len(w))
    counts = np.sort(np.unique(w, return_counts=True)[1])[::-1] if len(w) else np.zeros(1, int)
    pairs = w[1:] * np.uint64(3) + w[:-1]
    breaks = np.flatnonzero(kind == 5)
    ends = np.append(breaks, n)
    before = kind[np.maximum(ends - 1, 0)]
    lengths = np.diff(ends, prepend=-1) - 1
    filled = lengths > 0
    lines = max(1, int(filled.sum()))
    space = (kind == 4) | (kind == 5)
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    odd = np.add.reduceat(((kind == 0) | (kind >= 9)).astype(np.int64), start) > 0 if len(start) else np.zeros(1, bool)
    jump = (kind[1:] == 2) & (kind[:-1] == 1)
    head = [np.log1p(n), np.log1p(len(w)), np.log1p(lines), (n - space.sum()) / words, len(counts) / words, counts[0] / words, counts[:3].sum() / words, 1 - len(np.unique(pairs)) / max(1, len(pairs)), np.log1p(n / lines), (np.isin(before[filled], (6, 15))).mean() if filled.any() else 0.0, len(np.unique(lengths)) / len(lengths)]
    return np.array([*head, *(kinds / n), kinds[2] / max(1, kinds[1] + kinds[2]), odd.mean(), jump.sum() / words], np.float32)


@dataclass
class Model:
    edges: np.ndarray
    flat: np.ndarray  # a weight for each bin of each statistic, and the bias
    prior: float = 0.5
    shift: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(e, x[:, f], "right") + f * BINS for f, e in enumerate(self.edges)]).T.reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.flat[self.bins(x)].sum(1) + self.flat[-1], -LIMIT, LIMIT)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pull(rows: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """The gradient of the weights from that of the raw scores of rows of bins."""
    out = np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), size)
    out[-1] = g.sum()
    return out


def unlabelled_part(flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of rows of bins taken as negatives: sum of the loss, number of rows, gradient of the sum. These add up over parts of a table."""
    z = flat[rows].sum(1) + flat[-1]
    return np.concatenate([[np.logaddexp(0, z).sum(), len(z)], _pull(rows, _sigmoid(z), len(flat))])


def pu_gradient(flat: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Negative part of the risk before it is cut at 0, and the gradient of the non-negative risk with the logistic loss. unlabelled: the sum of
    unlabelled_part(). Where the negative part is below 0, the step climbs back out of it."""
    z = flat[positive].sum(1) + flat[-1]
    s, n = _sigmoid(z), max(1.0, unlabelled[1])
    minus = unlabelled[0] / n - prior * np.logaddexp(0, z).mean()
    down = unlabelled[2:] / n - prior * _pull(positive, s / len(s), len(flat))
    return minus, (prior * _pull(positive, (s - 1) / len(s), len(flat)) + down if minus >= 0 else -down)


def descend(flat: np.ndarray, gradient, steps: int, rate: float, decay: float = DECAY) -> np.ndarray:
    """Adam with weight decay."""
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        g = gradient(flat) + decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return flat


def started(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model without weights, its bins of equal numbers of rows of the sample."""
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    return Model(edges, np.zeros(positive.shape[1] * BINS + 1))


def plain(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Positives against unlabelled rows, each half of the weight, in few steps: only the order of its scores counts, on rows it hasn't seen."""
    p, u = model.bins(positive), model.bins(unlabelled)

    def gradient(flat):
        a, b = _sigmoid(flat[p].sum(1) + flat[-1]), _sigmoid(flat[u].sum(1) + flat[-1])
        return _pull(p, (a - 1) / len(p) / 2, len(flat)) + _pull(u, b / len(u) / 2, len(flat))

    return Model(model.edges, descend(model.flat, gradient, 60, RATE, 0.05))


def cell_of(raw: np.ndarray) -> np.ndarray:
    return ((raw + LIMIT) * (CELLS / (2 * LIMIT))).astype(np.int64).clip(0, CELLS - 1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from counts of both kinds' raw scores by cell: the ratio of their shares over that score, which
    SEEN of the positives reach, at which the ratio and SURE standard errors of it are the least."""
    p, u = (np.cumsum(c[::-1])[::-1] for c in (positive, unlabelled))
    n, m = max(1, p[0]), max(1, u[0])
    ok = (p >= SEEN * n) & (u > 0)
    if not ok.any():
        return 0.5
    seen, share = p[ok] / n, u[ok] / m
    error = np.sqrt((1 - share) / (share * m) + (1 - seen + 1 / n) / (seen * n))
    best = int(np.argmin(share / seen * (1 + SURE * error)))
    return float(np.clip(share[best] / seen[best], 0.01, 0.99))


def shift_to(counts: np.ndarray, prior: float) -> float:
    """What must be added to raw scores, given by their counts, so that the mean score is the prior."""
    z = (np.arange(CELLS) + 0.5) * (2 * LIMIT / CELLS) - LIMIT
    low, high = -2 * LIMIT, 2 * LIMIT
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (counts * _sigmoid(z + middle)).sum() < prior * counts.sum() else (low, middle)
    return (low + high) / 2


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, open (whether it may be learned from), x: the statistics of each text (doc_id, text), written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat_bytes(b.column("text"))
            x = np.array([statistics(data[off[i] : off[i + 1]]) for i in range(b.num_rows)], np.float32).reshape(-1, len(NAMES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("open"), lists], ["doc_id", "open", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("open", ~held_out() & F.col("doc_id").isNotNull())
    return shared_table(rows.select("doc_id", "open", "text").mapInArrow(run, "doc_id long, open boolean, x array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _summed(told: DataFrame, part, size: int) -> np.ndarray:
    """The sum over the open rows of told of part(matrix of statistics), an array of `size` numbers. It is summed by place on executors; the
    driver gets `size` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                out += part(_matrix(b.column("x")))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["at", "v"])

    out = np.zeros(size)
    for r in told.where("open").select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def learn(told: DataFrame, labels: DataFrame, rows: int = ROWS, passes: int = PASSES) -> Model | None:
    """Fit on described() documents and labels (doc_id, quality), of which only ones are read, never on held-out rows: at most about `rows` positives,
    drawn by a hash of doc_id, and all unlabelled rows. None if there are no positives."""
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    good = labels.where("quality = 1 and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n, total = good.count(), told.where("open").count()
    if not n:
        return None
    # a positive's statistics once, also where rows repeat; at most about `rows` of each kind come to the driver
    chosen = good.where(drawn < min(1.0, rows / n))
    sampled = drawn * 0.9999 + 0.0001 >= 1 - min(0.5, rows / max(1, total))
    found = told.where("open").join(chosen, "doc_id", "left_semi").groupBy("doc_id", sampled.alias("sampled")).agg(F.min("x").alias("x")).collect()
    p, apart = sorted(tuple(r["x"]) for r in found), sum(not r["sampled"] for r in found)
    u = sorted(tuple(r["x"]) for r in told.where("open").where(sampled).select("x").collect())
    if not p:
        return None
    positive, unlabelled = (np.array(x, np.float32).reshape(-1, len(NAMES)) for x in (p, u or p))
    start = started(positive, unlabelled)
    # the prior by positives that the plain classifier hasn't seen: two halves, each scored by the classifier of the other
    halves = (positive[::2], positive[1::2]) if len(positive) > 1 else (positive, positive)
    orders = [plain(start, half, unlabelled) for half in halves]
    # scores of rows that it has learned from tell nothing; of those, the positives are counted as what they are
    rest = told.where("open").where(~sampled).join(chosen, "doc_id", "left_anti")
    counts = _summed(rest, lambda x: sum(np.bincount(cell_of(o.raw(x)), minlength=CELLS) for o in orders), CELLS)
    prior = class_prior(sum(np.bincount(cell_of(o.raw(half)), minlength=CELLS) for o, half in zip(orders, halves[::-1])), counts)
    prior = (prior * (m := counts.sum() / 2) + apart) / max(1, m + apart)
    own, sample = start.bins(positive), start.bins(unlabelled)
    flat = descend(start.flat, lambda w: pu_gradient(w, own, unlabelled_part(w, sample), prior)[1], STEPS, RATE)
    flat = descend(flat, lambda w: pu_gradient(w, own, _summed(told, lambda x: unlabelled_part(w, start.bins(x)), len(w) + 2), prior)[1], passes, LAST_RATE)
    model = Model(start.edges, flat, prior)
    model.shift = shift_to(_summed(told, lambda x: np.bincount(cell_of(model.raw(x)), minlength=CELLS), CELLS), prior)
    return model


def scored(told: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of described() documents, each row on its own; null and empty texts are scored like any
    other. Without a model (no positives to learn from) every score is 0.5. Only text is an input."""
    kept = told.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for b in batches:
            s = m.scores(_matrix(b.column("x"))) if m else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return told.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def op9_quality_classifier(spark, sf_dir):
    told = described(documents(spark, sf_dir))
    model = learn(told, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(told, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
