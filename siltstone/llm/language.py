"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its 2-, 3- and 4-byte subwords over lower-cased letters (everything else is one space), hashed to
BUCKETS rows of an embedding table; their average goes through a linear layer and a softmax. Because the layer is linear,
prediction needs one table of logits per subword. Scores are calibrated by a temperature on rows held back from training,
which also give the score under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, flat_bytes, small

BUCKETS, WIDTH, EPOCHS, RATE = 1 << 15, 16, 4, 2.0
#: Learning rows for each language, and bytes of their texts: the bound of the training sample.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 600, 16 << 20
#: Share of right predictions that rejection may lose; windows of each size that a held-back text gives for calibration.
LOSS, WINDOWS = 0.0005, 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray) -> np.ndarray:
    """Bucket numbers of the subwords of one text (UTF-8 bytes)."""
    x = _FOLD[data]
    if len(x) > 1:  # Latin-1 capitals as two bytes: C3 80-9E
        x[1:] += ((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)).astype(np.uint8) * np.uint8(32)
    x = np.concatenate(([32], x, [32]))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep].astype(np.uint32)
    if len(x) < 4:
        x = np.concatenate((x, np.full(4 - len(x), 32, np.uint32)))
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (two[:-1] << np.uint32(8)) | x[2:]
    four = (three[:-1] << np.uint32(8)) | x[3:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    return np.concatenate([(g * np.uint32(m)) >> shift for g, m in ((two, 2654435761), (three, 2246822519), (four, 3266489917))])


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, data: np.ndarray) -> np.ndarray:
        at = subwords(data)
        z = (sum(self.logits[at[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(at), 65536)) / len(at) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(text: bytes, windows: int, rng: np.random.Generator) -> list[bytes]:
    """A whole text and, so that short ones are learned and judged as well, windows of it in three sizes."""
    out = [text]
    for size in (24, 80, 250):
        if len(text) > size:
            out += [text[at : at + size] for at in rng.integers(0, len(text) - size, windows).tolist()]
    return out


def least_score(right: np.ndarray, loss: float = LOSS) -> float:
    """The score under which a prediction is rejected: of n scores of right predictions the k-th smallest with k = floor(loss * (n + 1)), so that
    another right prediction scores less with a probability of `loss` at most. 0 if there are too few scores to tell."""
    k = int(loss * (len(right) + 1))
    return float(np.sort(right)[k - 1]) if k else 0.0


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model | None:
    """A model of these texts, or None without any. Every fifth text is held back for calibration: of the temperature, which whole texts
    and windows decide, and of the least score that is not rejected."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    data: list[list] = [[], []]
    for i, (t, label) in enumerate(zip(texts, labels)):
        for e in _examples(t.encode(), WINDOWS if i % 5 == 4 else 1, rng):
            at, count = np.unique(subwords(np.frombuffer(e, np.uint8)), return_counts=True)
            data[i % 5 == 4].append((at, (count / count.sum()).astype(np.float32), languages.index(label)))
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.3, layer.shape).astype(np.float32)
    steps, done = EPOCHS * len(data[0]), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data[0])):
            at, share, y = data[0][k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            x = share @ table[at]
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * 0.1 * np.outer(x, p)
            bias -= rate * np.float32(0.01) * p
            table[at] -= rate * len(at) ** 0.5 * share[:, None] * back
    model = Model(languages, (table @ layer).astype(np.float32), bias, 1.0, 0.0)
    held = data[1] or data[0]
    z = np.array([share @ model.logits[at] + bias for at, share, _ in held])
    y = np.array([k for *_, k in held])

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()

    model.temperature = float(min(np.geomspace(0.25, 8, 31), key=loss))
    s = z / model.temperature
    s = np.exp(s - s.max(1, keepdims=True))
    s /= s.sum(1, keepdims=True)
    right = s.max(1)[s.argmax(1) == y]
    model.least = least_score(right)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> Model | None:
    """Fit on about `per_language` rows and `most_bytes` of each language at most, chosen by a hash of doc_id, never on held-out rows. The
    driver holds this sample and one row per language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: max(r["n"] / per_language, r["b"] / most_bytes) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(1 / max(1.0, n)))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(drawn < share[F.col("lang")]).select("doc_id", "text", "lang").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def _judged(texts: pa.Array, m: Model | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    data, off = flat_bytes(texts)
    langs, scores = [], []
    for i in range(len(off) - 1):
        own = data[off[i] : off[i + 1]]
        if m is None or not _LETTER.search(own.tobytes().decode()):
            langs.append(UNKNOWN)
            scores.append(0.0)
        else:
            p = m.scores(own)
            k = int(p.argmax())
            langs.append(m.languages[k])
            scores.append(float(p[k]))
    low = m.least if m else 0.0
    gone = [x == UNKNOWN or s < low for x, s in zip(langs, scores)]
    return pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents, all columns, that identified() doesn't reject; each row on its own, an empty table gives an empty one. Where there
    is a lang column, it names the predicted language."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            langs, _, gone = _judged(b.column("text"), kept.value)
            if "lang" in b.schema.names:
                b = b.set_column(b.schema.get_field_index("lang"), "lang", langs)
            yield b.filter(pa.compute.invert(gone))

    return docs.mapInArrow(run, docs.schema)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of documents (doc_id, text), each row on its own.

    Texts that are null or have no letter, and all texts if there was nothing to learn from, are 'und' with score 0 and are
    rejected; others are rejected if their score is below the model's calibrated least. Only text is an input.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_judged(b.column("text"), kept.value)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identified(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
