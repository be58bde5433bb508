"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

The index has two tables. `counts` (key, n) holds for every line key the number of documents that have it: the exact
truth. `filters` (shard, slots, n) holds one cuckoo filter per shard over the keys found in `min_docs` documents or more.
Documents are inserted and deleted by adding or subtracting their counts; a key that crosses the threshold is inserted
into or deleted from its shard's filter, which a Bloom filter could not do, so deleting what was inserted gives the
index from before.

To drop lines, each document's keys are dealt to the shards, where the shard's filter passes the few possible ones and the exact
counts beside it decide. A shard with many lines is met by several tasks. Where all filters together are under SENT bytes, tasks
ask copies of them before anything is dealt, so that next to nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, shared_table, small

MIN_DOCS = 10
#: Keys that a shard is made for; lines of a shard that one task looks up, for each key in it and at least; bytes of filters that may be
#: sent to every task.
SHARD_KEYS, LINES_OF_KEY, LINES_OF_TASK, SENT = 1 << 15, 8, 1 << 14, 64 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLOTS, _KICKS = 4, 500


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).translate(_LOWER)


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, slots: np.ndarray, n: int = 0):
        self.slots, self.n = slots, n

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, n) / (_SLOTS * 0.8))))), _SLOTS), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: rows of two uint64."""
        mask = np.uint64(len(self.slots) - 1)
        mark = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = keys[:, 1] & mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return (bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.slots) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.slots[a.astype(np.int64)] == mark[:, None]).any(1) | (self.slots[b.astype(np.int64)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built anew with more room."""
        marks, firsts, seconds = self._places(keys)
        for mark, a, b in zip(marks, firsts, seconds):
            for at in (int(a), int(b)):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    break
            else:
                at = int(b)
                for kick in range(_KICKS):
                    slot = kick % _SLOTS
                    mark, self.slots[at, slot] = self.slots[at, slot], mark
                    at = int(self._other(np.uint64(at), np.uint16(mark)))
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
            self.n += 1
        return True

    def delete(self, keys: np.ndarray) -> None:
        marks, firsts, seconds = self._places(keys)
        for mark, a, b in zip(marks, firsts, seconds):
            for at in (int(a), int(b)):
                held = np.flatnonzero(self.slots[at] == mark)
                if len(held):
                    self.slots[at, held[0]] = 0
                    self.n -= 1
                    break


def as_numbers(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys[:, 0] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


@dataclass
class LineIndex:
    """room: the number of frequent keys that the filters were made for; beyond it they are made anew from the counts, with more room."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    room: int


def _keys(docs: DataFrame, possible=None, parts: np.ndarray | None = None) -> DataFrame:
    """(doc_id, key): the distinct hashed keys of each document's lines, without the empty key. parts: of each shard; then also the shard and
    the part of it that a key is dealt to, in the same function: a second one would run in a Python worker of its own beside the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, keys, rows = b.column("doc_id"), [], []
            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                own = {line_key(x) for x in text.encode().split(b"\n")} if text else set()
                own.discard(b"")
                keys += map(key_hash, own)
                rows += [i] * len(own)
            at = np.array(rows, np.int64)
            if possible is not None and keys:
                near = possible(as_numbers(keys))
                at, keys = at[near], [k for k, ok in zip(keys, near) if ok]
            if not keys:
                continue
            out = {"doc_id": ids.take(pa.array(at)), "key": pa.array(keys, pa.binary())}
            if parts is not None:
                shard = shard_of(as_numbers(keys), len(parts))
                part = out["doc_id"].to_numpy().view(np.uint64) % parts[shard].astype(np.uint64)
                out |= {"shard": pa.array(shard.astype(np.int32)), "part": pa.array(part.astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    dealt = ", shard int, part int" if parts is not None else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, key binary{dealt}")


def _counts(docs: DataFrame) -> DataFrame:
    return _keys(docs).groupBy("key").agg(F.count("*").alias("n"))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("shard", pa.array(shard_of(as_numbers(b.column("key").to_pylist()), shards).astype(np.int32)))

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in keys.schema if f.name != "key")
    return keys.mapInArrow(run, f"key binary{extra}, shard int")


def _filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int, int]:
    frequent = counts.where(F.col("n") >= min_docs).select("key")
    n = frequent.count()
    shards = -(-n // SHARD_KEYS) or 1
    room = 2 * -(-n // shards) + 1000

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        size = room
        while True:
            made = CuckooFilter.for_keys(max(size, len(frame)))
            if made.insert(as_numbers(frame["key"])):
                return pd.DataFrame({"shard": frame["shard"][:1], "slots": [made.slots.tobytes()], "n": [made.n]})
            size *= 2

    made = _sharded(frequent, shards).groupBy("shard").applyInPandas(build, "shard int, slots binary, n long")
    return shared_table(made), shards, room * shards


def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    """An index of documents (doc_id, text). Every row counts as one document; null and empty texts have no keys."""
    return _built(shared_table(_counts(docs)), min_docs)


def _built(counts: DataFrame, min_docs: int) -> LineIndex:
    filters, shards, room = _filters(counts, min_docs)
    return LineIndex(counts, filters, shards, min_docs, room)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    delta = _counts(docs).select("key", (sign * F.col("n")).alias("n"), F.lit(1).alias("new"))
    both = index.counts.select("key", "n", F.lit(0).alias("new")).union(delta).groupBy("key").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("new") == 0, F.col("n"))), F.lit(0)).alias("old"))
    both = shared_table(both)
    counts = shared_table(both.where("n > 0").select("key", "n"))
    m, shards = index.min_docs, index.shards
    crossed = both.where(f"(n >= {m}) <> (old >= {m})").select("key", (F.col("n") >= m).alias("enters"))
    if counts.where(F.col("n") >= m).count() > index.room:
        return _built(counts, m)

    def apply(key, held: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(np.frombuffer(held["slots"].iloc[0], np.uint16).reshape(-1, _SLOTS).copy(), int(held["n"].iloc[0])) if len(held) else CuckooFilter.for_keys(2 * len(moves) + 1000)
        f.delete(as_numbers(moves["key"][~moves["enters"].astype(bool)]))
        full = not f.insert(as_numbers(moves["key"][moves["enters"].astype(bool)]))
        return pd.DataFrame({"shard": [key[0]], "slots": [None if full else f.slots.tobytes()], "n": [f.n]})

    moves = _sharded(crossed, shards)
    filters = shared_table(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(apply, "shard int, slots binary, n long"))
    if filters.where("slots is null").limit(1).count():  # a full shard lost a key: all are made again from the exact counts
        return _built(counts, m)
    return LineIndex(counts, filters, shards, m, index.room)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    return _changed(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without these documents, which must have been inserted before."""
    return _changed(index, docs, -1)


def _frequent(index: LineIndex, docs: DataFrame, possible=None) -> DataFrame:
    """(mark, key) of the lines of documents (mark, text) whose key the index has in min_docs documents or more.

    Lines are dealt to (shard, part) and meet the shard's filter and its sorted frequent keys there. A shard's parts follow the number of
    lines that the counts tell of, so that a line in a third of all documents is spread over many tasks. The driver holds one row per shard of
    SHARD_KEYS frequent keys, never keys.
    """
    shards = index.shards
    frequent = _sharded(index.counts.where(F.col("n") >= index.min_docs), shards)
    told = frequent.groupBy("shard").agg(F.count("*").alias("keys"), F.sum("n").alias("lines")).collect()
    parts = np.ones(shards, np.int64)
    for r in told:
        parts[r["shard"]] = -(-r["lines"] // max(LINES_OF_TASK, LINES_OF_KEY * r["keys"]))

    def table(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": frame["shard"][:1], "keys": [b"".join(sorted(frame["key"]))], "parts": [parts[frame["shard"].iloc[0]]]})

    def look_up(frame: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(shard):
            return frame[["mark", "key"]].head(0)
        held = CuckooFilter(np.frombuffer(shard["slots"].iloc[0], np.uint16).reshape(-1, _SLOTS))
        frame = frame[held.holds(as_numbers(frame["key"]))]
        known = np.frombuffer(shard["keys"].iloc[0], "S16")
        own = np.frombuffer(b"".join(frame["key"]), "S16")
        return frame[["mark", "key"]][known[np.searchsorted(known, own).clip(0, len(known) - 1)] == own]

    keys = frequent.groupBy("shard").applyInPandas(table, "shard int, keys binary, parts int")
    tables = index.filters.select("shard", "slots").join(keys, "shard").select("shard", "slots", "keys", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    lines = _keys(docs.select(F.col("mark").alias("doc_id"), "text"), possible, parts).withColumnRenamed("doc_id", "mark")
    return lines.groupBy("shard", "part").cogroup(tables.groupBy("shard", "part")).applyInPandas(look_up, "mark long, key binary")


def drop_lines(index: LineIndex, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text) without the lines whose key the index has in min_docs documents or more.

    Returns doc_id, text, n_lines, n_dropped and the columns named in keep. Null or empty text is one empty line, and stays empty text. Each row
    stands for itself, also where doc_id repeats or is null. An empty table gives an empty result; extra columns are ignored.
    """
    possible = None
    size = index.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    if size <= SENT:
        shards = index.shards
        tables = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["slots"] for r in index.filters.collect()})

        def possible(keys):
            out, own = np.zeros(len(keys), bool), shard_of(keys, shards)
            for s in np.unique(own):
                if (slots := tables.value.get(int(s))) is not None:
                    at = np.flatnonzero(own == s)
                    out[at] = CuckooFilter(np.frombuffer(slots, np.uint16).reshape(-1, _SLOTS)).holds(keys[at])
            return out

    # rows with one mark have the same text, or else (by chance) share keys that are frequent in any case
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).withColumn("__mark", F.xxhash64("doc_id", "text"))
    dropped = _frequent(index, plain.select(F.col("__mark").alias("mark"), "text"), possible).groupBy("mark").agg(F.collect_set("key").alias("__keys"))
    both = plain.join(dropped, F.col("__mark") == F.col("mark"), "left").select("doc_id", "text", "__keys", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(b.column("text"), b.column("__keys")):
                lines = (text.as_py() or "").encode().split(b"\n")
                left = lines
                if keys.is_valid:
                    gone = set(keys.as_py())
                    left = [x for x in lines if not (k := line_key(x)) or key_hash(k) not in gone]
                texts.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *(b.column(c) for c in keep)], ["doc_id", "text", "n_lines", "n_dropped", *keep])

    extra = "".join(f", {name} {kind}" for name, kind in plain.dtypes if name in keep)
    return both.mapInArrow(run, f"doc_id long, text string, n_lines long, n_dropped long{extra}")


def op6_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = drop_lines(build(docs), docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
