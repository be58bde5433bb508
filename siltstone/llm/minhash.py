"""MinHash near-duplicate detection with min-max hashing.

Each hash evaluation of a shingle serves twice: a signature keeps the minimum and the maximum under every
permutation, so 128 values cost 64 evaluations. Both are unbiased estimators of the Jaccard similarity, and
being taken from one permutation they are negatively correlated, which lowers the variance of their mean.
Bands of 4 values (32 of them) find the candidates. A band has the minima of four permutations or the maxima of four, so its values are
independent and a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6, however small its sets
are. Every link is confirmed on the full shingle sets, with whole numbers.

Work is kept in proportion to the documents, however large a group of copies is:

1. equal sets collapse to one node, whatever their doc_ids;
2. in each band bucket every member is paired with one hub only, the member that is in most large buckets;
3. only buckets that still hold several components are looked at again, in blocks of bounded size; pairs from
   different components whose signatures agree well enough are confirmed there, until they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, connected, documents, flat_bytes, mix64, shared_table
from .shingles import shingle_set

EVALUATIONS, ROWS = 64, 4
_MULTIPLY = (mix64(np.arange(1000, 1000 + EVALUATIONS, dtype=np.uint64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix64(np.arange(5000, 5000 + EVALUATIONS, dtype=np.uint64)) >> U64(32)).astype(np.uint32)
_PLACE = mix64(np.arange(77, 77 + ROWS, dtype=np.uint64)) | U64(1)
KEYS = ("n_shingles", "s1", "s2")
#: Members of a part, and parts of a cluster up to which all of them may be compared.
BLOCK, MANY = 512, 16


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima and maxima of the hashes under each permutation, four minima and four maxima by turns: each four are a band."""
    low = np.full(EVALUATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(EVALUATIONS, np.uint32)
    x = (hashes >> U64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for i in range(0, len(x), 4096):
        part = np.multiply.outer(_MULTIPLY, x[i : i + 4096]) + _ADD[:, None]
        part ^= part >> np.uint32(15)
        low = np.minimum(low, part.min(1))
        high = np.maximum(high, part.max(1))
    return np.stack([low.reshape(-1, ROWS), high.reshape(-1, ROWS)], 1).ravel()


def marks(h: np.ndarray) -> tuple[int, int, int]:
    """Size of a set of hashes, and two hashes that stand for the whole set."""
    if not len(h):
        return 0, 0, 0
    return len(h), int(np.add.reduce(mix64(h ^ U64(0xA5A5A5A5))).view(np.int64)), int(np.bitwise_xor.reduce(mix64(h * U64(3) + U64(1))).view(np.int64))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n_shingles, two hashes that stand for the whole set, and the signature (null: no words) of each row (doc_id, mark, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat_bytes(b.column("text"))
            told, sig = [], []
            for i in range(b.num_rows):
                h = shingle_set(data[off[i] : off[i + 1]], width)
                told.append(marks(h))
                sig.append(signature(h).tobytes() if len(h) else None)
            n, s1, s2 = (pa.array([t[k] for t in told], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), n, s1, s2, pa.array(sig, pa.binary())], ["doc_id", "mark", *KEYS, "sig"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, s1 long, s2 long, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    """(bucket, doc): one row for each band of each signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, _ = flat_bytes(b.column("sig").cast(pa.large_binary()))
            x = data.view(np.uint32).reshape(b.num_rows, -1, ROWS).astype(np.uint64)
            key = mix64((x * _PLACE).sum(2) + np.arange(x.shape[1], dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
            doc = np.repeat(b.column("doc").to_numpy(), x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc)], ["bucket", "doc"])

    return reps.select("doc", "sig").mapInArrow(run, "bucket long, doc long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, shingles): the full sets of the nodes in `wanted` (doc, mark, KEYS): of the rows with that mark one whose set has these KEYS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            data, off = flat_bytes(b.column("text"))
            docs, sets = [], []
            for i, (doc, *keys) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", *KEYS)))):
                if doc == last:  # rows that repeat a doc_id and a text follow one another
                    continue
                h = shingle_set(data[off[i] : off[i + 1]], width)
                if marks(h) == tuple(keys):
                    last = doc
                    docs.append(doc)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc", "shingles"])

    found = docs.select("mark", "text").join(wanted.select("doc", "mark", *KEYS).hint("shuffle_hash"), "mark")
    return found.select("doc", "text", *KEYS).sortWithinPartitions("doc").mapInArrow(run, "doc long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) with denominator * |intersection| >= numerator * |union| on full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("sa"), b.column("sb")
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                keep[i] = alike(x, y, numerator, denominator)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    first = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    both = first.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted sets have denominator * |intersection| >= numerator * |union|."""
    least, most = sorted((len(x), len(y)))
    if denominator * least < numerator * most:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return denominator * common >= numerator * (len(both) - common)


def dealt(open_: DataFrame) -> DataFrame:
    """(x, y, side, doc, comp): the members of open buckets (bucket, doc, size, comp) dealt into pairs of parts.

    Documents that buckets connect form a cluster, cut into parts of about BLOCK members. In a cluster of more than MANY parts, which
    chains of unrelated buckets can make, a part is of one home instead: a document's largest bucket. Two parts are compared,
    once, if some bucket has members of both; so every pair that shares a bucket meets in one task, which holds two parts.
    """
    hub = open_.groupBy("bucket").agg(F.min("doc").alias("hub"))
    clusters = connected(open_.join(hub, "bucket").select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    home = open_.groupBy("doc", "comp").agg(F.max_by("bucket", F.struct("size", "bucket")).alias("home"))
    placed = shared_table(home.join(clusters.withColumnRenamed("node", "doc"), "doc", "left").withColumn("cluster", F.coalesce("component", "doc")).drop("component"))
    large = placed.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = placed.join(large, "cluster").withColumn("group", F.when(F.col("n") <= MANY * BLOCK, F.col("cluster")).otherwise(F.xxhash64("cluster", "home"))).drop("n")
    sizes = placed.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.xxhash64("group", F.pmod(F.xxhash64("doc"), "parts")).alias("part")
    parts = shared_table(placed.join(sizes, "group").select("doc", "comp", part))
    seen = open_.select("bucket", "doc").join(parts.select("doc", "part"), "doc").select("bucket", "part").distinct()
    meet = seen.join(seen.withColumnRenamed("part", "y"), "bucket").where("part <= y").select(F.col("part").alias("x"), "y").distinct()
    meet = shared_table(meet)
    left = parts.join(meet, parts.part == meet.x).select("x", "y", F.lit(0).alias("side"), "doc", "comp")
    right = parts.join(meet.where("x <> y"), F.col("part") == F.col("y")).select("x", "y", F.lit(1).alias("side"), "doc", "comp")
    return left.union(right)


def across(members: DataFrame, least: float, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between different components, enough of them to join what is linked, from dealt() members with their
    signatures and full sets (x, y, side, doc, comp, sig, shingles). Pairs that share a band and whose signatures agree on a
    share of `least` or more are confirmed on the full sets in the task."""
    def compare(doc, comp, side, sig, sets):
        root = {c: c for c in set(comp.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        n = np.array([len(x) for x in sets])
        one = np.flatnonzero(side == 0)
        two = one if len(one) == len(side) else np.flatnonzero(side == 1)
        out = []
        for i in range(0, len(one), 256):
            u = one[i : i + 256]
            ok = comp[u, None] != comp[None, two]
            ok &= denominator * np.minimum(n[u, None], n[None, two]) >= numerator * np.maximum(n[u, None], n[None, two])
            if two is one:
                ok &= u[:, None] < two[None]
            p, q = np.nonzero(ok)
            for k in range(0, len(p), 4096):
                v, w = u[p[k : k + 4096]], two[q[k : k + 4096]]
                same = sig[v] == sig[w]
                near = (same.mean(1) >= least) & same.reshape(len(v), -1, ROWS).all(2).any(1)
                for a, b in zip(v[near].tolist(), w[near].tolist()):
                    ra, rb = find(comp[a].item()), find(comp[b].item())
                    if ra != rb and alike(sets[a], sets[b], numerator, denominator):
                        root[max(ra, rb)] = min(ra, rb)
                        out.append(sorted((doc[a].item(), doc[b].item())))
        return out

    def solve(t: pa.Table) -> pa.RecordBatch:
        data, _ = flat_bytes(t.column("sig").combine_chunks().cast(pa.large_binary()))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        out = compare(*(t.column(c).to_numpy() for c in ("doc", "comp", "side")), data.view(np.uint32).reshape(t.num_rows, -1), sets)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            at = np.append(np.flatnonzero(new), len(x))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                if now is not None and now != (x[s], y[s]):
                    yield solve(pa.Table.from_batches(held))
                    held = []
                now = (x[s], y[s])
                held.append(b.slice(s, e - s))
        if held:
            yield solve(pa.Table.from_batches(held))

    return members.repartition("x", "y").sortWithinPartitions("x", "y", "side", "doc").mapInArrow(run, "a long, b long")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text: rows with one mark have the same doc_id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mark"), "text")


def _classes(docs: DataFrame, width: int, numerator: int, denominator: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark and KEYS of each row, and for each set of words that some row has: KEYS, node (its class) and component_id, the smallest
    doc_id of the class."""
    rows = _marked(docs)
    told = shared_table(sketches(rows, width))
    # null ids come last; numbered in the table, so that a task that runs again reads the numbers of the first time
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    reps = told.where("sig is not null").groupBy(*KEYS).agg(F.min_by(F.struct("doc_id", "mark", "sig"), order).alias("r"))
    reps = shared_table(reps.select(F.monotonically_increasing_id().alias("doc"), *KEYS, "r.doc_id", "r.mark", "r.sig"))
    found = bands(reps)
    sizes = found.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = shared_table(found.join(sizes, "bucket"))
    score = members.groupBy("doc").agg(F.sum("size").alias("score"))
    hub = members.join(score, "doc").groupBy("bucket").agg(F.max_by("doc", F.struct(F.col("score"), -F.col("doc"))).alias("hub"))
    stars = members.join(hub, "bucket").where("hub <> doc").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    wanted = reps.select("doc", "mark", *KEYS).join(members.select("doc").distinct(), "doc", "left_semi")
    sets = shared_table(shingle_sets(rows, wanted, width))
    links = shared_table(confirm(stars, sets, numerator, denominator))
    first = shared_table(connected(links))

    seen = members.join(first, members.doc == first.node, "left").select("bucket", "doc", "size", F.coalesce("component", "doc").alias("comp"))
    mixed = seen.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    met = dealt(shared_table(seen.join(mixed, "bucket")))
    full = met.join(reps.select("doc", "sig"), "doc").join(sets, "doc")
    more = shared_table(across(full, least, numerator, denominator))
    component = connected(links.union(more)) if more.take(1) else first

    nodes = reps.select("doc", "doc_id", *KEYS).join(component.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("node", F.coalesce("component", "doc"))
    smallest = nodes.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    return told.drop("sig"), shared_table(nodes.select(*KEYS, "node").join(smallest, "node"))


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 75, denominator: int = 100, least: float = 0.58) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split at ASCII white space; the set of a text is its distinct `width`-word
    shingles, or its whole sequence when it has fewer words. Two documents are linked if
    denominator * |intersection| >= numerator * |union|. Null texts and texts without words have n_shingles 0 and are
    their own component. Each row comes back once and stands for itself, also where rows repeat or texts share a doc_id. A null doc_id is
    never the smallest of a class: the component is null, and kept true, where a class has no other. Extra columns are ignored; an
    empty table gives an empty result.
    least: share of equal signature values below which a pair of different components is not confirmed
    (0.75 less 4.5 standard deviations of 128 values).
    """
    told, classes = _classes(docs, width, numerator, denominator, least)
    out = told.join(classes, list(KEYS), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, width: int = 5, numerator: int = 75, denominator: int = 100, least: float = 0.58) -> DataFrame:
    """One row of each near-duplicate class of documents (doc_id, text), with all its columns: the one with the smallest doc_id, null last. Of
    texts without words, and of rows that repeat a doc_id and a text, one of each doc_id and text stays."""
    told, classes = _classes(docs, width, numerator, denominator, least)
    of = told.where("n_shingles > 0").join(classes, list(KEYS)).select("node", "doc_id", "mark")
    first = of.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("f")).select("node", F.col("f.mark").alias("first"))
    gone = of.join(first, "node").where("mark <> first").select(F.col("mark").alias("__gone")).distinct()
    repeated = told.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    rows = docs.withColumn("__mark", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    left = rows.join(gone, F.col("__mark") == F.col("__gone"), "left_anti")
    if not repeated.take(1):
        return left.drop("__mark")
    return left.dropDuplicates(["__mark"]).drop("__mark")


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
