"""SpotSigs: document fingerprints from chains of content words that follow common words.

Every occurrence of an anchor (a very common word) and the CHAIN content words after it make a spot signature; in stretches of
more than GAP words without an anchor (tables, lists, other languages) each word is one. The multiset of a text's
signatures (the k-th occurrence of one is an element of its own), as sorted 32-bit hashes in hex, is its fingerprint. They
are compared by Jaccard similarity; sets of too different length need not be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, documents, mix64, partitions
from .shingles import word_hashes

CHAIN, GAP = 2, 10
#: Bits of the hash by which documents without an id are dealt into ranges.
NULLS = 6
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or said she so that the their there they this to was we were which who will with would you "
    "am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind um und von war wie wird zu zum zur über "
    "au aux avec ce ces dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous à "
    "al como con del el ella ellos era esta este está ha la las lo los más me mi muy no o para pero por se sin sobre su sus también te una y ya"
)
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ANCHORS = np.sort(np.concatenate([word_hashes(np.frombuffer(w.encode(), np.uint8)) for w in dict.fromkeys(ANCHORS.split())]))
_PLACE = mix64(np.arange(900, 902 + CHAIN, dtype=np.uint64)) | U64(1)


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit spot signatures of a text, none without words. Chains that the end of the text cuts off count as
    they are, so that every text with words has some."""
    w = word_hashes(np.frombuffer(text.encode().translate(_SPACED), np.uint8))
    if not len(w):
        return np.zeros(0, np.uint32)
    at = np.arange(len(w))
    common = _ANCHORS[np.searchsorted(_ANCHORS, w).clip(0, len(_ANCHORS) - 1)] == w
    since = at - np.maximum.accumulate(np.where(common, at, -GAP - 1))
    spots, content = np.flatnonzero(common | (since > GAP)), np.append(w[~common], np.zeros(CHAIN, np.uint64))
    after = np.searchsorted(np.flatnonzero(~common), spots, "right")
    h = w[spots] * _PLACE[0]
    for i in range(CHAIN):
        h = h + content[after + i] * _PLACE[i + 1]
    h.sort()
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), at, 0))
    return np.unique((mix64(h + (at - first).astype(np.uint64) * _PLACE[-1]) >> U64(32)).astype(np.uint32))


def to_hex(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 at once if their lengths rule out `least`. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of documents (doc_id, text); null text is empty and has the empty fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [to_hex(signatures(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def similar(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints with Jaccard similarity `least` or more; a < b are the smallest doc_ids
    that have them. Copies share a fingerprint and are not expanded.

    Fingerprints are partitioned by set length: lengths from 1 on are cut at powers of 1 / least, so that similar sets are in
    the same or in neighbouring partitions. Within those, sets meet only if they share one of the first few signatures
    in order of rising frequency, since similar sets must; the others are pruned without being compared.
    """
    sets = prints.where("fingerprint <> '' and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc"))
    sets = sets.withColumn("n", (F.length("fingerprint") / 8).cast("int")).withColumn("part", F.floor(F.log("n") / F.log(F.lit(1 / least))).cast("int"))
    one = sets.select("doc", "n", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("fingerprint"), (i * 8 + 1).cast("int"), F.lit(8)))).alias("sig"))
    common = one.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = one.join(common, "sig").groupBy("doc", "n", "part").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    # of n signatures ceil(least * n) must be shared; those that occur once can't be
    first = ranked.withColumn("most", F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1 - (F.col("n") - F.size("sigs"))).where("most > 0")
    first = first.select("doc", "n", "part", F.explode(F.slice("sigs", F.lit(1), F.col("most").cast("int"))).alias("s")).select("doc", "n", "part", F.col("s.sig").alias("sig"))
    left = first.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"))
    right = first.select("sig", "part", F.col("doc").alias("y"), F.col("n").alias("ny"))
    meet = left.join(right, ["sig", "part"]).where("(px < part or x < y) and x <> y and least(nx, ny) >= %r * greatest(nx, ny)" % least)
    pairs = meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    own = sets.select("doc", "fingerprint")
    full = pairs.join(own.select(F.col("doc").alias("a"), F.col("fingerprint").alias("fa")), "a").join(own.select(F.col("doc").alias("b"), F.col("fingerprint").alias("fb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = np.array([jaccard(*(np.frombuffer(bytes.fromhex(v.as_py()), ">u4") for v in (x, y)), least) for x, y in zip(b.column("fa"), b.column("fb"))], float)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(like)], ["a", "b", "likeness"]).filter(pa.array(like >= least))

    return full.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long, likeness double")


def with_next(docs: DataFrame) -> DataFrame:
    """grp, last, doc_id, h, text: documents dealt into ranges of doc_id (falling, null last, in NULLS ranges of h, the text's hash), each range
    followed by a copy of the first document of the next one (last = 1), the last range by the first document of all. Only ids and hashes at
    the borders of ranges come to the driver, no more than there are ranges."""
    spark, n = docs.sparkSession, 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.002)})

    def told(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """range, doc_id (or the hash) and whether it is the hash, of each row."""
        null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids, h = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
        at = len(cuts) - np.searchsorted(np.array(cuts, np.int64), ids, "right")
        return np.where(null, len(cuts) + 1 + (h >> (64 - NULLS)) + (1 << NULLS - 1), at).astype(np.int32), np.where(null, h, ids), null

    def ranges(batches):
        for b in batches:
            at, key, null = told(b)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.where(null, -1 - key, key))], ["grp", "first"])  # hashes rise

    heads = rows.select("doc_id", "h").mapInArrow(ranges, "grp int, first long").groupBy("grp").agg(F.max("first").alias("first")).collect()
    order = sorted((r["grp"], r["first"]) for r in heads)
    to = {own: order[k - 1][0] for k, (own, _) in enumerate(order)}
    head = dict(order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key, null = told(b)
            guest = np.array([head[g] for g in at.tolist()], np.int64) == np.where(null, -1 - key, key)
            rows = np.concatenate([np.arange(len(at)), np.flatnonzero(guest)])
            grp = np.concatenate([at, np.array([to[g] for g in at[guest].tolist()], np.int32)])
            last = np.concatenate([np.zeros(len(at), np.int32), np.ones(int(guest.sum()), np.int32)])
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(last), *(taken.column(c) for c in ("doc_id", "h", "text"))], ["grp", "last", "doc_id", "h", "text"])

    dealt = rows.mapInArrow(deal, "grp int, last int, doc_id long, h long, text string").repartition("grp")
    return dealt.sortWithinPartitions("grp", "last", F.desc_nulls_last("doc_id"), "h", "text")


def edited(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) next to an edited text and to the next document in falling order of doc_id.

    The last floor(n_chars / 3) code points are replaced by the first as many (or all) of the next document; after the
    last comes the first. Null text is empty; null doc_ids come after all others, in order of the text's xxhash64, equal ids in order of text. Returns
    doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. A single document is its own next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, done = None, None  # the row before, and the group whose guest was used

        for b in batches:
            out: list[list] = [[] for _ in names]
            for grp, last, i, text in zip(*(b.column(c).to_pylist() for c in ("grp", "last", "doc_id", "text"))):
                text = text or ""
                if last and done == grp:
                    continue
                sigs = signatures(text)
                if held is not None and held[0] == grp:
                    _, own_id, own, own_sigs = held
                    cut = len(own) // 3
                    new = own[: len(own) - cut] + text[:cut]
                    new_sigs = signatures(new) if cut else own_sigs
                    for col, v in zip(out, (own_id, len(own), new, to_hex(own_sigs), to_hex(new_sigs), jaccard(own_sigs, new_sigs), jaccard(own_sigs, sigs))):
                        col.append(v)
                held = (grp, i, text, sigs)
                if last:
                    held, done = None, grp
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_document_fingerprints(spark, sf_dir):
    out = edited(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
