"""Exact repeated-substring removal by blockwise suffix sorting with a difference cover.

Which bytes are covered by a WINDOW-byte string that starts earlier is decided in three steps.

1. Blocks. Every window is assigned to its anchor, the GRAM-byte substring with the least hash in it, so equal windows have
   equal anchors at equal places. Windows in a row with one anchor form a region. A shuffle on (anchor hash, region hash) puts
   equal regions together: all but the first go whole. That is settled by 128 bits of hash: among n regions two different ones are taken for
   equal with a probability of n * n / 2**129, 1e-12 for those of a petabyte. Regions that share an anchor with a different region form a block;
   other text (most of it) is never sent. The windows of anchors with many different regions are settled one by one by
   their 128-bit hashes, in a stream, so that no block grows with the corpus.
2. Suffix sorting. The suffixes of a block that start a window are sorted one bucket at a time: by their first PERIOD
   bytes, and where those tie by the ranks of the suffixes at the difference-cover positions, which are computed before
   and once for all. The cover has 6 of 31 residues, so a task keeps long keys for a fifth of its positions only.
   Neighbours that agree on WINDOW bytes form a class; all but its first member go.
3. The removed intervals meet their documents in a join on doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, documents, flat_bytes, mix64, shared_table
from .shingles import _SYMBOL, powers

WINDOW, GRAM = 100, 36
SPAN = WINDOW - GRAM + 1
#: A difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Different regions of one anchor above which its windows are settled by hashes; windows of a bucket; bytes of a block in memory.
HOT, BUCKET, BLOCK = 256, 1 << 17, 4 << 20
#: Parts that the regions of an anchor are dealt to.
SALTS = 256
_CHUNK = 1 << 18
_POS = U64((1 << 19) - 1)
_LEVELS = mix64(np.arange(301, 308, dtype=np.uint64)) | U64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all GRAM-byte (36) substrings."""
    h, four = _SYMBOL[data], None
    for level in range(5):
        step = 1 << level
        h = h[:-step] * _LEVELS[level] + h[step:]
        if step == 2:
            four = h
    return mix64(h[: len(h) - 4] * _LEVELS[5] + four[32:])


def regions(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, region hash, anchor place, first and last window start of each region of one text."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    h = gram_hashes(data)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    low = key
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    at = (np.minimum(low[:-1], key[SPAN - 1 :]) & _POS).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n) - 1
    up, down = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    p = at[first]
    region = mix64((total[last + SPAN] - total[first]) * down[first] + ((p - first) << 8 | (last - first)).astype(np.uint64))
    return h[p], region, p, first, last


def _regions(docs: DataFrame) -> DataFrame:
    """(h, g, doc, loc): loc packs the anchor's place, its distance from the first start, and the number of starts less 1. Regions that
    are equal to an earlier one of the same batch are repeats already and carry ~loc: they needn't meet the others, so a batch
    sends one row for each distinct region to its anchor, however often a line, or a word in one document, is repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy()
            data, off = flat_bytes(b.column("text"))
            out, rows = [[], [], []], 0
            for i in range(b.num_rows):
                own = data[off[i] : off[i + 1]]
                for at in range(0, len(own), _CHUNK):
                    h, g, p, first, last = regions(own[at : at + _CHUNK + WINDOW - 1])
                    if len(h):
                        out[0].append(np.stack([h, g], 1))
                        out[1].append(np.full(len(h), ids[i]))
                        out[2].append((p + at) << 16 | (p - first) << 8 | (last - first))
                        rows += len(h)
                if rows > 200_000:
                    yield packed(out)
                    out, rows = [[], [], []], 0
            if rows:
                yield packed(out)

    def packed(out):
        hg, doc, loc = np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])
        order = np.lexsort((loc, doc, hg[:, 1] ^ hg[:, 0]))
        a, b = order[1:], order[:-1]
        same = (hg[a] == hg[b]).all(1)
        # a repeated row of one document is not a repeat of itself: such rows stay as they are
        first = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(order))))
        itself = (doc[order] == doc[order[first]]) & (loc[order] == loc[order[first]])
        gone = order[np.append(False, same) & ~itself]
        loc[gone] = ~loc[gone]
        hg = hg.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hg[:, 0])), pa.array(np.ascontiguousarray(hg[:, 1])), pa.array(doc), pa.array(loc)], ["h", "g", "doc", "loc"])

    return docs.mapInArrow(run, "h long, g long, doc long, loc long")


def _sift(found: DataFrame) -> DataFrame:
    """Rows to go (kind 0) and first rows of each of several regions with one anchor (kind 1).

    Regions are dealt by their anchor and SALTS remainders of their hash, so a common anchor is spread over as many tasks. Rows with equal hashes
    meet there. Which anchors have several regions is then told by what each of these parts has: several, or a single one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last anchor so far: h, g, its first row's (doc, loc), whether it has several regions, the last row's doc and loc

        def rows(h, doc, loc, kind):
            n = np.full(len(h), kind, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(loc), pa.array(n)], ["h", "doc", "loc", "kind"])

        def one(kind):
            return rows(np.array([tail[0]]), np.array([tail[2][0]]), np.array([tail[2][1]]), kind)

        for b in batches:
            if not b.num_rows:
                continue
            h, g, doc, loc = (b.column(c).to_numpy() for c in ("h", "g", "doc", "loc"))
            if (known := loc < 0).any():
                yield rows(h[known], doc[known], ~loc[known], 0)
                h, g, doc, loc = (x[~known] for x in (h, g, doc, loc))
                if not len(h):
                    continue
            new_h = np.append(True, h[1:] != h[:-1])
            new_g = new_h | np.append(True, g[1:] != g[:-1])
            if tail is not None:
                new_h[0] = h[0] != tail[0]
                new_g[0] = new_h[0] or g[0] != tail[1]
            gone = ~new_g
            # a repeated row of one document is not a repeat of itself
            gone[1:] &= (doc[1:] != doc[:-1]) | (loc[1:] != loc[:-1])
            gone[0] &= tail is None or doc[0] != tail[4] or loc[0] != tail[5]
            yield rows(h[gone], doc[gone], loc[gone], 0)
            # an anchor has several regions if some row starts a region but not an anchor; group 0 goes on from the batch before
            group = np.cumsum(new_h)
            several = np.zeros(group[-1] + 1, bool)
            several[group[new_g & ~new_h]] = True
            had = not new_h[0] and tail[3]
            if tail is not None and not tail[3]:
                if not several[0] and (new_h[0] or group[-1]):
                    yield one(2)
                elif several[0]:
                    yield one(1)
                    yield one(3)
            ask = new_g & (several[group] | (had & (group == 0)))
            yield rows(h[ask], doc[ask], loc[ask], 1)
            last = group[-1]
            begin = np.flatnonzero(new_h)
            begin_several = several[group[begin]]
            at = begin[begin_several]
            yield rows(h[at], doc[at], loc[at], 3)
            at = begin[~begin_several & (group[begin] != last)]
            yield rows(h[at], doc[at], loc[at], 2)
            if last == 0:
                tail = (h[-1], g[-1], tail[2], had or bool(several[0]), doc[-1], loc[-1])
            else:
                tail = (h[-1], g[-1], (doc[begin[-1]], loc[begin[-1]]), bool(several[last]), doc[-1], loc[-1])
        if tail is not None and not tail[3]:
            yield one(2)

    part = F.xxhash64("h", F.pmod(F.col("g"), F.lit(SALTS)))
    dealt = found.repartition(F.when(F.col("loc") < 0, F.xxhash64("doc", "loc")).otherwise(part)).sortWithinPartitions("h", "g", "doc", "loc")
    told = dealt.mapInArrow(run, "h long, doc long, loc long, kind int")
    # of one anchor there are SALTS of these at most
    single = told.where("kind >= 2").withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1 and kind = 2")
    return told.where("kind < 2").union(single.select("h", "doc", "loc", F.lit(1).alias("kind")))


def cover_ranks(text: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Ranks, at the cover positions of text that are inside a region, of the WINDOW bytes from there (0 elsewhere)."""
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(inside)) % PERIOD] & inside)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[at])
    key = rows.view(f"S{WINDOW}").ravel()
    order = np.argsort(key, kind="stable")
    ranks = np.zeros(len(inside), np.int64)
    ranks[at[order]] = np.cumsum(np.append(True, key[order][1:] != key[order][:-1]))
    return ranks


def repeated_windows(group: np.ndarray, order: np.ndarray, anchor: np.ndarray, count: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """For each region (texts[i] with `count` windows, anchor at `anchor` in it): which windows are not the first of their kind
    among the regions of the same group. order: rank of the region's (document, place); equal windows have the same
    place relative to the anchor, so the region that is first has the first window."""
    skip = -anchor % PERIOD  # anchors come to stand at residue 0
    size = np.array([len(t) for t in texts]) + WINDOW
    size += (-(size + skip)) % PERIOD + skip
    begin = np.cumsum(size) - size + skip
    text = np.zeros(int(size.sum()) + WINDOW, np.uint8)
    inside = np.zeros(int(size.sum()), bool)
    for s, t in zip(begin, texts):
        text[s : s + len(t)] = np.frombuffer(t, np.uint8)
        inside[s : s + len(t)] = True
    ranks = cover_ranks(text, inside)
    ahead = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
    gone = np.zeros(int(count.sum()), bool)
    base = np.cumsum(count) - count
    view = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    # buckets: whole groups in a row
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    s = 0
    while s < len(group):
        e = int(ends[np.searchsorted(ends, s, "right")])
        while e < len(group) and count[s : (n := int(ends[np.searchsorted(ends, e, "right")]))].sum() <= BUCKET:
            e = n
        own = np.repeat(np.arange(s, e), count[s:e])
        k = np.arange(len(own)) - np.repeat(base[s:e] - base[s], count[s:e])
        at = begin[own] + k
        place = anchor[own] - k  # distance to the anchor
        words = view[at, :32].copy()
        words[:, PERIOD] = 0
        words = words.view(">u8").astype(np.uint64)
        tie = ranks[at + ahead[at % PERIOD]]
        sort = np.lexsort((tie, words[:, 3], words[:, 2], words[:, 1], words[:, 0], place, group[own]))
        a, b = sort[:-1], sort[1:]
        same = (group[own[a]] == group[own[b]]) & (place[a] == place[b]) & (words[a] == words[b]).all(1)
        near = np.flatnonzero(same)
        for i in range(0, len(near), 1 << 16):
            x = near[i : i + (1 << 16)]
            same[x] = (view[at[a[x]], PERIOD:] == view[at[b[x]], PERIOD:]).all(1)
        start = np.flatnonzero(np.append(True, ~same))
        rank = order[own[sort]]
        first = np.minimum.reduceat(rank, start)
        gone[base[s] + sort] = rank != np.repeat(first, np.diff(np.append(start, len(sort))))
        s = e
    return np.split(gone, base[1:])


_CUT = "kind int, key long, rest long, doc long, start long, anchor int, count int, bytes binary"


def _first_windows(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which windows of a batch are the first of their hash, and the runs (doc, start, count) of those that repeat an earlier one."""
    order = np.lexsort((start, doc, hashes[:, 1], hashes[:, 0]))
    new = np.append(True, (hashes[order[1:]] != hashes[order[:-1]]).any(1))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = order[(doc[order] != doc[first]) | (start[order] != start[first])]
    gone = gone[np.lexsort((start[gone], doc[gone]))]
    d, s = doc[gone], start[gone]
    begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1))) if len(s) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(s))[: len(begin)] - 1
    return order[new], (d[begin], s[begin], s[end] - s[begin] + 1)


def _cut(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The text of the regions asked for (doc, asks of h, loc, hot), by kind.

    1: a region of an anchor that has few, key its hash. 2: one window of a hot anchor, (key, rest) the 128-bit hash of its bytes; a batch
    sends the first of each hash only. 0: `count` windows from start that repeat one of the same batch, without a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc").to_numpy()
            data, off = flat_bytes(b.column("text"))
            out: list[list] = [[] for _ in range(6)]
            hot: tuple[list, list, list] = ([], [], [])
            rows = 0
            for i, asks in enumerate(b.column("asks").to_pylist()):
                own = data[off[i] : off[i + 1]].tobytes()
                for x in asks:
                    p, back, n = x["loc"] >> 16, x["loc"] >> 8 & 255, x["loc"] & 255
                    a = p - back
                    if not x["hot"]:
                        for col, v in zip(out, (x["h"], ids[i], a, back, n + 1, own[a : a + n + WINDOW])):
                            col.append(v)
                        continue
                    # equal windows have equal anchors, so their hash alone is the key
                    hot[0].append(b"".join([hashlib.blake2b(own[k : k + WINDOW], digest_size=16).digest() for k in range(a, a + n + 1)]))
                    hot[1].append(np.full(n + 1, ids[i]))
                    hot[2].append(np.arange(a, a + n + 1))
                    rows += n + 1
                    if rows > 400_000:
                        yield from windows(hot)
                        hot, rows = ([], [], []), 0
                if len(out[0]) > 20_000:
                    yield texts(out)
                    out = [[] for _ in out]
            if out[0]:
                yield texts(out)
            if rows:
                yield from windows(hot)

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["kind", "key", "rest", "doc", "start", "anchor", "count", "bytes"]

    def batch(kind, n, key, rest, doc, start, anchor, count, text):
        columns = (np.full(n, kind), key, rest, doc, start, anchor, count, text)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def texts(out):
        key, doc, start, anchor, count, text = out
        return batch(1, len(key), key, None, doc, start, anchor, count, text)

    def windows(hot):
        hashes = np.frombuffer(b"".join(hot[0]), np.int64).reshape(-1, 2)
        doc, start = np.concatenate(hot[1]), np.concatenate(hot[2])
        first, (d, s, n) = _first_windows(hashes, doc, start)
        yield batch(2, len(first), hashes[first, 0], hashes[first, 1], doc[first], start[first], None, None, None)
        if len(d):
            yield batch(0, len(d), None, None, d, s, None, n, None)

    return docs.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "asks").mapInArrow(run, _CUT)


def _resolve(cut: DataFrame) -> DataFrame:
    """(doc, s, e): the intervals that step 2 removes."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        key, doc, start, anchor, count = (t.column(c).to_numpy() for c in ("key", "doc", "start", "anchor", "count"))
        order, by = np.empty(len(key), np.int64), np.lexsort((start + anchor, doc))
        place = (start + anchor)[by]
        order[by] = np.cumsum(np.append(True, (doc[by][1:] != doc[by][:-1]) | (place[1:] != place[:-1])))
        found = [np.zeros((0, 3), np.int64)]
        many = np.append(key[1:] == key[:-1], False)
        many[1:] |= many[:-1].copy()
        at = np.flatnonzero(many)
        if len(at):
            texts = [x.as_py() for x in t.column("bytes").take(pa.array(at))]
            for i, gone in zip(at, repeated_windows(key[at], order[at], anchor[at].astype(np.int64), count[at].astype(np.int64), texts)):
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                if len(edge):
                    found.append(np.stack([np.full(len(edge), doc[i]), start[i] + edge[:, 0], start[i] + edge[:, 1] - 1 + WINDOW], 1))
        out = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(3)], ["doc", "s", "e"])

    def spans(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s), pa.array(e)], ["doc", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        tail = None  # of the last window so far: its hash, and (doc, start) of the first window with that hash
        for b in batches:
            one, two = np.searchsorted(b.column("kind").to_numpy(), (1, 2))
            if one:
                doc, start, count = (b.column(c).slice(0, one).to_numpy() for c in ("doc", "start", "count"))
                yield spans(doc, start, start + count - 1 + WINDOW)
            if two < b.num_rows:
                key, rest, doc, start = (b.column(c).slice(two).to_numpy() for c in ("key", "rest", "doc", "start"))
                new = np.append(True, (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]))
                new[0] = tail is None or (key[0], rest[0]) != tail[:2]
                at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                of, begun = (np.where(at >= 0, c[at], c[0] if tail is None else t) for c, t in ((doc, tail and tail[2]), (start, tail and tail[3])))
                gone = (doc != of) | (start != begun)
                yield spans(doc[gone], start[gone], start[gone] + WINDOW)
                tail = (key[-1], rest[-1], of[-1], begun[-1])
            if one == two:
                continue
            t = pa.Table.from_batches([b.slice(one, two - one)])
            held = t if held is None else pa.concat_tables([held, t])
            if held.nbytes < BLOCK:
                continue
            key = held.column("key").to_numpy()
            cut_at = int(np.searchsorted(key, key[-1]))
            if cut_at:
                yield solve(held.slice(0, cut_at))
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = cut.repartition(F.when(F.col("kind") == 0, F.xxhash64("doc", "start")).otherwise(F.col("key"))).sortWithinPartitions("kind", "key", "rest", "doc", "start")
    return dealt.mapInArrow(run, "doc long, s long, e long")


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc, s, e): byte intervals covered by repeats, from documents (doc, text); they may overlap."""
    sifted = shared_table(_sift(_regions(docs)))
    asks = sifted.where("kind = 1")
    hot = asks.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot"))
    # the asks of a common anchor meet its row in as many tasks as there are salts
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    spread = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asks.withColumn("salt", salt).join(spread, ["h", "salt"], "left").groupBy("doc").agg(F.collect_list(F.struct("h", "loc", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asks"))
    first = F.expr("shiftright(loc, 16) - (shiftright(loc, 8) & 255)")
    whole = sifted.where("kind = 0").select("doc", first.alias("s"), (first + F.expr("loc & 255") + WINDOW).alias("e"))
    return whole.union(_resolve(_cut(docs, asked)))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, text) with a doc for each distinct (doc_id, text), in the order of doc_id with nulls first; and each doc once.

    Where every row has its own doc_id, that is doc. Else the distinct (doc_id, SHA-256 of the text) are sorted and numbered."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, known = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.when(F.col("doc_id").isNotNull(), 1))).first()
    if (n or 0) == (known or 0):
        own = rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
        return own, own
    rows = rows.withColumn("mark", F.coalesce(F.sha2("text", 256), F.sha2(F.lit(""), 256)))
    # ids by partition and row follow the sort
    ids = shared_table(rows.select("doc_id", "mark").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "mark").withColumn("doc", F.monotonically_increasing_id()))
    ids = ids.select("doc", F.col("doc_id").alias("i"), F.col("mark").alias("m"))
    own = rows.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("doc", "doc_id", "text")
    return own, own.dropDuplicates(["doc"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) less every byte covered by a WINDOW-byte string that starts earlier (smaller doc_id, or
    the same document and an earlier start): doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Null and empty texts, and texts shorter than WINDOW bytes, lose nothing. A null doc_id comes before all others. Rows that
    repeat a doc_id and its text are one document: none of them is a repeat of the other. Different texts with one doc_id, or with
    none, are different documents, in the order of their SHA-256. Extra columns are ignored.
    """
    base, once = _numbered(docs)
    gaps = repeated_intervals(once.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("gaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat_bytes(b.column("text"))
            removed, spans, kept = [], [], []
            gaps = b.column("gaps")
            ends = gaps.values if not isinstance(gaps, pa.ChunkedArray) else gaps.combine_chunks().values
            s_all, e_all = ends.field("s").to_numpy(), ends.field("e").to_numpy()
            at = gaps.offsets.to_numpy()
            for i in range(b.num_rows):
                own = data[off[i] : off[i + 1]]
                s, e = s_all[at[i] : at[i + 1]], e_all[at[i] : at[i + 1]]
                depth = np.zeros(len(own) + 1, np.int32)
                np.add.at(depth, s, 1)
                np.add.at(depth, e, -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = base.join(gaps.hint("shuffle_hash"), "doc", "left")
    return both.select("doc_id", "text", "gaps").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark, sf_dir):
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
