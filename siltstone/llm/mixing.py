"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in shuffled order (by md5 of doc_id), are laid end to end and cut into blocks of equal numbers
of words. Golden-ratio points, mapped through the cumulative slot shares of the sources, give the schedule: slot by slot a
source, so that every prefix of the mix has the target shares within a few slots. A slot's rank within its source names
the block it takes; ranks beyond the last block start the source again (at most three times), and the last slot of a
source takes only the words that are left to its target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_table, small

WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 512
WORD = r"[^\x20\x09-\x0D]+"
#: 2**31 divided by the golden ratio, made odd: slot t is at (t * GOLDEN mod 2**31) / 2**31.
GOLDEN, RANGE = 1327217885, 1 << 31
_CHUNK = 1 << 14


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, none above `most` times its size, the excess reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for at, i in enumerate(order):
        level = left / weight
        if most * sizes[i] / weights[i] >= level:
            for j in order[at:]:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        left, weight = left - most * sizes[i], weight - weights[i]
    return out


def words_of(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_of("text").alias("size"))


def sources_of(rows: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row for each source: source, no, source_size, target, words (to take), slots, blocks.

    The driver holds one row per source, never documents.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("s")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["s"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    out = []
    for i, (r, t) in enumerate(zip(found, goal)):
        words, size = min(int(round(t)), most * r["s"]), r["s"]
        blocks = -(-size // block)
        slots = words // size * blocks + -(-(words % size) // block) if size else 0
        out.append((r["source"], i, size, float(t), words, slots, blocks))
    # as an Arrow table: a list of rows would go through Python workers of another pool on the executors
    kinds = {"source": pa.string(), "no": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "words": pa.int64(), "slots": pa.int64(), "blocks": pa.int64()}
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())], list(kinds)))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, no, rank): the mix in order. Every source gets exactly its slots; the few that the points leave short come last."""
    # Slots and their counts grow with the corpus, though the planner takes what comes from a short range for small: hence the
    # merge hints. sources has one row per source and is on the driver in any case, so it may go to every task.
    spark = sources.sparkSession
    need = np.array([r["slots"] for r in sources.orderBy("no").select("slots").collect()], np.int64)
    total = int(need.sum())
    bounds = np.floor(np.cumsum(need) / max(1, total) * RANGE).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("id").to_pylist():
                slot = np.arange(c * _CHUNK, min((c + 1) * _CHUNK, total), dtype=np.int64)
                no = np.searchsorted(bounds, slot % RANGE * GOLDEN % RANGE, "right").clip(0, len(need) - 1)
                order = np.argsort(no, kind="stable")
                first = np.searchsorted(no[order], no[order], "left")
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - first
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(no.astype(np.int32)), pa.array(rank), pa.array(np.full(len(slot), c))], ["slot", "no", "own", "chunk"])

    drawn = spark.range(-(-total // _CHUNK)).mapInArrow(run, "slot long, no int, own long, chunk long")
    told = drawn.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    before = told.withColumn("before", F.sum("n").over(Window.partitionBy("no").orderBy("chunk")) - F.col("n"))
    ranked = drawn.join(before.select("no", "chunk", "before").hint("merge"), ["no", "chunk"]).select("slot", "no", (F.col("own") + F.col("before")).alias("rank"))
    kept = ranked.join(F.broadcast(sources.select("no", "slots")), "no").where("rank < slots").select("slot", "no", "rank")
    had = told.groupBy("no").agg(F.sum("n").alias("had"))
    short = sources.join(had, "no", "left").where("slots > coalesce(had, 0)").select(F.col("no"), F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    return kept.union(short.select(F.lit(total).cast("long").alias("slot"), "no", "rank"))


def laid_out(rows: DataFrame) -> DataFrame:
    """rows with start: the words of their source before them in shuffled order. Sums by bucket come first, so that no
    window spans a source."""
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("mark", 1, 3))
    by = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inner", F.coalesce(F.sum("size").over(by), F.lit(0)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    b = before.select(F.col("source").alias("s"), F.col("bucket").alias("k"), "before")
    out = own.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    return out.withColumn("start", F.col("inner") + F.col("before")).drop("s", "k", "inner", "before", "bucket", "mark")


def _mixed(docs: DataFrame, weights, most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """mixed() with no, start and blocks of each document's source, and the slots (no, rank, slot)."""
    rows = shared_table(sized(docs))
    sources = sources_of(rows, weights, most, block)
    named = sources.select(F.col("source").alias("s"), "no", "source_size", "target", "words", "blocks")
    placed = laid_out(rows).join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # what each block of each source is taken: whole times, and the words of one clipped last time
    plan = schedule(sources)
    slots = plan.join(F.broadcast(sources.select("no", "source_size", "words", "blocks")), "no")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks"))
    begin = F.expr("(rank div blocks) * source_size") + F.col("block") * block
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slots = slots.withColumn("got", F.least(full, F.col("words") - begin)).withColumn("whole", (F.col("got") == full).cast("long"))
    use = slots.groupBy("no", "block").agg(F.sum("whole").alias("times"), F.max(F.when(F.col("whole") == 0, F.col("got"))).alias("clip"), F.min("slot").alias("slot"))
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    inner = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    length = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block, F.col("start"))
    got = parts.withColumn("inner", inner).withColumn("length", length).join(use.hint("merge"), ["no", "block"], "left")
    each = F.coalesce(F.col("times"), F.lit(0)) * F.col("length") + F.greatest(F.lit(0), F.least(F.col("length"), F.coalesce(F.col("clip"), F.lit(0)) - F.col("inner")))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    own = ["no", "start", "blocks"]
    taken = got.withColumn("each", each).groupBy(*columns, *own).agg(F.sum("each").alias("taken"), F.coalesce(F.min(F.when(F.col("each") > 0, F.col("slot"))), F.lit(-1)).alias("first_slot"))
    rest = placed.where("size = 0").select(*columns, *own, F.lit(0).cast("long").alias("taken"), F.lit(-1).cast("long").alias("first_slot"))
    return taken.unionByName(rest), plan


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix of documents (doc_id, text, source): doc_id, source, size, source_size, target, taken, first_slot: the first slot of the
    schedule that takes words of the document (-1: none does).

    A null text has size 0; a null source is a source of its own, last in order. Repeated rows are taken as documents of
    their own; ties in the shuffled order go by doc_id and size, so reruns agree. Sources without words have target 0. An empty
    table gives an empty result; extra columns are ignored.
    """
    return _mixed(docs, weights, most, block)[0].drop("no", "start", "blocks")


def taken_texts(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The documents that mixed() takes, as often as it takes them, each partition in the order of the schedule's slots: all columns, text whole
    for each whole time, and cut after the words of a last time that takes a part. Rows with equal or null doc_id are matched with what they are taken in
    order of size; n_chars, if there is one, follows the text. A time stands at the slot of the block that the document begins in."""
    # names of its own, for docs may have columns of any name
    names = {"doc_id": "__doc_id", "source": "__source", "size": "__size", "taken": "__taken", "no": "__no", "start": "__start", "blocks": "__blocks"}
    found, plan = _mixed(docs, weights, most, block)
    got = found.select(*[F.col(a).alias(b) for a, b in names.items()])
    got = got.withColumn("__nth", F.row_number().over(Window.partitionBy("__doc_id", "__source").orderBy("__size", "__taken")))
    rows = docs.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy(words_of("text"), "text")))
    match = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__row") == F.col("__nth"))
    times = got.where("__taken > 0").withColumn("__time", F.explode(F.sequence(F.lit(0), F.expr("(__taken - 1) div __size").cast("int"))))
    times = times.withColumn("__rank", F.expr(f"__start div {block} + __time * __blocks"))
    slots = plan.select(F.col("no").alias("__no"), F.col("rank").alias("__rank"), F.col("slot").alias("__slot"))
    times = times.join(slots.hint("merge"), ["__no", "__rank"], "left")
    both = rows.join(times, match)
    words = F.least("__size", F.col("__taken") - F.col("__time") * F.col("__size"))
    rows = both.select(*docs.columns, "__slot", "__start", F.when(words < F.col("__size"), words).alias("__words"))
    # not sorted over all partitions: that would shuffle the texts once more
    rows = rows.sortWithinPartitions(F.asc_nulls_last("__slot"), "__start")
    word, names, schema = re.compile(WORD), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, columns = b.column("text").to_pylist(), {c: b.column(c) for c in names}
            for i, k in enumerate(b.column("__words").to_pylist()):
                if k is not None:
                    texts[i] = texts[i][: next(islice(word.finditer(texts[i]), k - 1, None)).end()]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, schema)


def op10_source_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s
), c AS (
  SELECT *, ((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o
), f AS (
  SELECT min(k) AS k FROM c WHERE 3 * source_size / w >= level
), t AS (
  SELECT c.source, c.source_size,
    CASE WHEN c.k >= f.k THEN (SELECT level FROM c AS x WHERE x.k = f.k) * c.w ELSE 3.0 * c.source_size END::DOUBLE AS target
  FROM c, f
), u AS (
  SELECT source, source_size, target, round_even(target, 0)::BIGINT AS words, (source_size + 511) // 512 AS blocks FROM t
), n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no,
    CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * blocks + (words % source_size + 511) // 512 END AS slots FROM u
), g AS (
  SELECT no, slots, floor(sum(slots) OVER (ORDER BY no) / (SELECT sum(slots) FROM n) * 2147483648)::BIGINT AS bound FROM n
), z AS (  -- slot t belongs to the source whose share of the cumulative weights the t-th golden-ratio point falls into
  SELECT t, least((SELECT count(*) FROM g WHERE bound <= point), (SELECT max(no) FROM n)) AS no
  FROM (SELECT t, t % 2147483648 * 1327217885 % 2147483648 AS point FROM range((SELECT sum(slots)::BIGINT FROM n)) AS r(t))
), r AS (
  SELECT no, t, row_number() OVER (PARTITION BY no ORDER BY t) - 1 AS rank FROM z
), k AS (
  SELECT no, rank, t AS slot FROM r
), p AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.words, n.no, n.slots,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), q AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END::BIGINT AS taken FROM p
)
SELECT q.doc_id, q.size, q.source_size, q.target, q.taken,
  CASE WHEN taken > 0 THEN coalesce((SELECT k.slot FROM k WHERE k.no = q.no AND k.rank = q.start // 512 AND k.rank < q.slots), (SELECT sum(slots) FROM n)) ELSE -1 END::BIGINT AS first_slot
FROM q
"""
