"""Embedding near-duplicates by counting collisions of sorted one-dimensional projections.

Vectors of one label are projected on random lines. Two kinds of lines are used one after the other:

1. Cells. `depth` lines are cut into equal intervals and make a table of cells; there are `tables` such tables, and only vectors of one
   cell meet. The larger a label is, the more lines a table has and the more tables there are, so that a cell holds about CELL vectors and the
   pairs that meet grow far slower than all pairs: by tables * n * n * (chance that two unlike vectors share a cell). A label of up to
   CELL vectors is one cell: for those, more tables would send more than they save.
2. Windows. In a cell the vectors are sorted on each of LINES other lines; a pair collides on a line if one is in the window of half-width `half`
   around the other. Pairs with at least `count` collisions are verified by their cosine in double precision.

Tables, half-width and count are calibrated so that a pair exactly at the least cosine is lost with a probability under MISS. A pair is
counted in the first table that has it in one cell, so nothing is counted twice and pairs are never made into rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import U64, connected, mix64, shared_table

LINES, MISS, SEED = 32, 1e-6, 5
#: Vectors of a block: two blocks are compared in one task. Vectors that a cell is meant for. Width of the intervals that cells are made of, in
#: which unit vectors spread by 1, and steps that it is measured in.
BLOCK, CELL, INTERVAL, STEPS = 1024, 8192, 1.0, float(1 << 17)


def calibrated(least: float, lines: int = LINES, miss: float = MISS) -> tuple[float, int]:
    """(half, count): window half-width and collisions needed. A pair of unit vectors at cosine `least` is
    sqrt(2 - 2 * least) apart, and its difference on a Gaussian line is normal with that deviation."""
    apart = sqrt(max(1e-12, 2 - 2 * least))
    best = None
    for factor in np.arange(0.5, 3.1, 0.25):
        p = erf(factor / sqrt(2))
        lost, count = 0.0, 0
        while count < lines and lost + (t := comb(lines, count) * p**count * (1 - p) ** (lines - count)) < miss:
            lost, count = lost + t, count + 1
        # chance that a pair at right angles still has `count` collisions
        q = erf(factor * apart / 2)
        wrong = sum(comb(lines, k) * q**k * (1 - q) ** (lines - k) for k in range(count, lines + 1))
        if best is None or wrong < best[0]:
            best = (wrong, factor * apart, count)
    return best[1], best[2]


def directions(width: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, lines))


def shared_interval(apart: float, width: float = INTERVAL) -> float:
    """Chance that two vectors at this distance fall into one interval of a Gaussian line that is cut at random."""
    t = width / apart
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def tables_for(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(depth, tables) for a label of n vectors: lines of a table, and tables so that a pair at the least cosine shares a cell in one of them."""
    near, far = shared_interval(sqrt(max(1e-12, 2 - 2 * least))), shared_interval(sqrt(2))
    depth = max(0, ceil(log(max(1.0, n / CELL)) / -log(far)))
    return (depth, ceil(log(miss) / log(1 - near**depth))) if depth else (0, 1)


def cells(v: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table, as a hash: one column for each table. Components and lines are taken in whole steps of
    1 / STEPS, so the products are whole numbers under 2**53: a vector's cells are the same wherever they are computed."""
    rng = np.random.default_rng(SEED + 1)
    lines = np.rint(rng.standard_normal((v.shape[1], tables * depth)) * STEPS)
    start = np.rint(rng.random(tables * depth) * INTERVAL * STEPS * STEPS)
    place = np.floor((np.rint(v * STEPS) @ lines + start) / (INTERVAL * STEPS * STEPS)).astype(np.int64).view(np.uint64)
    out = np.zeros((len(v), tables), np.uint64)
    for k in range(depth):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + place[:, k::depth])
    return out


def collisions(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """Collision counts of all of x with all of y (projections: one row per vector), by ranks in y's sorted lines."""
    total = np.zeros((len(x), len(y)), np.uint8)
    for line in range(x.shape[1]):
        order = np.argsort(y[:, line], kind="stable")
        on = y[order, line]
        rank = np.empty(len(y), np.uint16)
        rank[order] = np.arange(len(y), dtype=np.uint16)
        low = np.searchsorted(on, x[:, line] - half, "left").astype(np.uint16)
        size = np.searchsorted(on, x[:, line] + half, "right").astype(np.uint16) - low
        total += (rank[None, :] - low[:, None]) < size[:, None]
    return total


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (doubles) of the rows that can link."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where("label is not null and vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return rows.withColumn("v", F.transform("v", lambda c: c + 0.0))  # -0.0 and 0.0 are one value


def unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, float)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links a - b reach."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == was).all():
            return root


def links(distinct: DataFrame, least: float) -> DataFrame:
    """Links of distinct vectors (vec, label, v, copies) at cosine >= least, summed up by block so that a large group of near vectors doesn't
    make its pairs into rows: (a, n) with the number of vectors, copies counted, that a links with, and b, a vector that it is joined
    with by links (or a itself)."""
    half, count = calibrated(least)
    own = distinct.select("label", "vec", "copies", "v", F.size("v").alias("width"))
    sizes = own.groupBy("label", "width").agg(F.count("*").alias("n"))
    sized = own.join(sizes, ["label", "width"])
    columns = own.columns
    schema = StructType(own.schema.fields + [StructField(name, kind) for name, kind in (("depth", IntegerType()), ("tables", IntegerType()), ("t", IntegerType()), ("cell", LongType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each table, with its cell."""
        for b in batches:
            n, width = b.column("n").to_numpy(), b.column("width").to_numpy()
            for w, m in {*zip(width.tolist(), n.tolist())}:
                depth, tables = tables_for(m, least)
                at = np.flatnonzero((width == w) & (n == m))
                for s in range(0, len(at), 2048):
                    part = b.take(pa.array(at[s : s + 2048]))
                    v = unit(part.column("v").to_pylist())
                    cell = cells(v, depth, tables)
                    row = np.repeat(np.arange(len(v)), tables)
                    more = [np.full(len(row), depth, np.int32), np.full(len(row), tables, np.int32), np.tile(np.arange(tables, dtype=np.int32), len(v)), cell.ravel().view(np.int64)]
                    kept = part.select(columns).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, more)], [*columns, "depth", "tables", "t", "cell"])

    met = sized.mapInArrow(deal, schema)
    key = ["label", "width", "t", "cell"]
    full = met.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(full, key).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    # parts of a cell that is too full, each to meet each
    spread = met.withColumn("part", F.pmod(F.xxhash64("vec"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = spread.select(*key, "depth", "tables", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).alias("right"), "vec", "copies", "v")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        same_part = frame["x"].iloc[0] == frame["y"].iloc[0]
        t, depth, tables = (int(frame[c].iloc[0]) for c in ("t", "depth", "tables"))
        v = unit(frame["v"].tolist())
        on, before = v @ directions(v.shape[1]), cells(v, depth, tables)[:, :t]
        ids, right = frame["vec"].to_numpy(), frame["right"].to_numpy(bool)
        left, rest = (np.arange(len(v)),) * 2 if same_part else (np.flatnonzero(~right), np.flatnonzero(right))
        out: list = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(left), 256):
            for j in range(0, len(rest), 2 * BLOCK):
                a, b = left[i : i + 256], rest[j : j + 2 * BLOCK]
                p, q = np.nonzero(collisions(on[a], on[b], half) >= count)
                a, b = a[p], b[q]
                if same_part:
                    a, b = a[a < b], b[a < b]
                near = np.einsum("ij,ij->i", v[a], v[b]) >= least
                a, b = a[near], b[near]
                first = ~(before[a] == before[b]).any(1)  # an earlier table has the others
                out.append(np.stack([a[first], b[first]]))
        a, b = np.concatenate(out, 1)
        copies, n = frame["copies"].to_numpy(), np.zeros(len(v), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        at = np.flatnonzero(n)
        return pd.DataFrame({"a": ids[at], "b": ids[forest(len(v), a, b)[at]], "n": n[at]})

    # without this, the cells' own partitioning would do for Spark, and all parts of a cell come to one task
    return placed.repartition(*key, "x", "y").groupBy(*key, "x", "y").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label).

    Vectors link only within one label (and one width) and at a cosine of at least `least` in double precision. A null label,
    and a vector that is null, empty, zero or has null or non-finite components, links with nothing. Equal vectors
    of a label collapse before any comparison, and count as links of each other. Each row comes back once: rows that repeat a vec_id with its
    label and vector are one vector, which doesn't link with itself; different vectors with one vec_id are different vectors.
    A null vec_id has no links and a null component. Extra columns are ignored; an empty table gives an empty result.
    """
    usable = _usable(vectors)
    # numbered in the table, so that a task that runs again reads the numbers of the first time
    distinct = usable.groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count_distinct("vec_id").alias("copies")).withColumn("vec", F.monotonically_increasing_id())
    distinct = shared_table(distinct)
    # vectors that came as floats travel as such; they are doubles again before anything is computed
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"
    sent = distinct.select("label", F.col("v").cast("array<float>").alias("v") if narrow else "v", "vec", "copies")
    found = shared_table(links(sent, least))
    node = connected(found.select("a", "b")).select(F.col("node").alias("vec"), "component")
    linked = found.groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("other"))
    classes = distinct.select("vec", "least_id", "copies").join(linked, "vec", "left").join(node, "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(smallest, "component").select("vec", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).cast("long").alias("n_links"), "component_id")
    known = distinct.select("label", "v", "vec").join(classes, "vec").drop("vec")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    apart = rows.withColumn("__v", F.when(F.col("vec_id").isNotNull(), F.transform("embedding", lambda c: c.cast("double") + 0.0)))
    out = apart.join(known.select(F.col("label").alias("__label"), F.col("v").alias("__known"), "n_links", "component_id"), (F.col("label") == F.col("__label")) & (F.col("__v") == F.col("__known")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) AS kept
FROM embeddings AS e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS l ON l.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) AS r ON r.a = e.vec_id
"""
