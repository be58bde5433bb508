"""Scalar functions over binary columns: counts, k-mers and hashes, as vectorised Arrow functions; and expressions in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary or string column end to end, and their offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def per_payload(df: DataFrame, keep: str | tuple[str, ...], solve: Callable[[np.ndarray], list[tuple] | tuple], schema: str) -> DataFrame:
    """Rows that solve() makes of each payload's bytes (content), with its `keep` column (or columns) before them. solve() returns a list of
    rows or, for many rows, a tuple of equally long columns."""
    names, keep = [part.split()[0] for part in schema.split(",")], (keep,) if isinstance(keep, str) else tuple(keep)
    kinds = ", ".join(f"{name} {dict(df.dtypes)[name]}" for name in keep)
    made = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in made.fields]
        for b in batches:
            data, off = flat(b.column("content"))
            parts, at, n = [[] for _ in names], [], 0
            for i in range(b.num_rows):
                new = solve(data[off[i] : off[i + 1]])
                columns = new if isinstance(new, tuple) else list(zip(*new)) or [[] for _ in names]
                size = len(columns[0])
                if size:
                    for part, c, kind in zip(parts, columns, arrow):
                        part.append(pa.array(c, kind))
                    at.append((i, size))
                    n += size
                if n > 100_000:
                    yield batch(b, at, parts, arrow)
                    parts, at, n = [[] for _ in names], [], 0
            yield batch(b, at, parts, arrow)

    def batch(b, at, parts, arrow):
        rows = pa.array(np.repeat(*np.array(at, np.int64).reshape(-1, 2).T))
        arrays = [pa.concat_arrays(part) if part else pa.array([], kind) for part, kind in zip(parts, arrow)]
        return pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in keep), *arrays], [*keep, *names])

    return df.select(*keep, "content").mapInArrow(run, f"{kinds}, {schema}")


def per_run(df: DataFrame, solve: Callable[[np.ndarray, np.ndarray], tuple], schema: str, size: int = 4 << 20) -> DataFrame:
    """Columns that solve() makes of all payloads (content) of a run of about `size` bytes, end to end, and their offsets."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("content"))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
                columns = solve(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                i = j

    return df.select("content").mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_counts(content: pd.Series) -> pd.Series:
    """How often each of the 256 byte values is in a payload."""
    return content.map(lambda b: np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256).astype(np.int32))


def strided_counts(target: int) -> Callable:
    """Byte counts of a sample: every ((n >> target) | 1)-th byte."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counts(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.bincount(np.frombuffer(b or b"", np.uint8)[:: (len(b or b"") >> target) | 1], minlength=256).astype(np.int32))

    return counts


@F.pandas_udf(T.LongType())
def checksum32(content: pd.Series) -> pd.Series:
    """The frame checksum: the low 32 bits of XXH64 with seed 0."""
    return content.map(lambda b: xxhash.xxh64_intdigest(b, seed=0) & 0xFFFFFFFF, na_action="ignore")


@F.pandas_udf(T.LongType())
def dictionary_id(content: pd.Series) -> pd.Series:
    """The id a trained dictionary gets from its content: XXH64 folded to 2**15 up to 2**31 - 1."""
    return content.map(lambda b: xxhash.xxh64_intdigest(b, seed=0) % ((1 << 31) - (1 << 15)) + (1 << 15), na_action="ignore")


@F.pandas_udf(T.IntegerType())
def common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the common prefix of two payloads."""
    def one(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        odd = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(odd[0]) if len(odd) else n

    return pd.Series([one(x or b"", y or b"") for x, y in zip(a, b)])


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """All k-byte substrings (k up to 8) as little-endian numbers."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = data[:n].astype(np.uint64)
    for i in range(1, k):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def distinct(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda c: c > 0))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)


def entropy_bits(counts: Column) -> Column:
    """Order-0 entropy of a histogram, in bits for all symbols together."""
    n = total(counts)
    parts = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.when(n > 0, n * F.log2(n) - parts).otherwise(F.lit(0.0))


def bit_length(value: Column) -> Column:
    """Bits of a positive number; exact at powers of two, unlike a logarithm."""
    return F.length(F.bin(value))
