"""Inspection of Zstandard-format frames: headers, blocks, totals and errors, without decoding.

A file or payload is a run of frames and skippable frames. The walk over it is a small loop per row; headers are fields of
a struct, and everything above (totals, bounds, verdicts) is grouped with built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bytesfn import per_payload

# Fixed values (RFC 8878): frame magic, skippable frame magics, block size limit; magics of other formats.
MAGIC, SKIPPABLE, BLOCK_MAX = 0xFD2FB528, 0x184D2A50, 128 << 10
FOREIGN = {"1F8B": "gzip", "FD377A58": "xz", "04224D18": "lz4"}
FRAME = "frame_no int, byte_offset long, kind string, header_size int, compressed_size long, content_size decimal(20,0), window_size long, dict_id long, has_checksum boolean, single_segment boolean, n_blocks int, error string"
BLOCKS = "frame_no int, block_no int, last boolean, block_type string, stored_size int, byte_offset long"
_TYPES = ("raw", "rle", "compressed", "reserved")


def _header(b: bytes, at: int) -> tuple:
    """(error, header size, window, dictionary id, content size, checksum, single segment) of the frame at `at`."""
    if len(b) < at + 5:
        return ("truncated header",)
    d = b[at + 4]
    if d & 8:
        return ("reserved bit",)
    single, flag = bool(d & 32), d >> 6
    dict_bytes, size_bytes = (0, 1, 2, 4)[d & 3], (1 if single else 0, 2, 4, 8)[flag]
    size = 5 + (not single) + dict_bytes + size_bytes
    if len(b) < at + size:
        return ("truncated header",)
    p = at + 5
    window = None
    if not single:
        base = 1 << (10 + (b[p] >> 3))
        window = base + base // 8 * (b[p] & 7)
        p += 1
    dict_id = int.from_bytes(b[p : p + dict_bytes], "little")
    p += dict_bytes
    content = int.from_bytes(b[p : p + size_bytes], "little") + (256 if size_bytes == 2 else 0) if size_bytes else None
    if single:
        window = content
    return None, size, window, dict_id, content, bool(d & 4), single


def walk(b: bytes) -> Iterator[tuple[tuple, list[tuple]]]:
    """(frame row, its block rows) for each frame; a broken frame is the last, with its error."""
    at, no = 0, 0
    while at < len(b):
        magic = int.from_bytes(b[at : at + 4], "little")
        empty = (None,) * 5
        if len(b) - at < 4:
            yield (no, at, "unknown", 0, len(b) - at, *empty, 0, "short tail"), []
            return
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
            broken = len(b) < at + 8 or end > len(b)
            yield (no, at, "skippable", 8, min(end, len(b)) - at, *empty, 0, "truncated skippable frame" if broken else None), []
            if broken:
                return
            at, no = end, no + 1
            continue
        if magic != MAGIC:
            yield (no, at, "unknown", 0, len(b) - at, *empty, 0, "bad magic" if no == 0 else "trailing garbage"), []
            return
        error, *h = _header(b, at)
        if error:
            yield (no, at, "frame", 0, len(b) - at, *empty, 0, error), []
            return
        size, window, dict_id, content, checksum, single = h
        p, blocks, last = at + size, [], False
        while not last and not error:
            if len(b) < p + 3:
                error = "truncated block header"
                break
            head = int.from_bytes(b[p : p + 3], "little")
            last, kind, n = bool(head & 1), head >> 1 & 3, head >> 3
            stored = 1 if kind == 1 else n
            if kind == 3:
                error = "reserved block type"
            elif n > BLOCK_MAX:
                error = "block too large"
            elif len(b) < p + 3 + stored:
                error = "truncated block"
            else:
                blocks.append((no, len(blocks), last, _TYPES[kind], n, p))
                p += 3 + stored
        if not error and checksum:
            p += 4
            error = "truncated checksum" if p > len(b) else None
        end = min(p, len(b))
        yield (no, at, "frame", size, end - at, content, window, dict_id, checksum, single, len(blocks), error), blocks
        if error:
            return
        at, no = p, no + 1


def frames(payloads: DataFrame, key: str = "payload_id", *keep: str) -> DataFrame:
    """One row for each frame and skippable frame of each payload (content), with the columns in keep."""
    def solve(data: np.ndarray) -> list[tuple]:
        return [(*row[:5], None if row[5] is None else str(row[5]), *row[6:]) for row, _ in walk(data.tobytes())]

    out = per_payload(payloads, (key, *keep), solve, FRAME.replace("decimal(20,0)", "string"))  # sizes go up to 2**64 - 1
    return out.withColumn("content_size", F.col("content_size").cast("decimal(20,0)"))


def blocks(payloads: DataFrame, key: str = "payload_id") -> DataFrame:
    """One row for each block of each frame; stored_size is the header's size field (for an rle block, the bytes it stands for)."""
    return per_payload(payloads, key, lambda data: [b for _, found in walk(data.tobytes()) for b in found], BLOCKS)


def totals(found: DataFrame, *by: str) -> DataFrame:
    """What a listing shows of each group of frames() rows: frames, skips, compressed, decompressed (null: some size is
    unknown), ratio, uses_check, errors."""
    real = F.col("kind") == "frame"
    known = F.bool_and(F.when(real, F.col("content_size").isNotNull()))
    size = F.sum(F.when(real, F.col("content_size")))
    out = found.groupBy(*by).agg(
        F.count_if(real).alias("frames"), F.count_if(F.col("kind") == "skippable").alias("skips"), F.sum("compressed_size").alias("compressed"),
        F.when(F.coalesce(known, F.lit(True)), F.coalesce(size, F.lit(0))).cast("long").alias("decompressed"),
        F.coalesce(F.bool_and(F.when(real, F.col("has_checksum"))), F.lit(True)).alias("uses_check"), F.count("error").alias("errors"),
    )
    return out.withColumn("ratio", F.when(F.col("compressed") == 0, 0.0).otherwise(F.col("decompressed") / F.col("compressed")))


def decompress_bound(found: DataFrame, *by: str) -> DataFrame:
    """Most bytes the frames of a group can decompress to: their content size, or their blocks at the largest size."""
    most = F.coalesce(F.col("content_size"), F.col("n_blocks").cast("decimal(20,0)") * F.least(F.coalesce("window_size", F.lit(BLOCK_MAX)), F.lit(BLOCK_MAX)))
    return found.where("kind = 'frame'").groupBy(*by).agg(F.sum(most).cast("long").alias("bound"))


def stored_frame(content: Column, block: int = BLOCK_MAX) -> Column:
    """A frame that holds content as it is, in raw blocks of at most `block` bytes, with its size in eight bytes and no checksum: level 0.
    Null content is empty."""
    content = F.coalesce(content, F.lit(b""))
    n = F.octet_length(content)
    size = F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(8)])

    def one(k: Column) -> Column:
        at = k * block
        own = F.least(F.lit(block), n - at)
        head = F.shiftleft(own, 3) + F.when(at + block >= n, 1).otherwise(0)
        text = F.concat(*[F.lpad(F.hex(F.shiftright(head, 8 * i).bitwiseAND(F.lit(255)).cast("long")), 2, "0") for i in range(3)])
        return F.concat(text, F.hex(F.substring(content, (at + 1).cast("int"), own.cast("int"))))

    last = F.greatest(F.lit(0), F.floor((n - 1) / block).cast("int"))
    return F.unhex(F.concat(F.lit("28B52FFDE0"), size, F.array_join(F.transform(F.sequence(F.lit(0), last), one), "")))


def skippable_frame(content: Column, variant: int = 0) -> Column:
    """A skippable frame of user bytes, magic variant 0 to 15."""
    if not 0 <= variant <= 15:
        raise ValueError("variant must be from 0 to 15")
    n = F.octet_length(content)
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0")) for k in range(4)])
    return F.concat(F.unhex(F.lit(f"{0x50 + variant:02X}2A4D18")), size, content)


def format_of(content: Column) -> Column:
    """zstd, skippable, gzip, xz or lz4 by magic; empty, short or unknown otherwise."""
    n, head = F.octet_length(content), F.hex(F.substring(content, 1, 4))
    out = F.when(n == 0, "empty").when(n < 4, "short").when(head == "28B52FFD", "zstd").when(head.rlike("^5.2A4D18$"), "skippable")
    for magic, name in FOREIGN.items():
        out = out.when(head.startswith(magic), name)
    return out.otherwise("unknown")
