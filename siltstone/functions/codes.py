"""Sequence codes and frame header fields of the Zstandard format (RFC 8878), as tables and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (RFC 8878, section 3.1.1.3.2.1.1): first value and extra bits of the codes above the direct ones.
LITERAL_LENGTHS = tuple((v, 0) for v in range(16)) + ((16, 1), (18, 1), (20, 1), (22, 1), (24, 2), (28, 2), (32, 3), (40, 3), (48, 4), (64, 6), (128, 7), (256, 8), (512, 9), (1024, 10), (2048, 11), (4096, 12), (8192, 13), (16384, 14), (32768, 15), (65536, 16))
MATCH_LENGTHS = tuple((v, 0) for v in range(3, 35)) + ((35, 1), (37, 1), (39, 1), (41, 1), (43, 2), (47, 2), (51, 3), (59, 3), (67, 4), (83, 4), (99, 5), (131, 7), (259, 8), (515, 9), (1027, 10), (2051, 11), (4099, 12), (8195, 13), (16387, 14), (32771, 15), (65539, 16))


def code_table(spark: SparkSession) -> DataFrame:
    """channel, code, base, extra_bits, next_base of the literal-length and match-length codes."""
    rows = [(name, k, v, bits, v + (1 << bits)) for name, table in (("ll", LITERAL_LENGTHS), ("ml", MATCH_LENGTHS)) for k, (v, bits) in enumerate(table)]
    return spark.createDataFrame(rows, "channel string, code int, base int, extra_bits int, next_base int")


def _stepped(value: Column, table) -> Column:
    """The code whose range holds value; a binary decision by CASE from the largest base down."""
    out = F.when(value >= table[-1][0], F.lit(len(table) - 1))
    for k in range(len(table) - 2, -1, -1):
        out = out.when(value >= table[k][0], F.lit(k))
    return out


def literal_length_code(value: Column) -> Column:
    return _stepped(value, LITERAL_LENGTHS)


def match_length_code(value: Column) -> Column:
    """Null below the least match length, 3."""
    return _stepped(value, MATCH_LENGTHS)


def offset_code(value: Column) -> Column:
    """floor(log2(value)), exactly."""
    return F.length(F.bin(value)) - 1


def window_size(byte: Column) -> Column:
    """Window size from a window descriptor byte: exponent in the high five bits, eighths in the low three."""
    base = F.expr("1L") * F.pow(F.lit(2), F.shiftright(byte, 3) + 10).cast("long")
    return base + (base / 8).cast("long") * byte.bitwiseAND(F.lit(7))


def descriptor_fields(byte: Column) -> dict[str, Column]:
    """Fields of a frame header descriptor byte."""
    flag, single, dictionary = F.shiftright(byte, 6), byte.bitwiseAND(F.lit(32)) != 0, byte.bitwiseAND(F.lit(3))
    size_bytes = F.when(flag == 0, F.when(single, 1).otherwise(0)).otherwise(F.expr("1") * F.pow(F.lit(2), flag).cast("int"))
    dictionary_bytes = F.when(dictionary == 3, 4).otherwise(dictionary)
    return {
        "size_flag": flag, "single_segment": single, "reserved": byte.bitwiseAND(F.lit(8)) != 0, "has_checksum": byte.bitwiseAND(F.lit(4)) != 0,
        "size_bytes": size_bytes, "dictionary_bytes": dictionary_bytes, "declares_size": (flag != 0) | single,
        "header_bytes": F.lit(5) + F.when(single, 0).otherwise(1) + dictionary_bytes + size_bytes,
    }


def compress_bound(n: Column) -> Column:
    """Most bytes that a payload of n bytes can take compressed."""
    return n + F.shiftright(n, 8) + F.when(n < (128 << 10), F.shiftright(F.lit(128 << 10) - n, 11)).otherwise(0)


def field_width(value: Column) -> Column:
    """Bytes of the narrowest field, of 1, 2, 4 or 8, that holds a number."""
    return F.when(value < (1 << 8), 1).when(value < (1 << 16), 2).when(value < (1 << 32), 4).otherwise(8)


def offset_price(distance: Column) -> Column:
    """Bits that an offset is taken to cost."""
    return offset_code(distance + 1)


def pays_for_offset(length: Column, distance: Column, repeat: Column) -> Column:
    """Whether a match saves more than its offset costs: a repeated offset, or 4 * length >= bits of the distance + 7."""
    return repeat | (length * 4 >= offset_code(distance) + 7)
