"""What a user of frame files asks about them: verdicts, shown dictionary ids, sizes for people, payloads of skippable frames, checks of
declared sizes, and decompression with dictionaries looked up by frame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.codec import decompressor, zstd_error
from siltstone.operators.frames import BLOCK_MAX, format_of

# Binary prefixes of sizes, and the suffixes that a size may be given with.
PREFIXES = (("EiB", 60), ("PiB", 50), ("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10))
SUFFIXES = {"": 0, "K": 10, "KB": 10, "KiB": 10, "M": 20, "MB": 20, "MiB": 20, "G": 30, "GB": 30, "GiB": 30}


def verdicts(found: DataFrame, *by: str) -> DataFrame:
    """What a listing says of each group of frames() rows: 'ok', or why its analysis stopped: 'not zstd' (no frame, or a tail too
    short for one, which incomplete_tail tells), 'truncated' (a skippable frame runs past the end) or 'frame error'. listed: whether
    the group gets a row in the listing; counted: whether it counts in the totals."""
    why = F.max("error")  # a walk ends at its first error, so there is one at most
    short = F.col("why") == "short tail"
    told = F.when(F.col("why").isNull(), "ok").when(short | F.col("why").isin("bad magic", "trailing garbage"), "not zstd").when(F.col("why") == "truncated skippable frame", "truncated").otherwise("frame error")
    out = found.groupBy(*by).agg(why.alias("why")).withColumn("verdict", told)
    return out.select(*by, "verdict", F.coalesce(short, F.lit(False)).alias("incomplete_tail"), F.col("verdict").isin("ok", "frame error").alias("listed"), (F.col("verdict") == "ok").alias("counted"))


def shown_dictionary(found: DataFrame, *by: str) -> DataFrame:
    """The dictionary id that a listing shows of each file's frames() rows, and whether it warns: frame by frame, an id that is not zero
    and differs from the next one goes back to 0 with a warning, else the next one is taken. Groups are files."""
    frames = F.array_sort(F.collect_list(F.when(F.col("kind") == "frame", F.struct("frame_no", F.coalesce("dict_id", F.lit(0)).cast("long").alias("id")))))
    start = F.struct(F.lit(0).cast("long").alias("dict_id"), F.lit(False).alias("warned"))

    def step(acc, x):
        clash = (acc["dict_id"] != 0) & (acc["dict_id"] != x["id"])
        return F.struct(F.when(clash, F.lit(0).cast("long")).otherwise(x["id"]).alias("dict_id"), (acc["warned"] | clash).alias("warned"))

    return found.groupBy(*by).agg(F.aggregate(frames, start, step).alias("shown")).select(*by, "shown.*")


def _rounded(n: Column, bits: int, places: int) -> Column:
    """n / 2**bits with as many decimals, as text, exactly; a half goes to the even side."""
    wide, unit = n.cast("decimal(20,0)") * F.lit(10**places).cast("decimal(4,0)"), F.lit(1 << bits).cast("decimal(20,0)")
    rest = wide % unit
    whole = ((wide - rest) / unit).cast("decimal(30,0)")
    whole = whole + F.when((2 * rest > unit) | ((2 * rest == unit) & (whole % 2 == 1)), 1).otherwise(0)
    digits = F.lpad(whole.cast("decimal(30,0)").cast("string"), 30, "0")
    head = F.regexp_replace(F.substring(digits, 1, 30 - places), "^0+(?=.)", "")
    return F.concat(head, F.lit("."), F.substring(digits, 31 - places, places)) if places else head


def human_size(n: Column) -> Column:
    """A size for people: the largest binary prefix that leaves a whole, whole numbers and hundreds without decimals, tens with one, else two."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for name, bits in reversed(PREFIXES):
        unit = F.lit(1 << bits)
        text = F.when((n % unit == 0) | (n >= 100 * (1 << bits)) if bits < 57 else (n % unit == 0), _rounded(n, bits, 0)).when(n >= min(10 * (1 << bits), (1 << 63) - 1), _rounded(n, bits, 1)).otherwise(_rounded(n, bits, 2))
        out = F.when(n >= unit, F.concat(text, F.lit(" " + name))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of a size as users write it, digits and one of SUFFIXES; null if it is none, or 2**63 and more."""
    digits, suffix = F.regexp_extract(text, r"^([0-9]+)([A-Za-z]*)$", 1), F.regexp_extract(text, r"^([0-9]+)([A-Za-z]*)$", 2)
    unit = None
    for name, bits in SUFFIXES.items():
        unit = F.when(suffix == name, F.lit(1 << bits)) if unit is None else unit.when(suffix == name, F.lit(1 << bits))
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.when(F.length(digits).between(1, 19), digits).cast("decimal(20,0)") * unit.cast("decimal(10,0)")
    return F.when(value < F.lit("9223372036854775808").cast("decimal(20,0)"), value).cast("long")


def skippable_payloads(found: DataFrame, payloads: DataFrame, key: str = "payload_id") -> DataFrame:
    """key, frame_no, variant (0 to 15), payload of the skippable frames in frames() rows of payloads (content)."""
    rows = found.where("kind = 'skippable' and error is null").select(key, "frame_no", "byte_offset", "compressed_size").join(payloads.select(key, "content"), key)
    variant = F.conv(F.hex(F.substring("content", (F.col("byte_offset") + 1).cast("int"), F.lit(1))), 16, 10).cast("int") - 0x50
    payload = F.substring("content", (F.col("byte_offset") + 9).cast("int"), (F.col("compressed_size") - 8).cast("int"))
    return rows.select(key, "frame_no", variant.alias("variant"), payload.alias("payload"))


def size_error(declared: Column, actual: Column) -> Column:
    """An error if a frame declares a size that its content doesn't have; null if it fits or none is declared."""
    return F.when(declared.isNotNull() & (declared != actual), F.format_string("content size mismatch: declared %s, actual %s", declared.cast("string"), actual.cast("string")))


def decoded_or_same(content: Column) -> Column:
    """Frames decoded, and content of any other format passed through as it is."""
    return F.when(format_of(content).isin("zstd", "skippable"), decompressor()(content)["content"]).otherwise(content)


def in_place_margin(found: DataFrame, *by: str) -> DataFrame:
    """Bytes that decoding frames() rows in place needs beyond their content: the bytes that are no content, and one block, the largest."""
    real = F.col("kind") == "frame"
    own = F.when(real, F.col("header_size") + F.when(F.col("has_checksum"), 4).otherwise(0) + 3 * F.col("n_blocks")).otherwise(F.col("compressed_size"))
    block = F.max(F.when(real, F.least(F.coalesce("window_size", F.lit(BLOCK_MAX)), F.lit(BLOCK_MAX))))
    return found.groupBy(*by).agg((F.sum(own) + F.coalesce(block, F.lit(0))).cast("long").alias("margin"))


#: Bytes of dictionaries up to which the whole table is sent to every task; larger tables are joined by shuffle.
SENT = 64 << 20


def decompressed_with(frames: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """frames (dict_id, content: one frame) with decoded and error: each frame decoded with the row of dictionaries (dict_id, dictionary)
    that has its id. A frame with id 0 or null needs none; an id that the table doesn't have is the error 'missing dictionary'.
    dict_id must not repeat in the table. The table is broadcast only if its bytes are counted to be SENT or fewer."""
    known = dictionaries.select(F.col("dict_id").alias("__id"), F.col("dictionary").alias("__dictionary"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("__dictionary")), F.lit(0))).first()[0]
    both = frames.join(F.broadcast(known) if size <= SENT else known.hint("merge"), F.col("dict_id") == F.col("__id"), "left")

    @F.pandas_udf("content binary, error string")
    def decode(content: pd.Series, needed: pd.Series, dictionary: pd.Series) -> pd.DataFrame:
        import zstandard as z

        made, out = {}, []
        for b, i, d in zip(content, needed, dictionary):
            if b is None:
                out.append((None, None))
            elif i and i == i and d is None:
                out.append((None, "missing dictionary"))
            else:
                if (own := made.get(bytes(d or b""))) is None:
                    own = made[bytes(d or b"")] = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(bytes(d)) if d else None)
                try:
                    out.append((own.decompressobj().decompress(bytes(b)), None))
                except z.ZstdError as e:
                    out.append((None, zstd_error(str(e))))
        return pd.DataFrame(out, columns=["content", "error"])

    told = both.withColumn("__told", decode("content", F.coalesce(F.col("dict_id").cast("long"), F.lit(0)), "__dictionary"))
    return told.select(*frames.columns, F.col("__told.content").alias("decoded"), F.col("__told.error").alias("error"))
