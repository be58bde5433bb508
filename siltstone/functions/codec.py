"""Compression and decompression of payload columns. The codec itself is a native library; Spark moves the rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def compressor(level: int = 3, checksum: bool = True, dictionary: bytes | None = None, window_log: int | None = None) -> Callable:
    """A function that makes one frame of each payload (null stays null). The compressor is made once per batch."""
    @F.pandas_udf("binary")
    def compress(content: pd.Series) -> pd.Series:
        import zstandard as z

        known = z.ZstdCompressionDict(dictionary) if dictionary else None
        if window_log:
            made = z.ZstdCompressor(compression_params=z.ZstdCompressionParameters.from_level(level, window_log=window_log, write_checksum=checksum), dict_data=known)
        else:
            made = z.ZstdCompressor(level=level, write_checksum=checksum, dict_data=known)
        return content.map(lambda b: made.compress(bytes(b)), na_action="ignore")

    return compress


def decompressor(dictionary: bytes | None = None, max_window: int = 1 << 27, max_bytes: int | None = None, single_frame: bool = False) -> Callable:
    """A function to struct<content, error>: all frames of each payload (or the first one), one after the other, skippable frames passed over.

    Frames that ask for a window above max_window, results above max_bytes, damaged or cut-off frames and bytes that are no frame
    give a null content and a named error. No more than max_bytes and a part of a frame are ever held. A payload without frames is empty.
    """
    @F.pandas_udf("content binary, error string")
    def decompress(content: pd.Series) -> pd.DataFrame:
        import zstandard as z

        from siltstone.operators.frames import walk

        known = z.ZstdCompressionDict(dictionary) if dictionary else None
        made = z.ZstdDecompressor(dict_data=known, max_window_size=max_window)

        def one(b: bytes | None) -> tuple[bytes | None, str | None]:
            if b is None:
                return None, None
            left, out, whole = max_bytes, [], memoryview(bytes(b))
            for row, _ in walk(bytes(b)):
                at, kind, size, error = row[1], row[2], row[4], row[-1]
                if kind == "skippable" and not error:
                    continue
                if kind == "unknown":
                    return None, "trailing garbage" if row[0] else "bad magic"
                if kind == "skippable":
                    return None, error
                if left is not None and (row[5] or 0) > left:
                    return None, "target too small"
                try:
                    if left is None:
                        frame = made.decompressobj()
                        part = frame.decompress(whole[at : at + size])
                        ended = frame.eof
                    else:
                        with made.stream_reader(whole[at : at + size], read_size=1 << 16) as reader:
                            part = reader.read(left + 1)
                        ended, left = not error, left - len(part)
                        if left < 0:
                            return None, "target too small"
                except z.ZstdError as e:
                    return None, zstd_error(str(e))
                if not ended:
                    return None, "truncated frame"
                out.append(part)
                if single_frame:
                    break
            return b"".join(out), None

        return pd.DataFrame([one(b) for b in content], columns=["content", "error"])

    return decompress


def zstd_error(message: str) -> str:
    """A name for what the codec says."""
    for part, name in (("checksum", "wrong checksum"), ("too much memory", "window too large"), ("window", "window too large"), ("ictionary", "missing dictionary"), ("nsupported", "unsupported frame")):
        if part in message:
            return name
    return "corrupted frame"
