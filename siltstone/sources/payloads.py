"""Payload tables: (payload_id, content, n_bytes) from the text tables, from files, and made up by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table: id expression and the column whose UTF-8 bytes are the payload.
TABLES = {
    "documents": ("doc_id", "text"),
    "pages": ("page_id", "html"),
    "conversations": ("conv_id * 10000 + turn", "text"),
    "benchmark": ("item_id", "text"),
    "events": ("event_id", "props"),
}
#: Extensions of files that are compressed already.
COMPRESSED = ("zst", "tzst", "gz", "tgz", "xz", "txz", "lzma", "tlz", "lz4", "bz2", "tbz", "7z", "zip", "rar", "br", "z", "jpg", "jpeg", "png", "gif", "webp", "mp3", "mp4", "mkv", "ogg", "flac")
SHAPES = ("zeros", "text", "json", "skewed", "random")


def payloads(spark: SparkSession, sf_dir: str, table: str = "documents", *keep: str) -> DataFrame:
    """payload_id, content, n_bytes and the columns in keep. A null text has null content and n_bytes 0."""
    key, column = TABLES[table]
    content = F.col(column).cast("binary")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(F.expr(key).cast("long").alias("payload_id"), content.alias("content"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("n_bytes"), *keep)


def extension(path: Column) -> Column:
    """The part of a file name after its last dot, lower case; a name that only begins with a dot has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def read_files(spark: SparkSession, path: str | list[str], recursive: bool = True, skip_compressed: bool = False) -> DataFrame:
    """Files under a path (or paths) as path, content, n_bytes. Directories are walked; rows hold at most 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = found.select("path", "content", F.col("length").alias("n_bytes"))
    return found.where(~extension(F.col("path")).isin(*COMPRESSED)) if skip_compressed else found


def listed_files(spark: SparkSession, list_path: str) -> DataFrame:
    """Files named one per line in a text file. The list is read on the driver, as any list of inputs is."""
    paths = [r.value.strip() for r in spark.read.text(list_path).where("trim(value) <> ''").collect()]
    return read_files(spark, paths, recursive=False)


def output_name(path: Column, decompress: bool = False) -> Column:
    """Where a file goes: .zst is added, or .zst dropped and .tzst made .tar; null if the name has neither."""
    if not decompress:
        return F.concat(path, F.lit(".zst"))
    return F.when(path.rlike(r"[^/]\.zst$"), F.regexp_replace(path, r"\.zst$", "")).when(path.rlike(r"[^/]\.tzst$"), F.regexp_replace(path, r"\.tzst$", ".tar"))


def shapes(spark: SparkSession, shape: str, n_payloads: int, n_bytes: int, seed: int = 7) -> DataFrame:
    """Made-up payloads of one of SHAPES, each of n_bytes, by a rule from payload_id and seed alone."""
    import pandas as pd

    def make(batches):
        import numpy as np

        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i), SHAPES.index(shape)])
                if shape == "zeros":
                    data = bytes(n_bytes)
                elif shape == "random":
                    data = rng.bytes(n_bytes)
                elif shape == "skewed":
                    share = 0.5 ** np.arange(1, 17)
                    data = rng.choice(np.arange(97, 113, dtype=np.uint8), n_bytes, p=share / share.sum()).tobytes()
                elif shape == "json":
                    rows, size = [], 0
                    while size < n_bytes:
                        rows.append('{"id":%d,"user":"u%04d","ok":%s,"value":%.3f}\n' % (len(rows), rng.integers(5000), ("true", "false")[rng.integers(2)], rng.random() * 1000))
                        size += len(rows[-1])
                    data = "".join(rows).encode()[:n_bytes]
                else:
                    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
                    data = " ".join(words[k] for k in rng.zipf(1.4, n_bytes // 3 + 1) % 300).encode()[:n_bytes]
                out.append(data)
            yield pd.DataFrame({"payload_id": b["id"], "shape": shape, "content": out, "n_bytes": [len(x) for x in out]})

    return spark.range(n_payloads).mapInPandas(make, "payload_id long, shape string, content binary, n_bytes long")


def write_files(files: DataFrame, directory: str) -> DataFrame:
    """Write rows (name, content) as files of a directory that all executors share: name, n_bytes of each, once it is written. Null content is an
    empty file. A file is written under another name and then renamed, so a task that runs again leaves nothing half written; nothing is
    written before the result is read. Names may have directories; they must not repeat, nor leave the directory."""
    def run(batches):
        import posixpath
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory if "://" in directory or directory.startswith("/") else "file:///" + directory)
        for b in batches:
            names, sizes = b.column("name").to_pylist(), []
            for name, content in zip(names, b.column("content")):
                path = posixpath.normpath(posixpath.join(root, name))
                if not path.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{name!r} is outside of the directory")
                store.create_dir(posixpath.dirname(path), recursive=True)
                part = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.part")
                with store.open_output_stream(part) as out:
                    sizes.append(out.write(content.as_buffer()) if content.is_valid else 0)
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, n_bytes long")
