"""Streams give what the batch gives, however the chunks arrive."""

from siltstone.plans import levels
from siltstone.streaming import chunks


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_encode_and_totals(spark, tmp_path):
    rows = [(f"s{s}", n, bytearray(b"%d-%d" % (s, n) * 50), n == 3) for s in range(3) for n in range(4)]
    schema = "stream_id string, chunk_no long, content binary, is_last boolean"
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(chunks.decode_stream(chunks.encode_stream(read())), "back", "append")
    got = {(r.stream_id, r.chunk_no): bytes(r.content) for r in spark.table("back").collect()}
    assert got == {(r[0], r[1]): bytes(r[2]) for r in rows}
    run(chunks.running_totals(read()), "totals", "update")
    last = spark.table("totals").groupBy("stream_id").agg({"bytes": "max", "chunks": "max"}).collect()
    assert sorted(tuple(r) for r in last) == sorted((f"s{s}", sum(len(r[2]) for r in rows if r[0] == f"s{s}"), 4) for s in range(3)) or sorted((r["stream_id"], r["max(bytes)"], r["max(chunks)"]) for r in last) == sorted((f"s{s}", sum(len(r[2]) for r in rows if r[0] == f"s{s}"), 4) for s in range(3))


def test_adaptive_level_equals_batch(spark, tmp_path):
    rows = [("a", n, (n * 37) % 100 + 50, (n * 53) % 100 + 50, (n * 11) % 100 + 50) for n in range(12)]
    schema = "stream_id string, chunk_no long, read_ns long, encode_ns long, output_ns long"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    run(chunks.adaptive_stream(stream), "adaptive", "append")
    got = [r.level for r in spark.table("adaptive").orderBy("chunk_no").collect()]
    assert got == levels.adaptive_levels(spark.createDataFrame(rows, schema)).first().levels
