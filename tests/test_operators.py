"""Operators against brute force, round trips and known values."""

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.functions import codec, codes
from siltstone.functions.bytesfn import checksum32, common_prefix
from siltstone.operators import chunking, decisions, dictionaries, entropy, frames, matching, tables
from siltstone.plans import levels
from siltstone.sources import payloads as source

SIZES = (0, 1, 7, 8, 127, 128, 255, 256, 65791, 65792, 131071, 131072, 131073, 300 << 10)


def table(spark, contents):
    rows = [(i, bytearray(c) if c is not None else None, len(c or b"")) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "payload_id long, content binary, n_bytes long")


def of(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


@pytest.mark.parametrize("shape", source.SHAPES)
def test_roundtrip_of_shapes(spark, shape):
    df = source.shapes(spark, shape, 3, 70_000)
    back = df.withColumn("z", codec.compressor(3)("content")).withColumn("d", codec.decompressor()("z"))
    assert back.where("d.error is null and d.content = content and octet_length(content) = 70000").count() == 3


def test_roundtrip_of_sizes(spark):
    rng = np.random.default_rng(1)
    df = table(spark, [rng.integers(0, 61, n, dtype=np.uint8).tobytes() for n in SIZES] + [None])
    back = df.withColumn("z", codec.compressor(1)("content")).withColumn("d", codec.decompressor()("z"))
    assert back.where("d.content = content").count() == len(SIZES)
    assert back.where("content is null and z is null and d.content is null and d.error is null").count() == 1


def test_frames_one_after_the_other_and_errors(spark):
    z = zstandard.ZstdCompressor(write_checksum=True)
    one, two = z.compress(b"a" * 1000), z.compress(b"bc" * 700)
    skip = bytes.fromhex("532A4D18") + (5).to_bytes(4, "little") + b"hello"
    flipped = bytearray(two)
    flipped[-1] ^= 1
    cases = {
        b"": (b"", None), one + two: (b"a" * 1000 + b"bc" * 700, None), skip + one + skip: (b"a" * 1000, None), skip: (b"", None),
        one + b"junk!": (None, "trailing garbage"), b"no frame": (None, "bad magic"), one[:-6]: (None, "truncated frame"), skip[:-1]: (None, "truncated skippable frame"),
        bytes(flipped): (None, "wrong checksum"),
    }
    got = table(spark, cases).withColumn("d", codec.decompressor()("content")).orderBy("payload_id").collect()
    assert [(bytes(r.d.content) if r.d.content is not None else None, r.d.error) for r in got] == list(cases.values())


def test_frame_walk(spark):
    z = zstandard.ZstdCompressor(write_checksum=True)
    data = np.random.default_rng(2).bytes(300_000)
    one = z.compress(data)
    skip = bytes.fromhex("502A4D18") + (3).to_bytes(4, "little") + b"abc"
    streamed = zstandard.ZstdCompressor().compressobj()
    unsized = streamed.compress(b"xyz" * 100) + streamed.flush()
    bad_type = bytes.fromhex("28B52FFD") + bytes([0x20, 0]) + bytes([0x07, 0, 0])
    reserved = bytes.fromhex("28B52FFD") + bytes([0x28, 0, 1, 0, 0])
    df = table(spark, [one + skip + one, unsized, bad_type, reserved, b"\x28\xb5", b"", one[:-2], one + b"garbage"])
    rows = {(r.payload_id, r.frame_no): r for r in frames.frames(df).collect()}
    assert [rows[0, k].kind for k in range(3)] == ["frame", "skippable", "frame"]
    assert rows[0, 0].content_size == 300_000 and rows[0, 0].has_checksum and rows[0, 0].n_blocks == 3 and rows[0, 0].compressed_size == len(one)
    assert rows[1, 0].content_size is None and rows[1, 0].error is None
    assert rows[2, 0].error == "reserved block type" and rows[3, 0].error == "reserved bit" and rows[4, 0].error == "short tail"
    assert rows[6, 0].error == "truncated checksum" and rows[7, 1].error == "trailing garbage"
    assert not [k for k in rows if k[0] == 5]
    total = {r.payload_id: r for r in frames.totals(frames.frames(df), "payload_id").collect()}
    assert (total[0].frames, total[0].skips, total[0].decompressed, total[0].uses_check) == (2, 1, 600_000, True)
    assert total[1].decompressed is None
    sizes = of(frames.blocks(df).where("payload_id = 0").groupBy("frame_no").agg(F.sum("stored_size").alias("n")), "n")
    assert sizes == [(300_000,), (300_000,)]


def test_skippable_and_magic(spark):
    df = table(spark, [b"user bytes", b""]).withColumn("s", frames.skippable_frame(F.col("content"), 7))
    assert [bytes(r.s) for r in df.orderBy("payload_id").collect()] == [bytes.fromhex("572A4D18") + n.to_bytes(4, "little") + c for n, c in ((10, b"user bytes"), (0, b""))]
    with pytest.raises(ValueError):
        frames.skippable_frame(F.col("content"), 16)
    kinds = table(spark, [b"", b"ab", b"\x1f\x8b\x08\x00", bytes.fromhex("FD377A585A00"), bytes.fromhex("04224D18"), bytes.fromhex("28B52FFD"), b"text"])
    assert [r.k for r in kinds.select("payload_id", frames.format_of(F.col("content")).alias("k")).orderBy("payload_id").collect()] == ["empty", "short", "gzip", "xz", "lz4", "zstd", "unknown"]


def test_checksum_and_prefix(spark):
    import xxhash

    df = table(spark, [b"", b"abc", None])
    assert [r.c for r in df.select("payload_id", checksum32("content").alias("c")).orderBy("payload_id").collect()] == [xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF, xxhash.xxh64_intdigest(b"abc") & 0xFFFFFFFF, None]
    assert spark.range(1).select(common_prefix(F.lit(b"abcdef"), F.lit(b"abcx")).alias("n")).first().n == 3


def test_codes_invert(spark):
    df = spark.range(3, 70_000, 7)
    t = codes.code_table(spark)
    for channel, f in (("ll", codes.literal_length_code), ("ml", codes.match_length_code)):
        bad = df.withColumn("code", f(F.col("id"))).join(t.where(F.col("channel") == channel), "code").where("id < base or id >= next_base")
        assert bad.count() == 0
    assert spark.range(1, 5000).where(F.pow(F.lit(2), codes.offset_code(F.col("id"))) > F.col("id")).count() == 0


def test_entropy_of_known_payloads(spark):
    df = entropy.payload_entropy(table(spark, [b"", b"aaaa", bytes(range(256)) * 4, b"ab" * 512]))
    got = {r.payload_id: (r.n_distinct, round(r.bits, 6), r.stored) for r in df.collect()}
    assert got == {0: (0, 0.0, True), 1: (1, 0.0, True), 2: (256, 8192.0, True), 3: (2, 1024.0, False)}


def test_content_changes(spark):
    rng = np.random.default_rng(4)
    glued = rng.integers(97, 105, 64 << 10).astype(np.uint8).tobytes() + rng.integers(0, 10, 64 << 10).astype(np.uint8).tobytes()
    alike = rng.integers(97, 105, 128 << 10).astype(np.uint8).tobytes()
    rows = chunking.content_changes(table(spark, [glued, alike, b"", b"short"])).collect()
    assert [(r.payload_id, r.byte_offset) for r in rows] == [(0, 64 << 10)]


def test_job_sizes(spark):
    """A share is rounded up, so there are no more jobs than twice the workers."""
    n = [1, (1 << 20) * 16, (1 << 20) * 16 + 1, 1 << 36]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "payload_id long, n_bytes long")
    got = [(r.job_size, r.n_jobs) for r in chunking.jobs(df).orderBy("payload_id").collect()]
    assert got == [(1 << 20, 1), (1 << 20, 16), ((1 << 20) + 1, 16), (1 << 30, 64)]


def test_long_distance_matches_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    part = rng.integers(97, 123, 700).astype(np.uint8).tobytes()
    data = part + rng.integers(97, 123, 900).astype(np.uint8).tobytes() + part[:500] + b"." + part[100:] + b"-" + part
    h, out, seen = chunking.gear_hashes(np.frombuffer(data, np.uint8)), [], []
    for p in range(64, len(data) + 1):
        if int(h[p - 1]) >> 58 == 0:
            best = (0, 0)
            for q in seen:
                if data[q - 64 : q] == data[p - 64 : p]:
                    k = 0
                    while p + k < len(data) and data[q + k] == data[p + k]:
                        k += 1
                    if k + 64 > best[0]:
                        best = (k + 64, p - q)
            if best[0]:
                out.append((p, best[1], best[0]))
            seen.append(p)
    got = sorted((r.split, r.distance, r.length) for r in matching.long_distance(table(spark, [data])).collect())
    assert got == out and len(out) > 5


def test_decompression_stops_at_its_bound(spark):
    df = table(spark, [bytes(5000), b"a" * 100]).withColumn("z", codec.compressor()("content"))
    got = df.select(codec.decompressor(max_bytes=1000)("z").alias("d")).select("d.*").collect()
    assert sorted((r.error or "", len(r.content or b"")) for r in got) == [("", 100), ("target too small", 0)]
    two = df.select(F.concat("z", "z").alias("z"))
    assert sorted(len(r.content) for r in two.select(codec.decompressor(single_frame=True)("z").alias("d")).select("d.*").collect()) == [100, 5000]
    assert [r.error for r in two.select(codec.decompressor(max_bytes=150)("z").alias("d")).select("d.*").collect()] == ["target too small"] * 2


def test_dictionaries_by_shuffle(spark, monkeypatch):
    from siltstone.operators import listing

    made = dictionaries.sample_dictionaries(2)
    rows = [(i, i % 3 and 40000 + i % 3, codec_frame(b"text %d" % i, made.get(40000 + i % 3))) for i in range(30)] + [(30, 7, b""), (31, None, None)]
    df = spark.createDataFrame(rows, "payload_id long, dict_id long, content binary")
    table_ = spark.createDataFrame(list(made.items()), "dict_id long, dictionary binary")
    want = sorted(map(str, listing.decompressed_with(df, table_).collect()))
    monkeypatch.setattr(listing, "SENT", -1)
    assert sorted(map(str, listing.decompressed_with(df, table_).collect())) == want
    assert sum("text" in w for w in want) == 30 and sum("missing dictionary" in w for w in want) == 1


def codec_frame(content, dictionary):
    import zstandard as z

    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None).compress(content)


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(4).integers(0, 256, 500, dtype=np.uint8)
    tab, h, want = [int(x) for x in chunking.gear_table()], 0, []
    for b in data.tolist():
        h = ((h << 1) + tab[b]) % (1 << 64)
        want.append(h)
    assert chunking.gear_hashes(data).tolist() == want


def test_previous_against_brute_force():
    data = np.random.default_rng(5).integers(0, 3, 300, dtype=np.uint8)
    last, want = {}, []
    for i in range(len(data) - 4):
        g = data[i : i + 5].tobytes()
        want.append(last.get(g, -1))
        last[g] = i
    assert matching.previous(data, 5).tolist() == want


def test_greedy_parse_rebuilds(spark):
    data = np.random.default_rng(6).integers(0, 4, 5000, dtype=np.uint8).tobytes() * 2
    rows = matching.greedy_sequences(table(spark, [data, b""])).orderBy("payload_id", "seq_no").collect()
    out, at = bytearray(), 0
    for r in [r for r in rows if r.payload_id == 0]:
        out += data[at : at + r.ll]
        for _ in range(r.ml):
            out.append(out[-r.distance])
        at = len(out)
    assert bytes(out) == data
    assert [(r.ll, r.ml) for r in rows if r.payload_id == 1] == [(0, 0)]
    sums = matching.parse_prefixes(matching.greedy_sequences(table(spark, [data]))).orderBy("seq_no").collect()
    assert sums[0].literals_before == 0 and sums[-1].literals_before + sums[-1].matched_before + sums[-1].ll + sums[-1].ml == len(data)


def test_repeat_offsets(spark):
    rows = [(1, 0, 5, 103), (1, 1, 2, 1), (1, 2, 0, 1), (1, 3, 4, 3), (1, 4, 0, 3)]
    got = matching.resolve_repeats(spark.createDataFrame(rows, "payload_id long, seq_no int, ll int, of_value int")).first().offsets
    # 100; again 100; without literals the second: 1; the third: 4; without literals the first less one: 3
    assert got == [100, 100, 1, 4, 3]


def test_huffman_and_normalisation():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 17, 256):
        counts = rng.zipf(1.3, size).clip(0, 100_000)
        bits = tables.code_lengths(counts, 11)
        assert bits.max() <= 11 and (bits > 0).all()
        assert sum(2.0 ** -int(b) for b in bits) <= 1 + 1e-12 or size == 1
        norm = tables.normalize(counts, 11)
        assert norm.sum() == 2048 and (norm[counts > 0] > 0).all()


def test_table_mode(spark):
    cases = [(1, 10, 10, 10, "rle"), (5, 10, 10, 10, "repeat"), (5, None, 10, 10, "predefined"), (5, None, 12, 10, "fse")]
    df = spark.createDataFrame(cases, "n int, r long, p long, f long, want string")
    assert df.where(tables.table_mode(F.col("n"), F.col("r"), F.col("p"), F.col("f")) != F.col("want")).count() == 0


def test_dictionary_helps(spark):
    contents = [b'{"name": "user%d", "role": "reader", "active": true, "last_login": "2024-01-%02d"}' % (i, i % 28) for i in range(400)]
    best = dictionaries.train(table(spark, contents), 4096).first()
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(c)) for c in contents)
    known = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(bytes(best.content)))
    assert sum(len(known.compress(c)) for c in contents) < 0.7 * plain
    assert dictionaries.dictionary_kind(bytes(best.content)) == ("raw", 0)


def test_dictionary_sweep_counts_every_held_out_row(spark):
    rng = np.random.default_rng(11)
    contents = [rng.bytes(300_000) for _ in range(60)]  # held-out rows of some 4 MB that no dictionary makes smaller
    df = table(spark, contents)
    held = df.where("pmod(pmod(xxhash64(payload_id), 1000003), 4) = 3").agg({"n_bytes": "sum"}).first()[0]
    assert held > 2 << 20
    assert all(held <= r.eval_bytes < 1.01 * held for r in dictionaries.train(df, 4096).collect())


def test_lanes():
    assert levels.heaviest_first_lanes([5, 9, 1, 1, 4], 2) == [1, 0, 0, 1, 1]
    lanes = levels.heaviest_first_lanes([7] * 6, 3)
    assert [lanes.count(k) for k in range(3)] == [2, 2, 2]


def test_gates_know_random_from_text(spark):
    rng = np.random.default_rng(8)
    words = b" ".join(rng.choice([b"some", b"words", b"of", b"text"], 20_000).tolist())
    noise = rng.bytes(100_000)
    df = table(spark, [noise, words, noise[:30_000] * 2, b"", noise[:100], bytes(50_000)])
    told = decisions.judged(df).orderBy("payload_id").collect()
    assert [r.stored for r in told] == [True, False, True, False, False, False] and [r.skipped for r in told][:2] == [True, False]
    kinds = decisions.stores(df).orderBy("payload_id").collect()
    assert [r.store for r in kinds] == ["row", "chain", "row", "chain", "row_head" if kinds[4].head_distinct < 96 else "row", "chain"]


def test_empty_table(spark):
    none = table(spark, [])
    for df in (entropy.byte_histogram(none), entropy.payload_entropy(none), chunking.fixed_blocks(none), frames.frames(none), matching.candidates(none), dictionaries.kmer_counts(none)):
        assert df.count() == 0


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.zst", b"one"), ("sub/b.bin", bytes(1000)), ("empty", b""), ("null", None)], "name string, content binary")
    told = source.write_files(rows, f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.n_bytes) for r in told) == [("a.zst", 3), ("empty", 0), ("null", 0), ("sub/b.bin", 1000)]
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.zst", "empty", "null", "sub/b.bin"]
    back = source.read_files(spark, f"{tmp_path}/out").orderBy("n_bytes").collect()
    assert [bytes(r.content) for r in back][-1] == bytes(1000)
    with pytest.raises(Exception, match="outside"):
        source.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), f"file://{tmp_path}/out").collect()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "sub" / "b.zst").write_bytes(zstandard.compress(b"xyz"))
    (tmp_path / ".gz").write_bytes(b"hidden names start with a dot")
    assert source.read_files(spark, str(tmp_path)).count() >= 2
    assert [r.content for r in source.read_files(spark, str(tmp_path), skip_compressed=True).where("path like '%.txt'").collect()] == [b"abc"]
    (tmp_path / "list").write_text(f"{tmp_path}/a.txt\n\n")
    assert source.listed_files(spark, str(tmp_path / "list")).count() == 1
    names = spark.createDataFrame([("x/a.zst",), ("x/a.tzst",), ("x/a.b",)], "p string").select(source.output_name(F.col("p"), True).alias("n"))
    assert [r.n for r in names.collect()] == ["x/a", "x/a.tar", None]
