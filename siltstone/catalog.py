"""Registered queries of the library and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import codec, codes
from siltstone.functions.bytesfn import checksum32, dictionary_id
from siltstone.operators import chunking, costs, decisions, dictionaries, entropy, frames, listing, matching, tables
from siltstone.plans import levels
from siltstone.sources.payloads import TABLES, payloads
from siltstone.streaming import chunks

QUERIES: dict = {}
SQL: dict = {}

#: Bytes of every document as rows (doc_id, pos, b), for the SQL side only.
_BYTES = """bytes AS (
  SELECT doc_id, unnest(hs) AS h, unnest(range(len(hs))) AS pos, len(hs) AS n
  FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS hs FROM documents)
), b AS (SELECT doc_id, pos, n, ('0x' || h)::INTEGER AS byte FROM bytes)"""
_ENTROPY = """, hist AS (SELECT doc_id, n, byte, count(*) AS c FROM b GROUP BY ALL),
ent AS (SELECT doc_id, n, count(*) AS n_distinct, n * log2(n) - sum(c * log2(c)) AS bits FROM hist GROUP BY doc_id, n),
e AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(n_distinct, 0) AS n_distinct, coalesce(bits, 0) AS bits FROM documents d LEFT JOIN ent ON d.doc_id = ent.doc_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return payloads(spark, sf_dir, "documents", *keep)


def _rounded(bits):
    return F.round(bits, 2)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_payloads, coalesce(sum(strlen({c})), 0)::BIGINT AS n_bytes, coalesce(max(strlen({c})), 0)::BIGINT AS longest FROM {t}" for t, (_, c) in TABLES.items()))
def payload_tables(spark, sf_dir):
    out = None
    for t in TABLES:
        one = payloads(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_payloads"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.max("n_bytes"), F.lit(0)).alias("longest"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_BYTES} SELECT byte, count(*) AS n FROM b GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return entropy.byte_histogram(_docs(spark, sf_dir))


@query(f"WITH {_BYTES}{_ENTROPY} SELECT doc_id, n AS n_bytes, n_distinct, round(bits, 2) AS bits, bits + 160 + 0.02 * n >= 8 * n AS stored FROM e")
def payload_entropy(spark, sf_dir):
    out = entropy.payload_entropy(_docs(spark, sf_dir))
    return out.select(F.col("payload_id").alias("doc_id"), "n_bytes", F.col("n_distinct").cast("long").alias("n_distinct"), _rounded("bits").alias("bits"), "stored")


@query(f"WITH {_BYTES}{_ENTROPY} SELECT source, count(*) AS n, count(*) FILTER (WHERE bits + 160 + 0.02 * n >= 8 * n) AS n_stored FROM e JOIN documents USING (doc_id) GROUP BY source")
def literal_gate(spark, sf_dir):
    return entropy.payload_entropy(_docs(spark, sf_dir, "source")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("stored").alias("n_stored"))


@query(f"WITH {_BYTES}{_ENTROPY} SELECT doc_id, n <= 0 OR n_distinct <= 1 AS uniform FROM e")
def uniform_payloads(spark, sf_dir):
    return entropy.uniform(_docs(spark, sf_dir)).select(F.col("payload_id").alias("doc_id"), "uniform")


@query(f"WITH {_BYTES} SELECT doc_id, count(DISTINCT byte) AS n_distinct FROM b WHERE pos % ((n // 2048) | 1) = 0 GROUP BY doc_id")
def strided_distinct(spark, sf_dir):
    out = entropy.sampled_distinct(_docs(spark, sf_dir).where("n_bytes > 0"))
    return out.select(F.col("payload_id").alias("doc_id"), F.col("n_distinct").cast("long").alias("n_distinct"))


@query(f"""WITH {_BYTES}, p AS (SELECT * FROM (VALUES (0), (1), (2)) AS t(k)),
probes AS (SELECT doc_id, k, count(DISTINCT byte) AS d FROM b, p
  WHERE pos >= CASE k WHEN 0 THEN 0 WHEN 1 THEN greatest(0, n // 2 - 2048) ELSE greatest(0, n - 4096) END
    AND pos < CASE k WHEN 0 THEN 0 WHEN 1 THEN greatest(0, n // 2 - 2048) ELSE greatest(0, n - 4096) END + 4096 GROUP BY doc_id, k)
SELECT d.doc_id, coalesce(max(p.d) >= 48, false) AS wide FROM documents d LEFT JOIN probes p ON d.doc_id = p.doc_id GROUP BY d.doc_id""")
def wide_alphabet(spark, sf_dir):
    """With 48 distinct bytes for wide: text hardly reaches the 128 that binary payloads are judged by."""
    return entropy.wide_alphabet(_docs(spark, sf_dir), least=48).select(F.col("payload_id").alias("doc_id"), "wide")


_HEAD = f"""WITH {_BYTES}, h AS (SELECT doc_id, count(DISTINCT byte) AS d FROM b WHERE pos < 8192 AND pos % ((least(n, 8192) >> 11) | 1) = 0 GROUP BY doc_id)"""


@query(_HEAD + """ SELECT documents.doc_id, coalesce(d, 0)::INTEGER AS head_distinct, CASE WHEN d >= 96 THEN 'row' WHEN d >= 48 THEN 'row_head' ELSE 'chain' END AS store
FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id""")
def candidate_stores(spark, sf_dir):
    return decisions.stores(_docs(spark, sf_dir)).select(F.col("payload_id").alias("doc_id"), "head_distinct", "store")


@query(_HEAD + " SELECT source, count(*) FILTER (WHERE coalesce(d, 0) < 48) AS light, count(*) AS n FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id GROUP BY source")
def light_searches(spark, sf_dir):
    rows = decisions.stores(_docs(spark, sf_dir, "source"))
    return rows.groupBy("source").agg(F.count_if(decisions.light_attempts(F.col("head_distinct"))).alias("light"), F.count("*").alias("n"))


@query(f"""WITH {_BYTES}, d AS (SELECT doc_id, count(DISTINCT byte) FILTER (WHERE pos % 8 = 0) AS d, count(DISTINCT byte) FILTER (WHERE pos < 4096) AS first FROM b GROUP BY doc_id)
SELECT documents.doc_id, (CASE WHEN coalesce(first, 0) <= 1 THEN 0 ELSE least(128, d) END)::INTEGER AS n_distinct FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id""")
def far_distinct(spark, sf_dir):
    return decisions.far_distinct(_docs(spark, sf_dir)).withColumnRenamed("payload_id", "doc_id")


@query(f"""WITH {_BYTES}, d AS (SELECT doc_id, count(DISTINCT byte) FILTER (WHERE pos % greatest(1, n // 128) = 0) AS a, count(DISTINCT byte) FILTER (WHERE pos % greatest(1, n // 512) = 0) AS z FROM b GROUP BY doc_id)
SELECT documents.doc_id, coalesce(a > 20 AND z >= 42, false) AS dense FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id""")
def small_dense(spark, sf_dir):
    return decisions.small_dense(_docs(spark, sf_dir)).withColumnRenamed("payload_id", "doc_id")


_STRIDED8 = """SELECT doc_id, i AS pos, substring(h, 2 * i + 1, 16) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 7), {step})) AS i
  FROM (SELECT doc_id, {head} AS h FROM documents))"""


@query("WITH g AS (" + _STRIDED8.format(head="substring(hex(encode(coalesce(text, ''))), 1, 16384)", step="((length(h) // 2) >> 11) | 1") + """), b AS (SELECT doc_id, count(DISTINCT substring(h, 2 * i + 1, 2)) AS d
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, ((length(h) // 2) >> 11) | 1)) AS i FROM (SELECT doc_id, substring(hex(encode(coalesce(text, ''))), 1, 16384) AS h FROM documents)) GROUP BY doc_id),
r AS (SELECT doc_id, count(DISTINCT k) < count(*) AS repeats FROM g GROUP BY doc_id)
SELECT documents.doc_id, coalesce(d >= 40 AND repeats, false) AS parses FROM documents LEFT JOIN b ON documents.doc_id = b.doc_id LEFT JOIN r ON documents.doc_id = r.doc_id""")
def head_repeats(spark, sf_dir):
    """With 40 distinct bytes for wide: text hardly reaches the 128 that binary payloads are judged by."""
    return decisions.head_repeats(_docs(spark, sf_dir), least=40).withColumnRenamed("payload_id", "doc_id")


@query("WITH g AS (" + _STRIDED8.format(head="hex(encode(coalesce(text, '')))", step="4") + """), c AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, k ORDER BY pos) AS prev FROM g),
t AS (SELECT doc_id, count(*) AS samples, count(*) FILTER (WHERE pos - prev >= 1024) AS far FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(samples, 0) AS samples, coalesce(far, 0) AS far, coalesce(far, 0) * 12 >= coalesce(samples, 0) AS dominant FROM documents LEFT JOIN t ON documents.doc_id = t.doc_id""")
def far_repeats(spark, sf_dir):
    """Every fourth place and a reach of 1 KiB: documents are shorter than the strips that the default stride is for."""
    return decisions.far_repeats(_docs(spark, sf_dir), 1024, 4).withColumnRenamed("payload_id", "doc_id")


_RANDOM = """WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN array_to_string(list_transform(range(600), lambda i: upper(sha256(concat(page_id, ':', i)))), '') ELSE repeat(hex(encode(coalesce(html, ''))), 8) END AS h FROM pages),
q AS (SELECT page_id, h, length(h) // 2 AS n FROM p),
s AS (SELECT page_id, n, substring(h, 2 * i + 1, 2) AS byte FROM (SELECT page_id, h, n, unnest(range(0, n, greatest(1, n // 1024))) AS i FROM q WHERE n >= 8192)),
sh AS (SELECT page_id, n, byte, count(*) AS c FROM s GROUP BY ALL),
st AS (SELECT page_id, n, count(*) AS d, log2(sum(c)) - sum(c * log2(c)) / sum(c) + (count(*) - 1) / (2 * ln(2) * sum(c)) AS bits FROM sh GROUP BY page_id, n),
m AS (SELECT page_id, n, i, substring(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 8 <= n THEN substring(h, 2 * i + 1, 16) END AS k FROM (SELECT page_id, h, n, unnest(range(0, n, (n >> 11) | 1)) AS i FROM q WHERE n >= 16384)),
mh AS (SELECT page_id, byte, count(*) AS c FROM m GROUP BY ALL),
mt AS (SELECT page_id, count(*) AS d, log2(sum(c)) - sum(c * log2(c)) / sum(c) + (count(*) - 1) / (2 * ln(2) * sum(c)) AS bits FROM mh GROUP BY page_id),
mr AS (SELECT page_id, count(DISTINCT k) < count(k) AS repeats FROM m GROUP BY page_id)
SELECT q.page_id, coalesce(st.d > 208 AND st.bits + 160.0 / q.n + 0.02 + 0.12 >= 8, false) AS stored, coalesce(NOT repeats AND mt.d >= 96 AND mt.bits + 0.12 >= 8, false) AS skipped
FROM q LEFT JOIN st ON q.page_id = st.page_id LEFT JOIN mt ON q.page_id = mt.page_id LEFT JOIN mr ON q.page_id = mr.page_id"""


@query(_RANDOM)
def random_payloads(spark, sf_dir):
    """Pages with even ids give way to 19,200 bytes of hashes; the others are repeated eight times, so that they are long enough to be judged."""
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: F.sha2(F.concat_ws(":", F.col("payload_id").cast("string"), i.cast("string")), 256)), ""))
    rows = payloads(spark, sf_dir, "pages").withColumn("content", F.when(F.col("payload_id") % 2 == 0, noise).otherwise(F.unhex(F.repeat(F.hex(F.coalesce("content", F.lit(b""))), F.lit(8)))))
    return decisions.judged(rows).withColumnRenamed("payload_id", "page_id")


@query(f"""WITH {_BYTES}, h AS (SELECT doc_id, pos // 4096 AS block_no, byte, count(*) AS c FROM b GROUP BY ALL)
SELECT doc_id, block_no::INTEGER AS block_no, sum(c)::BIGINT AS n_bytes, count(*) AS n_distinct, round(sum(c) * log2(sum(c)) - sum(c * log2(c)), 2) AS bits FROM h GROUP BY doc_id, block_no""")
def block_entropy(spark, sf_dir):
    out = entropy.block_entropy(_docs(spark, sf_dir), 4096)
    return out.select(F.col("payload_id").alias("doc_id"), "block_no", "n_bytes", F.col("n_distinct").cast("long").alias("n_distinct"), _rounded("bits").alias("bits"))


@query(f"""WITH {_BYTES}, h AS (SELECT doc_id, n, byte, count(*) AS c FROM b GROUP BY ALL),
logs AS (SELECT k, floor(256 * (8 - log2(greatest(1, k))))::BIGINT AS v FROM range(257) AS t(k))
SELECT doc_id, (sum(c * v) // 256)::BIGINT AS cost_bits FROM h JOIN logs ON k = greatest(1, c * 256 // n) GROUP BY doc_id""")
def fixed_point_cost(spark, sf_dir):
    out = entropy.histograms(_docs(spark, sf_dir).where("n_bytes > 0"))
    return out.select(F.col("payload_id").alias("doc_id"), entropy.fixed_point_bits(F.col("counts")).alias("cost_bits"))


@query("""SELECT doc_id, k::INTEGER AS block_no, k * 1024 AS byte_offset, least(1024, n - k * 1024)::BIGINT AS size
FROM (SELECT doc_id, n, unnest(range((n + 1023) // 1024)) AS k FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents))""")
def fixed_blocks(spark, sf_dir):
    return chunking.fixed_blocks(_docs(spark, sf_dir), 1024).withColumnRenamed("payload_id", "doc_id")


@query(f"""WITH {_BYTES}, h AS (SELECT doc_id, pos // 1024 AS k, byte, count(*) AS c FROM b WHERE pos // 1024 < n // 1024 GROUP BY ALL),
pairs AS (SELECT DISTINCT x.doc_id, x.k FROM h x WHERE x.k > 0),
keys AS (SELECT p.doc_id, p.k, h.byte FROM pairs p JOIN h ON h.doc_id = p.doc_id AND h.k IN (p.k, p.k - 1) GROUP BY ALL)
SELECT keys.doc_id, keys.k::INTEGER AS chunk_no, sum(abs(coalesce(a.c, 0) - coalesce(z.c, 0)) * 1024)::BIGINT AS distance
FROM keys LEFT JOIN h a ON a.doc_id = keys.doc_id AND a.k = keys.k AND a.byte = keys.byte
LEFT JOIN h z ON z.doc_id = keys.doc_id AND z.k = keys.k - 1 AND z.byte = keys.byte GROUP BY keys.doc_id, keys.k""")
def fingerprint_distance(spark, sf_dir):
    return chunking.chunk_distances(_docs(spark, sf_dir)).withColumnRenamed("payload_id", "doc_id")


@query(f"""WITH {_BYTES}, h AS (SELECT doc_id, pos // 1024 AS k, byte, count(*) AS c FROM b WHERE pos // 1024 < n // 1024 GROUP BY ALL),
keys AS (SELECT DISTINCT z.doc_id, z.k + 1 AS k, z.byte FROM h z JOIN (SELECT DISTINCT doc_id, k FROM h) n ON n.doc_id = z.doc_id AND n.k = z.k + 1 UNION SELECT doc_id, k, byte FROM h WHERE k > 0)
SELECT keys.doc_id, keys.k * 1024 AS byte_offset FROM keys LEFT JOIN h a ON a.doc_id = keys.doc_id AND a.k = keys.k AND a.byte = keys.byte
LEFT JOIN h z ON z.doc_id = keys.doc_id AND z.k = keys.k - 1 AND z.byte = keys.byte GROUP BY keys.doc_id, keys.k HAVING sum(abs(coalesce(a.c, 0) - coalesce(z.c, 0))) >= 0.2 * 2 * 1024""")
def content_changes(spark, sf_dir):
    """At a fifth of the largest distance: texts are more alike than the payloads that the default is for."""
    return chunking.content_changes(_docs(spark, sf_dir), least=0.2).withColumnRenamed("payload_id", "doc_id")


@query()
def content_splits(spark, sf_dir):
    return chunking.content_splits(_docs(spark, sf_dir)).groupBy(F.col("payload_id").alias("doc_id")).agg(F.count("*").alias("n_splits"), F.max("split").alias("last_split"))


@query("""SELECT page_id, job_size, greatest(1, ceil(n / job_size))::BIGINT AS n_jobs FROM (SELECT page_id, n, least(1073741824, greatest(1048576, (n + 15) // 16))::BIGINT AS job_size
FROM (SELECT page_id, strlen(coalesce(html, '')) * 40009 AS n FROM pages))""")
def job_grid(spark, sf_dir):
    """Of payloads 40,009 times as long as the pages, so that jobs of every size come up."""
    rows = payloads(spark, sf_dir, "pages").withColumn("n_bytes", F.col("n_bytes") * 40009)
    return chunking.jobs(rows).withColumnRenamed("payload_id", "page_id")


@query(f"""WITH t(level, strategy) AS (VALUES {", ".join(f"({a}, '{b}')" for a, b, *_ in levels.LEVELS)}), p AS (SELECT strlen(coalesce(html, '')) * 40009 AS n FROM pages)
SELECT level, sum(CASE WHEN strategy = 'btlazy' THEN 16777216 ELSE least(1073741824, greatest(4194304, (n + 15) // 16)) END)::BIGINT AS job_bytes FROM t, p GROUP BY level""")
def level_job_sizes(spark, sf_dir):
    rows = payloads(spark, sf_dir, "pages").select((F.col("n_bytes") * 40009).alias("n")).withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("strategy")) for a, b, *_ in levels.LEVELS])))
    return rows.groupBy("t.level").agg(F.sum(chunking.level_job_size(F.col("t.strategy"), F.col("n"), 8, 4 << 20)).cast("long").alias("job_bytes"))


@query("""WITH RECURSIVE e(epoch, byte_offset, job_size) AS (SELECT 0, 0::BIGINT, 1048576::BIGINT UNION ALL
  SELECT epoch + 1, byte_offset + 8 * job_size, least(2 * job_size, (268435456 - 262144) // 8) FROM e WHERE epoch < 11) SELECT * FROM e""")
def growing_jobs(spark, sf_dir):
    return chunking.growing_jobs(spark)


_GRAM5 = """WITH g AS (SELECT doc_id, i AS pos, substring(h, 2 * i + 1, 10) AS k FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 4))) AS i
  FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents))), c AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, k ORDER BY pos) AS prev FROM g)"""


@query(_GRAM5 + """ SELECT d.doc_id, count(pos) AS positions, count(prev) AS matched, count(*) FILTER (WHERE pos - prev <= 4096) AS near, coalesce(sum(pos - prev), 0)::BIGINT AS distance
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def asof_match_candidates(spark, sf_dir):
    return matching.candidate_summary(_docs(spark, sf_dir)).withColumnRenamed("payload_id", "doc_id")


@query(_GRAM5 + " SELECT (length(bin(pos - prev)) - 1)::INTEGER AS bucket, count(*) AS n FROM c WHERE prev IS NOT NULL GROUP BY ALL")
def offset_spectrum(spark, sf_dir):
    return matching.offset_spectrum(_docs(spark, sf_dir))


@query(_GRAM5.split(", c AS")[0] + """, c AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, k ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n_candidates FROM g)
SELECT doc_id, n_candidates::INTEGER AS n_candidates, count(*) AS n FROM c WHERE n_candidates > 0 GROUP BY ALL""")
def newest_match_candidates(spark, sf_dir):
    return matching.newest_candidates(_docs(spark, sf_dir)).withColumnRenamed("payload_id", "doc_id")


@query("""WITH w AS (SELECT substring(h, 128 * i + 1, 128) AS x FROM (SELECT h, unnest(range(length(h) // 128)) AS i FROM (SELECT hex(encode(coalesce(text, ''))) AS h FROM documents)))
SELECT md5(unhex(x)) AS hash, count(*) AS n FROM w GROUP BY x HAVING count(*) > 1""")
def twin_windows(spark, sf_dir):
    return matching.twins(_docs(spark, sf_dir))


@query()
def long_distance_matches(spark, sf_dir):
    found = matching.long_distance(_docs(spark, sf_dir))
    return found.groupBy(F.col("payload_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("distance").alias("distance"))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS restored FROM documents")
def parse_restores_length(spark, sf_dir):
    """Literal and match lengths of a greedy parse add up to the payload."""
    seqs = matching.greedy_sequences(_docs(spark, sf_dir))
    return seqs.groupBy(F.col("payload_id").alias("doc_id")).agg(F.sum(F.col("ll") + F.col("ml")).cast("long").alias("restored"))


@query()
def sequence_code_histogram(spark, sf_dir):
    seqs = matching.greedy_sequences(_docs(spark, sf_dir)).where("ml > 0")
    channel = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), v.cast("int").alias("code")) for c, v in (("ll", codes.literal_length_code(F.col("ll"))), ("ml", codes.match_length_code(F.col("ml"))), ("of", codes.offset_code(F.col("distance") + 3)))])).alias("c")
    return seqs.select(channel).groupBy("c.channel", "c.code").agg(F.count("*").alias("n"))


def _code_sql() -> str:
    values = ", ".join(f"('{c}', {k}, {v}, {v + (1 << b)})" for c, t in (("ll", codes.LITERAL_LENGTHS), ("ml", codes.MATCH_LENGTHS)) for k, (v, b) in enumerate(t))
    return f"""WITH t(channel, code, base, past) AS (VALUES {values}), v AS (SELECT DISTINCT strlen(coalesce(text, '')) AS v FROM documents)
SELECT v AS length, max(code) FILTER (WHERE channel = 'll') AS ll_code, max(code) FILTER (WHERE channel = 'ml') AS ml_code, (length(bin(v)) - 1)::INTEGER AS of_code
FROM v JOIN t ON v >= base AND v < past WHERE v >= 3 GROUP BY v"""


@query(_code_sql())
def length_codes(spark, sf_dir):
    n = _docs(spark, sf_dir).where("n_bytes >= 3").select(F.col("n_bytes").alias("length")).distinct()
    v = F.col("length")
    return n.select("length", codes.literal_length_code(v).alias("ll_code"), codes.match_length_code(v).alias("ml_code"), codes.offset_code(v).alias("of_code"))


@query("SELECT d AS byte, ((1 << (10 + d // 8)) + (1 << (10 + d // 8)) // 8 * (d % 8))::BIGINT AS window_size FROM (SELECT range AS d FROM range(176))")
def window_sizes(spark, sf_dir):
    """Descriptors up to the largest window that a 32-bit exponent names here, 2 GiB."""
    return spark.range(176).select(F.col("id").alias("byte"), codes.window_size(F.col("id").cast("int")).alias("window_size"))


@query("""SELECT d AS byte, (d >> 6)::INTEGER AS size_flag, (d & 32) <> 0 AS single_segment, (d & 8) <> 0 AS reserved, (d & 4) <> 0 AS has_checksum,
  (CASE d >> 6 WHEN 0 THEN (CASE WHEN d & 32 <> 0 THEN 1 ELSE 0 END) WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::INTEGER AS size_bytes,
  (CASE d & 3 WHEN 3 THEN 4 ELSE d & 3 END)::INTEGER AS dictionary_bytes, (d >> 6) <> 0 OR (d & 32) <> 0 AS declares_size,
  (5 + CASE WHEN d & 32 <> 0 THEN 0 ELSE 1 END + CASE d & 3 WHEN 3 THEN 4 ELSE d & 3 END
   + CASE d >> 6 WHEN 0 THEN (CASE WHEN d & 32 <> 0 THEN 1 ELSE 0 END) WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::INTEGER AS header_bytes FROM (SELECT range AS d FROM range(256))""")
def header_descriptors(spark, sf_dir):
    fields = codes.descriptor_fields(F.col("id").cast("int"))
    return spark.range(256).select(F.col("id").alias("byte"), *[c.alias(name) for name, c in fields.items()])


@query("SELECT doc_id, n + (n >> 8) + (CASE WHEN n < 131072 THEN (131072 - n) >> 11 ELSE 0 END) AS bound FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def compress_bounds(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("payload_id").alias("doc_id"), codes.compress_bound(F.col("n_bytes")).alias("bound"))


def _level_sql() -> str:
    rows = ", ".join(f"({a}, '{b}', {c}, {str(d).lower()})" for a, b, c, d in levels.LEVELS)
    return f"""WITH t(level, strategy, window_log, long_distance) AS (VALUES {rows})
SELECT level, count(*) AS n, max(greatest(10, least(window_log, CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END)))::INTEGER AS widest
FROM t, (SELECT strlen(coalesce(html, '')) AS n FROM pages) GROUP BY level"""


@query(_level_sql())
def level_windows(spark, sf_dir):
    """The widest window that each level needs for any page. The level table has a row per level, so it goes to every task."""
    rows = payloads(spark, sf_dir, "pages").select("n_bytes").withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(c).alias("window_log")) for a, _, c, _ in levels.LEVELS])))
    return rows.groupBy("t.level").agg(F.count("*").alias("n"), F.max(levels.adjusted_window_log(F.col("t.window_log"), F.col("n_bytes"))).alias("widest"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 8 // (SELECT count(*) FROM documents))::INTEGER AS lane FROM documents")
def consecutive_lanes(spark, sf_dir):
    return levels.consecutive_lanes(_docs(spark, sf_dir), 8).withColumnRenamed("payload_id", "doc_id")


@query("SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, md5(coalesce(text, '')) AS md5, NULL::VARCHAR AS error FROM documents")
def zstd_roundtrip(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("payload_id", F.coalesce("content", F.lit(b"")).alias("content"))
    back = rows.select("payload_id", codec.compressor()("content").alias("content")).select("payload_id", codec.decompressor()("content").alias("d"))
    return back.select(F.col("payload_id").alias("doc_id"), F.octet_length("d.content").cast("long").alias("n_bytes"), F.md5("d.content").alias("md5"), F.col("d.error").alias("error"))


@query("SELECT count(*) AS n, count(*) AS n_ok FROM documents")
def frame_checksums(spark, sf_dir):
    """The four bytes that end a frame are the content's checksum."""
    rows = _docs(spark, sf_dir).select(F.coalesce("content", F.lit(b"")).alias("content"))
    rows = rows.select(checksum32("content").alias("sum"), codec.compressor()("content").alias("z"))
    tail = F.concat(*[F.substring(F.hex(F.substring(F.col("z"), -k, 1)), 1, 2) for k in (1, 2, 3, 4)])
    return rows.agg(F.count("*").alias("n"), F.count_if(F.conv(tail, 16, 10).cast("long") == F.col("sum")).alias("n_ok"))


def _framed(spark, sf_dir) -> DataFrame:
    rows = _docs(spark, sf_dir, "source").withColumn("content", F.coalesce("content", F.lit(b"")))
    return rows.withColumn("content", codec.compressor()("content"))


@query("""SELECT doc_id, 0 AS frame_no, 'frame' AS kind, n AS content_size, true AS has_checksum, 0::BIGINT AS dict_id, NULL::VARCHAR AS error
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""")
def frame_headers(spark, sf_dir):
    return frames.frames(_framed(spark, sf_dir)).select(F.col("payload_id").alias("doc_id"), "frame_no", "kind", F.col("content_size").cast("long").alias("content_size"), "has_checksum", "dict_id", "error")


@query("""SELECT source, 2 * count(*) AS frames, count(*) AS skips, (2 * sum(strlen(coalesce(text, ''))))::BIGINT AS decompressed, true AS uses_check, 0::BIGINT AS errors FROM documents GROUP BY source""")
def file_totals(spark, sf_dir):
    """Each payload framed twice around a skippable frame, listed, and summed by source."""
    rows = _framed(spark, sf_dir)
    rows = rows.withColumn("content", F.concat("content", frames.skippable_frame(F.encode(F.col("source"), "utf-8"), 3), "content"))
    return frames.totals(frames.frames(rows, "payload_id", "source"), "source").drop("compressed", "ratio")


@query("SELECT doc_id, n AS bound FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def decompress_bounds(spark, sf_dir):
    return frames.decompress_bound(frames.frames(_framed(spark, sf_dir)), "payload_id").withColumnRenamed("payload_id", "doc_id")


def _stored(spark, sf_dir, *keep: str, block: int = 1000) -> DataFrame:
    """Documents as frames of raw blocks of 1,000 bytes: what a listing says of them can be computed without the codec."""
    return _docs(spark, sf_dir, *keep).withColumn("content", frames.stored_frame(F.col("content"), block))


_N = "(SELECT *, strlen(coalesce(text, '')) AS n FROM documents)"


@query(f"""SELECT doc_id, k::INTEGER AS block_no, k = greatest(1, ceil(n / 1000)) - 1 AS last, 'raw' AS block_type, least(1000, n - 1000 * k)::INTEGER AS stored_size, (13 + 1003 * k)::BIGINT AS byte_offset
FROM (SELECT *, unnest(range(greatest(1, ceil(n / 1000))::BIGINT)) AS k FROM {_N})""")
def block_types(spark, sf_dir):
    return frames.blocks(_stored(spark, sf_dir)).drop("frame_no").withColumnRenamed("payload_id", "doc_id")


@query(f"""SELECT source, count(*) AS frames, sum(13 + 3 * greatest(1, ceil(n / 1000)) + n)::BIGINT AS compressed, sum(n)::BIGINT AS decompressed, round(sum(n) / sum(13 + 3 * greatest(1, ceil(n / 1000)) + n), 6) AS ratio
FROM {_N} GROUP BY source""")
def stored_ratios(spark, sf_dir):
    out = frames.totals(frames.frames(_stored(spark, sf_dir, "source"), "payload_id", "source"), "source")
    return out.select("source", "frames", "compressed", "decompressed", F.round("ratio", 6).alias("ratio"))


@query(f"""SELECT doc_id, (2 * (13 + 3 * greatest(1, ceil(n / 1000))) + 8 + strlen(coalesce(source, '')) + least(n, 131072))::BIGINT AS margin, n AS first_size
FROM {_N}""")
def in_place_margins(spark, sf_dir):
    """Two frames around a skippable one; the size that the first frame declares is the bound that a caller asks for."""
    rows = _stored(spark, sf_dir, "source")
    rows = rows.withColumn("content", F.concat("content", frames.skippable_frame(F.encode(F.coalesce("source", F.lit("")), "utf-8"), 7), "content"))
    found = frames.frames(rows)
    first = F.max(F.when(F.col("frame_no") == 0, F.col("content_size"))).cast("long").alias("first_size")
    return listing.in_place_margin(found, "payload_id").join(found.groupBy("payload_id").agg(first), "payload_id").withColumnRenamed("payload_id", "doc_id")


@query("SELECT doc_id, (doc_id % 16)::INTEGER AS variant, coalesce(source, '') AS payload FROM documents")
def skippable_payloads(spark, sf_dir):
    """Sources as user data in skippable frames of every variant, between frames of the text, and read again."""
    rows = _stored(spark, sf_dir, "source")
    skips = F.element_at(F.array(*[frames.skippable_frame(F.encode(F.coalesce("source", F.lit("")), "utf-8"), k) for k in range(16)]), (F.col("payload_id") % 16 + 1).cast("int"))
    rows = rows.withColumn("content", F.concat("content", skips, "content"))
    out = listing.skippable_payloads(frames.frames(rows), rows)
    return out.select(F.col("payload_id").alias("doc_id"), "variant", F.decode("payload", "utf-8").alias("payload"))


_CASES = "CASE doc_id % 6 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} WHEN 4 THEN {} ELSE {} END"


@query("SELECT doc_id, " + _CASES.format("'ok'", "'not zstd'", "'not zstd'", "'truncated'", "'frame error'", "'not zstd'") + """ AS verdict, doc_id % 6 = 1 AS incomplete_tail,
  doc_id % 6 IN (0, 4) AS listed, doc_id % 6 = 0 AS counted FROM documents""")
def listing_verdicts(spark, sf_dir):
    """Whole frames, and frames with a short tail, behind other bytes, before a skippable frame that is cut off, cut off themselves, and
    followed by other bytes."""
    k, z = F.col("payload_id") % 6, F.col("content")
    broken = F.when(k == 1, F.concat(z, F.lit(b"abc"))).when(k == 2, F.concat(F.lit(b"other"), z)).when(k == 3, F.concat(z, F.unhex(F.lit("5A2A4D18FF000000")), F.lit(b"cut off")))
    broken = broken.when(k == 4, F.substring(z, F.lit(1), F.octet_length(z) - 1)).when(k == 5, F.concat(z, F.lit(b"more bytes"))).otherwise(z)
    # a frame without its last byte: an empty one lacks a part of its block header
    found = frames.frames(_stored(spark, sf_dir).withColumn("content", broken))
    return listing.verdicts(found, "payload_id").withColumnRenamed("payload_id", "doc_id")


@query("""WITH f AS (SELECT doc_id, doc_id % 3 AS a, (doc_id // 3) % 3 AS b, (doc_id // 9) % 3 AS c FROM documents),
x AS (SELECT *, a <> 0 AND a <> b AS clash1, CASE WHEN a <> 0 AND a <> b THEN 0 ELSE b END AS s FROM f)
SELECT doc_id, (CASE WHEN s <> 0 AND s <> c THEN 0 ELSE c END)::BIGINT AS dict_id, clash1 OR (s <> 0 AND s <> c) AS warned FROM x""")
def shown_dictionaries(spark, sf_dir):
    """Empty frames that name the dictionaries 0, 1 and 2 in every order."""
    def frame(i):
        return F.unhex(F.concat(F.lit("28B52FFD21"), F.lpad(F.hex(i.cast("long")), 2, "0"), F.lit("00010000")))

    d = F.col("payload_id")
    rows = _docs(spark, sf_dir).withColumn("content", F.concat(*[frame(F.floor(d / 3**k) % 3) for k in range(3)]))
    return listing.shown_dictionary(frames.frames(rows), "payload_id").withColumnRenamed("payload_id", "doc_id")


def _human_sql() -> str:
    def text(bits: int, places: int) -> str:
        v, u = f"(n::HUGEINT * {10**places})", f"{1 << bits}::HUGEINT"
        whole = f"({v} // {u} + CASE WHEN 2 * ({v} % {u}) > {u} OR (2 * ({v} % {u}) = {u} AND ({v} // {u}) % 2 = 1) THEN 1 ELSE 0 END)"
        return f"({whole})::VARCHAR" if not places else f"concat({whole} // {10**places}, '.', lpad(({whole} % {10**places})::VARCHAR, {places}, '0'))"

    out = "concat(n, ' B')"
    for name, bits in reversed(listing.PREFIXES):
        u = f"{1 << bits}::HUGEINT"
        out = f"CASE WHEN n >= {u} THEN concat(CASE WHEN n % {u} = 0 OR n >= 100 * {u} THEN {text(bits, 0)} WHEN n >= 10 * {u} THEN {text(bits, 1)} ELSE {text(bits, 2)} END, ' {name}') ELSE {out} END"
    return f"SELECT doc_id, k::INTEGER AS k, n::BIGINT AS n, {out} AS shown FROM (SELECT doc_id, k, (strlen(coalesce(text, '')) + 3)::HUGEINT * (1::BIGINT << (7 * k)) AS n FROM documents, range(7) AS t(k))"


@query(_human_sql())
def human_sizes(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("payload_id").alias("doc_id"), "n_bytes", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    rows = rows.withColumn("n", (F.col("n_bytes") + 3) * F.element_at(F.array(*[F.lit(1 << (7 * k)).cast("long") for k in range(7)]), F.col("k") + 1))
    return rows.select("doc_id", "k", "n", listing.human_size(F.col("n")).alias("shown"))


_SUFFIX = list(listing.SUFFIXES) + ["B", "k", "T"]


@query(f"""WITH u(i, suffix, unit) AS (VALUES {", ".join(f"({i}, '{s}', {1 << listing.SUFFIXES[s] if s in listing.SUFFIXES else 'NULL'})" for i, s in enumerate(_SUFFIX))})
SELECT concat(n, suffix) AS text, coalesce(any_value(n::HUGEINT * unit), -1)::BIGINT AS size FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) d JOIN u ON i = doc_id % {len(_SUFFIX)} GROUP BY ALL""")
def parsed_sizes(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("payload_id") % len(_SUFFIX) + 1).cast("int"))
    rows = _docs(spark, sf_dir).select(F.concat(F.col("n_bytes").cast("string"), suffix).alias("text")).distinct()
    return rows.select("text", F.coalesce(listing.parse_size(F.col("text")), F.lit(-1)).alias("size"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN concat('content size mismatch: declared ', n, ', actual ', n + 1) END AS error FROM {_N}""")
def content_size_checks(spark, sf_dir):
    """Every seventh text is a byte longer than its frame says."""
    rows = _docs(spark, sf_dir).select("payload_id", "n_bytes", frames.stored_frame(F.col("content")).alias("content"))
    found = frames.frames(rows, "payload_id", "n_bytes")
    actual = F.col("n_bytes") + F.when(F.col("payload_id") % 7 == 3, 1).otherwise(0)
    return found.select(F.col("payload_id").alias("doc_id"), listing.size_error(F.col("content_size"), actual).alias("error"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def passed_through(spark, sf_dir):
    """Every third text comes as it is, the others as frames; what is no frame is passed through."""
    rows = _docs(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit(b"")))
    rows = rows.withColumn("content", F.when(F.col("payload_id") % 3 == 0, F.col("content")).when(F.col("payload_id") % 3 == 1, frames.stored_frame(F.col("content"))).otherwise(codec.compressor()("content")))
    return rows.select(F.col("payload_id").alias("doc_id"), F.md5(listing.decoded_or_same(F.col("content"))).alias("md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN md5(coalesce(text, '')) END AS md5, CASE WHEN doc_id % 4 = 3 THEN 'missing dictionary' END AS error FROM documents")
def dictionary_lookup(spark, sf_dir):
    """Frames that need one of two dictionaries, none, or one that the table hasn't; each is decoded with the row of its id."""
    rows = _docs(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit(b"")))
    made = dictionaries.sample_dictionaries(3)
    k = (F.col("payload_id") % 4).cast("int")
    framed = F.when(k == 0, codec.compressor()("content"))
    for i, d in enumerate(made.values()):
        framed = framed.when(k == i + 1, codec.compressor(dictionary=d)("content"))
    rows = rows.withColumn("content", framed)
    found = frames.frames(rows).select("payload_id", "dict_id").join(rows.select("payload_id", "content"), "payload_id")
    table = spark.createDataFrame(list(made.items())[:2], "dict_id long, dictionary binary")
    return listing.decompressed_with(found, table).select(F.col("payload_id").alias("doc_id"), F.md5("decoded").alias("md5"), "error")


@query(f"""SELECT doc_id, (CASE WHEN v < 256 THEN 1 WHEN v < 65536 THEN 2 WHEN v < 4294967296 THEN 4 ELSE 8 END)::INTEGER AS width, (length(bin(v + 2)) - 1)::INTEGER AS price,
  4 * (n % 9) >= length(bin(v + 1)) - 1 + 7 AS pays FROM (SELECT doc_id, n, n * n * (doc_id % 5) AS v FROM {_N})""")
def field_widths(spark, sf_dir):
    v = F.col("n_bytes") * F.col("n_bytes") * (F.col("payload_id") % 5)
    return _docs(spark, sf_dir).select(F.col("payload_id").alias("doc_id"), codes.field_width(v).alias("width"), codes.offset_price(v + 1).alias("price"), codes.pays_for_offset(F.col("n_bytes") % 9, v + 1, F.lit(False)).alias("pays"))


@query("""SELECT doc_id, greatest(10, least(27, length(bin(greatest(n, 1)))))::INTEGER AS window_log, greatest(1000, n) AS decode_bound, CASE WHEN b * 50 <= a * 49 THEN 'shrink' ELSE 'keep' END AS reach
FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n, strlen(coalesce(text, ''))::DOUBLE AS a, length(coalesce(text, ''))::DOUBLE AS b FROM documents)""")
def patch_windows(spark, sf_dir):
    """Windows for patching against each text, and the reach that is chosen if its bytes and its letters were the two costs."""
    rows = _docs(spark, sf_dir, F.coalesce(F.char_length("text"), F.lit(0)).cast("double").alias("letters"))
    reach = decisions.reach(F.col("n_bytes").cast("double"), F.col("letters"))
    return rows.select(F.col("payload_id").alias("doc_id"), levels.patch_window_log(F.col("n_bytes")).alias("window_log"), levels.patch_decode_bound(F.lit(1000), F.col("n_bytes")).alias("decode_bound"), reach.alias("reach"))


@query("""SELECT lang, round(exp(avg(ln(strlen(text) / length(text)))) - 1, 9) AS delta, count(*) AS n FROM documents WHERE length(coalesce(text, '')) > 0 GROUP BY lang""")
def ratio_deltas(spark, sf_dir):
    """The geometric mean of bytes by letters, less one, by language."""
    rows = _docs(spark, sf_dir, "lang", F.coalesce(F.char_length("text"), F.lit(0)).alias("letters"))
    out = entropy.geometric_mean_delta(rows, "n_bytes", "letters", "lang")
    return out.select("lang", F.round("delta", 9).alias("delta"), "n")


def _turn_codes(spark, sf_dir) -> DataFrame:
    """Code histograms (role, channel, code, n) of the lengths of conversations' turns, as if they were lengths in sequences."""
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", n.alias("v"))
    told = (("ll", codes.literal_length_code(F.col("v"))), ("ml", codes.match_length_code(F.col("v") + 3)), ("of", codes.offset_code(F.col("v") + 4)))
    channel = F.array(*[F.struct(F.lit(c).alias("channel"), code.cast("int").alias("code")) for c, code in told])
    return rows.select("role", F.explode(channel).alias("c")).groupBy("role", "c.channel", "c.code").agg(F.count("*").alias("n"))


def _cost_sql() -> str:
    ranges = ", ".join(f"('{c}', {k}, {v}, {v + (1 << b)})" for c, t in (("ll", codes.LITERAL_LENGTHS), ("ml", codes.MATCH_LENGTHS)) for k, (v, b) in enumerate(t))
    norms = ", ".join(f"('{c}', {k}, {abs(v)}, {log})" for c, (log, t) in costs.DEFAULTS.items() for k, v in enumerate(t))
    return f"""WITH r(channel, code, base, past) AS (VALUES {ranges}), d(channel, code, norm, log) AS (VALUES {norms}),
price AS (SELECT channel, code, floor(256 * (8 - log2(norm << (8 - log))))::BIGINT AS price FROM d),
v AS (SELECT role, strlen(coalesce(text, '')) AS v FROM conversations),
c AS (SELECT role, channel, code FROM v JOIN r ON channel = 'll' AND v >= base AND v < past UNION ALL SELECT role, channel, code FROM v JOIN r ON channel = 'ml' AND v + 3 >= base AND v + 3 < past
  UNION ALL SELECT role, 'of', length(bin(v + 4)) - 1 FROM v),
h AS (SELECT role, channel, code, count(*) AS n FROM c GROUP BY ALL), whole AS (SELECT channel, code, sum(n) AS n FROM h GROUP BY ALL), total AS (SELECT channel, sum(n) AS total FROM whole GROUP BY channel),
t AS (SELECT role, channel, count(*) AS n_codes, sum(h.n)::BIGINT AS n, max(code) AS largest, sum(h.n) * log2(sum(h.n)) - sum(h.n * log2(h.n)) AS entropy_bits,
  CASE WHEN count(price) = count(*) THEN (sum(h.n * price) // 256)::BIGINT END AS default_bits, sum(h.n * log2(total / whole.n)) AS repeat_bits
  FROM h LEFT JOIN price USING (channel, code) JOIN whole USING (channel, code) JOIN total USING (channel) GROUP BY ALL)
SELECT role, channel, n_codes, n, round(entropy_bits, 2) AS entropy_bits, default_bits, round(entropy_bits + (largest + 1) * 6 + 8, 2) AS fresh_bits, round(repeat_bits, 2) AS repeat_bits,
  CASE WHEN n_codes = 1 AND n > 2 THEN 'rle' WHEN repeat_bits <= coalesce(default_bits, 'inf'::DOUBLE) AND repeat_bits <= entropy_bits + (largest + 1) * 6 + 8 THEN 'repeat'
    WHEN default_bits <= entropy_bits + (largest + 1) * 6 + 8 THEN 'predefined' ELSE 'fresh' END AS mode FROM t"""


@query(_cost_sql())
def sequence_costs(spark, sf_dir):
    """Costs of each role's code histograms under a fresh table, the default one and the one of all roles, and the mode that is chosen."""
    own = _turn_codes(spark, sf_dir)
    whole = own.groupBy("channel", "code").agg(F.sum("n").alias("n"))
    # one row per role, channel and code: some hundreds
    previous = own.select("role").distinct().join(F.broadcast(whole), F.lit(True))
    out = costs.channel_costs(own, "role").join(costs.repeat_costs(own, previous, "role"), ["role", "channel"])
    mode = costs.table_mode(F.col("n_codes"), F.col("n"), F.col("fresh_bits"), F.col("default_bits"), F.col("repeat_bits"))
    return out.select("role", "channel", "n_codes", "n", *[F.round(c, 2).alias(c) for c in ("entropy_bits", "fresh_bits", "repeat_bits")], "default_bits", mode.alias("mode"))


@query("SELECT 'zstd' AS format, count(*) AS n FROM documents UNION ALL SELECT 'skippable', count(*) FROM documents UNION ALL SELECT 'gzip', count(*) FROM documents UNION ALL SELECT 'empty', count(*) FROM documents")
def format_sniffing(spark, sf_dir):
    z = _framed(spark, sf_dir).select("content")
    rows = z.select(F.explode(F.array("content", frames.skippable_frame(F.col("content")), F.concat(F.unhex(F.lit("1F8B0800")), F.col("content")), F.lit(b""))).alias("content"))
    return rows.groupBy(frames.format_of(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


@query()
def ratio_report(spark, sf_dir):
    rows = _docs(spark, sf_dir, "lang", "source").withColumn("z", F.octet_length(codec.compressor()(F.coalesce("content", F.lit(b"")))))
    out = rows.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum("z").cast("long").alias("compressed"))
    return out.withColumn("ratio", F.when(F.col("compressed") == 0, 0.0).otherwise(F.round(F.col("n_bytes") / F.col("compressed"), 3)))


@query("""WITH g AS (SELECT substring(h, 2 * i + 1, 16) AS k FROM (SELECT h, unnest(range(greatest(0, length(h) // 2 - 7))) AS i FROM (SELECT hex(encode(coalesce(text, ''))) AS h FROM documents)))
SELECT k AS kmer, count(*) AS n FROM g GROUP BY k HAVING count(*) >= 20""")
def kmer_counts(spark, sf_dir):
    found = dictionaries.kmer_counts(_docs(spark, sf_dir), 20)
    text = F.lpad(F.hex(F.col("kmer")), 16, "0")
    return found.select(F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(8)]).alias("kmer"), "n")


@query()
def dictionary_sweep(spark, sf_dir):
    return dictionaries.train(payloads(spark, sf_dir, "conversations")).select("k", "eval_bytes", "dict_bytes", dictionary_id("content").alias("dict_id"))


def _source_hist(spark, sf_dir) -> DataFrame:
    each = entropy.histograms(_docs(spark, sf_dir, "source")).select("source", F.posexplode("counts").alias("symbol", "n")).where("n > 0")
    return each.groupBy("source", "symbol").agg(F.sum("n").cast("long").alias("n"))


@query("SELECT DISTINCT source, 2048::BIGINT AS states FROM documents")
def normalized_tables(spark, sf_dir):
    """Normalised byte counts of each source add up to the table's states."""
    return tables.normalized_counts(_source_hist(spark, sf_dir), "source").groupBy("source").agg(F.sum("norm").cast("long").alias("states"))


@query()
def huffman_sizes(spark, sf_dir):
    return tables.coded_size(tables.huffman_lengths(_source_hist(spark, sf_dir), "source"), "source")


def _timings(spark, sf_dir) -> DataFrame:
    """Made-up timings of a conversation's turns: by length of the turn and its number."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return rows.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("chunk_no"), (n % 97 + 50).alias("read_ns"), (n % 89 + 50).alias("encode_ns"), (n % 83 + 50).alias("output_ns"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, strlen(coalesce(text, '')) AS n FROM conversations),
s AS (SELECT conv_id, i, CASE WHEN greatest(n % 97, n % 83) * 8 + 400 >= (n % 89 + 50) * 9 THEN 1 WHEN (n % 89 + 50) * 32 >= (greatest(n % 97, n % 83) + 50) * 33 THEN -1 ELSE 0 END AS step FROM t),
r(conv_id, i, level) AS (SELECT conv_id, 0::BIGINT, 3 FROM s WHERE i = 1 UNION ALL SELECT r.conv_id, s.i, greatest(1, least(19, r.level + s.step)) FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id::VARCHAR AS stream_id, string_agg(level::VARCHAR, ',' ORDER BY i) AS levels FROM r WHERE i > 0 GROUP BY conv_id""")
def adaptive_levels(spark, sf_dir):
    out = levels.adaptive_levels(_timings(spark, sf_dir))
    return out.select("stream_id", F.concat_ws(",", F.transform("levels", lambda x: x.cast("string"))).alias("levels"))


@query("SELECT page_id::VARCHAR AS stream_id, greatest(1, ceil(strlen(coalesce(html, '')) / 1024))::BIGINT AS chunks, strlen(coalesce(html, '')) AS n_bytes FROM pages")
def chunked_streams(spark, sf_dir):
    """Pages as streams of 1 KiB chunks, encoded and decoded chunk by chunk."""
    back = chunks.decode_stream(chunks.encode_stream(chunks.chunked(payloads(spark, sf_dir, "pages"), 1024)))
    return back.groupBy("stream_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("content")).alias("n_bytes"))


@query(f"""WITH {_BYTES}, t AS (SELECT doc_id, max(byte) AS top, any_value(n) AS n FROM b GROUP BY doc_id HAVING any_value(n) > 1)
SELECT doc_id, least(11, greatest(5, least(length(bin(n)), length(bin(greatest(top, 1))) + 1), least(11, greatest(length(bin(greatest(n - 1, 1))) - 2, 0))))::INTEGER AS log FROM t""")
def literal_logs(spark, sf_dir):
    rows = entropy.histograms(_docs(spark, sf_dir).where("n_bytes > 1"))
    top = F.array_max(F.transform("counts", lambda c, i: F.when(c > 0, i)))
    return rows.select(F.col("payload_id").alias("doc_id"), tables.literal_log(F.col("n_bytes"), top).cast("int").alias("log"))


@query(f"""WITH {_BYTES}, h AS (SELECT source, byte AS symbol, count(*) AS n FROM b JOIN documents USING (doc_id) GROUP BY ALL),
t AS (SELECT *, count(*) OVER (PARTITION BY source) AS live, row_number() OVER (PARTITION BY source ORDER BY n DESC, symbol) AS place FROM h)
SELECT source, symbol, n, (1 + CASE WHEN place = 1 THEN greatest(32, 1 << length(bin(greatest(live - 1, 1)))) - live ELSE 0 END)::BIGINT AS norm FROM t""")
def flat_tables(spark, sf_dir):
    return tables.flat_counts(_source_hist(spark, sf_dir), "source").select("source", "symbol", "n", F.col("norm").cast("long").alias("norm"))


@query(f"""WITH {_BYTES}, h AS (SELECT source, byte, count(*) AS n FROM b JOIN documents USING (doc_id) GROUP BY ALL), w AS (SELECT byte, sum(n) AS n FROM h GROUP BY byte), total AS (SELECT sum(n) AS n FROM w),
t AS (SELECT source, sum(h.n) AS n, floor((sum(h.n) * log2(sum(h.n)) - sum(h.n * log2(h.n))) / 8) AS fresh, floor(sum(h.n * log2(total.n / w.n)) / 8) AS old FROM h JOIN w USING (byte), total GROUP BY source)
SELECT source, fresh::BIGINT AS fresh, old::BIGINT AS old, 128 + 12 >= n OR old <= 128 + fresh AS keeps FROM t""")
def kept_tables(spark, sf_dir):
    """For each source whether the table of all sources would be kept, with a description of 128 bytes for a table of its own."""
    own = _source_hist(spark, sf_dir)
    # 256 rows at most
    whole = own.groupBy("symbol").agg(F.sum("n").alias("all"))
    total = F.broadcast(whole.agg(F.sum("all").alias("total")))
    rows = own.join(F.broadcast(whole), "symbol").join(total, F.lit(True))
    n = F.sum("n")
    out = rows.groupBy("source").agg(n.alias("n"), F.floor((n * F.log2(n) - F.sum(F.col("n") * F.log2("n"))) / 8).alias("fresh"), F.floor(F.sum(F.col("n") * F.log2(F.col("total") / F.col("all"))) / 8).alias("old"))
    return out.select("source", "fresh", "old", tables.keeps_table(F.lit(128), F.col("n"), F.col("old"), F.col("fresh")).alias("keeps"))


@query(_HEAD + f""", t(level, strategy, window_log, far) AS (VALUES {", ".join(f"({a}, '{b}', {c}, {str(d).lower()})" for a, b, c, d in levels.LEVELS)}),
d AS (SELECT documents.doc_id, strlen(coalesce(text, '')) * 9 AS n, coalesce(d, 0) AS d FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id)
SELECT level, CASE WHEN d >= 48 AND ((level = 4 AND n <= 16384) OR (level BETWEEN 5 AND 10 AND n <= 131072)) THEN 'btlazy' WHEN level BETWEEN 11 AND 17 AND n <= 131072 THEN 'opt' ELSE strategy END AS chosen,
  count(*) AS n, count(*) FILTER (WHERE far AND doc_id % 2 = 0 AND (1 << window_log) >= 33554432) AS far FROM t, d GROUP BY ALL""")
def small_strategies(spark, sf_dir):
    """Strategies that each level takes for the documents, as if they were nine times as long, and how many would be searched for long-distance
    matches if that were allowed for every other one."""
    rows = decisions.stores(_docs(spark, sf_dir)).select("payload_id", (F.col("n_bytes") * 9).alias("n_bytes"), "head_distinct")
    rows = rows.withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("strategy"), F.lit(1 << c).cast("long").alias("window"), F.lit(d).alias("far")) for a, b, c, d in levels.LEVELS])))
    chosen = levels.small_strategy(F.col("t.level"), F.col("t.strategy"), F.col("n_bytes"), F.col("head_distinct"))
    far = levels.matches_far(F.col("t.far"), F.col("t.window"), F.col("payload_id") % 2 == 0)
    return rows.groupBy("t.level", chosen.alias("chosen")).agg(F.count("*").alias("n"), F.count_if(far).alias("far"))
