"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, embeddings, extraction, language, line_dedup, minhash, mixing, packing, quality, spotsigs, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, grp int, h long, bucket string, doc long, score double"
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
LINE = "the same line of text in many documents, over and over again"


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the old house.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"), (5, LONG, "en", None), (6, LONG, None, "a"),
        (7, "Der Hund und die Katze sind nicht in dem Haus, das der Mann gebaut hat.", "de", "c"), (8, "12345 !!! ???", "en", "b"),
        (None, "a row without an id, but with some words in it", None, "c"), (None, None, None, None), (9, "퟿\U0001f600 Été \x00 nul", "en", "a"),
    ]
    texts += [(20 + i, f"unique words {i} here\n{LINE}\n  {LINE.upper()}\t", "en", "d") for i in range(12)]
    texts += [(40, "exact copy of a text with more than five words", "en", "d"), (41, "exact copy of a text with more than five words", "en", "d")]
    full = [(i, t, lang, s, len(t) if t is not None else None) + (5, "k", 1, 2, "b", 3, 0.5) for i, t, lang, s in texts]
    return full + [full[0]] + [full[-1]]  # two repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(out, column="doc_id"):
    return sorted((r[0] is None, r[0] or 0) for r in out.select(column).collect())


def wanted():
    return sorted((r[0] is None, r[0] or 0) for r in rows())


def test_suffix_dedup(docs, none):
    out = suffix_dedup.without_repeats(docs).cache()
    assert ids(out) == wanted()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [x.n_removed for x in got[1]] == [0, 0]  # a repeated row is the same document
    assert got[6][0].n_removed == len(LONG) and got[6][0].kept == b"" and got[5][0].n_removed == 0
    assert got[2][0].n_bytes == 0 and got[3][0].n_bytes == 0
    assert suffix_dedup.without_repeats(none).count() == 0


def test_minhash(docs, none):
    out = minhash.near_duplicates(docs).cache()
    assert ids(out) == wanted()
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[41].component_id == 40 and not got[41].kept and got[40].kept
    assert got[6].component_id == 5 and got[5].n_shingles > 50_000
    for i in (2, 3, 4):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[8].n_shingles == 1
    assert out.where("doc_id is null and kept").count() == 2
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_where_texts_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near, other = text.replace("w50 ", "x "), " ".join(f"z{i}" for i in range(100))
    rows = [(1, other), (1, text), (1, text), (2, near), (None, near + " end"), (None, other + " end"), (None, "alone with its few words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted([("1", 96, "1", True)] * 3 + [("2", 96, "1", False), ("None", 97, "1", False), ("None", 97, "1", False), ("None", 2, "None", True), ("None", 0, "None", True)])
    left = minhash.one_of_each(docs.withColumn("mark", F.lit(1)))
    assert left.columns == ["doc_id", "text", "mark"]
    left = [(r.doc_id, r.text) for r in left.collect()]
    assert len(left) == 4 and {(1, other), (1, text), (None, None)} < set(left)


def test_language(docs, none):
    model = language.learn(docs)
    out = language.identified(docs, model).cache()
    assert ids(out) == wanted()
    for r in out.where("doc_id in (2, 3, 4, 8)").collect():
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert out.where("score < 0 or score > 1").count() == 0
    assert language.learn(none) is None
    assert language.identified(none, None).count() == 0
    assert language.identified(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language.accepted(docs, model).columns == docs.columns


def test_extraction(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two\n three</p>" + "<p>" + "long " * 200_000 + "</p></article></body>"
    data = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (None, "v", "", 3), (4, "w", "<p>cut off <b", 4), (5, "x", "no tags at all & nothing", 5), (6, "y", "<<<>>> </p></p><", 6)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text long")
    out = extraction.extracted(pages)
    assert out.count() == len(data)
    got = {r.page_id: r.text for r in out.collect()}
    assert got[1].startswith("T & U\n\nOne two three\n\nlong long") and got[1].count("long") == 200_000
    assert got[2] == "" and got[None] == ""
    assert extraction.extracted(pages.limit(0)).count() == 0


def test_spotsigs(docs, none):
    out = spotsigs.edited(docs).cache()
    assert ids(out) == wanted()
    by_text = {}
    for r in spotsigs.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    for r in out.collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = spotsigs.edited(docs.where("doc_id = 7")).first()
    assert (one.near_next, len(one.edited_text)) == (1.0, one.n_chars)
    assert spotsigs.edited(none).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.drop_lines(line_dedup.build(docs), docs).cache()
    assert ids(out) == wanted()
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert (got[20].text, got[20].n_lines, got[20].n_dropped) == ("unique words 0 here", 3, 2)
    assert (got[2].text, got[2].n_lines, got[2].n_dropped) == ("", 1, 0)
    assert got[4].text == " \t\n " and got[5].text == LONG
    assert all(r.n_dropped == 0 and r.text in ("", "a row without an id, but with some words in it") for r in out.where("doc_id is null").collect())
    assert line_dedup.drop_lines(line_dedup.build(none), none).count() == 0


def test_packing(docs, none):
    out = packing.packed_documents(docs).cache()
    per = {}
    for r in out.collect():
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.ROOM
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in rows()}
    assert out.where("doc_id = 2").first().length == 1
    long_one = out.where("doc_id = 5").orderBy("piece").collect()
    assert [r.length for r in long_one[:-1]] == [packing.ROOM] * (len(long_one) - 1) and [r.start for r in long_one] == [packing.ROOM * k for k in range(len(long_one))]
    assert packing.packed_documents(none).count() == 0


def test_embeddings(spark):
    v = [1.0, 0.5, 0.25]
    nan, inf = float("nan"), float("inf")
    data = [
        (1, v, 1, 0), (2, v, 1, 0), (3, [1.0, 0.5, 0.26], 1, 0), (4, v, 2, 0), (5, v, None, 0), (6, None, 1, 0), (7, [0.0, 0.0, 0.0], 1, 0), (8, [nan, 1.0, 1.0], 1, 0),
        (9, [inf, 1.0, 1.0], 1, 0), (10, [1.0, None, 1.0], 1, 0), (11, [], 1, 0), (12, [-1.0, -0.5, -0.25], 1, 0), (None, v, 1, 0), (13, [0.0, -0.0, 1.0], 3, 0), (14, [-0.0, 0.0, 1.0], 3, 0), (15, [1e-30, 0.0, 1e-30], 4, 0), (16, [1.0, 0.0, 1.0], 4, 0),
    ]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[i] == (0, i, True)
    assert got[14] == (1, 13, False) and got[16] == (1, 15, False) and got[None] == (0, None, True)
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0
    # rows that repeat, and other vectors with the same vec_id, come back as often as they came
    again = spark.createDataFrame([data[0], data[0], data[2], (1, [0.0, 1.0, 0.0], 1, 0), (1, v, 2, 0), data[7], data[7]], vectors.schema)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(again).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 1), (3, 1, 1), (8, 0, 8), (8, 0, 8)]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (20, 1, 0), (21, None, 1), (None, 1, 0), (5, 0, 0), (1, 1, 0)], "doc_id long, quality int, text int")
    told = quality.described(docs)
    model = quality.learn(told, labels)
    out = quality.scored(told, model).cache()
    assert ids(out) == wanted()
    assert out.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.7 as int)").count() == 0
    empty = quality.described(none)
    assert quality.learn(empty, labels.limit(0)) is None and quality.learn(empty, labels) is None
    assert quality.scored(empty, None).count() == 0 and quality.scored(told, None).where("score <> 0.5").count() == 0
    once = quality.learn(quality.described(docs.repartition(2)), labels)
    assert abs(once.prior - model.prior) < 1e-9 and np.allclose(once.flat, model.flat)


def test_mixing(docs, none):
    out = mixing.mixed(docs).cache()
    assert ids(out) == wanted()
    assert out.where("taken < 0 or taken > 3 * size").count() == 0
    assert out.where("doc_id in (2, 3, 4)").where("size <> 0 or taken <> 0").count() == 0
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1
    again = mixing.mixed(docs.repartition(5))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert mixing.mixed(none).count() == 0
    texts = mixing.taken_texts(docs)
    assert texts.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in texts.collect()) - out.agg({"taken": "sum"}).first()[0]) <= 5


def test_line_dedup_by_shards_alone(docs, monkeypatch):
    """Filters too large to be sent to every task: all lines are looked up where the shards are, in several parts of a shard."""
    want = sorted(map(str, line_dedup.drop_lines(line_dedup.build(docs, 3), docs).collect()))
    monkeypatch.setattr(line_dedup, "SENT", -1)
    monkeypatch.setattr(line_dedup, "LINES_OF_TASK", 4)
    monkeypatch.setattr(line_dedup, "LINES_OF_KEY", 1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    assert sorted(map(str, line_dedup.drop_lines(line_dedup.build(docs, 3), docs).collect())) == want


def test_stages(spark, docs, none):
    """Each stage on odd rows: nulls, repeated rows, empty and long texts; and on an empty table."""
    import corpus_pipeline

    columns = list(corpus_pipeline.COLUMNS)
    frame = docs.select(*columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*columns), "").count() == 0
        out = stage(spark, frame, "")
        n = out.count()
        assert n > 0
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "line_dedup":
            assert n == frame.count()
        if name == "minhash_near_dedup":
            assert n == out.distinct().count() and {r.doc_id for r in out.collect()} >= {1, 2, 3, 4, 5, 7, 8, 9, 20, 40, None} and out.where("doc_id in (6, 41)").count() == 0
        if name == "language_id":
            assert out.where("doc_id in (2, 3, 4, 8) or text is null").count() == 0 and {r.lang for r in out.collect()} <= {"en", "de"}


def test_whole_pipeline_on_odd_rows(spark, docs, none):
    import corpus_pipeline

    for start, some in ((none, False), (docs, True)):
        out = start.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
        assert (out.count() > 0) == some
        # the pieces of each time that a document is taken are told apart
        assert out.groupBy("copy", "piece").count().where("count > 1").count() == 0


def python_in_one_task(df):
    """How many functions of a plan one task runs in Python workers beside each other: without an exchange between them."""
    def most(node, above=0):
        name = node.nodeName()
        above = 0 if "Exchange" in name else above + any(x in name for x in ("Arrow", "Pandas", "Python"))
        below = node.children()
        return max([above, *(most(below.apply(i), above) for i in range(below.size()))])

    return most(df._jdf.queryExecution().executedPlan().initialPlan())


def test_one_python_worker_for_a_task(docs):
    """Each function that a task runs in a chain has a worker of its own, and Spark keeps it: that took line_dedup of the pipeline over its memory."""
    assert python_in_one_task(docs.mapInArrow(lambda b: b, docs.schema).mapInArrow(lambda b: b, docs.schema)) == 2
    for sent in (line_dedup.SENT, -1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(line_dedup, "SENT", sent)
            assert python_in_one_task(line_dedup.drop_lines(line_dedup.build(docs, 3), docs, keep=("lang", "source"))) == 1


def test_rows_of_the_driver_need_no_python_workers(spark, docs):
    """A list of rows is sent through a second pool of workers; an Arrow table isn't."""
    sources = mixing.sources_of(mixing.sized(docs))
    assert "ExistingRDD" not in sources._jdf.queryExecution().executedPlan().toString()
    assert sources.dtypes == [("source", "string"), ("no", "int"), ("source_size", "bigint"), ("target", "double"), ("words", "bigint"), ("slots", "bigint"), ("blocks", "bigint")]


def test_small_batches():
    """Slices of about so many bytes have the same rows in order; a row that is longer than that stays whole."""
    texts = ["x" * n for n in (0, 5, 5000, 3, 40, 1, 0, 900)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(common.small(iter([batch, batch.slice(0, 0), batch.slice(7, 3)]), 4000))
    assert [t for b in out for t in b.column("text").to_pylist()] == texts + texts[7:10]
    assert len(out) > 50 and all(b.num_rows for b in out)
    data, off = common.flat_bytes(out[3].column("text"))
    assert [data[i:j].tobytes().decode() for i, j in zip(off, off[1:])] == out[3].column("text").to_pylist()
