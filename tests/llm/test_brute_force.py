"""Operators against brute-force versions on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import catalog, embeddings, extraction, language, line_dedup, minhash, mixing, packing, quality, spotsigs, suffix_dedup


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck(sf).sql(catalog.SQL[name]).df()
    key = ours.columns[0]
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (d[sorted(d.columns)].sort_values(key).reset_index(drop=True) for d in (ours, theirs))
    assert ours.astype(str).equals(theirs.astype(str))


def made_texts(seed, n=120):
    """Texts with copies, near copies, shared passages and runs of one letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if kind < 0.15 and out:
            text = rng.choice(out)
        elif kind < 0.4 and out:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        elif kind < 0.6:
            cut = rng.randint(0, len(passage) - 150)
            text = text[: rng.randint(0, 200)] + passage[cut : cut + rng.randint(90, 300)] + text[:50]
        elif kind < 0.65:
            text = "x" * rng.randint(50, 700) + text
        elif kind < 0.7:
            text = "abc" * rng.randint(50, 300)
        out.append(text)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    texts = made_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        depth = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                depth[k] += 1
                depth[k + 100] -= 1
            seen.add(b[k : k + 100])
        gone = np.cumsum(depth[:-1]) > 0
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_suffix_dedup_of_a_common_passage_holds_no_large_group(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(80))
    passage = word() + word()
    n = suffix_dedup.HOT + 100
    docs = spark.createDataFrame([(i, word() + word() + passage + word() + word()) for i in range(n)], "doc_id long, text string").repartition(4)
    out = suffix_dedup.without_repeats(docs).collect()
    # a letter beside the passage may be the same by chance
    assert len(out) == n and all(160 <= r.n_removed < 170 if r.doc_id else r.n_removed == 0 for r in out)
    named = docs.withColumnRenamed("doc_id", "doc")
    hot = F.struct("h", "loc", F.lit(True).alias("hot"))
    asked = suffix_dedup._sift(suffix_dedup._regions(named)).where("kind = 1").groupBy("doc").agg(F.collect_list(hot).alias("asks"))
    sizes = suffix_dedup._cut(named, asked).where("key is not null").groupBy("key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    inner, shared = word(150), word(150)
    rows = [(None, inner + "-" + word(300) + "+" + inner), (None, "short"), (None, None), (7, "<" + shared + ">" + word(90)), (7, word(40) + "[" + shared + "]"), (7, "brief")]
    rows += [(-(1 << 63), word(120)), (8, "(" + shared + ")"), rows[0]]
    by_mark = sorted((r for r in rows[3:5]), key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    want = {r: r[1] or "" for r in rows} | {rows[0]: rows[0][1][:-150], by_mark[1]: by_mark[1][1].replace(shared, ""), rows[7]: "()"}
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.kept).decode()) for r in out), key=key) == sorted(((r[0], want[r]) for r in rows), key=key)


def test_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("seed", [3, 4])
def test_minhash(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = made_texts(seed) + [None, "", "One two", "one TWO"]
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_minmax_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)])
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_line_index_is_reversible(spark):
    first = spark.createDataFrame([(i, f"head {i}\ncommon line\nother {i % 3}") for i in range(30)], "doc_id long, text string")
    more = spark.createDataFrame([(100 + i, "rare line\ncommon line\nother 9") for i in range(12)], "doc_id long, text string")
    index = line_dedup.build(first)
    both = line_dedup.insert_documents(index, more)
    whole = line_dedup.build(first.union(more))
    state = lambda x: sorted((bytes(r.key), r.n) for r in x.counts.collect())
    drop = lambda x: sorted(tuple(r) for r in line_dedup.drop_lines(x, first.union(more)).collect())
    assert state(both) == state(whole) and drop(both) == drop(whole)
    back = line_dedup.delete_documents(both, more)
    assert state(back) == state(index) and drop(back) == drop(index) != drop(both)


@pytest.mark.parametrize("begin", [0, 100])
def test_line_index_grows(spark, begin):
    lines = lambda a, b: "\n".join(f"a frequent line {k}" for k in range(a, b))
    docs = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index, seen = line_dedup.build(docs(*[lines(0, begin)] * 2), 2), docs(lines(0, 9000) + "\nrare")
    for a, b in ((begin, 700), (700, 5000), (5000, 9000)):
        index = line_dedup.insert_documents(index, docs(*[lines(a, b)] * 2))
        row = line_dedup.drop_lines(index, seen).first()
        assert row.n_dropped == b and index.counts.count() == b and index.filters.agg(F.sum("n")).first()[0] == b
    for a, b in ((5000, 9000), (700, 5000)):
        index = line_dedup.delete_documents(index, docs(*[lines(a, b)] * 2))
        assert line_dedup.drop_lines(index, seen).first().n_dropped == index.counts.count() == a


def test_full_shards_are_made_again(spark):
    docs = lambda a, b: spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(a, b))) for i in range(2)], "doc_id long, text string")
    index = line_dedup.build(docs(0, 10), 2)
    index.room = 100_000  # so that the count alone doesn't call for it
    grown = line_dedup.insert_documents(index, docs(10, 6000))
    assert line_dedup.drop_lines(grown, docs(0, 6000)).agg(F.sum("n_dropped")).first()[0] == 12_000


def test_cuckoo_filter():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.int64).astype(np.uint64)
    f = line_dedup.CuckooFilter.for_keys(len(keys))
    assert f.insert(keys) and f.holds(keys).all()
    f.delete(keys[:2500])
    assert f.holds(keys[2500:]).all() and f.holds(keys[:2500]).mean() < 0.01 and f.n == 2500


def test_packing_is_near_the_bound(spark):
    rng = np.random.default_rng(7)
    lengths = np.concatenate([rng.integers(1, 400, 600), rng.integers(900, 4097, 300)])
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    out = packing.pack(items, group=300).toPandas()
    assert sorted(zip(out.doc_id, out.length)) == [(i, n) for i, n in enumerate(lengths)]
    assert out.groupby("sequence_id").length.sum().max() <= packing.ROOM
    plain = packing.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths.tolist(), packing.ROOM)
    assert out.sequence_id.nunique() <= len(plain) + 2


def test_crossover_keeps_every_item():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 2000) for _ in range(200)), reverse=True)
    a = packing.best_fit(range(200), lengths, 4096)
    b = packing.best_fit(rng.sample(range(200), 200), lengths, 4096)
    for _ in range(50):
        c = packing.cross(a, b, lengths, 4096, rng)
        assert sorted(i for _, own in c for i in own) == list(range(200))
        assert all(fill == sum(lengths[i] for i in own) <= 4096 for fill, own in c)


def hard_lengths(seed, n, room):
    """n bins' worth of three pieces each that fill a bin to the last token: best fit in falling order misses that by far."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(room * 38 // 100, room * 49 // 100)
        b = rng.randint(room // 4 + 1, (room - a) // 2)
        out += [a, b, room - a - b]
    return sorted(out, reverse=True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossover_beats_best_fit_on_hard_lengths(seed):
    lengths = hard_lengths(seed, 40, 4096)
    plain = packing.best_fit(range(120), lengths, 4096)
    seeds_only = packing.evolve(lengths, 4096, seed, [], children=0)
    grown = packing.evolve(lengths, 4096, seed, [])
    assert packing.fitness(grown, 4096) > max(packing.fitness(p, 4096) for p in (plain, seeds_only))
    assert len(grown) < len(plain)


def test_islands_and_migration_beat_one_island(spark):
    room, lengths = 4096, [n for seed in range(4) for n in hard_lengths(seed, 40, 4096)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row long, length long")  # a column named as one of the operator's own
    n = {}
    for name, how in (("many", {"islands": 3, "epochs": 4}), ("one", {"islands": 1, "epochs": 1})):
        out = packing.pack(items, room, **how).toPandas()
        assert out.columns.tolist() == ["row", "length", "sequence_id", "offset"] and out.groupby("sequence_id").length.sum().max() <= room
        assert sorted(zip(out.row, out.length)) == list(enumerate(lengths))
        n[name] = out.sequence_id.nunique()
    plain = len(packing.best_fit(range(len(lengths)), sorted(lengths, reverse=True), room))
    assert n["many"] < n["one"] < plain


def test_rounds_of_groups_end(spark):
    """Lengths of which no two bins' worth fills a bin: every bin stays open, and the rounds end all the same."""
    items = spark.createDataFrame([(i, 2100 - 200 * (i % 2)) for i in range(3000)] + [(i, 1) for i in range(2000)], "doc_id long, length long")
    out = packing.pack(items, group=256, epochs=1, children=5).toPandas()
    assert len(out) == 5000 and out.groupby("sequence_id").length.sum().max() <= packing.ROOM
    assert out.sequence_id.nunique() <= 1500 + 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_texts(name):
    """Each text by itself through the tokenizer, against the pieces of all texts at once; and a tokenizer that splits otherwise."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    table, whole = packing.WordIds(packing.tokenizer_path(name)), Tokenizer.from_file(packing.tokenizer_path(name))
    assert table.by_pieces == name.startswith("word")
    rng = random.Random(2)
    chars = [chr(c) for c in range(256)] + list("\u0300\u0391\u03a3\u2003\u3000\U0001f600\u0130\ufb01\u2028") + ["<|endoftext|>", "<|", "'S", "'ll", "\u00c9t\u00e9", "A7", "...", "e\u0301", " ", "\n"] * 9
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, table.of(pa.array([*texts, None]))):
        assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_token_pieces(spark, sf):
    import zlib

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += ["It's <|endoftext|> á À\x1cB", "", None, "a" * 5000 + " " + "b c " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pieces(docs, packing.tokenizer_path(), 512).orderBy("doc_id", "piece").collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == [(k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512)]


def test_edited_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id", ascending=False).collect()]
    got = {r.doc_id: r for r in spotsigs.edited(docs).collect()}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        s, se, sn = (spotsigs.signatures(x) for x in (t, e, after))
        assert (got[i].edited_text, got[i].fingerprint, got[i].edited_fingerprint) == (e, spotsigs.to_hex(s), spotsigs.to_hex(se))
        assert (got[i].near_edited, got[i].near_next) == (spotsigs.jaccard(s, se), spotsigs.jaccard(s, sn))


def test_similar_fingerprints(spark):
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(400), rng.randint(1, 40))) for _ in range(150)]
    sets += [sorted({*s[1:], 500 + i}) for i, s in enumerate(sets[:60])] + sets[:5] + [[]]
    prints = spark.createDataFrame([(i, spotsigs.to_hex(np.array(s, np.uint32))) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    got = {(r.a, r.b) for r in spotsigs.similar(prints, 0.75).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and s and t and len({*s} & {*t}) >= 0.75 * len({*s} | {*t})}
    assert got == want and len(want) > 20


def test_embedding_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((300, 64))
    near = base + rng.standard_normal(base.shape) * rng.uniform(0.05, 0.25, (300, 1))
    v = np.concatenate([base, near, base[:20]]).astype(np.float32)
    label = np.concatenate([np.arange(300) % 2, np.arange(300) % 2, np.arange(20) % 2])
    rows = [(i, [float(x) for x in v[i]], int(label[i])) for i in range(len(v))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    assert [got[i] for i in range(len(v))] == link.sum(1).tolist() and link.sum() > 200


def test_embedding_links_through_cells(spark, monkeypatch):
    """A label far larger than a block: vectors meet in cells of several tables, and no link is lost or counted twice."""
    monkeypatch.setattr(embeddings, "CELL", 32)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(19)
    base = rng.standard_normal((400, 24))
    near = base[:200] + rng.standard_normal((200, 24)) * rng.uniform(0.02, 0.25, (200, 1))
    group = base[399] + rng.standard_normal((150, 24)) * 0.08  # a large group of near vectors
    v = np.concatenate([base, near, group]).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(len(v))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    root = np.arange(len(v))
    for _ in range(20):
        root = np.array([min(root[i], root[link[i]].min(initial=i)) for i in range(len(v))])
    assert embeddings.tables_for(len(v), 0.98)[0] >= 2
    assert got == {i: (int(link[i].sum()), int(root[i])) for i in range(len(v))}
    assert link.sum() > 10_000


def test_cells_prune_and_keep():
    """Of pairs at the least cosine nearly all share a cell in some table, and of unlike pairs few: those that meet grow slower than all pairs."""
    rng = np.random.default_rng(20)
    meets = []
    for n in (1 << 16, 1 << 20, 1 << 24):
        depth, tables = embeddings.tables_for(n, 0.98)
        a = rng.standard_normal((2000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        x, y = (embeddings.cells(v, depth, tables) for v in (a, b))
        assert (x == y).any(1).all()
        meets.append((x == np.roll(x, 1, 0)).sum() / len(a))  # times that an unlike pair meets
    assert meets[0] > 4 * meets[1] > 16 * meets[2] - 1e-9


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert language.identified(docs, language.learn(docs)).where("rejected").count() <= 3


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op9_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9


def test_class_prior_of_two_normals():
    """Without a negative label, the share of positives among unlabelled rows is found, for several shares."""
    rng = np.random.default_rng(11)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(2, 1, 3000)
        unlabelled = np.where(rng.random(20_000) < share, rng.normal(2, 1, 20_000), rng.normal(-2, 1, 20_000))
        cells = [np.bincount(quality.cell_of(z), minlength=quality.CELLS) for z in (positive, unlabelled)]
        assert abs(quality.class_prior(*cells) - share) < 0.04
        z = np.random.default_rng(1).normal(0, 3, 5000)
        shift = quality.shift_to(np.bincount(quality.cell_of(z), minlength=quality.CELLS), share)
        assert abs((1 / (1 + np.exp(-z - shift))).mean() - share) < 0.01


def test_gradient_of_the_risk():
    """The gradient against differences of the risk, where its negative part is positive; where it is negative, the step climbs."""
    rng = np.random.default_rng(12)
    size, p, u = 3 * 4 + 1, rng.integers(0, 12, (50, 3)), rng.integers(0, 12, (80, 3))
    soft = lambda z: np.logaddexp(0, z)

    def risk(w, prior):
        zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
        minus = soft(zu).mean() - prior * soft(zp).mean()
        return minus, prior * soft(-zp).mean() + minus

    w = rng.normal(0, 0.5, size)
    # parts of a table add up to the whole
    whole = quality.unlabelled_part(w, u[:30]) + quality.unlabelled_part(w, u[30:])
    for prior in (0.3, 0.95):
        minus, g = quality.pu_gradient(w, p, whole, prior)
        assert abs(minus - risk(w, prior)[0]) < 1e-9
        k = 0 if minus < 0 else 1
        step = 1e-6 * np.eye(size)
        want = np.array([(risk(w + d, prior)[k] - risk(w - d, prior)[k]) / 2e-6 for d in step])
        assert np.allclose(g, want if minus >= 0 else -want, atol=1e-5)
    low = np.full(size, 0.0)
    low[-1] = 5.0  # all taken for positives and a large prior: the negative part is below zero
    assert quality.pu_gradient(low, p, quality.unlabelled_part(low, u), 1.2)[0] < 0


def words(n, w="word"):
    return " ".join([w] * n)


@pytest.mark.parametrize("page, want", [
    # marks on elements that need no end tag
    (f"<article><h1>T</h1><p class='ad'>{words(9, 'buy')}<p>{words(20)}<ul><li>one two<li class=comment>{words(8, 'bad')}<li>three</ul></article>", ["T", words(20), "one two", "three"]),
    (f"<article><p>{words(30)}</p><table><tr><td>a<td class='advert'>{words(9, 'spam')}<td>b</table></article>", [words(30), "a", "b"]),
    (f"<article><dl><dt>term<dd class='sponsored'>{words(6, 'x')}<dd>{words(7)}</dl></article>", ["term", words(7)]),
    # parts of an article with unlucky names
    (f"<article><p>{words(40)}</p><div class='callout-notice'><p>{words(30, 'note')}</p></div><section id='social-history'><h2>Then</h2><p>{words(40, 'hist')}</p></section></article>", [words(40), words(30, "note"), "Then", words(40, "hist")]),
    (f"<article><header class='entry-header'><h1>Title</h1></header><p>{words(25)}</p></article>", ["Title", words(25)]),
    # names of boilerplate only, in many spellings
    (f"<article><p>{words(40)}</p></article><div id='siteFooter'>{words(30, 'f')}</div><div class='comment-list'><p>{words(50, 'c')}</p></div><div class='cookie-consent'>{words(15, 'k')}</div>", [words(40)]),
    (f"<div class='main-menu'><a href=x>Home</a> <a href=y>About</a></div><article><p>{words(35)}</p><div role=complementary>{words(30, 's')}</div><div hidden>{words(9, 'h')}</div></article>", [words(35)]),
    # pages that mark no article: words, links and neighbours decide
    (f"<div><a href=x>Home</a></div><div><a href=y>About us</a></div><h1>A title</h1><p>{words(60)}</p><p>{words(50, 'more')}</p><p>Short.</p><p>{words(45, 'last')}</p><div><a href=z>Next page</a></div><div>(c) Somebody</div>", ["A title", words(60), words(50, "more"), "Short.", words(45, "last")]),
    (f"<nav><a href=a>A</a></nav><p>{words(80)}</p><ul><li><a href=b>Related one</a><li><a href=c>Related two</a></ul>", [words(80)]),
    ("<nav><a href=a>A</a></nav><form><p>Your name please, and a long explanation of why it is asked for</p></form>", []),
])
def test_main_text_of_made_up_pages(page, want):
    assert extraction.main_text(page, extraction.train()) == "\n\n".join(want)


def test_tree_uses_neighbours():
    def used(tree):
        return {extraction.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {"words", "links", "boilerplate", "article"} <= used(extraction.train()) and used(extraction.train()) & {"words_before", "links_before", "words_after", "links_after"}


def plain_signatures(text):
    """SpotSigs as the module describes them, with strings: anchor (or word of a stretch without one) and the next content words, counted."""
    anchors = set(spotsigs.ANCHORS.split())
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    own = re.findall(r"[^\x00-\x7f\w]*(?:[a-z0-9]|[^\x00-\x7f])+", lower)
    content = [(i, w) for i, w in enumerate(own) if w not in anchors]
    out, since = collections.Counter(), spotsigs.GAP + 1
    for i, w in enumerate(own):
        since = 0 if w in anchors else since + 1
        if w in anchors or since > spotsigs.GAP:
            out[(w, *[x for k, x in content if k > i][: spotsigs.CHAIN])] += 1
    return out


def test_signatures_are_those_of_the_description():
    """Equal likeness with strings in place of hashes; the fingerprints' sizes are those of the multisets."""
    rng = random.Random(21)
    vocabulary = ["the", "of", "and", "der", "la", "que"] + [f"w{i}" for i in range(40)] + ["\u00fcber", "\u00e9t\u00e9"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["The END, of it. 3.5 x", " ".join(f"row{i}" for i in range(30))]
    texts += [t + " " + rng.choice(vocabulary) for t in texts[:20]]
    plain, hashed = [plain_signatures(t) for t in texts], [spotsigs.signatures(t) for t in texts]
    for p, h in zip(plain, hashed):
        assert sum(p.values()) == len(h)
    for i in range(len(texts)):
        for j in range(i):
            a, b = plain[i], plain[j]
            union = sum((a | b).values())
            assert abs(spotsigs.jaccard(hashed[i], hashed[j]) - (sum((a & b).values()) / union if union else 1.0)) < 1e-12


def test_pages_give_their_article(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extraction.extracted(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<[^>]*$", "", re.sub(r"</article>.*", "", r.html[r.html.find("<article>") + 9 :], flags=re.S))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_schedule_is_even():
    got = mixing.targets([1000, 10, 500], [5, 2, 1])
    assert abs(sum(got) - 1510) < 1e-6 and got[1] == 30 and abs(got[0] / got[2] - 5) < 1e-9


def test_schedule_prefixes(spark):
    rows = [("a", 0, 0, 0.0, 0, 500, 1), ("b", 1, 0, 0.0, 0, 200, 1), ("c", 2, 0, 0.0, 0, 3, 1)]
    sources = spark.createDataFrame(rows, "source string, no int, source_size long, target double, words long, slots long, blocks long")
    order = [r.no for r in mixing.schedule(sources).orderBy("slot", "no", "rank").collect()]
    assert collections.Counter(order) == {0: 500, 1: 200, 2: 3}
    for n in (50, 200, 400):
        assert abs(order[:n].count(0) - n * 500 / 703) < 6


def test_taken_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    words = collections.Counter()
    for r in mixing.taken_texts(docs).collect():
        words[r.doc_id] += len(re.findall("[^\x20\x09-\x0d]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == {i: n for i, n in taken.items() if n}


def test_sha(spark, sf):
    row = suffix_dedup.op1_suffix_dedup(spark, sf).where("n_removed = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
