"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `room` tokens; only longer ones are cut. Pieces are dealt into groups of bounded size.
Each group is packed on several islands. An island's population (each a partition of the pieces into bins) starts from best fit
in random orders; crossover injects whole well-filled bins of one parent into another, removes the bins that hold duplicates
of the injected pieces, and best-fits the displaced pieces. Between epochs the best packing of each island migrates to the
next one; the best of all islands gives the result. An island stops early only when no packing can be better: the least possible
number of bins, with all free room in one of them. The emptiest bins of each group are dissolved and their pieces packed together
in a next round, so that groups do not each waste a bin.
"""

from __future__ import annotations

import bisect
import json
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import SPACES, documents, flat_bytes, runs, shared_table

ROOM, END = 4096, 1
#: Pieces of a group; islands of a group; epochs, after each of which elites migrate; individuals of an island; children of an epoch.
GROUP, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 2, 3, 6, 40
#: Share of room from which a bin counts as full, and the share of a group's bins, its emptiest, that a next round may pack again.
FULL, AGAIN = 0.98, 0.25
#: Words or pieces of words in a generation of what a Python worker remembers; bytes of texts that are split at once.
PIECES, RUN = 400_000, 1 << 20
# Classes of bytes: 0 white space, 1 a letter (or a byte of one of the letters that begin with C3), 2 a digit, 3 another printable character of
# ASCII, 4 anything that the split by bytes leaves to the tokenizer: controls, apostrophes (contractions) and other characters.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 4
_CLASS[list(SPACES)] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Remembered(dict):
    """A dictionary of two generations: when the newer one is full, the older one goes, so what is used again stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class WordIds:
    """Ids of texts by a tokenizer file, through ids of pieces of words that are remembered as little-endian 32-bit bytes.

    Files whose tokenizer drops white space, lower-cases and splits by SPLIT never join across white space, nor across the pieces of SPLIT. So
    texts are cut where SPLIT cuts them, all texts of a run at once; words with bytes of class 4 are left whole and go through the
    tokenizer. With any other file whole texts do.
    """

    # How the tokenizer normalises and splits.
    NORMALIZERS = ("NFC", "Replace", "Lowercase")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: What cut() makes pieces of; a word that it leaves whole has another character.
    PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = tuple(n.get("type") for n in (told.get("normalizer") or {}).get("normalizers") or [])
        split = before[0].get("type") == "Split" and before[0].get("pattern") == {"Regex": self.SPLIT} and before[0].get("behavior") == "Removed" and before[0].get("invert")
        byte_level = len(before) == 2 and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space")
        special = all(t["content"].startswith("<|") for t in told.get("added_tokens") or [])
        self.by_pieces = bool(split and byte_level and normal == self.NORMALIZERS and special)
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.pieces = Remembered(self._piece, PIECES)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.PLAIN.fullmatch(piece) or "<|" in piece:
            return self._encoded(piece)
        return array("I", [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        if not self.by_pieces:
            for text in texts:
                yield self._encoded(text.as_py() or "")
            return
        data, off = flat_bytes(texts)
        for i, j in runs(off, RUN):
            yield from self._run(data[off[i] : off[j]], off[i : j + 1] - off[i])

    def _run(self, data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        own, start = cut(data, off)
        size = np.add.reduceat((_CLASS[data] > 0).astype(np.int64), start) if len(start) else start
        places = np.append(0, np.cumsum(size))
        units = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(own)]).dictionary_encode()
        ids = list(map(self.pieces.__getitem__, units.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size, flat = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, np.frombuffer(b"".join(ids), np.uint32)
        first, code = np.cumsum(size) - size, units.indices.to_numpy()
        n = size[code]
        upto = np.append(0, np.cumsum(n))
        tokens = flat[np.repeat(first[code] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        at = 4 * upto[np.searchsorted(start, off)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield tokens[a:b]


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, cut into pieces as WordIds.SPLIT does, or whole words where a byte is not for that: their bytes, without white space and
    with lower case in pieces; and where each of them starts in data."""
    kind = _CLASS[data]
    # letters of two bytes that begin with C3: all but the signs of multiplication and division
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = 1
    mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # special tokens begin so
    kind[mark] = 4
    space, head = kind == 0, off[off < len(data)]
    new, word = np.ones(len(data), bool), ~space  # where the class changes, and where words begin
    new[1:] = kind[1:] != kind[:-1]
    word[1:] &= space[:-1]
    new[head], word[head] = True, ~space[head]
    begin = np.flatnonzero(word)
    own = _LOWER[data]
    own[two + 1] += ((own[two + 1] >= 0x80) & (own[two + 1] <= 0x9E)).astype(np.uint8) << 5
    start = (new | (kind == 2)) & ~space
    if (odd := kind == 4).any():
        # whole words: no cuts inside them, bytes as they are
        left = np.logical_or.reduceat(odd, begin)
        inside = np.repeat(left, np.diff(np.append(begin, len(data))))
        inside = np.append(np.zeros(begin[0], bool), inside)
        start = np.where(inside, word, start)
        own = np.where(inside, data, own)
    return own[~space], np.flatnonzero(start)


_TABLES: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TABLES:
        _TABLES[path] = WordIds(path)
    return _TABLES[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, room: int = ROOM, keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, piece, start, length, ids_crc32 (and ids as binary): each document's ids and the end id, cut at `room`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            rows, out = [], [[], [], [], [], []]
            for i, ids in enumerate(table.of(b.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at : at + 4 * room]
                    rows.append(i)
                    for col, v in zip(out, (k, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None)):
                        col.append(v)
            own = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", *keep)]
            arrays = [*own, pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:4])]
            names = ["doc_id", *keep, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(out[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    kinds = "".join(f", {c} {kind}" for c, kind in rows.dtypes if c in keep)
    return rows.mapInArrow(run, f"doc_id long{kinds}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


#: A packing: bins of (tokens, the places of its pieces).
Bins = list[tuple[int, tuple[int, ...]]]


def best_fit(order, lengths, room: int, bins: Bins = ()) -> Bins:
    """bins with each further piece, in this order, put into the bin with the least room that takes it; opens bins as needed."""
    free = sorted((room - fill, k) for k, (fill, _) in enumerate(bins) if fill < room)
    bins, more = list(bins), {}
    for i in order:
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            left, k = free.pop(at)
        else:
            left, k = room, len(bins)
            bins.append((0, ()))
        more.setdefault(k, []).append(i)
        if left > n:
            bisect.insort(free, (left - n, k))
    for k, new in more.items():
        fill, own = bins[k]
        bins[k] = (fill + sum(lengths[i] for i in new), (*own, *new))
    return bins


def fitness(bins: Bins, room: int) -> float:
    """Fewer bins first; at equal numbers, the mean square fill."""
    return -len(bins) + sum((fill / room) ** 2 for fill, _ in bins) / max(1, len(bins))


def perfect(bins: Bins, room: int) -> bool:
    """Whether no packing is fitter: all bins but one are full to the last token."""
    return sum(fill < room for fill, _ in bins) <= 1


def cross(a: Bins, b: Bins, lengths, room: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of b into a; the bins of a that hold any of their pieces go, with its emptiest one, and the pieces that
    are displaced by that are best-fitted, longest first or, one time in four, in any order."""
    full = sorted(b, key=lambda x: -x[0])[: max(1, len(b) // 2)]
    given = rng.sample(full, rng.randint(1, max(1, min(len(full), len(b) // 8))))
    taken = {i for _, own in given for i in own}
    kept, lost = [], []
    for x in a:
        if taken.isdisjoint(x[1]):
            kept.append(x)
        else:
            lost += [i for i in x[1] if i not in taken]
    for _ in range(min(len(kept), rng.randint(1, 3))):
        k = min(range(len(kept)), key=lambda k: kept[k][0])
        lost += kept.pop(k)[1]
    if rng.random() < 0.25:
        rng.shuffle(lost)
    else:
        lost.sort(key=lambda i: -lengths[i])
    return best_fit(lost, lengths, room, given + kept)


def evolve(lengths, room: int, seed: int, elites: list[Bins], population: int = POPULATION, children: int = CHILDREN) -> Bins:
    """The best packing that an island finds in one epoch, from the elites that came and best fit in random orders: the later the order
    of an individual, the less it follows the lengths. lengths: in falling order."""
    rng, n = random.Random(seed), len(lengths)
    people = sorted(((fitness(p, room), k, p) for k, p in enumerate(elites)), key=lambda x: (-x[0], x[1]))
    while len(people) < population:
        loose = 0.1 + 0.9 * len(people) / population
        key = [-x * (1 + loose * (rng.random() - 0.5)) for x in lengths]
        p = best_fit(sorted(range(n), key=key.__getitem__), lengths, room)
        people.append((fitness(p, room), len(people), p))
    born = len(people)
    people.sort(key=lambda x: (-x[0], x[1]))
    for _ in range(children):
        if perfect(people[0][2], room):
            break
        a, b = (min(rng.sample(range(len(people)), 2)) for _ in range(2))  # the better of two, twice
        child = cross(people[a][2], people[b][2], lengths, room, rng)
        told = fitness(child, room)
        if told > people[-1][0]:
            people[-1] = (told, born, child)
            people.sort(key=lambda x: (-x[0], x[1]))
        born += 1
    return people[0][2]


def _packed(items: DataFrame, room: int, islands: int, epochs: int, population: int, children: int) -> DataFrame:
    """items (grp, row, length, item) with bin, offset, fill and again by group."""
    def in_order(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["length", "row"], ascending=[False, True], kind="stable")

    def owner(bins: Bins, n: int) -> bytes:
        out = np.zeros(n, np.int32)
        for k, (_, own) in enumerate(bins):
            out[list(own)] = k
        return out.tobytes()

    def grouped(of: bytes, lengths) -> Bins:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(np.frombuffer(of, np.int32).tolist()):
            bins.setdefault(k, []).append(i)
        return [(sum(lengths[i] for i in own), tuple(own)) for own in bins.values()]

    def epoch(number: int):
        def run(key, frame: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):  # this group can't be packed better
                return came.head(1)
            lengths = in_order(frame)["length"].tolist()
            elites = [grouped(x, lengths) for x in came.sort_values("born")["owner"]]
            best = evolve(lengths, room, hash((int(key[0]), int(key[1]), number)), elites, population, children)
            return pd.DataFrame({"grp": [key[0]], "island": [key[1]], "born": [key[1]], "owner": [owner(best, len(lengths))], "fit": [fitness(best, room)], "done": [perfect(best, room)]})

        return run

    schema = "grp long, island int, born int, owner binary, fit double, done boolean"
    spread = items.select("grp", "row", "length", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    best = None
    for number in range(epochs):
        if best is None:
            came, left = items.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]), spread
        else:  # the elite of each island migrates to the next one and stays on its own
            came = best.union(best.withColumn("island", (F.col("island") + 1) % islands)) if islands > 1 else best
            left = spread.join(best.where("done").select("grp").distinct(), "grp", "left_anti")
        best = shared_table(left.groupBy("grp", "island").cogroup(came.groupBy("grp", "island")).applyInPandas(epoch(number), schema))
        if not best.where("not done").take(1):
            break
    top = best.groupBy("grp").agg(F.max_by("owner", F.struct("fit", -F.col("island"))).alias("owner"))

    def place(key, frame: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        frame = in_order(frame).reset_index(drop=True)
        frame["bin"] = np.frombuffer(won["owner"].iloc[0], np.int32)
        by = frame.groupby("bin", sort=False)["length"]
        frame["offset"] = by.cumsum() - frame["length"]
        frame["fill"] = by.transform("sum")
        # the emptiest bins may be packed again
        fills = np.sort(by.sum().to_numpy())
        frame["again"] = (frame["fill"] < FULL * room) & (frame["fill"] <= fills[int(np.ceil(AGAIN * len(fills))) - 1])
        return frame

    schema = StructType([*items.schema.fields, *(StructField(name, kind) for name, kind in (("bin", IntegerType()), ("offset", LongType()), ("fill", LongType()), ("again", BooleanType())))])
    return items.groupBy("grp").cogroup(top.groupBy("grp")).applyInPandas(place, schema)


def pack(items: DataFrame, room: int = ROOM, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """Pack rows (length, any other columns) into sequences of at most `room`: the rows with sequence_id and offset.

    Lengths are from 1 to room; the number of sequences is near the least possible. Rows may repeat, and may have null columns; an
    empty table gives an empty result. Each round packs groups of about `group` rows. The emptiest quarter of a group's bins goes to
    the next round as far as it isn't full, in half as many groups or fewer, until there is one group.
    """
    # numbered in the table, so that a task that runs again reads the numbers of the first time
    items = shared_table(items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    done, number, groups = None, 0, max(1, -(-items.count() // group))
    while True:
        dealt = items.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)))
        packed = shared_table(_packed(dealt, room, islands, epochs, population, children))
        named = packed.withColumn("sequence_id", F.lit(number << 56) + F.col("grp") * (1 << 24) + F.col("bin"))
        ready = (named if groups == 1 else named.where("not again")).select("item.*", "sequence_id", "offset")
        done = ready if done is None else done.union(ready)
        if groups == 1:
            return done
        items, number = packed.where("again").select("item", "length", "row"), number + 1
        groups = min(groups // 2, max(1, -(-items.count() // group)))


def packed_documents(docs: DataFrame, path: str | None = None, room: int = ROOM, numbered: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives the end id alone; rows with null or repeated doc_id are documents of their own; extra columns
    are ignored; very long texts become as many pieces as they need. path: a tokenizer file. numbered: a column copy more, a number
    that the pieces of one row share and no other row has.
    """
    rows = docs.select("doc_id", "text")
    if numbered:
        rows = rows.withColumn("copy", F.monotonically_increasing_id())
    return pack(pieces(rows, path or tokenizer_path(), room, keep=("copy",) * numbered), room)


def op7_best_fit_packing(spark, sf_dir):
    return packed_documents(documents(spark, sf_dir))
