"""Interpolated modified Kneser-Ney over words of an open vocabulary (operator 8).

Words, marks, line ends and capitals are tokens, named by 64-bit hashes; the
distribution below the unigrams is the spelling of a word by the character
model of ``kneser_ney``, so no word is outside of the vocabulary. The n-grams
that are gathered grow with the trusted text: they are counted in each task,
summed by n-gram, and the model is a table sharded by n-gram that no machine
holds as a whole.

The log probability of a text is a sum over its n-grams. With the back-off
factor ``bow`` of a context, a token ``c`` after ``a b`` has

    log p3(abc) = spelling(c) + up(c) + log bow(b) + up(bc) + log bow(ab) + up(abc)

where ``up`` of a seen n-gram is what it gains over its back-off, and what is
not seen adds nothing. So the places of the distinct n-grams of groups of
documents meet ``key -> up + log bow`` in its shard, and one sum by document
scores every whole text.

What shards send each other are packed columns, a block for each sender,
not rows: an n-gram costs Spark nothing but its bytes. A trigram lies in the
shard of its context, a pair in its own, so no frequent word has a shard to
itself.

Half of the trusted texts teaches the model of the other half: no text is
scored by a model that has seen it, and all texts are scored by models of
like size. The half of a text is a bit of the smallest hash of its
three-token runs, which exact copies share always and near copies mostly.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_tables, lean, shuffle_partitions, slices, store
from .kneser_ney import ALPHABET, CLASSES, ORDER, estimate, grams, log_table
from .kneser_ney import train as train_spelling
from .words import run_hashes, word_hashes

#: Scripts without blanks between words: each character is a token.
_SINGLE = "฀-໿ក-៿⺀-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+|[^\w\s]|_|\n")
#: Tokens before a word with a capital and before one in capitals.
CAPITAL, CAPITALS = "\x01", "\x02"
BEGIN, END = (np.int64(x) for x in (0x5BD1E9955BD1E995, 0x3C6EF372A54FF53A))
#: What sets the keys of the second model apart.
SALT = 0x2545F4914F6CDD1D
#: Log2 probability of the end of a text where no n-gram tells more.
END_BITS = -10.0
#: Fixed point of log2 probabilities: sums of whole numbers do not depend on their order.
POINT = 1 << 20
#: Tokens that a task holds before it sends their n-grams.
HELD_TOKENS = 1_000_000
#: Turns that texts are scored in. All are scored; a turn's n-grams are removed before the next one.
TURNS = 4

#: What the shards of the model send each other: packed columns of one model, from the shard ``home`` to ``shard``.
BLOCKS = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("model", T.IntegerType()),
                       T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])
PLACED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("model", T.IntegerType()), T.StructField("group", T.LongType()),
                       T.StructField("head", T.BooleanType()), T.StructField("data", T.BinaryType())])
SUMS = T.StructType([T.StructField("group", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("data", T.BinaryType())])
COUNTS = T.StructType([T.StructField("model", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in "abcn"]])
PLACES = T.StructType([T.StructField("group", T.LongType()), T.StructField("key", T.LongType()), T.StructField("at", T.BinaryType()),
                       T.StructField("bits", T.LongType())])
GAINS = T.StructType([T.StructField(x, T.LongType()) for x in ("row", "s", "n")])


def tokens(text: str) -> list[str]:
    """Words in lower case after marks of their capitals, marks and line ends; a blank text has none."""
    if not text.strip():
        return []
    out = []
    for t in _TOKEN.findall(text):
        low = t.lower()
        if low != t:
            out.append(CAPITALS if len(t) > 1 and t.upper() == t else CAPITAL)
        out.append(low)
    return out


def _spread() -> np.ndarray:
    """Bits that tell a character from others of its class: half for the plain one, the other half for all others."""
    size = np.bincount(CLASSES, minlength=33)
    bits = (1 + np.log2(size))[CLASSES].astype(np.float32)
    bits[CLASSES == 0] = 0
    bits[:128] = np.where(CLASSES[:128] == 28, 1 + np.log2(10), np.minimum(bits[:128], np.where(CLASSES[:128] > 30, 6, CLASSES[:128] > 0)))
    return bits


SPREAD = _spread()


class Vocabulary:
    """Hash and log2 probability of the spelling of each token, in a bounded memo."""

    def __init__(self, table: np.ndarray, most: int = 400_000):
        self.table, self.most = table, most
        self.hash: dict[str, int] = {}
        self.bits: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.hash) > self.most:
            self.hash, self.bits = {}, {}
        new = [w for w in words if w not in self.hash]
        hashes, bits = self.measure(new)
        self.hash.update(zip(new, hashes))
        self.bits.update(zip(new, bits))

    def measure(self, new: list[str]) -> tuple[list[int], list[float]]:
        """Hashes and log2 probabilities of words, past the memo."""
        if not new:
            return [], []
        hashes = word_hashes(" ".join(new).encode("utf-8", "surrogatepass")).view(np.int64).tolist()
        points = np.frombuffer(("   " + "".join(w + "   " for w in new)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        plane = np.minimum(points, 0xFFFF)
        codes = np.where(points < 1 << 16, CLASSES[plane], 32).astype(np.int64)
        cost = self.table[grams(codes)]
        cost -= np.where(points < 1 << 16, SPREAD[plane], 20.0)[ORDER - 1:]
        # a word's letters and the blank after it, each after the symbols before it; not the other blanks
        size = np.array([len(w) + 1 for w in new])
        first = np.cumsum(size + ORDER - 2) - size - ORDER + 2
        cuts = np.column_stack([first, first + size]).ravel()
        return hashes, np.add.reduceat(np.append(cost, 0), cuts)[::2].tolist()


def _sequence(found: list[str], words: Vocabulary) -> np.ndarray:
    """Hashes of the tokens between the marks of the ends."""
    inner = np.fromiter(map(words.hash.__getitem__, found), np.int64, len(found))
    return np.concatenate([[BEGIN, BEGIN], inner, [END]])


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    u = x.view(np.uint64)
    return ((u << np.uint64(bits)) | (u >> np.uint64(64 - bits))).view(np.int64)


def _triples(s: np.ndarray) -> np.ndarray:
    return _turned(s[:-2], 42) ^ _turned(s[1:-1], 21) ^ s[2:]


def _half(triples: np.ndarray) -> int:
    """The half of a text with these three-token runs."""
    return int(triples.min()) & 1


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane what it is in a token, and its lower case."""
    points = [chr(c) for c in range(1 << 16)]
    single = re.compile(f"[{_SINGLE}_]")
    low, up = [x.lower() for x in points], [x.upper() for x in points]
    flags = [(RUN if x.isalnum() and not single.match(x) else 0) | (BLANK if x.isspace() and x != "\n" else 0) | (FALLS if l != x else 0)
             | (RISEN if u == x else 0) | (ODD if len(l) > 1 or x in "\u03a3\uffff" else 0) for x, l, u in zip(points, low, up)]
    return np.array(flags, np.uint8), np.array([ord(x[0]) for x in low], np.uint16)


#: Part of a run of letters, blank, with a lower case, its own upper case, and lower case that depends on its neighbours.
RUN, BLANK, FALLS, RISEN, ODD = (1 << i for i in range(5))
FLAGS, LOWER = _letters()


class Reader:
    """Token hashes and spellings of texts, as ``tokens`` cuts them, of many texts at once."""

    def __init__(self, table: np.ndarray):
        self.words = Vocabulary(table)
        hashes, bits = self.words.measure([CAPITAL, CAPITALS])
        self.marks, self.mark_bits = np.array([0, *hashes], np.int64), np.array([0, *bits])

    def _one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text with characters beyond the basic plane, or whose lower case depends on their neighbours."""
        hashes, bits = self.words.measure(tokens(text))
        return np.array([BEGIN, BEGIN, *hashes, END], np.int64), np.array([*bits, END_BITS])

    def read(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The sequence of hashes between the marks of the ends, and the bits of its tokens and the end; None of a blank text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        live = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if not live:
            return out
        points = np.frombuffer("".join([texts[i] for i in live]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.array([len(texts[i]) for i in live])
        start = np.cumsum(size) - size
        points = np.minimum(points, 0xFFFF)
        flags = FLAGS[points]
        odd = np.bitwise_or.reduceat(flags, start) & ODD
        if odd.any():
            plain = [i for i, x in zip(live, odd) if not x]
            for i, x in zip(plain, self.read([texts[i] for i in plain])):
                out[i] = x
            for i, x in zip(live, odd):
                if x:
                    out[i] = self._one(texts[i])
            return out
        kept, run = flags & BLANK == 0, flags & RUN != 0
        begin = kept.copy()
        begin[1:] &= ~(run[1:] & run[:-1])
        begin[start] = kept[start]
        many = np.add.reduceat(begin, start, dtype=np.int64)
        hashes, bits, mark = self._measured(points[kept], flags[kept], np.flatnonzero(begin[kept]))
        # marks of capitals stand before their words, and marks of the ends around each text
        marked, whose = np.flatnonzero(mark), np.repeat(np.arange(len(live)), many)
        last = np.cumsum(1 + (mark > 0)) + 1 + 3 * whose
        s, spelled = np.empty(int(last[-1]) + 2, np.int64), np.empty(int(last[-1]) + 2)
        s[last], spelled[last] = hashes, bits
        s[last[marked] - 1], spelled[last[marked] - 1] = self.marks[mark[marked]], self.mark_bits[mark[marked]]
        ends = last[np.cumsum(many) - 1] + 2
        begins = np.append(0, ends[:-1])
        s[begins] = s[begins + 1] = BEGIN
        s[ends - 1], spelled[ends - 1] = END, END_BITS
        for i, a, b in zip(live, begins.tolist(), ends.tolist()):
            out[i] = s[a:b], spelled[a + 2:b]
        return out

    def _measured(self, points: np.ndarray, flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, spelling and mark of capitals of the tokens that begin at ``first``."""
        size = np.diff(np.append(first, len(points)))
        some, every = np.bitwise_or.reduceat(flags, first), np.bitwise_and.reduceat(flags, first)
        mark = np.where(some & FALLS, np.where((every & RISEN != 0) & (size > 1), 2, 1), 0)
        low = LOWER[points]
        place = np.arange(len(low)) - np.repeat(first, size)
        if int(low.max()) < 128:
            hashes = run_hashes(low, first, size, place)
        else:
            raw = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            wide = 1 + (low > 0x7F) + (low > 0x7FF)
            at, n = (np.cumsum(wide) - wide)[first], np.add.reduceat(wide, first)
            hashes = run_hashes(raw, at, n, np.arange(len(raw)) - np.repeat(at, n))
        codes = CLASSES[low].astype(np.int32)
        gram = codes.copy()
        for j in range(1, ORDER):
            gram[j:] += codes[:-j] * (place[j:] >= j) * np.int32(ALPHABET ** j)
        cost = (self.words.table[gram] - SPREAD[low]).astype(np.float64)
        # and the blank after each word
        blank = self.words.table[gram[first + size - 1] % ALPHABET ** (ORDER - 1) * ALPHABET]
        return hashes.view(np.int64), np.add.reduceat(cost, first) + blank, mark


def pack(*columns: tuple[str, np.ndarray]) -> bytes:
    """Columns as one compressed string. Kinds: ``d`` whole numbers in order, as differences; ``p`` byte by byte of all values; ``r`` as they are."""
    head, body = [], []
    for kind, x in columns:
        if kind == "d":
            x = np.diff(x.astype(np.int64).view(np.uint64), prepend=np.uint64(0))
        head.append(f"{kind}{x.dtype.str[1:]}{len(x)}")
        body.append(x.tobytes() if kind == "r" else np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    raw = b"".join(["|".join(head).encode(), b"\n", *body])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at = raw.index(b"\n")
    names, body, at, out = raw[:at].decode().split("|"), np.frombuffer(raw, np.uint8), at + 1, []
    for name in names:
        kind, dtype, n = name[0], np.dtype(f"<{name[1:3]}"), int(name[3:])
        part = body[at:at + n * dtype.itemsize]
        at += len(part)
        x = part.copy().view(dtype) if kind == "r" else np.ascontiguousarray(part.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
        out.append(np.cumsum(x, dtype=np.uint64).view(np.int64) if kind == "d" else x)
    return out


def _joined(blocks: list[bytes]) -> list[np.ndarray]:
    """The columns of all blocks, one after the other."""
    return [np.concatenate(x) for x in zip(*map(unpack, blocks))]


def _place(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key, by the upper bits of a product."""
    upper = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((upper * np.uint64(shards)) >> np.uint64(32)).astype(np.uint16 if shards < 1 << 16 else np.int32)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` and where each distinct one begins in it."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    return order, np.flatnonzero(new)


def _cut(place: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The runs of each shard in ordered places."""
    ends = np.searchsorted(place, np.arange(shards + 1))
    for i in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(i), slice(ends[i], ends[i + 1])


def shard_names(spark: SparkSession) -> np.ndarray:
    """Names of as many shards as the model has: whole numbers that Spark deals to one partition each."""
    n = shuffle_partitions(spark)
    n = max(min(n, 24), n // 2)
    dealt = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found, most = [], 32 * n
    while len(found) < n:
        found = spark.range(most).groupBy(dealt.alias("k")).agg(F.min("id").alias("id")).collect()
        most *= 4
    return np.array(sorted(r["id"] for r in found), np.int32)


def _rows(rows: list[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    types = to_arrow_schema(schema)
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i:i + 64]), types)], schema=types)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], dict[str, list[tuple[int, bytes]]]]:
    """The blocks of a task by shard and model, and by kind."""
    out: dict = {}
    for b in batches:
        for home, shard, model, kind, data in zip(*(b[c].to_pylist() for c in BLOCKS.names)):
            out.setdefault((shard, model), {}).setdefault(kind, []).append((home, data))
    return out


def _stat(n: np.ndarray) -> bytes:
    """How many n-grams there are, once, twice, three and four times, and of all counts the sum."""
    return pack(("r", np.array([len(n), *[(n == i).sum() for i in (1, 2, 3, 4)], n.sum()], np.int64)))


def trigram_blocks(trusted: DataFrame, table: np.ndarray, names: np.ndarray, models: tuple[int, ...] = (0, 1)) -> DataFrame:
    """For some of the models, blocks of the trigrams (``tri``: three words and a count) and the words (``word``: hash and spelling) of all whole trusted texts.

    A text counts for the model that scores the other half. Each task sends
    an n-gram once for every ``HELD_TOKENS`` tokens: a trigram to the shard
    of its context, a word to its own. No shard has all trigrams around a
    frequent word.
    """
    shared, shards = trusted.sparkSession.sparkContext.broadcast(table), len(names)

    def sent(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for model in models:
            mine = [(s, x) for m, s, x in held if m == model]
            if not mine:
                continue
            rows = []
            a, b, c = (np.concatenate([s[i:len(s) - 2 + i] for s, _ in mine]) for i in range(3))
            order, first = _distinct(c)
            u, bits = c[order[first]], np.concatenate([x for _, x in mine])[order[first]]
            place = _place(u, shards)
            by = np.argsort(place, kind="stable")
            u, bits = u[by], bits[by]
            for i, k in _cut(place[by], shards):
                rows.append((0, int(names[i]), model, "word", pack(("d", u[k]), ("p", bits[k].astype(np.float32)))))
            order, first = _distinct(_turned(a, 42) ^ _turned(b, 21) ^ c)
            n = np.diff(np.append(first, len(c))).astype(np.int32)
            at = order[first]
            a, b, c = a[at], b[at], c[at]
            # equal words side by side
            by = np.argsort((a & ~np.int64(0xFFFFFF)) | (b.view(np.uint64) >> np.uint64(40)).view(np.int64))
            place = _place(_turned(a, 21) ^ b, shards)[by]
            again = np.argsort(place, kind="stable")
            by, place = by[again], place[again]
            a, b, c, n = a[by], b[by], c[by], n[by]
            for i, k in _cut(place, shards):
                rows.append((0, int(names[i]), model, "tri", pack(("r", a[k]), ("r", b[k]), ("r", c[k]), ("p", n[k]))))
            yield from _rows(rows, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(shared.value), [], 0
        for b in slices(batches, 64):
            for found in reader.read(b["text"].to_pylist()):
                if found:
                    s, bits = found
                    model = 1 - _half(_triples(s))
                    if model not in models:
                        continue
                    held.append((model, s, bits))
                    size += len(bits) - 1
                    if size >= HELD_TOKENS:
                        yield from sent(held)
                        held, size = [], 0
        yield from sent(held)

    return trusted.select("text").mapInArrow(run, BLOCKS)


def merged_trigrams(blocks: DataFrame, names: np.ndarray) -> DataFrame:
    """The trigrams (``tri``) of each shard once; of their pairs what the shard of the pair asks for (``pair``: two words
    and the number of different words before them); and the shard's words, once."""
    shards = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, model), kinds in _gathered(batches).items():
            rows = []
            if "word" in kinds:
                u, bits = _joined([x for _, x in kinds["word"]])
                order, first = _distinct(u)
                rows.append((shard, shard, model, "word", pack(("d", u[order[first]]), ("p", np.minimum.reduceat(bits[order], first)))))
            if "tri" in kinds:
                a, b, c, n = _joined([x for _, x in kinds.pop("tri")])
                order, first = _distinct(_turned(a, 42) ^ _turned(b, 21) ^ c)
                n, at = np.add.reduceat(n[order].astype(np.int64), first), order[first]
                a, b, c = a[at], b[at], c[at]
                by = np.argsort((a & ~np.int64(0xFFFFFF)) | (b.view(np.uint64) >> np.uint64(40)).view(np.int64))
                a, b, c, n = a[by], b[by], c[by], n[by]
                rows.append((shard, shard, model, "tri", pack(("r", a), ("r", b), ("r", c), ("p", n))))
                rows.append((shard, shard, model, "stat", _stat(n)))
                order, first, place = _pairs(b, c, shards)
                times = np.diff(np.append(first, len(c))).astype(np.int32)
                b, c = b[order[first]], c[order[first]]
                for i, k in _cut(place, shards):
                    rows.append((shard, int(names[i]), model, "pair", pack(("r", b[k]), ("r", c[k]), ("p", times[k]))))
            yield from _rows(rows, BLOCKS)

    return blocks.mapInArrow(run, BLOCKS)


def _pairs(b: np.ndarray, c: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of pairs by shard and key, where each distinct one begins in it, and its shard."""
    key = _turned(b, 21) ^ c
    order = np.argsort(key)
    place = _place(key[order], shards)
    by = np.argsort(place, kind="stable")
    order, place = order[by], place[by]
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return order, first, place[first]


def _contexts(of: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Each distinct ``of``, in order, and of its counts ``n`` the sum and how many are one, two, and more."""
    order, first = _distinct(of)
    n = n[order].astype(np.int64)
    return [of[order[first]], *(np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2))]


def counted_pairs(blocks: DataFrame, names: np.ndarray) -> DataFrame:
    """The pairs of each shard (``pair``) with the number of different words before them, which of them who asks for
    (``list``), and what the shards of their words have to add up (``ask``): different words before, and as a context
    the sum of counts and how many are one, two, and more."""
    shards = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, model), kinds in _gathered(batches).items():
            homes, parts = [h for h, _ in kinds["pair"]], [unpack(x) for _, x in kinds["pair"]]
            b, c, n = (np.concatenate(x) for x in zip(*parts))
            key = _turned(b, 21) ^ c
            order, first = _distinct(key)
            n = np.add.reduceat(n[order].astype(np.int64), first)
            where = np.empty(len(key), np.int64)
            where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            rows, at = [], 0
            for home, part in zip(homes, parts):
                rows.append((shard, shard, model, "list", pack(("r", np.array([home])), ("d", where[at:at + len(part[0])]))))
                at += len(part[0])
            b, c = b[order[first]], c[order[first]]
            rows.append((shard, shard, model, "pairs", pack(("r", b), ("r", c), ("p", n))))
            rows.append((shard, shard, model, "stat", _stat(n)))
            u, *sums = _contexts(b, n)
            v, times = np.unique(c, return_counts=True)
            words = np.union1d(u, v)
            columns = np.zeros((5, len(words)), np.int64)
            columns[0, np.searchsorted(words, v)] = times
            columns[1:, np.searchsorted(words, u)] = sums
            place = _place(words, shards)
            by = np.argsort(place, kind="stable")
            words, columns = words[by], columns[:, by]
            for i, k in _cut(place[by], shards):
                rows.append((shard, int(names[i]), model, "ask", pack(("d", words[k]), *(("p", x[k]) for x in columns))))
            yield from _rows(rows, BLOCKS)

    return blocks.mapInArrow(run, BLOCKS)


def counted_words(blocks: DataFrame) -> DataFrame:
    """The words of each shard with their sums and spelling (``words``), and the answers to those who ask (``words`` as well)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, model), kinds in _gathered(batches).items():
            asks = [(h, unpack(x)) for h, x in kinds.get("ask", ())]
            if not asks:
                continue
            order, first = _distinct(words := np.concatenate([x[0] for _, x in asks]))
            sums = [np.add.reduceat(np.concatenate([x[i] for _, x in asks])[order], first) for i in range(1, 6)]
            words = words[order[first]]
            bits = np.zeros(len(words), np.float32)
            for _, x in kinds.get("word", ()):
                known, own = unpack(x)
                bits[np.searchsorted(words, known)] = own
            columns = [*sums, bits]
            answers = [(shard, shard, model, "own", pack(("d", words), *(("p", x) for x in columns)))]
            for home, x in asks:
                at = np.searchsorted(words, x[0])
                answers.append((shard, home, model, "words", pack(("d", x[0]), *(("p", y[at]) for y in columns))))
            yield from _rows([*answers, (shard, shard, model, "stat", _stat(sums[0][sums[0] > 0]))], BLOCKS)

    return blocks.mapInArrow(run, BLOCKS)


class Rules:
    """The discounts of one model by order, and the root of its words."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, top: np.ndarray):
        # six digits, so that sums of discounts are whole numbers
        self.cuts = [np.array([round(d, 6) for d in estimate(x[1:5].tolist())]) for x in (words, pairs, top)]
        kinds = np.array([words[1], words[2], words[0] - words[1] - words[2]])
        self.total = float(words[5]) or 1.0
        self.share = float(self.back(0, self.total, *kinds)) if words[0] else 1.0

    def cut(self, order: int, n: np.ndarray) -> np.ndarray:
        return self.cuts[order][np.minimum(n, 3) - 1]

    def back(self, order: int, total, one, two, more):
        """What a context leaves to the lower order."""
        whole = np.round(self.cuts[order] * 1e6)
        return (one * whole[0] + two * whole[1] + more * whole[2]) / 1e6 / total

    def words(self, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of seen words, and log2 of what that gains over their spelling."""
        bits = bits.astype(np.float64)
        spelled = self.share * np.exp2(bits)
        p = (n - self.cut(0, n)) / self.total + spelled
        return p, np.where(spelled > 1e-300, np.log2(p / np.maximum(spelled, 1e-300)), np.log2(p) - bits - np.log2(self.share))


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * POINT).astype(np.int64)


def pair_chances(rule: Rules) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one shard and model, by its pairs and the words it has and asked for: keys and weights of its words and pairs
    (``gain``), and the probabilities of the pairs that shards of trigrams asked for (``p``)."""
    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        both = pa.concat_tables([pairs, words])
        shard, model = (both[x][0].as_py() for x in ("shard", "model"))
        rows, found = [], {}
        for kind, data in zip(both["kind"].to_pylist(), both["data"].to_pylist()):
            found.setdefault(kind, []).append(data)
        for x in found.get("own", ()):
            known, n, *context, bits = unpack(x)
            seen, ahead = np.flatnonzero(n), np.flatnonzero(context[0])
            rows.append((shard, shard, model, "gain", pack(("r", known[seen]), ("p", _fixed(rule.words(n[seen], bits[seen])[1])))))
            rows.append((shard, shard, model, "gain", pack(("r", known[ahead]), ("p", _fixed(np.log2(rule.back(1, *(y[ahead] for y in context))))))))
        for x in found.get("pairs", ()):
            b, c, n = unpack(x)
            known, times, *context, bits = _joined(found["words"])
            by = np.argsort(known)
            known, times, context, bits = known[by], times[by], [y[by] for y in context], bits[by]
            at, ahead = np.searchsorted(known, c), np.searchsorted(known, b)
            low = rule.words(np.maximum(times, 1), bits)[0][at]
            back = rule.back(1, *(np.maximum(y, i == 0) for i, y in enumerate(context)))[ahead] * low
            p = (n - rule.cut(1, n)) / context[0][ahead] + back
            rows.append((shard, shard, model, "gain", pack(("r", _turned(b, 21) ^ c), ("p", _fixed(np.log2(p / back))))))
            for y in found["list"]:
                (home,), asked = unpack(y)
                rows.append((shard, int(home), model, "p", pack(("r", p[asked]))))
        return pa.Table.from_batches(_rows(rows, BLOCKS), schema=to_arrow_schema(BLOCKS))

    return run


def weighed(names: np.ndarray, rule: Rules) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one shard and model, ``weight``: the key and the weight of every n-gram, by its trigrams and what was sent to it."""
    shards, order_of = len(names), {int(x): i for i, x in enumerate(names)}

    def run(top: pa.Table, sent: pa.Table) -> pa.Table:
        columns = [unpack(x) for x, kind in zip(sent["data"].to_pylist(), sent["kind"].to_pylist()) if kind == "gain"]
        keys, weights = [x[0] for x in columns], [x[1] for x in columns]
        shard, model = (sent[x][0].as_py() for x in ("shard", "model"))
        for data in top["data"].to_pylist():
            a, b, c, n = unpack(data)
            low = sorted((order_of[h], x) for h, x, kind in zip(*(sent[k].to_pylist() for k in ("home", "data", "kind"))) if kind == "p")
            order, first, _ = _pairs(b, c, shards)
            p2 = np.empty(len(c))
            p2[order] = np.repeat(np.concatenate([unpack(x)[0] for _, x in low]), np.diff(np.append(first, len(c))))
            context = _turned(a, 21) ^ b
            known, *sums = _contexts(context, n)
            bow, at = rule.back(2, *sums), np.searchsorted(known, context)
            back = bow[at] * p2
            keys += [_turned(context, 21) ^ c, known]
            weights += [_fixed(np.log2(((n - rule.cut(2, n)) / sums[0][at] + back) / back)), _fixed(np.log2(bow))]
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order, first = _distinct(key)
        data = pack(("d", key[order[first]]), ("p", np.add.reduceat(weight[order], first)))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((shard, shard, model, "weight", data), to_arrow_schema(BLOCKS))],
                                    schema=to_arrow_schema(BLOCKS))

    return run


def _keep(df: DataFrame, table: str, shards: int) -> DataFrame:
    """Adds blocks to a table of the warehouse in buckets of the shard that made them; its files go when it is dropped."""
    with lean(df.sparkSession):
        (df.write.mode("append").partitionBy("model", "kind").bucketBy(shards, "home")
         .option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20)
         .saveAsTable(table))
    return df.sparkSession.table(table).select(*BLOCKS.names)


def _drop(spark: SparkSession, table: str, kind: str, model: int) -> None:
    """Drops blocks that were read for the last time, with their files."""
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (model = {model}, kind = '{kind}')")


def _stat_of(blocks: DataFrame) -> np.ndarray:
    """The summed ``stat`` of all shards."""
    return sum((unpack(r["data"])[0] for r in blocks.filter("kind = 'stat'").select("data").collect()), np.zeros(6, np.int64))


def add_weights(trusted: DataFrame, table: np.ndarray, names: np.ndarray, out: str, model: int) -> float:
    """Adds to the table ``out`` blocks of key and weight (fixed-point log2) of every n-gram of one model, in buckets of
    their shard, and returns log2 of the share of the spelling."""
    spark, n = trusted.sparkSession, len(names)
    tables = [f"llm_{x}_{uuid.uuid4().hex}" for x in ("trigrams", "pairs", "words")]
    dealt = lambda df: df.repartition(n, "shard")
    only = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    try:
        top = _keep(merged_trigrams(dealt(trigram_blocks(trusted, table, names, (model,))), names), tables[0], n)
        pairs = _keep(counted_pairs(dealt(only(top, "pair")), names), tables[1], n)
        _drop(spark, tables[0], "pair", model)
        words = _keep(counted_words(dealt(only(pairs, "ask").unionByName(only(top, "word")))), tables[2], n)
        _drop(spark, tables[1], "ask", model)
        _drop(spark, tables[0], "word", model)
        rule = Rules(*map(_stat_of, (words, pairs, top)))
        known = dealt(only(words, "own", "words"))
        sent = dealt(only(pairs, "pairs", "list").groupBy("home").cogroup(known.groupBy("shard")).applyInArrow(pair_chances(rule), BLOCKS))
        _keep(only(top, "tri").groupBy("home").cogroup(sent.groupBy("shard")).applyInArrow(weighed(names, rule), BLOCKS), out, n)
        return float(np.log2(rule.share))
    finally:
        drop_tables(spark, *tables)


def document_blocks(docs: DataFrame, table: np.ndarray, share: list[float], names: np.ndarray) -> DataFrame:
    """The n-grams of groups of documents, by the shards that have their weights.

    Each task numbers the documents of a group of up to ``HELD_TOKENS``
    tokens. A block has the distinct keys of a group that a shard has for a
    model, of each how many places it has, and the number of the document of
    each place. The ``head`` of a group has of each document its ``row``,
    its number of tokens and its spelling.
    """
    shared, shards = docs.sparkSession.sparkContext.broadcast(table), len(names)

    def sent(group: int, held: list[tuple[int, np.ndarray]], heads: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if not heads:
            return
        rows = [(int(names[group % shards]), -1, group, True, pack(*(("p", np.array(x, np.int64)) for x in zip(*heads))))]
        for model in (0, 1):
            mine = [(i, s) for i, (m, s) in enumerate(held) if m == model]
            if not mine:
                continue
            s = np.concatenate([x for _, x in mine])
            size = np.array([len(x) for _, x in mine])
            whose = np.repeat(np.array([i for i, _ in mine], np.int32), size)
            begin = np.zeros(len(s), bool)
            begin[np.cumsum(size)[:-1]] = begin[0] = True
            one = np.flatnonzero(~begin)
            pair = _turned(s[one - 1], 21) ^ s[one]
            # the first pair of a text is no end of a run of three
            two = np.flatnonzero(~begin[one - 1])
            context = _turned(s[one[two] - 2], 21) ^ s[one[two] - 1]
            keys = np.concatenate([s[one], pair, _turned(context, 21) ^ s[one[two]]])
            place = np.concatenate([_place(s[one], shards), _place(pair, shards), _place(context, shards)])
            doc = np.concatenate([whose[one], whose[one], whose[one[two]]])
            order = np.argsort(keys)
            place = place[order]
            by = np.argsort(place, kind="stable")
            order, place = order[by], place[by]
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
            for i, k in _cut(place, shards):
                first = np.flatnonzero(new[k])
                times = np.diff(np.append(first, k.stop - k.start)).astype(np.int32)
                rows.append((int(names[i]), model, group, False, pack(
                    ("r", np.array([len(heads)])), ("d", keys[k][first]), ("p", times), ("p", doc[k]))))
        yield from _rows(rows, PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, heads, size = Reader(shared.value), [], [], 0
        group = TaskContext.get().partitionId() << 32
        for b in slices(batches, 64):
            for row, found in zip(b["row"].to_pylist(), reader.read(b["text"].to_pylist())):
                if not found:
                    continue
                s, bits = found
                f = _half(_triples(s))
                held.append((f, s))
                heads.append((row, len(bits), round((float(bits.sum(dtype=np.float64)) + len(bits) * share[f]) * POINT)))
                size += len(bits) - 1
                if size >= HELD_TOKENS:
                    yield from sent(group, held, heads)
                    held, heads, size, group = [], [], 0, group + 1
        yield from sent(group, held, heads)

    return docs.select("row", "text").mapInArrow(run, PLACED)


def shard_sums(model: pa.Table, placed: pa.Table) -> pa.Table:
    """Of each group what the n-grams of one shard add to each of its documents; the heads of groups go on as they are."""
    out = []
    weights = {m: unpack(x) for m, x in zip(model["model"].to_pylist(), model["data"].to_pylist())}
    sums: dict[int, np.ndarray] = {}
    for m, group, head, data in zip(*(placed[c].to_pylist() for c in PLACED.names[1:])):
        if head:
            out.append((group, True, data))
        elif m in weights and len(weights[m][0]):
            known, weight = weights[m]
            (n,), keys, times, doc = unpack(data)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            gain = np.repeat(np.where(known[at] == keys, weight[at], 0), times)
            found = np.bincount(doc, gain, n).astype(np.int64)
            sums[group] = sums[group] + found if group in sums else found
    out += [(g, False, pack(("p", x))) for g, x in sums.items()]
    types = to_arrow_schema(SUMS)
    return pa.Table.from_batches(_rows(out, SUMS), schema=types)


def gains(sums: DataFrame) -> DataFrame:
    """``row``, the sum ``s`` of its spelling and all that its n-grams add, and its number of tokens ``n``, by document;
    all rows of a group have to be in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, added = {}, {}
        for b in batches:
            for group, head, data in zip(*(b[c].to_pylist() for c in SUMS.names)):
                if head:
                    heads[group] = data
                else:
                    found = unpack(data)[0]
                    added[group] = added[group] + found if group in added else found
        for group, data in heads.items():
            row, n, spelled = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, spelled + added.get(group, 0), n)], GAINS.names)

    return sums.mapInArrow(run, GAINS)


def trigram_counts(trusted: DataFrame, table: np.ndarray) -> DataFrame:
    """The gathered trigrams as rows: ``model``, ``a``, ``b``, ``c`` and ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, data in zip(b["model"].to_pylist(), b["data"].to_pylist()):
                a, *rest = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), model, np.int32)), *map(pa.array, (a, *rest))], COUNTS.names)

    names = shard_names(trusted.sparkSession)
    blocks = merged_trigrams(trigram_blocks(trusted, table, names).repartition(len(names), "shard"), names)
    return blocks.filter("kind = 'tri'").mapInArrow(run, COUNTS)


def document_counts(docs: DataFrame, table: np.ndarray, share: list[float]) -> DataFrame:
    """``document_blocks`` as rows: for each n-gram of a group ``key`` and, in ``at``, pairs of 32-bit numbers: the number
    of a document and how often it has it there. A row a document has its ``row`` in ``key`` and its spelling in ``bits`` (else null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, model, group, head, data in zip(*(b[c].to_pylist() for c in PLACED.names)):
                if head:
                    key, n, bits = unpack(data)
                    at = [np.array([i, x], np.int32).tobytes() for i, x in enumerate(n.tolist())]
                else:
                    _, key, times, doc = unpack(data)
                    key, bits = key ^ np.int64(SALT if model else 0), pa.nulls(len(key), pa.int64())
                    at = [np.column_stack([x, np.ones_like(x)]).tobytes() for x in np.split(doc, np.cumsum(times)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), group)), pa.array(key), pa.array(at, pa.binary()),
                                                  bits if isinstance(bits, pa.Array) else pa.array(bits)], PLACES.names)

    return document_blocks(docs, table, share, shard_names(docs.sparkSession)).mapInArrow(run, PLACES)


def row_key() -> Column:
    """Names a row's content: equal rows share a key, and so a perplexity."""
    return F.xxhash64("doc_id", "text")


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``row`` (``row_key``) and ``perplexity`` by token of every whole text with tokens, stored.

    All texts are scored, in ``TURNS`` turns, so that the n-grams of only a
    part of them are on disk at a time.
    """
    spark = docs.sparkSession
    (weights, taught), done = [f"llm_{x}_{uuid.uuid4().hex}" for x in ("weights", "trusted")], []
    names = shard_names(spark)
    try:
        with lean(spark):
            trusted.select("text").write.option("compression", "zstd").saveAsTable(taught)
        trusted = spark.table(taught)
        table = log_table(train_spelling(trusted))
        # one after the other: what the steps of a model send takes more room than its weights
        share = [add_weights(trusted, table, names, weights, m) for m in (0, 1)]
        drop_tables(spark, taught)
        model = spark.table(weights)
        keyed = docs.select(row_key().alias("row"), "text")
        for turn in range(TURNS):
            placed = document_blocks(keyed.filter(F.pmod("row", F.lit(TURNS)) == turn), table, share, names)
            sums = model.groupBy("home").cogroup(placed.repartition(len(names), "shard").groupBy("shard")).applyInArrow(shard_sums, SUMS)
            # equal documents have equal means
            gained = gains(sums.repartition(len(names), "group")).groupBy("row").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            with lean(spark):
                done.append(store(gained.select("row", F.pow(F.lit(2.0), -F.col("s") / POINT / F.col("n")).alias("perplexity")), "perplexities"))
    finally:
        drop_tables(spark, weights, taught)
    return functools.reduce(DataFrame.unionByName, done)
