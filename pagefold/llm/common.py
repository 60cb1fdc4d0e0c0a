"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.session import ensure_checkpoint_dir, materialize

#: Rows of one Arrow batch that a Python pass handles together.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back."""
    return materialize(df, f"llm-{name}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs that begin in here are removed when their job has ended, not at some collection in the
    driver, and two tables in buckets of one of the columns that join them are joined where they lie."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null read as empty) and the columns in ``keep``; other columns are dropped."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns that clash with ``names`` renamed, and a function that gives back just its own columns."""
    own = docs.columns
    taken = {*own, *names}
    renamed = {}
    for c in own:
        if c in names:
            new = f"{c}_own"
            while new in taken:
                new += "_"
            taken.add(new)
            renamed[c] = new

    def restore(df: DataFrame) -> DataFrame:
        return df.select([F.col(f"`{renamed.get(c, c)}`").alias(c) for c in own])

    return docs.withColumnsRenamed(renamed), restore


def text_key(text: Column | str = "text") -> Column:
    """128 bits of a text: with ``doc_id`` it names a row's content, so equal rows share a key."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into at most ``rows`` rows, so Python copies of long texts stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def uncollected(call: Callable) -> Callable:
    """``call`` with the collector of cycles paused. For calls that make many objects that stay and no cycles: the
    collector would walk through them again and again and free none."""
    @functools.wraps(call)
    def paused(*args, **kwargs):
        running = gc.isenabled()
        gc.disable()
        try:
            return call(*args, **kwargs)
        finally:
            if running:
                gc.enable()
    return paused


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (package ``public_tokenizers``)."""
    import public_tokenizers

    return public_tokenizers.path(name)


_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


#: Chunks whose characters are assigned alike in every Unicode version, with no blank at either end.
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\u024f](?:[\n -~\xa1-\xac\xae-\u024f]*[!-~\xa1-\xac\xae-\u024f])?")
#: Several plain chunks without spaces inside, joined by spaces.
_PLAIN_ROW = re.compile("[!-~\xa1-\xac\xae-\u024f]+(?:(?: |\n+)[!-~\xa1-\xac\xae-\u024f]+)*")
#: Chunks that are looked at together.
_ROW_CHUNKS = 32


class ChunkEncoder:
    """Ids of a byte-level BPE tokenizer file, each distinct chunk encoded once.

    New chunks of a batch are joined and encoded in one call; tokens never
    cross a chunk's border, so byte counts tell which ids are whose. Plain
    chunks are encoded by tiktoken with ranks made from the same file (only
    if its ids are in merge order), all others by the tokenizers library,
    which is the measure for both. The memo of chunks is bounded: when it
    holds ``cache_items`` it is emptied, which costs time and changes no id.
    """

    def __init__(self, path: str, cache_items: int = 400_000, longest: int = 48):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.path, self.dtype = path, "<u2" if size <= 1 << 16 else "<u4"
        self.cache_items, self.longest = cache_items, longest
        self.memo: dict[str, bytes | None] = {}
        self.no_cut: set[str] = set()       # those that the memo marks by None
        self.library = None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        pre = spec["pre_tokenizer"] or {}
        made = [vocab[a + b] for a, b in (m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges)]
        if (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and spec["normalizer"] is None and made == sorted(set(made))):
            import public_tokenizers
            import tiktoken

            letters = byte_alphabet()
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(size, dtype=np.int64)
            for t, i in ranks.items():
                self.width[i] = len(t)

    def _library(self, todo: list[str]) -> list[bytes]:
        """Ids by the tokenizers library, which is loaded when it is first needed."""
        import numpy as np

        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return [np.asarray(e.ids, dtype=self.dtype).tobytes()
                for e in self.library.encode_batch_fast(todo, add_special_tokens=False)]

    def _plain(self, chunk: str) -> bool:
        return self.fast is not None and _PLAIN.fullmatch(chunk) is not None and not any(s in chunk for s in self.special)

    def _parted(self, new: list[str]) -> tuple[list[str], list[str]]:
        """Plain chunks, and all others. Most rows of chunks are plain as a whole; only in the rest is each looked at."""
        plain: list[str] = []
        other: list[str] = []
        for i in range(0, len(new), _ROW_CHUNKS):
            row = new[i:i + _ROW_CHUNKS]
            line = " ".join(row)
            if self.fast is not None and _PLAIN_ROW.fullmatch(line) is not None and not any(s in line for s in self.special):
                plain += row
            else:
                for x in row:
                    (plain if self._plain(x) else other).append(x)
        return plain, other

    def _joined(self, new: list[str]) -> list[bytes]:
        """Ids of plain chunks, each with a blank in front, encoded in one call."""
        import numpy as np

        line = "\0".join(new)       # no plain chunk has this character, and it is as long as a blank
        ids = np.array(self.fast.encode_ordinary(" " + line.replace("\0", " ")), dtype=self.dtype)
        at = np.frombuffer(line.encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(at == 0), len(at)) + 1
        reached = np.cumsum(self.width[ids])
        cuts = [0, *(np.searchsorted(reached, ends) + 1).tolist()]
        raw, w = ids.tobytes(), ids.itemsize
        return [raw[a * w:b * w] for a, b in zip(cuts, cuts[1:])]

    def _head(self, text: str) -> bytes:
        import numpy as np

        if not text or not self._plain(text):
            return self._library([text])[0]
        return np.array(self.fast.encode_ordinary(text), dtype=self.dtype).tobytes()

    @uncollected
    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian ids (``self.dtype``) of each text.

        The pre-tokenizer lets a word take one blank before it, so a single
        space between two non-blank characters always begins a new
        pre-token: texts are cut there, the first chunk is encoded as it is
        and every other one with a blank in front. Where a cut at a space
        leaves an empty chunk, or one with a blank at an end, the text is cut
        anew by a pattern that looks at both sides.
        """
        if len(self.memo) > self.cache_items:
            self.memo, self.no_cut = {}, set()
        parts = [t.split(" ") for t in batch]
        heads = [p.pop(0) for p in parts]
        self._learn(set().union(*parts) if parts else set())
        out, again, get = [b""] * len(batch), [], self.memo.__getitem__
        for i, (head, p) in enumerate(zip(heads, parts)):
            try:
                if head[-1:].isspace() or not head:
                    raise TypeError
                out[i] = b"".join([self._head(head), *map(get, p)])
            except (KeyError, TypeError):
                again.append(i)
        for i in again:
            if batch[i]:
                head, *p = _SAFE_SPACE.split(batch[i])
                rare = self._learn(set(p))
                out[i] = b"".join([self._head(head), *[rare.get(x) or self.memo[x] for x in p]])
        return out

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Puts new chunks into the memo; long ones, and those with a blank at an end, are returned instead.

        In the memo, ``None`` marks a chunk that is no chunk of a right cut.
        """
        memo, apart = self.memo, {}
        plain, other = self._parted([*wanted.difference(memo), *wanted.intersection(self.no_cut)])
        if plain:
            # a plain chunk has no blank at its ends
            short = [x for x in plain if len(x) <= self.longest]
            long = [x for x in plain if len(x) > self.longest] if len(short) < len(plain) else []
            done = self._joined(short + long)
            memo.update(zip(short, done))
            apart.update(zip(long, done[len(short):]))
        for x, ids in zip(other, self._library([" " + x for x in other]) if other else []):
            if not x or x[0].isspace() or x[-1].isspace():
                memo[x] = None
                self.no_cut.add(x)
                apart[x] = ids
            elif len(x) <= self.longest:
                memo[x] = ids
            else:
                apart[x] = ids
        return apart


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker, made once and kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
