"""BPE encoding and decoding by a prefix-sharing trie (operator 1).

A byte-pair encoding is determined by its last token: the encoding of a
prefix is the encoding of a shorter prefix plus one token, and a token fits
exactly when the pair (last token of the shorter prefix, token) is stable,
that is when merging would not have joined symbols across their border. So
the last token of every prefix is the whole state of the encoder. Distinct
words go into a trie; a depth-first walk computes the last token of each
node from the states on its path, and words that share a prefix share that
work. The last symbol of a word carries the end-of-word mark, so it is a
leaf of its own under the shared prefix.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_alphabet, slices, texts, uncollected

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])
DIGEST_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
#: Rows whose new words are inserted together.
WORD_ROWS = 1024
#: Separators of this range are blanks to Python but not to the tokenizer's pattern.
_ODD_BLANK = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[ \t\n\x0b\x0c\r]+")
#: Runs that normalization leaves as they are but for lower case, and their pieces by the file's pattern; a blank parts runs.
_PLAIN = re.compile("[!-~\xc0-\u012f\u0131-\u017f]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^ 0-9a-z\xdf-\xf6\xf8-\u017f]+| ")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = {b: c for c, b in byte_alphabet().items()}
#: What stands in the byte alphabet for each letter of plain runs beyond ASCII.
_BYTES = {c: "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


def _runs(text: str) -> list[str]:
    """Runs of non-blank characters."""
    return [r for r in _BLANK.split(text) if r] if _ODD_BLANK.search(text) else text.split()


class Merges:
    """Vocabulary and merge order of a BPE file with an end-of-word suffix."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [p if isinstance(p, (list, tuple)) else p.split(" ") for p in model["merges"]]
        #: (left id, right id) -> merge rank
        self.rank: dict[tuple[int, int], int] = {}
        #: id -> (rank, left id, right id) of the merge that last made the token
        self.made: dict[int, tuple[int, int, int]] = {}
        joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            key = (self.vocab[a], self.vocab[b])
            self.rank.setdefault(key, r)
            joined.setdefault(key, self.vocab[a + b])
        self.joined = joined
        #: proper tokens (a word of their symbols encodes to the token alone), by
        #: text: inside a word, and at its end
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for token, i in self.vocab.items():
            at_end = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if at_end else token
            symbols = list(body)
            if at_end:
                symbols[-1] += self.end
            if all(s in self.vocab for s in symbols) and self._merge(symbols, i):
                (self.last if at_end else self.inner)[body] = i

    def _merge(self, symbols: list[str], whole: int) -> bool:
        """Merge a token's symbols in rank order; note its last merge. True if the token itself results."""
        ids, final = [self.vocab[s] for s in symbols], None
        while len(ids) > 1:
            ranked = [(self.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not ranked:
                return False
            r, k = min(ranked)
            final = (r, ids[k], ids[k + 1])
            ids[k:k + 2] = [self.joined[ids[k], ids[k + 1]]]
        if ids[0] == whole and final:
            self.made[whole] = final
        return ids[0] == whole

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the symbols of ``left`` and ``right`` together gives back just these two tokens.

        The border is followed back in time: of the two tokens that touch it,
        the later made one is undone, and a merge across the border that would
        have come before that moment proves the pair unstable. Equal ranks
        merge from the left, which decides the ties.
        """
        before = float("inf")
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 0.5, b[1]


class Endings:
    """Automaton over the symbols of all tokens: for what has been read, the tokens that end there, longest first.

    A state is the longest ending that begins some token; ``fail`` leads to
    the next shorter one, ``shorter`` to the next that is a token itself.
    """

    def __init__(self, merges: Merges):
        self.end = merges.end
        self.next: list[dict[str, int]] = [{}]
        self.token, self.length, self.fail, self.shorter = [-1], [0], [0], [0]
        for tokens, end in ((merges.inner, ""), (merges.last, merges.end)):
            for body, i in tokens.items():
                state = 0
                for symbol in (*body[:-1], body[-1] + end):
                    state = self.next[state].get(symbol) or self._new(state, symbol)
                self.token[state] = i
        level = list(self.next[0].values())
        while level:        # by length, so shorter endings are done first
            below = []
            for state in level:
                for symbol, child in self.next[state].items():
                    fail = self.fail[child] = self.step(self.fail[state], symbol)
                    self.shorter[child] = fail if self.token[fail] >= 0 else self.shorter[fail]
                    below.append(child)
            level = below

    def _new(self, state: int, symbol: str) -> int:
        child = self.next[state][symbol] = len(self.next)
        self.next.append({})
        self.token.append(-1)
        self.length.append(self.length[state] + 1)
        self.fail.append(0)
        self.shorter.append(0)
        return child

    def step(self, state: int, symbol: str) -> int:
        while (child := self.next[state].get(symbol)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return child


#: Places in a node of the trie: its children by symbol, the last token of its prefix, the length of the prefix
#: before that token, and the state of the automaton.
CHILDREN, TOKEN, BACK, STATE = range(4)


class TrieEncoder:
    """Encodes distinct words; the states of shared prefixes are computed once.

    Words are inserted in their order, which walks the trie depth first: a
    new node takes its last token from the nodes above it. The trie stays
    between batches and is begun anew when it holds ``most_nodes``, which
    costs time and changes no id.
    """

    def __init__(self, merges: Merges, most_nodes: int = 600_000):
        self.merges, self.endings, self.most_nodes = merges, Endings(merges), most_nodes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(merges.vocab.values()))]
        self._clear()

    def _clear(self) -> None:
        self.root, self.nodes = [{}, -1, -1, 0], 0

    def _fits(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs = {}
            ok = self.pairs[left, right] = self.merges.stable(left, right)
        return ok

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, little-endian in 32 bits. Words are non-empty strings of the byte alphabet."""
        if self.nodes > self.most_nodes:
            self._clear()
        out: dict[str, bytes] = {}
        follow, step, end, last, four = self.endings.next, self.endings.step, self.endings.end, self._last, self.four
        before, path = "", [self.root]
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word[:-1]):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            node, before = path[-1], word[:-1]
            for symbol in before[shared:]:
                child = node[CHILDREN].get(symbol)
                if child is None:
                    state = follow[node[STATE]].get(symbol)
                    if state is None:
                        state = step(node[STATE], symbol)
                    child = node[CHILDREN][symbol] = [{}, *last(path, state), state]
                    self.nodes += 1
                path.append(child)
                node = child
            state = follow[node[STATE]].get(word[-1] + end)
            token, back = last(path, step(node[STATE], word[-1] + end) if state is None else state)
            if back:
                ids = [four[token]]
                while back:
                    node = path[back]
                    ids.append(four[node[TOKEN]])
                    back = node[BACK]
                out[word] = b"".join(ids[::-1])
            else:
                out[word] = four[token]
        return out

    def _last(self, path: list[list], state: int) -> tuple[int, int]:
        """Last token of the prefix that goes one symbol beyond ``path``, and where it starts: the one that fits what is before it."""
        ends, pairs = self.endings, self.pairs
        if ends.token[state] < 0:
            state = ends.shorter[state]
        while state:
            token, start = ends.token[state], len(path) - ends.length[state]
            if not start:
                return token, 0
            ok = pairs.get((path[start][TOKEN], token))
            if ok or (ok is None and self._fits(path[start][TOKEN], token)):
                return token, start
            state = ends.shorter[state]
        raise ValueError("no token ends a prefix")


class WordCodec:
    """Whole texts to ids and back, as the file's tokenizer does.

    Normalization and word splitting are the tokenizers library's own, run
    once for each distinct run of non-blank characters; the ids of words come
    from the trie. The memo is bounded and emptied when full.
    """

    def __init__(self, path: str, cache_items: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tok = Tokenizer.from_file(path)
        self.split, self.normal = tok.pre_tokenizer.pre_tokenize_str, tok.normalizer.normalize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.trie = TrieEncoder(Merges(spec["model"]))
        size = tok.get_vocab_size(with_added_tokens=True)
        self.token = [tok.id_to_token(i) or "" for i in range(size)]
        self.number = [str(i) for i in range(size)]
        self.decoder = tok.decoder
        normal = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        #: whether ``_PIECES`` cuts plain runs as the file's own normalizer and pattern do
        self.known = (normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
                      and parts[0]["pattern"] == {"Regex": _PATTERN} and parts[0]["invert"] and not parts[1]["add_prefix_space"]
                      and all(len(_PIECES.findall(s.lower())) > 1 for s in self.special))
        self.cache_items = cache_items
        #: ids of each run, little-endian in 32 bits
        self.memo: dict[str, bytes] = {}

    def _words(self, run: str) -> list:
        """Pieces of a run of non-blank characters: byte-alphabet words, and ids of special tokens."""
        if run.isascii():
            if run.isalpha():
                return [run.lower()]
            if run[-1] in ".,!" and run[:-1].isalpha():
                return [run[:-1].lower(), run[-1]]
        found = [(run.find(s), s) for s in self.special if s in run]
        if found:
            at, s = min(found)
            rest = run[at + len(s):]
            return [*(self._words(run[:at]) if at else ()), self.special[s], *(self._words(rest) if rest else ())]
        return [w for w, _ in self.split(self.normal(run))]

    def _plain(self, new: set[str]) -> list[str]:
        """The runs of ``new`` that ``_PIECES`` cuts."""
        return [r for r in new if _PLAIN.fullmatch(r) and not any(s in r for s in self.special)] if self.known else []

    def _learn_plain(self, runs: list[str]) -> None:
        """Puts the ids of plain runs and of their pieces, which are runs of one piece, into the memo."""
        memo = self.memo
        found = _PIECES.findall(" ".join(runs).lower())
        words = {w: w if w.isascii() else w.translate(_BYTES) for w in set(found).difference(memo, " ")}
        coded = self.trie.encode(list(words.values()))
        memo.update((w, coded[x]) for w, x in words.items())
        found.append(" ")
        first = 0
        for r in runs:
            cut = found.index(" ", first)
            if cut == first + 1:
                memo[r] = memo[found[first]]
            else:
                memo[r] = b"".join(map(memo.__getitem__, found[first:cut]))
            first = cut + 1

    @uncollected
    def encode(self, batch: list[str]) -> list[list[int]]:
        runs = [_runs(t) for t in batch]
        if len(self.memo) > self.cache_items:
            self.memo = {}
        new = set().union(*runs).difference(self.memo)
        plain = self._plain(new)
        if plain:
            self._learn_plain(plain)
        pieces = {r: self._words(r) for r in new.difference(plain)}
        coded = self.trie.encode(list({w for p in pieces.values() for w in p if isinstance(w, str)}))
        for r, p in pieces.items():
            self.memo[r] = b"".join([coded[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p])
        ids_of = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, rs)), dtype="<i4").tolist() for rs in runs]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``, special tokens included; a file without a decoder joins tokens by blanks."""
        tokens = map(self.token.__getitem__, ids)
        return " ".join(tokens) if self.decoder is None else self.decoder.decode(list(tokens))


_CODECS: dict[str, WordCodec] = {}


def word_codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` for every row of ``docs``.

    A null text is encoded as an empty one: no ids, empty decoded text.
    Repeated rows give repeated results; other columns are ignored. Every
    whole text is encoded in one narrow stage without a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for b in slices(batches, WORD_ROWS):
            ids = codec.encode(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, SCHEMA)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 of ids and decoded text, without moving ids out of the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for b in slices(batches, WORD_ROWS):
            n, a, d = [], [], []
            for ids in codec.encode(b["text"].to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(codec.number.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, DIGEST_SCHEMA)
