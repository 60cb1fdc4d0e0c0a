"""Toxicity by a learned lexicon, Levenshtein automata and context windows (operator 6).

The lexicon is learned from a bounded sample of labelled texts: words, and
stems of words, that stand in toxic texts far more often than in others. It
is kept as a trie. A Levenshtein automaton of a word, run through the trie,
finds the terms within one edit; here the intersection is built the other
way round and lazily: the trie's own states are made deterministic sets of
(node, errors), so each word of the corpus walks it once, and leaves it at
the first letter that no misspelling explains. A hit's weight depends on its
window: quotation marks around it and words of report nearby speak for a
quoted insult, words of address for abuse. A logistic model of a text's hits
gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled texts that the lexicon and the weights are learned from, at most (taken by hash of doc_id).
SAMPLE = 6000
#: Characters up to which every labelled text may be in that sample; of longer ones, fewer are taken by their length,
#: so the expected bytes of the sample have a bound.
SAMPLE_CHARS = 20_000
#: Terms of the lexicon, at most.
MOST_TERMS = 600
#: Words on each side of a hit that its window holds.
WINDOW = 6
_WORD = re.compile(r"[^\W_]+")
_QUOTES = frozenset("\"“”«»„‘’")
#: Words of report and of address: cues of the window (fixed lists, English, German, French and Spanish).
REPORT = frozenset("said says wrote called calls quote quoted reported sagte schrieb nannte zitat dit écrit appelé citation "
                   "dijo escribió llamó cita".split())
ADDRESS = frozenset("you your youre u du dich dir dein ihr tu te toi ton vous votre tú ti usted ustedes".split())

N_FEATURES = 9


class Lexicon:
    """Terms as a trie, and the lazily built automaton of all words within one edit of a term.

    A state is a set of (node, errors); reading a letter follows the trie
    (no error), or spends the error on a substitution, an insertion or a
    lost letter. Terms of fewer than ``least`` letters allow no error. A stem
    accepts any longer word.
    """

    def __init__(self, weights: dict[str, float], stems: dict[str, float], least: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.long: list[bool] = [False]
        for table, terms in ((self.word, weights), (self.stem, stems)):
            for term, weight in sorted(terms.items()):
                node = 0
                for ch in term:
                    if ch not in self.children[node]:
                        self.children[node][ch] = len(self.children)
                        self.children.append({})
                        self.word.append(0.0)
                        self.stem.append(0.0)
                        self.long.append(False)
                    node = self.children[node][ch]
                    if len(term) >= least:
                        self.long[node] = True
                table[node] = weight
        self.long[0] = any(self.long)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.begin = self._state(self._close({(0, 0)}))

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """With the states reached by a lost letter of the term."""
        out = set(items)
        for node, errors in items:
            if not errors:
                out.update((child, 1) for child in self.children[node].values() if self.long[child])
        return frozenset(x for x in out if not (x[1] and (x[0], 0) in out))

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.step.append({})
        return self.states[items]

    def _next(self, state: int, ch: str) -> int:
        """The state after ``ch``, or -1 if no term is left."""
        items: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            if ch in self.children[node]:
                items.add((self.children[node][ch], errors))
            if not errors:
                if self.long[node]:
                    items.add((node, 1))
                items.update((child, 1) for c, child in self.children[node].items() if c != ch and self.long[child])
        out = self._state(self._close(items)) if items else -1
        if len(self.sets) < 200_000:
            self.step[state][ch] = out
        return out

    def match(self, word: str) -> tuple[float, int]:
        """(weight, errors) of the heaviest term that the word is, or begins with; (0, 0) if there is none."""
        state, best, errors = self.begin, 0.0, 0
        for ch in word:
            found = self.step[state].get(ch)
            state = self._next(state, ch) if found is None else found
            if state < 0:
                return best, errors
            for node, e in self.sets[state]:
                if not e and self.stem[node] > best:
                    best, errors = self.stem[node], 0
        for node, e in self.sets[state]:
            weight = self.word[node] * (1.0 if not e else 0.7)
            if weight > best:
                best, errors = weight, e
        return best, errors


def hits(text: str, lexicon: Lexicon, memo: dict[str, tuple[float, int]]) -> tuple[list[str], list[tuple[int, float, int, float]]]:
    """Words of the text, and of each hit its word, weight, errors and context factor.

    The factor falls with quotation marks on both sides and words of report
    in the window, and rises with words of address.
    """
    lowered = text.lower()
    words = _WORD.findall(lowered)
    known = list(map(memo.get, words))
    if None in known:
        for i, hit in enumerate(known):
            if hit is None:
                w = words[i]
                hit = known[i] = memo.get(w) or lexicon.match(w)
                if len(memo) < 300_000:
                    memo[w] = hit
    spots = [i for i, hit in enumerate(known) if hit[0] > 0]
    starts = [m.start() for m in _WORD.finditer(lowered)] if spots else []
    out = []
    for i in spots:
        near = words[max(0, i - WINDOW):i + WINDOW + 1]
        lo, at, hi = starts[max(0, i - WINDOW)], starts[i], starts[min(len(words) - 1, i + WINDOW)]
        quoted = not _QUOTES.isdisjoint(lowered[lo:at]) and not _QUOTES.isdisjoint(lowered[at:hi + 1])
        factor = (0.3 if quoted else 1.0) * (0.6 if not REPORT.isdisjoint(near) else 1.0)
        out.append((i, *known[i], min(1.0, factor * (1.3 if not ADDRESS.isdisjoint(near) else 1.0))))
    return words, out


def features(text: str, lexicon: Lexicon, memo: dict[str, tuple[float, int]]) -> list[float]:
    """Features of a whole text: sums, heaviest hit and share of hits, as found and by context."""
    return measures(*hits(text, lexicon, memo))


def measures(words: list[str], found: list[tuple[int, float, int, float]]) -> list[float]:
    """The features of a text with these words and hits."""
    plain = [w for _, w, e, _ in found if not e]
    weighed = [w * f for _, w, _, f in found]
    n = len(words)
    spots = [i for i, *_ in found]
    close = sum(1 for a, b in zip(spots, spots[1:]) if b - a <= WINDOW)
    return [1.0, math.log1p(sum(weighed)), max(weighed, default=0.0), math.log1p(sum(plain)), max(plain, default=0.0),
            math.log1p(len(found)), 100.0 * len(found) / (n + 20), math.log1p(close), 1.0 if found else 0.0]


def learn_lexicon(rows: list[tuple[str, int]], least_docs: int = 4) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of stems, by the log ratio of their shares of toxic and of other texts."""
    seen = {0: Counter(), 1: Counter()}
    stems = {0: Counter(), 1: Counter()}
    total = Counter(y for _, y in rows)
    for text, y in rows:
        words = {w for w in _WORD.findall(text.lower()) if not w.isdigit()}
        seen[y].update(words)
        stems[y].update({w[:k] for w in words for k in (4, 5, 6) if len(w) > k})

    def weighed(counts: dict[int, Counter], docs: int, ratio: float) -> dict[str, float]:
        out = {}
        for term, n in counts[1].items():
            lift = math.log(((n + 0.1) / (total[1] + 1)) / ((counts[0][term] + 0.1) / (total[0] + 1)))
            if n >= docs and lift >= ratio:
                out[term] = lift * math.log1p(n)
        best = sorted(out, key=lambda t: (-out[t], t))[:MOST_TERMS]
        top = max((out[t] for t in best), default=1.0)
        return {t: out[t] / top for t in best}

    return weighed(seen, least_docs, 2.5), weighed(stems, 2 * least_docs, 3.0)


def fit(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, rounds: int = 60, ridge: float = 0.01) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; row ``i`` counts ``counts[i]`` times (null: once)."""
    w = np.zeros(x.shape[1])
    counts = np.ones(len(y)) if counts is None else counts
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (y - p)) - penalty @ w
        move = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), slope)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
          sample_chars: int = SAMPLE_CHARS) -> tuple[dict, dict, np.ndarray]:
    """Lexicon and weights from a bounded sample of labelled texts (``doc_id``, ``toxic``).

    Half of the sample teaches the lexicon and the other half the weights,
    so the weights are learned on words as an unseen text has them. The
    sample takes the smallest hashes of ``doc_id``, at most as many of each
    class; in the fit a class counts by its share of all labelled rows, so
    the scores do not depend on how far the sample cut a class. A text of
    more than ``sample_chars`` characters may be taken with the chance
    ``sample_chars`` / its length, and then counts as often as it stands for.
    """
    rank = F.xxhash64("doc_id")
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = known.join(docs.groupBy("doc_id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("chars")), "doc_id")
    all_rows = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands = F.greatest(F.lit(1.0), F.col("chars") / sample_chars)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("long text")), F.lit(1 << 20)) / (1 << 20)
    known = held.select("doc_id", "toxic", stands.alias("stands")).filter(chance * F.col("stands") < 1)
    taken = known.filter("toxic = 1").orderBy(rank).limit(sample // 2).union(
        known.filter("toxic = 0").orderBy(rank).limit(sample // 2))
    rows = (docs.join(F.broadcast(taken), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", "stands")
            .dropDuplicates(["doc_id"]).orderBy(rank).limit(sample).collect())
    first = [(r["text"], r["toxic"]) for r in rows[0::2]]
    second = [(r["text"], r["toxic"]) for r in rows[1::2]]
    words, stems = learn_lexicon(first)
    lexicon, memo = Lexicon(words, stems), {}
    base = sum(y for _, y in second) / max(1, len(second))
    if not second or base in (0.0, 1.0):
        return words, stems, np.array([-4.0, *[0.0] * (N_FEATURES - 2), 5.0])
    y = np.array([y for _, y in second], dtype=float)
    share = all_rows[1] / (all_rows[0] + all_rows[1])
    stands = np.array([r["stands"] for r in rows[1::2]])
    counts = stands * len(y) * np.where(y == 1, share / stands[y == 1].sum(), (1 - share) / stands[y == 0].sum())
    weights = fit(np.array([features(t, lexicon, memo) for t, _ in second]), y, counts)
    words, stems = learn_lexicon(first + second)
    return words, stems, weights


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``n_hits`` and ``spans`` (words of the hits) of every whole document.

    ``labels`` are the rows to learn from. Null and empty texts have no hits
    and the model's base score; equal rows keep a row each; without both
    classes among the labels a fixed score of the hits is used; an empty
    table gives no rows. Only the text is an input of a score.
    """
    words, stems, weights = learn(docs.select("doc_id", "text"), labels, sample, sample_chars)
    shared = docs.sparkSession.sparkContext.broadcast((words, stems, weights))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
                           T.StructField("n_hits", T.LongType()), T.StructField("spans", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s, beta = shared.value
        lexicon, memo = Lexicon(w, s), {}
        for b in slices(batches):
            scores, counts, spans = [], [], []
            for text in b["text"].to_pylist():
                words, at = hits(text or "", lexicon, memo)
                x = measures(words, at)
                scores.append(float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, beta))))))))
                counts.append(len(at))
                spans.append([words[i] for i, *_ in at])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64()), pa.array(counts, pa.int64()),
                                              pa.array(spans, pa.list_(pa.string()))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
