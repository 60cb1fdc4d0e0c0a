"""Quality rules combined by weak supervision (operator 7); DataFrame functions only.

Each rule votes or abstains. Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes on good and on bad texts, and
the posterior probability of good quality replaces the rule that all must
pass. With r rules there are at most 2**r patterns, so
what the driver reads and what goes back as a literal does not grow with the
corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, store

#: Words, symbols and the base rule.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a run of ``WINDOW`` words which the text has twice or more."""
    places = F.sequence(F.lit(0), n - WINDOW)
    grams = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def twice(p: Column) -> Column:
            marked = F.transform(p, lambda x, k: F.when(
                (F.get(p, k - 1)["g"] == x["g"]) | (F.get(p, k + 1)["g"] == x["g"]), x["i"]))
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        spans = _let(pairs, twice)
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(spans, start, lambda s, i: F.struct(
            (i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n")))["n"]

    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(_let(grams, lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a one-character ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts that the rules read, for one whole text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, BLANKS), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        n = F.size(w)
        joined = F.array_join(w, "")
        return F.struct(
            n.cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w, n).alias("n_repeat_words"))

    def lined(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        _let(words, of).alias("w"), _let(lines, lined).alias("l"), _removed(t, SYMBOLS).alias("n_symbols"),
        _removed(t, r"\p{Lu}").alias("n_upper"), _removed(t, "!").alias("n_marks"), _removed(t, r"\p{L}").alias("n_letters"),
        _removed(t, r"\|").alias("n_bars"))


#: Names of the measures, and their places in the struct.
MEASURES = {
    **{c: f"m.w.{c}" for c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")},
    **{c: f"m.l.{c}" for c in ("n_lines", "n_dup_lines")},
    **{c: f"m.{c}" for c in ("n_symbols", "n_upper", "n_marks", "n_letters", "n_bars")},
}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of ``text`` as columns after its own (which must not have their names)."""
    return docs.withColumn("m", measures(F.col("text"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[F.col(path).alias(c) for c, path in MEASURES.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, tuple[bool, Column]]:
    """Of each rule, whether it speaks for good quality, and when it votes; else it abstains.

    A fault is looked at by more than one rule, so that rules can confirm
    each other; no rule praises a text for a fault that it lacks.
    """
    words = F.col("n_words")
    mean = _share("word_chars", "n_words")
    return {
        "prose": (True, (words >= 20) & (_share("n_letters", "word_chars") > 0.85) & mean.between(3, 12)
                  & (_share("n_symbols", "n_words") < 0.1)),
        "short": (False, words < LEAST_WORDS),
        "symbols": (False, _share("n_symbols", "n_words") > 0.3),
        "letters": (False, (words >= 50) & (_share("n_letters", "word_chars") < 0.72)),
        "bars": (False, _share("n_bars", "n_words") > 0.15),
        "capitals": (False, _share("n_upper", "n_letters") > 0.5),
        "marks": (False, _share("n_marks", "n_words") > 0.3),
        "repeats": (False, _share("n_repeat_words", "n_words") > 0.2),
        "distinct": (False, (words >= 20) & (_share("n_distinct", "n_words") < 0.15 + 2.5 / F.sqrt(F.greatest(words, F.lit(1))))),
        "lines": (False, _share("n_dup_lines", "n_lines") > 0.3),
        "words": (False, (words >= LEAST_WORDS) & ~mean.between(2, 14)),
    }


def pattern() -> Column:
    """Which rules vote, as one number: a binary digit a rule."""
    digits = [F.when(fires, 2 ** i).otherwise(0) for i, (_, fires) in enumerate(rules().values())]
    return sum(digits[1:], digits[0])


def estimate(counts: dict[int, int], praises: list[bool], rounds: int = 200, prior: float = 0.9, weight: float = 50.0,
             good_rule: tuple[float, float] = (0.9, 0.3), bad_rule: tuple[float, float] = (0.005, 0.5),
             ) -> tuple[list[float], list[tuple[float, float]]]:
    """Posterior probability of good quality of every pattern, and each rule's rates on (good, bad) texts.

    Expectation-maximisation of the naive model in which each rule votes at
    one rate on good texts and at another on bad ones. ``good_rule``,
    ``bad_rule`` and ``prior`` are where it starts and what ``weight``
    imagined texts say, so rules that never vote keep sane rates. A vote
    never speaks for the other side: its rates meet at most. ``praises``
    tells of each rule whether it speaks for good quality; that a text lacks
    praise says nothing.
    """
    begin = [good_rule if p else bad_rule for p in praises]
    rates, good = list(begin), prior
    total = sum(counts.values())
    imagined = (weight * prior, weight * (1 - prior))

    def posterior(p: int) -> float:
        logit = math.log(good / (1 - good))
        for i, (a, b) in enumerate(rates):
            a, b = min(max(a, 1e-9), 1 - 1e-9), min(max(b, 1e-9), 1 - 1e-9)
            if p >> i & 1:
                logit += math.log(a / b)
            elif not praises[i]:
                logit += math.log((1 - a) / (1 - b))
        return 1 / (1 + math.exp(-min(max(logit, -700), 700)))

    for _ in range(rounds):
        now = {p: posterior(p) for p in counts}
        sides = (sum(c * now[p] for p, c in counts.items()), sum(c * (1 - now[p]) for p, c in counts.items()))
        fresh = []
        for i, praise in enumerate(praises):
            seen = (sum(c * now[p] for p, c in counts.items() if p >> i & 1),
                    sum(c * (1 - now[p]) for p, c in counts.items() if p >> i & 1))
            a, b = ((begin[i][k] * imagined[k] + seen[k]) / (imagined[k] + sides[k]) for k in (0, 1))
            fresh.append((max(a, b), b) if praise else (a, max(a, b)))
        moved = max(abs(x - y) for old, new in zip(rates, fresh) for x, y in zip(old, new))
        rates, good = fresh, (weight * prior + sides[0]) / (weight + total)
        if moved < 1e-9:
            break
    return [posterior(p) for p in range(2 ** len(praises))], rates


def posterior_column(table: DataFrame) -> Column:
    """Posterior of the rows of ``table`` (with the measures), its patterns counted over all rows."""
    counted = table.groupBy(pattern().alias("p")).agg(F.count("*").alias("n")).collect()
    chances, _ = estimate({r["p"]: r["n"] for r in counted}, [praise for praise, _ in rules().values()])
    literal = F.from_json(F.lit(str([round(c, 12) for c in chances])), "array<double>")
    return F.get(literal, pattern())


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Measures, ``base_failed``, ``posterior`` and ``kept`` of every document.

    Null and empty texts have no words and fail the base rule; equal rows
    keep a row each; columns but ``doc_id`` and ``text`` are ignored; an
    empty table gives no rows. The texts are read once: the measures are
    stored, and patterns are counted on them.
    """
    table = store(measured(docs.select("doc_id", "text")).drop("text"), "quality-measures")
    return (table.withColumn("posterior", posterior_column(table)).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, without moving a text."""
    rows, restore = set_aside(docs, "m", *MEASURES)
    chance = posterior_column(measured(docs.select("text")))
    return restore(measured(rows).filter(~base_failed() & (chance >= least)))
