"""Operators 6, 7 and 8 and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagefold.llm import kneser_ney, quality_rules, queries, toxicity
from pagefold.llm.common import read_table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    covered = {i + j for i in range(n - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_op7_awkward_rows(docs, rows, no_docs):
    got = quality_rules.judge(docs).collect()
    assert Counter(tuple(r[c] for c in COLS) for r in got) == Counter((r[0], *brute_measures(r[1] or "")) for r in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality_rules.judge(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_op7_given_documents(spark, given):
    got = {r["doc_id"]: tuple(r[c] for c in COLS[1:]) for r in queries.op7_quality_rules(spark, SMALL).collect()}
    assert got == {g["doc_id"]: brute_measures(g["text"] or "") for g in given}


def test_op7_runs_no_python(spark):
    plan = queries.op7_quality_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op7_keeps_good_labels_and_drops_bad_ones(spark):
    judged = queries.op7_quality_rules(spark, MEDIUM).join(read_table(spark, MEDIUM, "labels"), "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_rules_that_confirm_each_other_outweigh_a_lone_vote():
    praises = [True, False, False, False]
    chances, rates = quality_rules.estimate({0b0001: 900, 0b0000: 50, 0b0110: 40, 0b1001: 30, 0b1000: 3}, praises)
    assert chances[0b0001] > 0.9 and chances[0] > 0.5 and chances[0b0110] < 0.1
    assert all(b >= a for (a, b), p in zip(rates, praises) if not p)
    assert len(quality_rules.estimate({}, praises)[0]) == 16


def test_probabilities_sum_to_one(spark):
    model = kneser_ney.train(read_table(spark, SMALL, "documents").limit(20))
    sums = model.groupBy("k", F.floor(F.col("gram") / kneser_ney.ALPHABET)).agg(F.sum("p").alias("s")).agg(
        F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    assert abs(sums["lo"] - 1) < 1e-9 and abs(sums["hi"] - 1) < 1e-9


def brute_kneser_ney(texts):
    """Modified Kneser-Ney by dictionaries, straight from the formulas."""
    order, size = kneser_ney.ORDER, kneser_ney.ALPHABET
    top = Counter()
    for t in texts:
        s = kneser_ney.symbols(t).tolist()
        top.update(tuple(s[i:i + order]) for i in range(len(s) - order + 1))
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    rules = {}
    for k, table in tables.items():
        c = [max(1, sum(v == i for v in table.values())) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        rules[k] = [min(max(i + 1 - (i + 2) * y * c[i + 1] / c[i], 0.05), i + 0.95) for i in range(3)]
    inside = {k: {} for k in tables}
    for k, table in tables.items():
        for g, n in table.items():
            inside[k].setdefault(g[:-1], []).append(n)

    def p(g):
        if not g:
            return 1 / size
        seen = inside[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        take = lambda n: rules[len(g)][min(n, 3) - 1]
        n = tables[len(g)][g]
        return ((n - take(n) if n else 0) + sum(map(take, seen)) * p(g[1:])) / sum(seen)

    return p


def test_log_table_equals_the_formulas(spark, given):
    texts = [g["text"] for g in given[:6]]
    table = kneser_ney.log_table(kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string")))
    p = brute_kneser_ney(texts)
    rnd = np.random.default_rng(0)
    codes = [*rnd.integers(0, kneser_ney.ALPHABET, (300, 4)), *np.lib.stride_tricks.sliding_window_view(
        kneser_ney.symbols(given[7]["text"])[:400], 4)]
    for g in codes:
        at = int(np.dot(g, kneser_ney.ALPHABET ** np.arange(3, -1, -1)))
        assert table[at] == pytest.approx(np.log2(p(tuple(int(x) for x in g))), abs=1e-4)


def test_op8_awkward_rows(spark, docs, rows, no_docs):
    ids = spark.createDataFrame([(5,), (6,), (8,), (None,), (999,)], "doc_id long")
    got = kneser_ney.keep_fluent(docs, ids)
    assert got.columns == docs.columns
    kept = Counter(r["doc_id"] for r in got.collect())
    assert kept[5] == 1 and kept[6] == 2 and kept[9] == 1 and not kept[1] and not kept[3] and not kept[20]
    assert kneser_ney.keep_fluent(no_docs, ids).count() == 0
    untrained = kneser_ney.keep_fluent(docs, ids.limit(0))
    assert untrained.count() == sum(bool((r[1] or "").strip()) for r in rows)


def test_op8_parts_good_from_bad(spark):
    rows = queries.op8_quality_classifier(spark, MEDIUM).join(read_table(spark, MEDIUM, "labels"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.5


def edits(word):
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {
        a + c + b for a, b in cuts for c in letters}


def test_automaton_finds_exactly_one_edit():
    terms = {"idiot": 1.0, "moron": 0.9, "scum": 0.8}
    lexicon = toxicity.Lexicon(terms, {"lowei": 0.5})
    for term in ("idiot", "moron"):
        for w in edits(term):
            assert lexicon.match(w)[0] > 0, w
    assert lexicon.match("idiot") == (1.0, 0) and lexicon.match("idoit")[0] == 0.0 and lexicon.match("idi0t")[1] == 1
    assert lexicon.match("scum") == (0.8, 0) and lexicon.match("scam")[0] == 0.0
    assert lexicon.match("loweischaft") == (0.5, 0) and lexicon.match("") == (0.0, 0)
    near = set().union(*(edits(t) for t in ("idiot", "moron")))
    for w in ("riot", "moon", "melon", "idol", "iditarod", "radio"):
        assert (lexicon.match(w)[0] > 0) == (w in near)


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {})
    factor = lambda t: toxicity.hits(t, lexicon, {})[1][0][3]
    assert factor('he said "what an idiot" to them') < factor("what an idiot") <= factor("you are an idiot")


def test_op6_held_out_accuracy(spark):
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(read_table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    held = rows.filter("held_out").collect()
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02


def test_op6_awkward_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(5, 1), (6, 0), (8, 1), (None, 1), (9, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).filter("score >= 0.5").count() == 0


def test_op6_learns_nothing_from_held_out_rows(spark):
    ids = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    import zlib
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}, None: False}


def test_pipeline_stages_on_awkward_rows(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and stage(spark, no_docs, SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_pipeline_runs_through(spark, given):
    out = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {g["doc_id"] for g in given} and len(ids) > 0.5 * len(given)
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SMALL, "labels").collect()}
    assert sum(labels.get(i) == 0 for i in ids) < sum(q == 0 for q in labels.values()) / 4
