"""Operators 2 and 3 against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold.llm import jaccard_join, queries, topk, words
from pagefold.llm.components import components

SMALL = "/root/testdata/sf0.001"


def brute_top(rows, k):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in ok]
    out = Counter()
    for q, (qi, qv) in enumerate(whole):
        if qi is not None and qi % 50 == 0:
            hits = sorted((-min(max(sum(a * b for a, b in zip(qv, v)), -2**63), 2**63 - 1), i is None, i or 0, i)
                          for c, (i, v) in enumerate(whole) if c != q and len(v) == len(qv))
            out.update((qi, r + 1, i, -s) for r, (s, _, _, i) in enumerate(hits[:k]))
    return out


def top_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "score": F.lit("x")})
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, **options).collect()
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 3, "block_rows": 2, "fan_in": 2},
                                   {"shard_rows": 2, "block_rows": 1, "fan_in": 3, "lane_shards": 3}])
def test_op2_awkward_vectors(spark, sizes):
    rnd = random.Random(0)
    rows = [(i, [round(rnd.uniform(-1, 1), 1) for _ in range(4)]) for i in range(0, 120, 5)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (None, rows[0][1]), (150, None), (151, [0.1, None, 0.2, 0.3]), (200, []),
             (152, [0.1, float("nan"), 0.0, 1.0]), (153, [float("inf"), 0.0, 0.0, 1.0]), (250, [1.0, 2.0]), (3, [-1.0, 1e-9])]
    assert top_rows(spark, rows, **sizes) == brute_top(rows, 5)


def test_op2_scores_beyond_exact_floats(spark):
    rows = [(0, [1e6 + 0.5, 3.0]), (1, [1e8 + 0.25, 1.0]), (2, [1e8 + 0.25, 1.004]), (50, [1e30, -1.0]), (3, [-1e30, 5.0])]
    assert top_rows(spark, rows) == brute_top(rows, 5)


def test_op2_broadcasts_no_tiles(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5), F.col("id") / 400]).alias("embedding"))
    found = topk.top_k(df, F.col("vec_id") % 2 == 0, shard_rows=16, block_rows=8, lane_shards=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "CartesianProduct" not in plan
    assert found.count() == 200 * 5


def test_op2_empty_table_and_no_queries(spark):
    assert not top_rows(spark, [])
    assert not top_rows(spark, [(1, [1.0])])


def brute_components(contents, k, percent):
    sets = [jaccard_join.word_shingles(t or "", k) for _, t in contents]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(contents):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(contents, sets)))


def joined(df, **options):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, **options).collect())


def test_op3_awkward_rows(docs, rows, no_docs):
    assert joined(docs, k=4, percent=85) == brute_components([(r[0], r[1]) for r in rows], 4, 85)
    assert not joined(no_docs, k=4, percent=85)


def chains(n_groups, copies, seed=4):
    """Groups of near copies, chains of copies of copies, and a passage that all documents share."""
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randrange(400))
    passage = [word() for _ in range(25)]
    out, at = [], 0
    for g in range(n_groups):
        text = [word() for _ in range(rnd.choice([6, 40, 90]))]
        for c in range(copies):
            if c and rnd.random() < 0.8:
                text = list(text)
                text[rnd.randrange(len(text))] = word()
            out.append((at, " ".join(text + (passage if g % 2 else []))))
            at += 1
    return out


@pytest.mark.parametrize("rounds", [0, 2])
def test_op3_near_copies_and_shared_passages(spark, rounds):
    contents = chains(12, 9)
    df = spark.createDataFrame(contents, "doc_id long, text string").repartition(4)
    assert joined(df, k=4, percent=85, rounds=rounds) == brute_components(contents, 4, 85)


def test_op3_given_documents(spark, given):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in queries.op3_ngram_jaccard_join(spark, SMALL).collect())
    assert got == brute_components([(g["doc_id"], g["text"]) for g in given], 4, 85)


def test_matches_follow_the_cost():
    assert jaccard_join.best_matches(np.zeros(60), 16, 100) == 1
    dear = np.concatenate([np.full(16, 50.0), np.zeros(10)])
    assert jaccard_join.best_matches(dear, 16, 100) > 1
    assert jaccard_join.best_matches(np.array([5.0]), 1, 1) == 1


def test_hashes_tell_words_apart():
    texts = ["a b", "ab", "a  b", "A B", "", "b a", "a b a b"]
    sets = [tuple(s.tolist()) for s in jaccard_join.shingle_sets(texts, 2)]
    assert sets[0] == sets[2] == sets[3] and sets[4] == ()
    assert len({sets[0], sets[1], sets[5], sets[6]}) == 4


def test_one_of_each_keeps_the_smallest_of_a_group(docs, rows):
    kept = jaccard_join.one_of_each(docs, k=5, percent=80)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[8] == 1 and not ids[9] and not ids[10] and ids[6] == 1 and ids[1] == ids[2] == ids[3] == 1
    assert set(ids) == {r[0] for r in rows} - {9, 10, 11} | ({11} if ids[11] else set())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op3_shingles_of_many_texts_are_hashed_together(monkeypatch):
    texts = [f"a{i} b c d e f g{i % 3} h" * (i % 5) for i in range(64)] + ["", " \n", "one two", "é è  x\x85y z w v"]
    alone = [jaccard_join.shingle_sets([t], 5)[0].tolist() for t in texts]
    calls, hashed = [], words.gram_hashes
    for module in (words, jaccard_join):
        monkeypatch.setattr(module, "gram_hashes", lambda w, k: calls.append(k) or hashed(w, k))
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts, 5)] == alone
    assert calls.count(5) <= -(-len(texts) // jaccard_join.SET_TEXTS)
    assert [len(s) for s in alone] == [len(jaccard_join.word_shingles(t, 5)) for t in texts]
