"""Operator 13 against brute force and its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from pagefold.llm import divergence, queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, limit=30, ranks=50):
    """Rows of the contract for (lang, source, text) rows."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in
                                        re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= limit)
        count = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                count[d[1]].update(t for t in d[2] if held[t] >= limit)
        everywhere = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 5) // (c.total() + 5 * len(kept))

        for a in count:
            pairs = sorted((-sum(abs(p(count[a], t) - p(count[b], t)) for t in kept), b.encode(), b) for b in count if b != a)
            terms = sorted((p(everywhere, t) - p(count[a], t), t.encode(), t) for t in kept if count[a][t])
            out |= {(lang, a, "pair", b, -v, k) for k, (v, _, b) in enumerate(pairs, 1)}
            out |= {(lang, a, "term", t, -v, k) for k, (v, _, t) in enumerate([x for x in terms if x[0] < 0][:ranks], 1)}
    return out


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_op13_given_documents(spark, given):
    want = brute([(g["lang"], g["source"], g["text"]) for g in given])
    assert rows_of(queries.op13_source_divergence(spark, SMALL)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert set(con.execute(queries.ORACLES["op13_source_divergence"]).fetchall()) == want


def test_op13_awkward_rows(docs, rows, no_docs):
    cut = [(r[2], r[3], r[1]) for r in rows]
    for limit in (2, 100):
        assert rows_of(divergence.audit(docs, limit=limit, ranks=7, slice_counts=40)) == brute(cut, limit, 7)
    assert divergence.audit(no_docs).count() == 0


def test_terms_between_the_bounds_are_counted_exactly(spark):
    """One document holds several chunks of a term: neither the commonest chunk nor their sum is its number of documents."""
    rows = [("en", f"s{i % 3}", f"Word, word. (word) other{i} rare" if i < 4 else f"word! WORD-x Zeta;zeta {'rare' * (i % 2)}")
            for i in range(9)] + [("en", "s4", None), ("de", None, "word word"), (None, None, "")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "lang string, source string, text string, chunk string")
    for limit in (2, 4, 9):
        assert rows_of(divergence.audit(df, limit=limit)) == brute(rows, limit)


def test_pair_sums_over_many_sources(spark):
    """More sources than a block of the matrix."""
    rows = [("en", f"s{i % 71}", " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence.audit(df, limit=5)) == brute(rows, 5)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(10 ** 12 + 7, 10 ** 15 + 3, 10 ** 9), (0, 0, 3), (9 * 10 ** 18, 9 * 10 ** 18, 1)]
    df = spark.createDataFrame(big, "a long, b long, c long").select("a", "b", "c", divergence._share(F.col("a"), F.col("b"), F.col("c")).alias("p"))
    assert all(r["p"] == 1 + 10 ** 9 * (r["a"] + 5) // (r["b"] + 5 * r["c"]) for r in df.collect())
    frame = pd.DataFrame({"lang": "x", "source": ["a", "b", "a"], "term": [None, None, "t"], "p": [1, 2, 10 ** 9], "none": [1, 2, 1]})
    assert divergence.pair_sums(frame)["value"].tolist() == [10 ** 9 - 2] * 2


def test_cells_are_plain_numbers(spark):
    """A group and its occurrences, or a document of a rare chunk, is one word in a shuffle; groups are not spelled out."""
    rows = [("en", "a", "x x y"), ("en", "b", "x"), ("de", "a", "x"), ("de", None, None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    groups = divergence.numbered_groups(df)
    number = {(r["lang"], r["source"]): r["grp"] for r in groups.collect()}
    assert sorted(number.values()) == [0, 1, 2, 3] and ("de", "") in number
    parts = divergence.chunk_counts(df, groups, limit=2)
    assert dict(parts.dtypes)["cells"] == "array<bigint>"
    got = {(r["lang"], r["chunk"]): r["cells"] for r in parts.collect()}
    counted = {k: {(c >> 32, c & 0xFFFFFFFF) for c in v if c >= 0} for k, v in got.items()}
    assert counted == {("en", "x"): {(number["en", "a"], 2), (number["en", "b"], 1)}, ("en", "y"): {(number["en", "a"], 1)},
                       ("de", "x"): {(number["de", "a"], 1)}}
    assert {k: sum(c < 0 for c in v) for k, v in got.items()} == {("en", "x"): 0, ("en", "y"): 1, ("de", "x"): 1}
