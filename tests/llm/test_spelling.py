"""Operator 11 against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagefold.llm import queries, spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(n):
    gaps = {}
    for w in n:         # words one edit apart share a form with one letter left out, or one is such a form of the other
        for g in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            gaps.setdefault(g, []).append(w)
    near = {w: set() for w in n}
    for words in gaps.values():
        for a in words:
            near[a].update(b for b in words if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


COLS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    got = [tuple(r[c] for c in COLS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_op11_given_documents(spark, given):
    want = brute(brute_counts([(g["doc_id"], g["text"]) for g in given]))
    assert rows_of(queries.op11_spelling_variants(spark, SMALL)) == want
    assert any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)


def test_op11_awkward_rows(docs, rows, no_docs):
    assert rows_of(spelling.variants(docs)) == brute(brute_counts([r[:2] for r in rows]))
    assert spelling.variants(no_docs).count() == 0


@pytest.mark.parametrize("block", [2, 7, 256])
def test_hot_entries_are_cut_into_blocks(spark, block):
    rng = np.random.default_rng(block)
    words = {"harbor" + "".join(rng.choice(list("abé"), size)) for size in rng.integers(0, 6, 300)}
    words |= {"".join(rng.choice(list("ab"), 6)) for _ in range(60)} | {"x" * 3000, "x" * 3001, "x" * 2999 + "y"}
    n = {w: int(k) for w, k in zip(sorted(words), rng.integers(3, 60, len(words)))}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = {(r["word"], r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(df, block=block).collect()}
    want = set()
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want.add((w, len(near), best, n[best]))
    assert got == want


def test_roots_of_long_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("w40", None), ("alone", None), ("side", "w7")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "side": "w40"}
