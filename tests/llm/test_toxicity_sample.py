"""Operator 6: the bounded sample."""

import random

import pytest

from pagefold.llm import toxicity


def labelled(spark, n, seed=0):
    """``n`` clean texts to each 8 of which a toxic one comes; some clean ones have a term of the toxic."""
    rnd = random.Random(seed)
    stock = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        toxic = int(i % 9 == 0)
        words = [rnd.choice(stock) for _ in range(40)]
        if rnd.random() < (0.7 if toxic else 0.05):
            words[rnd.randrange(40)] = "blargh"
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_sample_of_even_classes_keeps_the_calibration(spark):
    rows = labelled(spark, 9000)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    score = {}
    for sample in (1600, 18000):
        words, stems, weights = toxicity.learn(docs, labels, sample)
        assert "blargh" in words
        lexicon = toxicity.Lexicon({"blargh": words["blargh"]}, {})
        for text in ("word1 word2 " * 20, "word1 blargh " + "word2 " * 38):
            score[sample, text] = float(toxicity.features(text, lexicon, {}) @ weights)
    texts = {t for _, t in score}
    for text in texts:
        assert score[1600, text] == pytest.approx(score[18000, text], abs=1.0)


def test_long_texts_teach_too(spark):
    rows = labelled(spark, 400)
    long = rows.selectExpr("doc_id", "concat(repeat(concat(text, ' '), 100), if(toxic = 1, 'zarkon', '')) as text", "toxic")
    assert long.selectExpr("min(length(text))").first()[0] > 20_000
    words, _, _ = toxicity.learn(long.select("doc_id", "text"), long.select("doc_id", "toxic"))
    assert "zarkon" in words
    words, _, _ = toxicity.learn(long.select("doc_id", "text"), long.select("doc_id", "toxic"), sample_chars=1)
    assert not words


def test_a_text_is_read_once_and_its_places_only_where_it_has_hits(monkeypatch):
    class Words:
        reads = places = 0

        def findall(self, text):
            Words.reads += 1
            return ["x"] * 3 if "x" in text else ["idiot", "you"]

        def finditer(self, text):
            Words.places += 1
            import re
            return re.finditer(r"\w+", text)

    monkeypatch.setattr(toxicity, "_WORD", Words())
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {})
    assert toxicity.hits("x x x", lexicon, {}) == (["x"] * 3, []) and (Words.reads, Words.places) == (1, 0)
    assert toxicity.hits("idiot you", lexicon, {}) == (["idiot", "you"], [(0, 1.0, 0, 1.0)]) and Words.places == 1
