"""P20 against the standard library's ``urljoin``: awkward references and seeded random ones."""

import itertools
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagefold.functions.urls import resolve_url

BASES = ["http://a/b/c/d;p?q", "https://example.com", "https://example.com/", "http://a/b/c/../d", "HTTP://A/x", "//host/p/q",
         "a/b/c", "x", "/", "", "file:///etc/hosts", "mailto:me@x.org", "http://[::1]/a/b", "http://[1::2::3]/a", "http://a/b//c//d",
         " http://a/b", "http://a;x/y;z/w", "svn+ssh://h/p/", "http://a?x=1", "http://ex\u2100.org/a",
         "https://u:p@h:80?q", "http://h#f", "http://h\n/a", "http:a", "http://h"]
REFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..",
        "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "g;x=1/../y", "http:g", "http://x", "https:g",
        "data:image/png;base64,AA//..", "javascript:void(0)", "mailto:a@b", "  g ", "\tg\n/h", "a\nb", "//[::1]/x", "//[zz]/x", "//[::1/x",
        "//x]/y", "//[v1.a]/x", "//[1:2:3:4:5:6:7::]/x", "//[1:2:3:4:5:6:7:8]", "//[::1.2.3.4]/x", "//[::1.2.3.04]", "//[fe80::1%25e]/x",
        "//[1.2.3.4]", "//[]", "http://\uff0fx/y", "//caf\u00e9/x", "/a;", "/a;b/c;", "///x", "////x", "//", "?", "#", ":x", "1:x", "é:x",
        "a//b", "/a//b/../c", "/a/.?x", "/..", "/.#f", "/a/...", "/a?x#", "/a?", "/a/?b/..", "http://h", "http://h/../x", "https://u:p@h:80/a;b?c",
        "HTTP://H/x", "http://h?", "http://h/a#", "http:///x", "http://h\n/x", "/a\n", "http://h\\n/x", "g?a/../b", "g#a/../b", "\x00g", "\u00a0g", None]
PIECES = ["a", "b", ".", "..", "/", "//", "?", "#", ";", ":", "http:", "https://", "x.y", "é", " ", "%20", "[", "]", "::1", "@", "\t", "=", "&", "\U0001f600"]


def expected(base: str, ref: str | None) -> str | None:
    if ref is None:
        return None
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def check(spark, cases):
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(cases)], "i int, base string, ref string")
    found = {x["i"]: x["u"] for x in rows.select("i", resolve_url("base", "ref").alias("u")).collect()}
    assert len(found) == len(cases)
    wrong = [(b, r, found[i], expected(b, r)) for i, (b, r) in enumerate(cases) if found[i] != expected(b, r)]
    assert not wrong, wrong[:10]


def test_awkward_references(spark):
    check(spark, list(itertools.product(BASES, REFS)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_references(spark, seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    check(spark, [(rnd.choice([rnd.choice(BASES), some(8), "http://h/" + some(6)]), some(8)) for _ in range(5000)])


def test_a_null_base_leaves_the_reference_and_long_ones_resolve(spark):
    assert spark.range(1).select(resolve_url(F.lit(None).cast("string"), F.lit("g"))).first()[0] == "g"
    long = "s/" * 20000 + "../" * 100 + "x" * 50000
    check(spark, [("http://a/b/c", long), ("http://a/b/c", "data:image/png;base64," + "A/../" * 20000), ("http://a/" + "d/" * 20000 + "f", "../g")])


def test_the_join_is_no_python_node(spark):
    plan = spark.createDataFrame([("http://a/", "b")], "u string, r string").select(resolve_url("u", "r"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
