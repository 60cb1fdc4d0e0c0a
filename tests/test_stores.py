"""Stored model answers, tables of buckets, the service's media request, constraints."""

import glob
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from pagefold.operators import cache
from pagefold.operators.model_calls import enrich_stored, stored_answers
from pagefold.operators.quality import page_meta_violations, scrape_request_violations
from pagefold.plans.service_media import service_media
from pagefold.sources.buckets import BucketTable, insert_absent
from pagefold.sources.sinks import delete_keys


def _model(log, down=()):
    def ask(prompt):
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if prompt in down:
            raise RuntimeError(f"down on {prompt}")
        return {"completion": "prose" if prompt.startswith("prose") else json.dumps({"said": prompt})}
    return ask


def _asked(log):
    return sorted(open(f).read() for f in glob.glob(os.path.join(log, "*")))


def test_answers_are_asked_once_and_a_rerun_asks_what_is_absent(spark, tmp_path):
    logs = [str(tmp_path / x) for x in ("a", "b", "c", "d", "e")]
    for log in logs:
        os.mkdir(log)
    path = str(tmp_path / "answers")
    rows = [(1, "x"), (2, "x"), (3, "prose y"), (4, "z"), (5, None), (6, "w" * 50), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    got = enrich_stored(df, _model(logs[0], down=("z",)), path, _model(logs[1], down=("z", "prose y")), max_input_tokens=10)
    seen = sorted((r["id"], r["model"], r["result"] is not None, r["error"]) for r in got.collect())
    assert len(seen) == 8
    assert {s[0]: s[1:] for s in seen} == {
        1: ("default", True, None), 2: ("default", True, None), 3: ("fallback", False, "down on prose y"),
        4: ("fallback", False, "down on z"), 5: (None, False, "No prompt"), 6: (None, False, "Prompt exceeds 10 tokens"),
        7: ("default", True, None)}
    assert _asked(logs[0]) == ["", "prose y", "x", "z"]           # each distinct prompt once
    assert _asked(logs[1]) == ["prose y", "z"]                    # only what failed
    # the model is up again: only failed prompts are asked, the fallback for what still fails
    again = enrich_stored(df.unionByName(spark.createDataFrame([(8, "new")], df.schema)), _model(logs[2]), path,
                          _model(logs[3]), max_input_tokens=10)
    assert {r["id"]: (r["model"], r["error"]) for r in again.collect()} == {
        1: ("default", None), 2: ("default", None), 3: ("fallback", "Invalid JSON response"), 4: ("default", None),
        5: (None, "No prompt"), 6: (None, "Prompt exceeds 10 tokens"), 7: ("default", None), 8: ("default", None)}
    assert _asked(logs[2]) == ["new", "prose y", "z"] and _asked(logs[3]) == ["prose y"]
    # a completion over the output limit is a failure, and an empty table asks nothing
    long = enrich_stored(df.filter("id = 1"), _model(logs[4]), str(tmp_path / "long"), max_output_tokens=1).first()
    assert long["error"] == "Completion exceeds 1 tokens" and long["result"] is None
    assert enrich_stored(df.limit(0), _model(logs[4]), str(tmp_path / "none")).count() == 0
    assert stored_answers(spark, str(tmp_path / "absent")).count() == 0


def _files(path):
    return {b: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{b}/*.parquet")} for b in os.listdir(path) if b.startswith("bucket=")}


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "key string, v long"))
    store = BucketTable(spark, path, ("key",), 16).create(rows)
    assert sorted(store.read().collect(), key=str) == sorted(rows.collect(), key=str)
    before = _files(path)
    assert len(before) == 16
    new = spark.createDataFrame([("k3", 999), ("new", 7), ("new", 7)], rows.schema)
    touched = store.change(new, insert_absent(("key",)))
    after = _files(path)
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {f"bucket={n}" for n in touched}
    got = {r["key"]: r["v"] for r in store.read().collect()}
    assert got["k3"] == 3 and got["new"] == 7 and got[None] == -1 and len(got) == 202 and store.read().count() == 202
    # a bucket that loses every row is emptied, not left as it was
    one = touched[0]
    gone = store.read([one])
    keys = [r["key"] for r in gone.filter("key is not null").collect()]
    assert store.change(spark.createDataFrame([(k,) for k in keys], "key string"), delete_keys) == [one]
    assert store.read([one]).filter("key is not null").count() == 0
    assert store.read().count() == 202 - len(keys)
    # no changes touch nothing
    at = _files(path)
    assert store.change(new.limit(0), insert_absent(("key",))) == [] and _files(path) == at


def test_an_empty_table_of_buckets_and_the_cache_rules(spark, tmp_path):
    schema = "url string, type string, data string, expires_at long, created_at long"
    store = BucketTable(spark, str(tmp_path / "cache"), ("url", "type"), 4).create(spark.createDataFrame([], schema))
    assert store.read().count() == 0
    store.change(spark.createDataFrame([("u", "a", "old", 1, 5), ("u", "b", "x", 1, 5)], schema), cache.upsert)
    store.change(spark.createDataFrame([("u", "a", "late", 2, 4), ("u", "b", "tie", 2, 5)], schema), cache.upsert)
    assert {(r["type"], r["data"]) for r in store.read().collect()} == {("a", "old"), ("b", "tie")}
    store.change(spark.createDataFrame([("u", "a")], "url string, type string"), cache.delete)
    assert [r["type"] for r in store.read().collect()] == ["b"]


def test_service_media_page(spark, parse):
    html = ("<img src='/a.png' alt='Team'><img src='/a.png' alt='Logo'><img src='/b.png' alt='Logo'>"
            "<img src='/lost.png' alt='Logo'><video src='/c'></video>")
    elements = parse(html).unionByName(parse("<p>none</p>", "https://example.com/none", 2))
    base = "https://example.com"
    fetched = spark.createDataFrame(
        [(f"{base}/a.png", b"aa", 10, 10), (f"{base}/b.png", b"bbb", 2000, 10), (f"{base}/c", b"c", None, None), (f"{base}/lost.png", None, 1, 1)],
        "media_url string, content binary, width int, height int")
    items, meta = service_media(elements, fetched, "cdn", None, 2)
    got = [(r["pos"], r["type"], r["context"], r["size_bytes"], r["priority"]) for r in items.orderBy("pos").collect()]
    assert got == [(1, "image", "Logo", 3, 110), (2, "image", "Team", 2, 100)]
    metas = {r["page_id"]: (r["total_count"], r["has_more"], r["next_cursor"]) for r in meta.collect()}
    assert metas == {1: (3, True, "eyJvZmZzZXQiOiAyfQ=="), 2: (0, False, None)}
    rest, _ = service_media(elements, fetched, "cdn", "eyJvZmZzZXQiOiAyfQ==", 2)
    last = rest.collect()
    assert [(r["pos"], r["type"]) for r in last] == [(3, "video")] and last[0]["filename"].startswith("videos/") and last[0]["url"].endswith(".mp4")
    with pytest.raises(ValueError):
        service_media(elements, fetched, "cdn", "not a cursor", 2)
    with pytest.raises(ValueError):
        service_media(elements, fetched, "cdn", None, 51)


def test_request_and_meta_constraints(spark):
    rows = spark.createDataFrame(
        [(1, "u", "gpt-4", None, 3, 1, True, "c"), (2, None, "gpt-4x", 0, -1, -1, True, None), (3, "u" * 2049, None, 51, None, 2, None, None)],
        "id int, url string, model string, limit int, total_count int, remaining_count int, has_more boolean, next_cursor string")
    got = {r["id"]: (len(r["a"]), len(r["b"])) for r in rows.select(
        "id", scrape_request_violations().alias("a"), page_meta_violations().alias("b")).collect()}
    assert got == {1: (0, 0), 2: (3, 3), 3: (3, 2)}
