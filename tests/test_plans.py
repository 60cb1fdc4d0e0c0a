"""Plan-level checks behind the scale claims in the README."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pagefold.operators.page import link_list
from pagefold.operators.metrics import llm_cost_rollup
from pagefold.operators.paging import position_within, slice_of
from pagefold.plans import registry

SF = "/root/testdata/sf0.001"
# streaming queries run their streams eagerly; their plans are the stream operators
registry.load_all()
BATCH = sorted(n for n in registry.QUERIES if not n.startswith("z") or n.endswith("_batch"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_explosions(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["a1_hybrid_about_links", "a2_split_about_links", "m9_svc_media_context", "w5_w9_media_page_at_cursor",
                                  "qb_media_endpoint", "qc_v4_text", "t8_split_video_thumbnails"])
def test_urls_are_resolved_without_python(spark, name):
    assert "EvalPython" not in _plan(E.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["a3_a6_classic_about_page", "qa_intelligent", "qc_v4_text", "split_text_scrape", "qb_media_endpoint",
                                  "fast_scrape_hybrid", "m9_svc_media_context", "w5_w9_media_page_at_cursor",
                                  "p2_p4_page_header", "basic_scrape_envelope"])
def test_a_query_parses_its_pages_once_in_the_stored_element_table(spark, name):
    assert "MapInArrow" not in _plan(E.queries()[name](spark, SF))


def test_first_k_is_a_window_group_limit(spark, parse):
    el = parse("<a href='/1'>a</a>" * 30)
    assert "WindowGroupLimit" in _plan(link_list(el, 10))


def test_position_within_splits_a_hot_key(spark):
    n = 60000
    # key -1 holds a third of all rows, key null another tenth
    df = spark.range(n).select((F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 10 == 1, F.lit(None))
                                .otherwise(F.col("id") % 97)).alias("k"), F.col("id").alias("v"), (F.col("id") % 2).alias("p"))
    df = df.unionByName(spark.createDataFrame([(-1, None, None), (-1, None, 0)], "k long, v long, p long"))
    # a descending rank first, as the media lists have it, then the place in the page
    ranked = position_within(df, "k", [F.col("p").desc_nulls_first(), "v"], [-F.col("p"), slice_of("v")])
    want = df.toPandas().sort_values(["p", "v"], ascending=[False, True], na_position="first")
    want["pos"] = want.groupby("k", dropna=False).cumcount() + 1
    key = lambda r: tuple(-2.0 if x != x or x is None else float(x) for x in r)
    assert sorted(map(key, ranked.select("k", "v", "p", "pos").toPandas().itertuples(index=False, name=None))) == \
        sorted(map(key, want[["k", "v", "p", "pos"]].itertuples(index=False, name=None)))
    # one task sorts a slice of the hot key, not the key
    most = df.filter("k = -1").groupBy("p", slice_of("v")).count().agg(F.max("count")).first()[0]
    assert most <= 8192 < df.filter("k = -1").count()


def test_position_within_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks", "ranks")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
        ranked = position_within(df, "k", ["v"], [slice_of("v")])
        assert not tracker.getJobIdsForGroup("ranks")
        assert ranked.count() == 100
        assert tracker.getJobIdsForGroup("ranks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cost_rollup_is_one_aggregate(spark):
    calls = spark.createDataFrame(
        [("2024-01-01 00:10:00", 1.0, 10, 1), ("2024-01-01 00:50:00", 2.0, 20, 2), ("2024-01-01 05:00:00", 4.0, 40, 4),
         (None, 8.0, 80, 8)], "t string, cost_estimate_usd double, prompt_tokens long, completion_tokens long")
    r = llm_cost_rollup(calls.select(F.col("t").cast("timestamp").alias("ts"), "*"))
    assert _plan(r).count("Exchange hashpartitioning") == 1
    got = sorted((x["period"], str(x["window_start"]), float(x["cost_usd"]), x["prompt_tokens"], x["calls"]) for x in r.collect())
    assert got == [("day", "2024-01-01 00:00:00", 7.0, 70, 3), ("day", "None", 8.0, 80, 1),
                   ("hour", "2024-01-01 00:00:00", 3.0, 30, 2), ("hour", "2024-01-01 05:00:00", 4.0, 40, 1),
                   ("hour", "None", 8.0, 80, 1)]


def test_bucketed_page_texts_make_the_about_join_shuffle_only_links(spark):
    import tempfile
    from pagefold.plans.intelligent import intelligent
    from pagefold.sources.html import parse_pages
    from pagefold.sources.standin import company_site
    from pagefold.sources.tables import bucket_page_texts
    el = parse_pages(company_site(spark, SF))
    texts = bucket_page_texts(el, "pf_site_texts", tempfile.mkdtemp(prefix="pf-bucket-") + "/t", buckets=16)
    fast = intelligent(el, corpus=el, corpus_texts=texts)
    slow = intelligent(el, corpus=el)
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
    # inspect the static plan with broadcasting off, i.e. as at scale where
    # neither side fits the broadcast threshold
    bt = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # a fresh plan: the executed one above was planned with the old settings
        fresh = intelligent(el, corpus=el, corpus_texts=spark.table("pf_site_texts"))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bt)
    lines = plan.splitlines()
    idx = next(i for i, l in enumerate(lines) if "FileScan" in l and "pf_site_texts" in l)
    assert "Bucketed: true" in lines[idx]
    # the text table's scan feeds the join without an exchange above it
    above = lines[max(0, idx - 3):idx]
    assert not any("Exchange" in l for l in above), "\n".join(lines[max(0, idx - 6):idx + 1])


def test_intelligent_shuffles_page_texts_once_and_no_page_window_over_all_links(spark):
    from pagefold.plans.intelligent import intelligent
    from pagefold.sources.html import parse_pages
    from pagefold.sources.standin import company_site
    df = intelligent(parse_pages(company_site(spark, SF)))
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # the page-field aggregate (page texts) is planned once and its shuffle reused
    assert plan.count("partial_first(url") == 1
    # the top About links are a first-k, not a full per-page rank with a count
    assert "WindowGroupLimit" in plan
    assert "count(1) windowspecdefinition" not in plan
    # URLs are resolved by built-in expressions
    assert "EvalPython" not in plan


def test_media_endpoint_slices_with_first_k_and_counts_partially(spark):
    from pagefold.plans.media_pages import media_endpoint
    from pagefold.sources.html import parse_pages
    from pagefold.sources.standin import gallery_pages
    import base64
    cur = base64.b64encode(b"media:5").decode()
    df = media_endpoint(parse_pages(gallery_pages(spark, SF)), cur, 10)
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # the slice keeps at most start + limit rows per page per map task
    assert "WindowGroupLimit" in plan and "row_number(), 15, Partial" in plan
    # page totals are aggregates, not window aggregates over a whole page
    assert "windowspecdefinition" not in plan.replace("row_number() windowspecdefinition", "")


def test_split_text_resolves_candidate_links_once(spark):
    from pagefold.plans.endpoints import split_text
    from pagefold.sources.html import parse_pages
    from pagefold.sources.standin import company_site
    df = split_text(parse_pages(company_site(spark, SF)))
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # top-k and the found count read one reused link aggregate, resolved by built-in expressions
    assert "EvalPython" not in plan and "ReusedExchange" in plan
    assert "WindowGroupLimit" in plan and "count(1) windowspecdefinition" not in plan


def _exchanges(plan):
    """(partitioning and output of each shuffle that ran, records that it wrote) of a final adaptive plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _exchanges(plan.executedPlan())
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
        return _exchanges(plan.plan())
    out = []
    if name == "ShuffleExchangeExec":
        records = plan.metrics().get("shuffleRecordsWritten").get().value()
        out.append((plan.outputPartitioning().toString(), plan.output().toString(), records))
    children = plan.children()
    for i in range(children.size()):
        out += _exchanges(children.apply(i))
    return out


@pytest.mark.parametrize("own_corpus", [True, False])
def test_only_linked_pages_move_their_text_by_url(spark, own_corpus):
    from pagefold.plans.intelligent import intelligent
    from pagefold.session import materialize_elements
    from pagefold.sources.html import parse_pages
    text = "<p>" + "we build bridges of stone. " * 30 + "</p>"
    pages = [(i, f"https://s{i}.org/", f"<nav><a href='/about'>About us</a></nav>{text}") for i in range(3)]
    pages += [(10 + i, f"https://s{i}.org/about", text + f"founded in 19{i}0") for i in range(2)]
    pages += [(20, "https://s0.org/about", "recrawled")] + [(100 + i, f"https://other.org/{i}", text) for i in range(200)]
    el = materialize_elements(parse_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as at scale
    try:
        df = intelligent(el, corpus=None if own_corpus else el)
        rows = {r["page_id"]: r for r in df.collect()}
        by_url = [(out, n) for part, out, n in _exchanges(df._jdf.queryExecution().executedPlan())
                  if "hashpartitioning(about_url" in part]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert by_url and all(n <= 3 for _, n in by_url), by_url
    assert rows[0]["best_about_url"] == "https://s0.org/about" and rows[2]["best_about_url"] == "https://s2.org/"
    assert len(rows) == len(pages)
