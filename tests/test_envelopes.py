"""Envelope schema compliance (the reference's API schema tests)."""

import json

from pagefold.plans.envelopes import intelligent_envelope_json, media_envelope_json, v4_envelope_json
from pagefold.plans.intelligent import intelligent
from pagefold.plans.media_pages import media_endpoint
from pagefold.plans.text_v4 import text_v4
from pagefold.sources.html import parse_pages
from pagefold.sources.standin import company_site, gallery_pages

SF = "/root/testdata/sf0.001"


def test_v4_envelope_schema(spark):
    el = parse_pages(company_site(spark, SF))
    rows = [json.loads(r["envelope"]) for r in v4_envelope_json(text_v4(el)).collect()]
    assert rows
    for data in rows:
        assert data["statusCode"] == 200 and data["message"] == "URL scraping completed successfully"
        sd = data["scrapingData"]
        for f in ["page_title", "url", "language", "summary", "sections", "key_values", "media", "notes"]:
            assert f in sd
        assert isinstance(sd["sections"], list) and isinstance(sd["key_values"], list)
        for s in sd["sections"]:
            assert set(s) == {"name", "content_summary", "raw_excerpt"}
        for kv in sd["key_values"]:
            assert set(kv) == {"key", "value"}
        assert isinstance(sd["media"]["images"], list) and isinstance(sd["media"]["videos"], list)
        assert len(sd["media"]["images"]) <= 20 and len(sd["media"]["videos"]) <= 10


def test_media_envelope_schema(spark):
    el = parse_pages(gallery_pages(spark, SF))
    rows = [json.loads(r["envelope"]) for r in media_envelope_json(media_endpoint(el, None, 3)).collect()]
    assert rows
    for d in rows:
        assert d["success"] is True and d["approach_used"] == "programmatic_only"
        assert "processing_time_seconds" in d and "next_cursor" in d["pagination"]
        assert len(d["media_assets"]) <= 3
        assert d["media_summary"]["current_page_count"] == len(d["media_assets"])
        if d["pagination"]["has_more"]:
            assert d["pagination"]["current_page_end"] == 3


def test_intelligent_envelope_schema(spark):
    el = parse_pages(company_site(spark, SF))
    rows = [json.loads(r["envelope"]) for r in intelligent_envelope_json(intelligent(el)).collect()]
    assert rows
    for d in rows:
        for f in ["success", "url", "best_about_url", "title", "description", "content", "company_info",
                  "about_pages_found", "about_page_analysis", "media_summary", "ai_enhancement",
                  "processing_time_seconds", "approach_used"]:
            assert f in d
        assert d["approach_used"] in ("ai_enhanced", "programmatic")
        assert d["company_info"]["confidence"] in ("high", "medium", "low")


def test_media_type_filter_after_slice(spark):
    el = parse_pages(gallery_pages(spark, SF))
    full = {r["page_id"]: r for r in media_endpoint(el, None, 5).collect()}
    only = {r["page_id"]: r for r in media_endpoint(el, None, 5, media_type="image").collect()}
    for pid, r in only.items():
        assert r["media_summary"]["current_page_count"] == full[pid]["media_summary"]["current_page_count"]
        assert [a["media_url"] for a in r["media_assets"]] == \
            [a["media_url"] for a in full[pid]["media_assets"] if a["type"] == "image"]
        assert r["pagination"] == full[pid]["pagination"]


def test_cursor_slice_equals_slice_of_the_full_list(spark):
    import base64
    el = parse_pages(gallery_pages(spark, SF))
    full = {r["page_id"]: r for r in media_endpoint(el, None, 50).collect()}
    cur = base64.b64encode(b"media:7").decode()
    part = {r["page_id"]: r for r in media_endpoint(el, cur, 4).collect()}
    assert part.keys() == full.keys()
    for pid, r in part.items():
        whole = full[pid]["media_assets"]
        assert [a["media_url"] for a in r["media_assets"]] == [a["media_url"] for a in whole[7:11]]
        total = full[pid]["media_summary"]["total_assets"]
        assert r["media_summary"]["total_assets"] == total
        assert r["media_summary"]["current_page_count"] == len(whole[7:11])
        assert r["pagination"]["has_more"] == (min(11, total) < total)
        assert r["pagination"]["current_page_end"] == min(11, total)
