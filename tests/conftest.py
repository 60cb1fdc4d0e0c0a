import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pagefold.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def parse(spark):
    """parse(html, url) -> element DataFrame for one literal page."""
    from pagefold.sources.html import parse_pages

    def _parse(html: str, url: str = "https://example.com/page", page_id: int = 1):
        df = spark.createDataFrame([(page_id, url, html)], "page_id bigint, url string, html string")
        return parse_pages(df)
    return _parse
