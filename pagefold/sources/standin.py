"""Stand-in crawl pages built from the driver tables.

The driver's ``pages`` have no company facts, media, About links or
sections, so the operators for those are exercised on HTML assembled here
from table columns (``supplier``, ``nation``, ``part``). These builders
only produce ``(page_id, url, html)`` rows in the crawl schema; every
extraction step runs through the parser and the operators, which do not
know how the HTML was made. Page counts grow with the tables.

* ``company_site`` — per supplier ``k``: a home page ``https://s{k}.example.com/``
  (page_id ``k``) with head fields, nav/header/footer links, fact
  sentences, sections, a few media elements; an About page
  (page_id ``10^9 + k``) for ``k % 3 != 0``, long for ``k % 3 == 1`` and
  short for ``k % 3 == 2``.
* ``gallery_pages`` — per part ``p``: one media element on gallery page
  ``p div 40`` (page_id ``2*10^9 + p div 40``), element kind ``p % 10``; a
  page holds at most 40 items and the number of pages grows with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

ABOUT_PAGE_OFFSET = 1_000_000_000
GALLERY_PAGE_OFFSET = 2_000_000_000
GALLERY_ITEMS_PER_PAGE = 40
# A supplier is a few stored bytes, its two pages some hundred elements.
SUPPLIERS_A_TASK = 1000

_HOME = """
concat(
  '<!DOCTYPE html><html', CASE WHEN k % 3 = 0 THEN '' ELSE concat(' lang="', lang, '"') END, '>',
  '<head><meta charset="utf-8">',
  CASE WHEN k % 7 = 0 THEN '<meta name="description">'
       WHEN k % 5 <> 0 THEN concat('<meta name="description" content="', name, ' supplies parts &amp; tools">')
       ELSE '' END,
  '<title>', name, '</title>',
  CASE WHEN k % 3 = 0 THEN '<meta http-equiv="content-language" content="de">' ELSE '' END,
  '<link rel="shortcut icon" href="/favicon.ico"><link rel="stylesheet" href="/site.css">',
  '<style>p{margin:0}</style><script>var nav = "<a href=\\'/about\\'>x</a>";</script>',
  '</head><body>',
  '<header><nav><ul>',
  '<li><a href="/about">About Us</a></li>',
  CASE WHEN k % 2 = 0 THEN '<li><a href="/Company">Our Company</a></li>' ELSE '' END,
  '<li><a href="/products">Products</a></li>',
  '<li><a href="/our-team">Team</a></li>',
  '<li><a href="', base, 'about">About</a></li>',
  '<li><a href="/contact">Contact</a></li>',
  '</ul></nav></header>',
  '<main><h1>', name, '</h1>',
  '<div class="about-section"><p>', facts, '</p></div>',
  CASE WHEN k % 8 < 4 THEN concat('<div class="details"><p>', filler, '</p></div>') ELSE '' END,
  '<section class="our_mission"><h2>Our Mission</h2><p>Our mission: to deliver quality parts.</p></section>',
  '<img src="/img/logo.png" alt="', name, ' logo" class="site-logo">',
  '<img data-src="team.jpg" alt="Our Team">',
  '<img src="/icons/cart-icon.png">',
  CASE WHEN k % 2 = 1 THEN concat('<video src="/media/intro', k, '.mp4" poster="/media/poster', k, '.jpg" title="Intro"></video>') ELSE '' END,
  CASE WHEN k % 3 = 1 THEN concat('<iframe src="https://www.youtube.com/embed/yt', lpad(CAST(k AS STRING), 9, '0'), '" title="Tour"></iframe>') ELSE '' END,
  CASE WHEN k % 4 = 2 THEN concat('<iframe src="https://player.vimeo.com/video/', k, '"></iframe>') ELSE '' END,
  '<iframe src="/widgets/map"></iframe>',
  '<p><a href="/docs/report', k, '.pdf">Annual report</a> <a href="/team">Meet the team</a></p>',
  CASE WHEN k % 2 = 1 THEN '<p><a href="/who-we-are">Who we are</a><a href="/values"></a></p>' ELSE '' END,
  '</main>',
  '<footer><a href="/our-story">Our Story</a><a href="/about">About</a></footer>',
  '</body></html>')
"""

_FACTS = """
CASE k % 4
  WHEN 0 THEN 'We make parts for many customers.'
  WHEN 1 THEN concat('Founded in ', year, '.')
  WHEN 2 THEN concat('Founded in ', year, '. We have ', emp, ' employees.')
  ELSE concat('Founded in ', year, '. We have ', emp, ' employees. Based in ', n_name, '.')
END
"""

_ABOUT = """
concat(
  '<!DOCTYPE html><html lang="en"><head><title>About ', name, '</title></head><body>',
  '<main><h1>About ', name, '</h1><p>',
  CASE WHEN k % 3 = 1
       THEN concat('Established in ', about_year, '. Our team of ', k * 3, ' people. ', filler, ' ', filler)
       ELSE 'A short page.' END,
  '</p></main></body></html>')
"""


def company_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), SUPPLIERS_A_TASK)
    n = table(spark, sf_dir, "nation")
    base = (s.join(n, s.s_nationkey == n.n_nationkey)     # AQE broadcasts the small side by measured size
            .selectExpr("s_suppkey AS k", "s_name AS name", "n_name",
                        "element_at(array('en', 'fr', 'de', 'es'), CAST(s_suppkey % 4 AS INT) + 1) AS lang",
                        "concat('https://s', s_suppkey, '.example.com/') AS base",
                        "CAST(1900 + s_suppkey % 120 AS STRING) AS year",
                        "CAST(1950 + s_suppkey % 70 AS STRING) AS about_year",
                        "format_number(s_suppkey * 7, 0) AS emp",
                        "repeat('Quality parts and service for every order. ', 14) AS filler"))
    base = base.withColumn("facts", F.expr(_FACTS))
    home = base.selectExpr("k AS page_id", "base AS url", f"{_HOME} AS html")
    about = base.filter("k % 3 <> 0").selectExpr(
        f"k + {ABOUT_PAGE_OFFSET} AS page_id", "concat(base, 'about') AS url", f"{_ABOUT} AS html")
    return home.unionByName(about)


_ITEM = """
CASE kind
  WHEN 0 THEN concat('<img data-src="/img/p', pk, '.jpg" alt="', p_name, '">')
  WHEN 1 THEN concat('<img src="/img/p', pk, '.png" alt="', p_brand, ' logo" class="logo">')
  WHEN 2 THEN concat('<figure><img src="icons/button-', pk, '.svg" class="header-img"><figcaption>', p_name, '</figcaption></figure>')
  WHEN 3 THEN concat('<iframe src="https://www.youtube.com/embed/v', lpad(CAST(pk AS STRING), 10, '0'), '" title="', p_type, '"></iframe>')
  WHEN 4 THEN concat('<video src="/media/p', pk, '.mp4"', CASE WHEN pk % 20 = 4 THEN '' ELSE concat(' poster="/media/p', pk, '.jpg"') END, '></video>')
  WHEN 5 THEN concat('<a href="/docs/spec-', pk, '.pdf">', p_type, '</a>')
  WHEN 6 THEN concat('<link rel="icon" sizes="16x16" href="/fav/', pk, '.ico">')
  WHEN 7 THEN concat('<img src="/img/cart-', pk, '.gif" alt="Team ', p_size, '" width="', p_size, '">')
  WHEN 8 THEN concat('<iframe src="/maps/', pk, '"></iframe>')
  ELSE concat('<audio src="/audio/p', pk, '.mp3" title="', p_type, '"></audio>',
              '<div class="bg" style="background-image: url(/bg/p', pk, '.png)"></div>')
END
"""


def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    items = p.selectExpr(
        "p_partkey AS pk", f"p_partkey div {GALLERY_ITEMS_PER_PAGE} AS m",
        "CAST(pmod(p_partkey, 10) AS INT) AS kind", "p_name", "p_brand", "p_type", "p_size")
    items = items.select("m", "pk", F.expr(_ITEM).alias("item"))
    # Assemble one HTML document per gallery page (<= 40 items), items in
    # part-key order.
    pages = items.groupBy("m").agg(
        F.array_sort(F.collect_list(F.struct("pk", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    return pages.select(
        (F.col("m") + GALLERY_PAGE_OFFSET).cast("bigint").alias("page_id"),
        F.concat(F.lit("https://media"), F.col("m"), F.lit(".example.com/gallery/index.html")).alias("url"),
        F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><title>Gallery '), F.col("m"),
                 F.lit("</title></head><body><main>\n"), body,
                 F.lit("\n</main></body></html>")).alias("html"))
