"""Fetched pages with tags put before them that the delivered pages lack, so that every branch of the page checks is met.

Which tags a page gets is decided by its fetch id; the expression is the same text in both dialects.  Rows, columns
and the delivered html stay as they are: what is added stands before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

_LD = '<script type="application/ld+json">{}</script>'
#: (modulus, remainder -> tags); {url} stands for the page's address.
TAGS: tuple[tuple[int, dict[int, str]], ...] = (
    (7, {0: '<link rel="canonical" href="{url}">', 1: "<LINK HREF={url}/ REL=canonical>", 2: '<link rel="canonical" href="{url}?utm_source=x">', 3: '<link rel="canonical" href="{url}?id=7&amp;ref=a">', 4: '<link rel="canonical" href="https://elsewhere.example/a">', 5: '<link rel="canonical" href="not an address/">'}),
    (5, {0: '<meta name="robots" content="NOINDEX, follow">', 1: "<meta content=nofollow name=robots>", 2: '<meta name="robots" content="index">'}),
    (4, {0: '<meta property="og:title" content="First"><meta property="og:title" content="Last"><meta property="og:type" content="Article">', 1: '<meta property="og:image" content="https://i.example/1.jpg"><meta property="og:url" content="{url}"><meta property="og:description" content="About it">', 2: '<meta property="article:published_time" content="2024-05-01T10:00:00Z"><meta property="article:modified_time" content="2024-06-29T08:00:00Z">'}),
    (3, {0: '<meta name="twitter:card" content="summary"><meta name=twitter:title content=T>', 1: '<meta name="twitter:image" content="https://i.example/2.jpg">'}),
    (6, {0: '<link rel=next href="/page/2">', 1: '<link rel="prev" href="/page/1">', 2: '<link rel="amphtml" href="{url}/amp">'}),
    (8, {0: '<link rel="alternate" hreflang="EN" href="https://e.example/en"><link href="https://e.example/fr" hreflang=fr rel=alternate><link rel="alternate" hreflang="EN" href="https://e.example/en">', 1: '<meta http-equiv="content-type" content="text/html; charset=ISO-8859-1">'}),
    (11, {
        0: _LD.format('{"@type": "NewsArticle", "headline": "H", "datePublished": "2024-06-30", "dateModified": "2024-06-30T10:00:00Z", "author": {"@type": "Person", "name": "A"}, "image": ["i"], "publisher": {"name": "P", "logo": "l"}, "mainEntityOfPage": "m", "description": "d"}'),
        1: _LD.format('{"@graph": [{"@type": "WebSite", "potentialAction": {"x": 1}}, {"@type": "Organization", "name": "O", "logo": ""}, {"@type": ["WebPage", "CollectionPage"]}]}'),
        2: _LD.format('[{"@type": "Person", "name": "N", "url": "u", "sameAs": []}, {"@type": "BreadcrumbList"}]'),
        3: _LD.format('{"@type": "VideoObject", "name": "V", "description": null, "thumbnailUrl": "t", "uploadDate": 0}'),
        4: _LD.format('{"@type": "NewsArticle", broken'),
        5: _LD.format('{"@type": "BlogPosting", "headline": "", "datePublished": "June 3rd", "author": "Someone", "isAccessibleForFree": false}'),
        6: '<div itemscope itemtype="https://schema.org/Product"></div><span typeof="schema:Person ProfilePage"></span>',
        7: _LD.format('{"@type": "Article", "headline": "H", "datePublished": "2024-06-01T10:00:00Z", "author": [{"@type": "Person", "name": "B"}], "image": "i"}'),
        8: _LD.format('{"@type": "TechArticle", "headline": "H", "dateModified": "2023-01-05", "datePublished": "2023-02-01", "author": [{"name": "C"}, "D"]}'),
        9: '<meta name="date" content="2024-01-15"><time datetime="2023-12-24T18:00:00Z">x</time>',
    }),
    (10, {0: '<link rel="sitemap" href="/maps/s.xml"><a href="/sitemap.html">Our sitemap</a>', 1: '<link href="https://e.example/feed.xml" type="application/rss+xml"><link type="application/atom+xml" href="atom">', 2: '<a class=x href="/all-sitemap-pages">All</a><a href="/list.xml">the sitemap</a>', 3: '<p style="font-size: 12px; touch-action: none">small</p><img src=a.png><img src=b.png alt="b">', 4: '<p style="font-size:16px">large</p><img loading="lazy" src=c.png>'}),
    (13, {0: "<script>window._cf_chl_opt = 1</script>", 1: "<title>Just a moment...</title>", 2: '<script src="/cdn-cgi/challenge-platform/x.js"></script>', 3: "<i>_abck=1; ak_bmsc=2</i>", 4: "<i>_abck=1</i>", 5: "<!-- Incapsula incident ID: 1 -->", 6: '<script src="https://tag.captcha-delivery.com/c.js"></script>', 7: "<i>_pxAppId = 1</i>", 8: "<i>aws-waf-token</i>", 9: '<title> Verify you are human </title><i>hcaptcha.com/1/api.js</i>', 10: "<title>How to verify you are human in forms</title>"}),
)


def _before(groups: tuple[tuple[int, dict[int, str]], ...]) -> str:
    """SQL text, of either dialect, of the tags a page gets."""
    cases = []
    for modulus, of in groups:
        whens = " ".join(f"WHEN {k} THEN '" + text.replace("{url}", "' || coalesce(url, '') || '") + "'" for k, text in of.items())
        cases.append(f"CASE fetch_id % {modulus} {whens} ELSE '' END")
    return " || ".join(cases)


#: All tags but the challenges', and with them.
BEFORE, WITH_CHALLENGES = _before(TAGS[:-1]), _before(TAGS[-1:])
#: A page's address with paging put after it.
PAGED = "CASE fetch_id % 5 WHEN 0 THEN coalesce(url, '') || '?page=2' WHEN 1 THEN coalesce(url, '') || '/page/3' WHEN 2 THEN coalesce(url, '') || '?x=1&p=4' ELSE coalesce(url, '') END"

_ONCE = "(SELECT DISTINCT fetch_id, site_id, url, final_url, x_robots_tag, html FROM fetch_results WHERE html IS NOT NULL AND html <> '')"
SQL = f"(SELECT fetch_id, site_id, url, {PAGED} AS paged_url, {BEFORE} || html AS html FROM {_ONCE})"
CHALLENGES_SQL = f"(SELECT fetch_id, {WITH_CHALLENGES} || html AS html FROM {_ONCE})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch_id, site_id, url, paged_url, html."""
    rows = spread(load(spark, sf_dir, "fetch_results").select("fetch_id", "site_id", "url", "html").where("html is not null and html <> ''"))
    return rows.select("fetch_id", "site_id", "url", F.expr(PAGED).alias("paged_url"), F.concat(F.expr(BEFORE), F.col("html")).alias("html"))


def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(load(spark, sf_dir, "fetch_results").select("fetch_id", "html").where("html is not null and html <> ''"))
    return rows.select("fetch_id", F.concat(F.expr(WITH_CHALLENGES), F.col("html")).alias("html"))
