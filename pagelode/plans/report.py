"""One page's report: dates and freshness, content measures, links to sitemaps and feeds, key terms, and what a failed fetch gets instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.html import q
from ..operators.sitefiles import sitemap_files, sitemap_rows
from ..operators.sitemaps import AS_OF, read_time
from ..session import load, spread
from . import augmented
from .checks import entities

_META = r"(?i)<meta[^>]*{}=[\"']{}[\"'][^>]*content=[\"']([^\"']*)[\"']"
#: Where dates stand beside JSON-LD, in order (fixed).
_PUBLISHED = (("property", "article:published_time"), ("name", "article:published_time"), ("name", "date"), ("name", r"DC\.date"))
_MODIFIED = (("property", "article:modified_time"), ("name", "article:modified_time"), ("name", "last-modified"))
_TIME = r"(?i)<time[^>]*datetime=[\"']([^\"']*)[\"'][^>]*>"


def _first(html: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def _days(at: Column) -> Column:
    """Days from at to AS_OF, rounded half up."""
    return F.floor((F.lit(AS_OF).cast("timestamp").cast("double") - at.cast("double")) / 86400.0 + 0.5).cast("bigint")


def date_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, url, ld_published, ld_modified, meta_published, meta_modified, sitemap_lastmod): date texts of a page, each from its first source that has one;
    the sitemap's by address without a trailing slash, its first entry."""
    pages = augmented.pages(spark, sf_dir).select("fetch_id", "url", "html")  # redelivered ones fall together below
    text = lambda f: F.nullif(F.expr(f"try_variant_get(entity, '$.{f}', 'string')"), F.lit(""))
    ld = entities(pages).groupBy("fetch_id").agg(*[F.min_by(text(f), F.when(text(f).isNotNull(), F.col("no"))).alias(f"ld_{k}") for k, f in (("published", "datePublished"), ("modified", "dateModified"))])
    meta = pages.select("fetch_id", "url", _first(F.col("html"), [_META.format(a, n) for a, n in _PUBLISHED] + [_TIME]).alias("meta_published"), _first(F.col("html"), [_META.format(a, n) for a, n in _MODIFIED]).alias("meta_modified")).distinct()
    maps = sitemap_rows(sitemap_files(spark, sf_dir)).where("loc is not null").groupBy(F.regexp_replace("loc", "/$", "").alias("key")).agg(F.min_by("lastmod", F.struct("origin", "ordinal")).alias("sitemap_lastmod"))
    rows = meta.join(ld, "fetch_id", "left").withColumn("key", F.regexp_replace("url", "/$", "")).join(maps, "key", "left")
    return rows.select("fetch_id", "url", "ld_published", "ld_modified", "meta_published", "meta_modified", "sitemap_lastmod")


def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: published and modified (JSON-LD before the rest), age of the newest date in days and its category (2, 30, 180 days), whether dates contradict one
    another, whether one lies more than a day ahead, the age score by page type, and a score of 100 less its faults."""
    d = date_sources(spark, sf_dir)
    d = d.select("fetch_id", read_time(F.coalesce("ld_published", "meta_published")).alias("p"), read_time(F.coalesce("ld_modified", "meta_modified")).alias("m"), read_time(F.col("sitemap_lastmod")).alias("s"), read_time(F.col("ld_published")).alias("lp"), read_time(F.col("meta_published")).alias("mp"))
    newest = F.greatest("p", "m", "s")
    days = _days(newest)
    kind = F.when(newest.isNull(), "unknown").when(days <= 2, "fresh").when(days <= 30, "recent").when(days <= 180, "aging").otherwise("stale")
    backwards = F.col("m") < F.col("p")
    late = F.abs(_days(F.col("m")) - _days(F.col("s"))) >= 7
    apart = F.abs(F.col("lp").cast("double") - F.col("mp").cast("double")) >= 86400.0
    off = lambda c, n: F.when(c, n).otherwise(0)
    score = 100 - off(kind.isin("unknown", "stale"), 20) - off(kind == "aging", 10) - off(backwards, 15) - off(late, 10) - off(apart, 10) - off(F.col("p").isNull(), 10) - off(F.col("m").isNull(), 5)
    ahead = F.coalesce(F.col("p").cast("double") > F.lit(AS_OF).cast("timestamp").cast("double") + 86400.0, F.lit(False))
    floor_days = F.floor((F.lit(AS_OF).cast("timestamp").cast("double") - F.col("p").cast("double")) / 86400.0)
    ladder = F.when(floor_days <= 1, 1.0).when(floor_days <= 7, 0.9).when(floor_days <= 30, 0.7).when(floor_days <= 90, 0.5).when(floor_days <= 365, 0.3).otherwise(0.15)
    return d.select(
        "fetch_id", kind.alias("category"), days.alias("days"), F.coalesce(backwards, F.lit(False)).alias("backwards"), F.coalesce(late, F.lit(False)).alias("sitemap_late"), F.coalesce(apart, F.lit(False)).alias("dates_apart"), ahead.alias("ahead"),
        F.when(F.col("p").isNotNull(), ladder).alias("age_score"), F.greatest(F.lit(0), score).cast("bigint").alias("score"), F.when(score < 50, "FAIL").when(score < 80, "WARNING").otherwise("PASS").alias("status"),
    )


def _dates_sql() -> str:
    ex = lambda p: f"nullif(regexp_extract(html, {q(p)}, 1), '')"
    from .checks import _LD

    sitemaps = "(SELECT concat_ws('/', site_id, CAST(floor(meta_id / 500) AS BIGINT)) AS origin, meta_id, url, CASE WHEN meta_id % 5 > 0 THEN strftime(checked_at, '%Y-%m-%d') END AS lastmod FROM (SELECT DISTINCT meta_id, site_id, url, checked_at FROM content_meta WHERE url IS NOT NULL))"
    return f"""
WITH p AS (SELECT DISTINCT fetch_id, url, html FROM {augmented.SQL}),
b AS (SELECT fetch_id, unnest(range(len(x))) AS block, unnest(x) AS body FROM (SELECT fetch_id, regexp_extract_all(html, {q(_LD)}, 1) AS x FROM p)),
v AS (SELECT fetch_id, block, body::JSON AS j FROM b WHERE json_valid(body)),
o AS (SELECT fetch_id, block, unnest(range(len(l))) AS pos, unnest(l) AS o FROM (SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM v)),
g AS (SELECT fetch_id, block, pos, unnest(range(len(l))) AS sub, unnest(l) AS e FROM (SELECT *, CASE WHEN json_type(o, '$."@graph"') = 'ARRAY' THEN json_extract(o, '$."@graph"[*]') ELSE [o] END AS l FROM o)),
t AS (SELECT *, nullif(json_extract_string(e, '$.datePublished'), '') AS dp, nullif(json_extract_string(e, '$.dateModified'), '') AS dm FROM g),
ld AS (SELECT fetch_id, arg_min(dp, (block, pos, sub)) FILTER (WHERE dp IS NOT NULL) AS ld_published, arg_min(dm, (block, pos, sub)) FILTER (WHERE dm IS NOT NULL) AS ld_modified FROM t GROUP BY fetch_id),
sm AS (SELECT regexp_replace(url, '/$', '') AS key, arg_min(coalesce(lastmod, '-'), (origin, meta_id)) AS lastmod FROM {sitemaps} GROUP BY 1),
ds AS (SELECT p.fetch_id, p.url, ld_published, ld_modified, coalesce({', '.join(ex(_META.format(a, n)) for a, n in _PUBLISHED)}, {ex(_TIME)}) AS meta_published, coalesce({', '.join(ex(_META.format(a, n)) for a, n in _MODIFIED)}) AS meta_modified, nullif(sm.lastmod, '-') AS sitemap_lastmod
  FROM p LEFT JOIN ld USING (fetch_id) LEFT JOIN sm ON sm.key = regexp_replace(p.url, '/$', ''))"""


def _freshness_sql() -> str:
    read = lambda e: f"coalesce(try_strptime({e}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({e}, '%Y-%m-%d'))"
    days = lambda e: f"CAST(floor(epoch(TIMESTAMP '{AS_OF}' - {e}) / 86400.0::DOUBLE + 0.5) AS BIGINT)"
    return _dates_sql() + f""",
r AS (SELECT fetch_id, {read('coalesce(ld_published, meta_published)')} AS p, {read('coalesce(ld_modified, meta_modified)')} AS m, {read('sitemap_lastmod')} AS s, {read('ld_published')} AS lp, {read('meta_published')} AS mp FROM ds),
k AS (SELECT *, {days('greatest(p, m, s)')} AS days, coalesce(m < p, false) AS backwards, coalesce(abs({days('m')} - {days('s')}) >= 7, false) AS late, coalesce(abs(epoch(lp - mp)) >= 86400, false) AS apart FROM r),
c AS (SELECT *, CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 2 THEN 'fresh' WHEN days <= 30 THEN 'recent' WHEN days <= 180 THEN 'aging' ELSE 'stale' END AS category, floor(epoch(TIMESTAMP '{AS_OF}' - p) / 86400.0::DOUBLE) AS age FROM k),
z AS (SELECT *, 100 - CASE WHEN category IN ('unknown', 'stale') THEN 20 WHEN category = 'aging' THEN 10 ELSE 0 END - CASE WHEN backwards THEN 15 ELSE 0 END - CASE WHEN late THEN 10 ELSE 0 END - CASE WHEN apart THEN 10 ELSE 0 END - CASE WHEN p IS NULL THEN 10 ELSE 0 END - CASE WHEN m IS NULL THEN 5 ELSE 0 END AS score FROM c)
SELECT fetch_id, category, days, backwards, late AS sitemap_late, apart AS dates_apart, coalesce(p > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY, false) AS ahead,
  CASE WHEN p IS NULL THEN NULL WHEN age <= 1 THEN 1.0 WHEN age <= 7 THEN 0.9 WHEN age <= 30 THEN 0.7 WHEN age <= 90 THEN 0.5 WHEN age <= 365 THEN 0.3 ELSE 0.15 END::DOUBLE AS age_score, CAST(greatest(0, score) AS BIGINT) AS score, CASE WHEN score < 50 THEN 'FAIL' WHEN score < 80 THEN 'WARNING' ELSE 'PASS' END AS status FROM z"""


# -- the report of a page ------------------------------------------------------------------------
_DESC = (r"(?i)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']", r"(?i)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*name=[\"']description[\"']")
_CANON = (r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']", r"(?i)<link[^>]*href=[\"']([^\"']*)[\"'][^>]*rel=[\"']canonical[\"']")
_HREF = r"(?i)<a[^>]*href=[\"']([^\"']*)[\"']"


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fetch: title, description and first h1 as text, words, links (relative, mailto and tel ones count as internal), content depth, canonical conflict, the
    orphan risk of so few links one click deep, how fit for phones, and the load estimates; a fetch without html gets the report of a failed one."""
    fetched = spread(load(spark, sf_dir, "fetch_results").select("fetch_id", "url", F.coalesce("html", F.lit("")).alias("html")))
    h = F.when(F.col("html") == "", "").otherwise(F.concat(F.expr(augmented.BEFORE), F.col("html")))
    rows = fetched.withColumn("html", h).withColumn("visible", H.visible(F.col("html")))
    html = F.col("html")
    text = lambda tag: F.when(html.rlike(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), H.visible(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)))
    words = F.size(F.filter(F.split("visible", " "), lambda w: w != ""))
    hrefs = F.filter(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("javascript:"))
    absolute = lambda x: x.startswith("http://") | x.startswith("https://")
    n = lambda tag: F.size(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)))
    canonical = F.when(html.rlike(_CANON[0]), F.regexp_extract(html, _CANON[0], 1)).when(html.rlike(_CANON[1]), F.regexp_extract(html, _CANON[1], 1))
    rows = rows.select(
        "fetch_id", "url", "html", text("title").alias("title"), _first(html, list(_DESC)).alias("description"), text("h1").alias("h1"), words.alias("words"), hrefs.alias("hrefs"), n("h2").alias("n2"), n("h3").alias("n3"), F.nullif(canonical, F.lit("")).alias("c"),
        F.regexp_count(html, F.lit("(?i)<img")).alias("images"), F.regexp_count(html, F.lit("(?i)<script")).alias("scripts"), (html.contains('loading="lazy"') | html.contains("loading=lazy")).alias("lazy"), F.nullif(F.regexp_extract(html, r"(?i)font-size:\s*(\d{1,6})px", 1), F.lit("")).cast("int").alias("px"),
    )
    host = U.host(F.col("url"))
    internal = F.size(F.filter("hrefs", lambda x: ~absolute(x) | F.coalesce(U.host(x) == host, F.lit(False))))
    rows = rows.withColumn("internal", F.when(host.isNull(), 0).otherwise(internal)).withColumn("external", F.when(host.isNull(), 0).otherwise(F.size("hrefs") - internal))
    w, size = F.col("words"), F.length("html")
    depth = F.when(w > 300, 2).otherwise(0) + F.when(w > 1000, 2).otherwise(0) + F.when(w > 2000, 1).otherwise(0) + F.when(F.col("n2") > 2, 1).otherwise(0) + F.when(F.col("n3") > 3, 1).otherwise(0) + F.when(F.col("n2") > 5, 1).otherwise(0)
    lcp = F.when((size > 1_000_000) | (F.col("images") > 100), "poor").when((size > 500_000) | (F.col("images") > 50), "needs improvement").otherwise("good")
    cls = F.when((F.col("images") > 50) & ~F.col("lazy"), "high").when((F.col("images") > 10) & ~F.col("lazy"), "medium").otherwise("low")
    inp = F.when(F.col("scripts") > 40, "high").when(F.col("scripts") > 20, "medium").otherwise("low")
    failed = F.col("html") == ""
    unless = lambda c, default: F.when(failed, default).otherwise(c)
    whole = lambda u: F.when(U.host(u).isNotNull(), F.concat(F.lower(U.part(u, 1)), F.lit("://"), U.host(u), U.path(u), F.coalesce(F.concat(F.lit("?"), F.nullif(U.part(u, 5), F.lit(""))), F.lit(""))))
    conflict = F.coalesce(whole(F.col("c")) != whole(F.col("url")), F.lit(False))
    return rows.select(
        "fetch_id", F.when(failed, "failed").otherwise("success").alias("outcome"), "title", "description", "h1", unless(w, 0).cast("bigint").alias("words"), unless(F.col("internal"), 0).cast("bigint").alias("internal"), unless(F.col("external"), 0).cast("bigint").alias("external"),
        unless(depth, 0).cast("bigint").alias("depth_score"), unless(conflict, F.lit(False)).alias("conflict"), unless(F.when(F.col("internal") < 3, 40).when(F.col("internal") < 5, 20).otherwise(0), 0).cast("bigint").alias("orphan_risk"),
        unless(F.coalesce(F.col("px") >= 14, F.lit(True)), F.lit(False)).alias("font_ok"), unless(~html.contains("touch-action: none"), F.lit(False)).alias("tap_ok"), unless(lcp, "unknown").alias("lcp"), unless(cls, "unknown").alias("cls"), unless(inp, "unknown").alias("inp"),
    ).distinct()


def _report_sql() -> str:
    text = lambda tag: f"CASE WHEN regexp_matches(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>') THEN {H.visible_sql(f'''regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)''')} END"
    n = lambda tag: f"len(regexp_extract_all(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>'))"
    whole = lambda u: f"CASE WHEN {U.host_sql(u)} IS NOT NULL THEN lower({U.part_sql(u, 1)}) || '://' || {U.host_sql(u)} || {U.path_sql(u)} || coalesce('?' || nullif({U.part_sql(u, 5)}, ''), '') END"
    return f"""
WITH f AS (SELECT DISTINCT fetch_id, url, coalesce(html, '') AS raw FROM fetch_results),
p AS (SELECT fetch_id, url, CASE WHEN raw = '' THEN '' ELSE {augmented.BEFORE} || raw END AS html FROM f),
x AS (SELECT *, {H.words_sql('html')} AS w, list_filter(regexp_extract_all(html, {q(_HREF)}, 1), lambda h: h <> '' AND NOT starts_with(h, '#') AND NOT starts_with(h, 'javascript:')) AS hr, {n('h2')} AS n2, {n('h3')} AS n3,
  nullif(CASE WHEN regexp_matches(html, {q(_CANON[0])}) THEN regexp_extract(html, {q(_CANON[0])}, 1) ELSE regexp_extract(html, {q(_CANON[1])}, 1) END, '') AS c, len(regexp_extract_all(html, '(?i)<img')) AS im, len(regexp_extract_all(html, '(?i)<script')) AS sc,
  contains(html, 'loading="lazy"') OR contains(html, 'loading=lazy') AS lazy, {U.host_sql('url')} AS ho FROM p),
y AS (SELECT *, CASE WHEN ho IS NULL THEN 0 ELSE len(list_filter(hr, lambda h: NOT (starts_with(h, 'http://') OR starts_with(h, 'https://')) OR coalesce({U.host_sql('h')} = ho, false))) END AS inn FROM x)
SELECT fetch_id, CASE WHEN html = '' THEN 'failed' ELSE 'success' END AS outcome, {text('title')} AS title, coalesce(nullif(regexp_extract(html, {q(_DESC[0])}, 1), ''), nullif(regexp_extract(html, {q(_DESC[1])}, 1), '')) AS description, {text('h1')} AS h1, CAST(len(w) AS BIGINT) AS words,
  CAST(inn AS BIGINT) AS internal, CAST(CASE WHEN ho IS NULL THEN 0 ELSE len(hr) - inn END AS BIGINT) AS external,
  CAST(CASE WHEN len(w) > 300 THEN 2 ELSE 0 END + CASE WHEN len(w) > 1000 THEN 2 ELSE 0 END + CASE WHEN len(w) > 2000 THEN 1 ELSE 0 END + CASE WHEN n2 > 2 THEN 1 ELSE 0 END + CASE WHEN n3 > 3 THEN 1 ELSE 0 END + CASE WHEN n2 > 5 THEN 1 ELSE 0 END AS BIGINT) AS depth_score,
  coalesce({whole('c')} <> {whole('url')}, false) AS conflict, CAST(CASE WHEN html = '' THEN 0 WHEN inn < 3 THEN 40 WHEN inn < 5 THEN 20 ELSE 0 END AS BIGINT) AS orphan_risk,
  html <> '' AND coalesce(TRY_CAST(regexp_extract(html, '(?i)font-size:\\s*(\\d{{1,6}})px', 1) AS INTEGER) >= 14, true) AS font_ok, html <> '' AND NOT contains(html, 'touch-action: none') AS tap_ok,
  CASE WHEN html = '' THEN 'unknown' WHEN length(html) > 1000000 OR im > 100 THEN 'poor' WHEN length(html) > 500000 OR im > 50 THEN 'needs improvement' ELSE 'good' END AS lcp,
  CASE WHEN html = '' THEN 'unknown' WHEN im > 50 AND NOT lazy THEN 'high' WHEN im > 10 AND NOT lazy THEN 'medium' ELSE 'low' END AS cls, CASE WHEN html = '' THEN 'unknown' WHEN sc > 40 THEN 'high' WHEN sc > 20 THEN 'medium' ELSE 'low' END AS inp FROM y
"""


# -- links to sitemaps and feeds, alternatives, terms --------------------------------------------
_MAP_LINKS = (r"(?i)<link[^>]*rel=[\"']sitemap[\"'][^>]*href=[\"']([^\"']*)[\"']", r"(?i)<link[^>]*href=[\"']([^\"']*)[\"'][^>]*rel=[\"']sitemap[\"']", r"(?i)<a[^>]*href=[\"']([^\"']*sitemap[^\"']*)[\"']")
_MAP_ANCHOR = r"(?i)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>[^<]*sitemap[^<]*"
_FEEDS = (r"(?i)<link[^>]*type=[\"']application/(?:rss|atom)\+xml[\"'][^>]*href=[\"']([^\"']*)[\"']", r"(?i)<link[^>]*href=[\"']([^\"']*)[\"'][^>]*type=[\"']application/(?:rss|atom)\+xml[\"']")


def discovery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, kind, url): sitemap and feed addresses that a site's pages point to, resolved against the site's root, each once."""
    html = F.col("html")
    every = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    maps = F.concat(*[every(p) for p in _MAP_LINKS], F.filter(every(_MAP_ANCHOR), lambda x: x.rlike(r"(?i)\.xml|sitemap")))
    rows = augmented.pages(spark, sf_dir).select("site_id", F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1), F.lit("/")).alias("root"), maps.alias("sitemap"), F.concat(*[every(p) for p in _FEEDS]).alias("feed"))
    long = rows.select("site_id", "root", F.expr("stack(2, 'sitemap', sitemap, 'feed', feed) as (kind, hrefs)")).select("site_id", "root", "kind", F.explode("hrefs").alias("href")).where("trim(href) <> ''").withColumn("href", F.trim("href")).distinct()
    return U.with_resolved(long, "href", "root", "url").select("site_id", "kind", "url").distinct()


def _discovery_sql() -> str:
    every = lambda p: f"regexp_extract_all(html, {q(p)}, 1)"
    maps = "list_concat(" + ", ".join([every(p) for p in _MAP_LINKS] + [f"list_filter({every(_MAP_ANCHOR)}, lambda x: regexp_matches(x, '(?i)\\.xml|sitemap'))"]) + ")"
    return f"""
WITH p AS (SELECT site_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS root, html FROM {augmented.SQL}),
l AS (SELECT site_id, root, 'sitemap' AS kind, trim(unnest({maps})) AS href FROM p UNION ALL SELECT site_id, root, 'feed', trim(unnest(list_concat({every(_FEEDS[0])}, {every(_FEEDS[1])}))) FROM p)
SELECT DISTINCT site_id, kind, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN root || href ELSE root || '/' || href END AS url FROM l WHERE href <> ''
"""


def hreflang_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language alternatives of each page's links: code and address, in order, each pair once."""
    tags = F.filter(H.tags(F.col("html"), "link"), lambda a: F.coalesce(F.lower(H.attr(a, "rel")) == "alternate", F.lit(False)))
    pair = F.filter(F.transform(tags, lambda a: F.struct(H.attr(a, "hreflang").alias("lang"), H.attr(a, "href").alias("href"))), lambda p: p.lang.isNotNull() & p.href.isNotNull())
    rows = augmented.pages(spark, sf_dir).select("fetch_id", F.posexplode(F.array_distinct(pair)).alias("place", "p")).distinct()
    return rows.select("fetch_id", F.col("place").cast("bigint").alias("place"), "p.lang", "p.href")


def _hreflang_sql() -> str:
    return f"""
WITH t AS (SELECT DISTINCT fetch_id, list_filter({H.tags_sql('html', 'link')}, lambda a: lower({H.attr_sql('a', 'rel')}) = 'alternate') AS tags FROM {augmented.SQL}),
u AS (SELECT fetch_id, unnest(range(len(tags))) AS i, unnest(tags) AS a FROM t),
v AS (SELECT fetch_id, i, {H.attr_sql('a', 'hreflang')} AS lang, {H.attr_sql('a', 'href')} AS href FROM u),
w AS (SELECT fetch_id, lang, href, min(i) AS i FROM v WHERE lang IS NOT NULL AND href IS NOT NULL GROUP BY ALL)
SELECT fetch_id, row_number() OVER (PARTITION BY fetch_id ORDER BY i) - 1 AS place, lang, href FROM w
"""


#: Words that are no terms (fixed values that must match).
STOPS = ("this", "that", "with", "from", "have", "been", "were", "they", "their", "would", "could", "should", "about", "which", "when", "what", "where", "there", "some", "more", "also", "than", "them", "into", "other", "just", "only", "very", "will", "each", "make", "like", "over", "such", "then", "most", "many", "well", "back", "much")
_TERM_CHARS = r"[^a-z0-9\x{0600}-\x{06ff}\x{0400}-\x{04ff}\x{4e00}-\x{9fff} \t\r\n\f-]"


def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest terms of each page's title, description and h1: words of more than three characters that aren't stop words; ties by first appearance."""
    meta = load(spark, sf_dir, "content_meta").select("meta_id", F.lower(F.concat_ws(" ", "title", "description", "h1")).alias("t")).dropDuplicates(["meta_id"])
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace("t", "<[^>]+>", " "), _TERM_CHARS, " ")), f"{H.WS}+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOPS))
    rows = meta.select("meta_id", F.posexplode(words).alias("place", "term"))
    counts = rows.groupBy("meta_id", "term").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("meta_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where("rank <= 10").select("meta_id", "term", "n", F.col("rank").cast("bigint").alias("rank"))


_KEY_TERMS_SQL = f"""
WITH m AS (SELECT meta_id, lower(concat_ws(' ', any_value(title), any_value(description), any_value(h1))) AS t FROM content_meta GROUP BY meta_id),
w AS (SELECT meta_id, regexp_split_to_array(trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '{_TERM_CHARS}', ' ', 'g')), '[ \\t\\r\\n\\f]+') AS w FROM m),
x AS (SELECT meta_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM w),
c AS (SELECT meta_id, term, count(*) AS n, min(place) AS first FROM x WHERE length(term) > 3 AND term NOT IN ({', '.join(f"'{s}'" for s in STOPS)}) GROUP BY ALL)
SELECT meta_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY meta_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10
"""


def page_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest words of more than three characters of each page's text with their share in percent; ties by first appearance, numbers first."""
    rows = spread(load(spark, sf_dir, "fetch_results").select("fetch_id", "html").where("html <> ''"))
    words = F.filter(F.split(F.lower(H.visible(F.col("html"))), " "), lambda w: F.length(w) > 3)
    long = rows.select("fetch_id", words.alias("w")).select("fetch_id", F.size("w").alias("total"), F.posexplode("w").alias("place", "term"))
    # redelivered pages are whole copies: their counts are divided by their number, so no text crosses a shuffle
    copies = rows.groupBy("fetch_id").agg(F.count("*").alias("copies"))
    counts = long.groupBy("fetch_id", "term").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("total").alias("total")).join(copies, "fetch_id").withColumn("n", F.expr("n div copies"))
    number = F.when(F.col("term").rlike("^[1-9][0-9]{3,8}$"), F.col("term").try_cast("bigint"))  # keys that are whole numbers stand first
    rank = F.row_number().over(Window.partitionBy("fetch_id").orderBy(F.desc("n"), number.asc_nulls_last(), "first"))
    return counts.withColumn("rank", rank).where("rank <= 10").select("fetch_id", "term", "n", F.col("rank").cast("bigint").alias("rank"), (F.floor(F.col("n") * 10000.0 / F.col("total") + 0.5) / 100).alias("pct"))


_PAGE_TERMS_SQL = f"""
WITH p AS (SELECT DISTINCT fetch_id, list_filter(string_split(lower({H.visible_sql('html')}), ' '), lambda w: length(w) > 3) AS w FROM fetch_results WHERE html <> ''),
x AS (SELECT fetch_id, len(w) AS total, unnest(w) AS term, unnest(range(len(w))) AS place FROM p),
c AS (SELECT fetch_id, term, count(*) AS n, min(place) AS first, any_value(total) AS total, CASE WHEN regexp_matches(term, '^[1-9][0-9]{{3,8}}$') THEN TRY_CAST(term AS BIGINT) END AS num FROM x GROUP BY fetch_id, term)
SELECT fetch_id, term, n, rank, floor(n * 10000.0::DOUBLE / total + 0.5) / 100 AS pct FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY n DESC, num NULLS LAST, first) AS rank FROM c) WHERE rank <= 10
"""


def registry() -> tuple[dict, dict[str, str]]:
    pairs = {
        "date_sources": (date_sources, _dates_sql() + " SELECT * FROM ds"), "freshness_report": (freshness_report, _freshness_sql()), "page_report": (page_report, _report_sql()), "discovery_links": (discovery_links, _discovery_sql()),
        "hreflang_html": (hreflang_html, _hreflang_sql()), "key_terms": (key_terms, _KEY_TERMS_SQL), "page_terms": (page_terms, _PAGE_TERMS_SQL),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
