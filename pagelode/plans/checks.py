"""Page checks: state of a fetch, bot gates, canonical, paging, structured data, page type and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..session import load
from . import augmented
from .fetch_log import ATTEMPTS, attempts

# -- state of a fetch ----------------------------------------------------------------------------
_DENIED = ("access_denied", "waf_challenge")


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(load(spark, sf_dir, "fetch_results"), attempts(spark, sf_dir))


def states(fetches: DataFrame, tried: DataFrame) -> DataFrame:
    """Per fetch: the effective status (0 or missing and nothing succeeded: 403 if any attempt was denied or gated, else the last attempt's), the
    page's state, and whether its html can be checked.  States are tried in order: content, gate, not found, server error, unreadable, blocked, failed."""
    per = tried.groupBy("fetch_id").agg(
        F.count_if("ok").alias("n_ok"), F.count("*").alias("n"), F.count_if(F.col("failure_kind").isin(*_DENIED)).alias("n_denied"), F.count_if(F.col("failure_kind") == "not_found").alias("n_missing"),
        F.bool_or(F.coalesce(F.col("cf_challenge"), F.lit(False)) | (F.col("failure_kind") == "waf_challenge")).alias("gated"), F.bool_or(F.coalesce(F.col("failure_kind") == "parser_failure", F.lit(False))).alias("unreadable"),
        F.max_by("status", F.struct("attempt_no", "attempt_id")).alias("last_status"),
    )
    rows = fetches.select("fetch_id", "fetch_ok", "http_status", F.coalesce("html", F.lit("")).rlike("(?i)<!doctype|<html|<head|<body").alias("markup")).distinct()
    ok = F.coalesce("fetch_ok", F.lit(False))
    status = F.when(~ok & (F.coalesce("http_status", F.lit(0)) == 0) & F.col("n").isNotNull(), F.when(F.col("n_denied") > 0, 403).otherwise(F.coalesce("last_status", F.lit(0)))).otherwise(F.coalesce("http_status", F.lit(0)))
    sure = F.col("n").isNotNull() & (F.col("n_ok") == 0) & ((F.col("n_missing") > 0) | (F.col("n_denied") == F.col("n")) | (F.col("n_denied") >= 2))
    state = (
        F.when(ok, "OK").when(F.col("gated"), "BOT_PROTECTION_CHALLENGE").when(F.col("s").isin(404, 410), "NOT_FOUND").when(F.col("s") >= 500, "SERVER_ERROR")
        .when(F.col("unreadable"), "PARSE_ERROR").when(sure, "CRAWLER_BLOCKED").otherwise("FETCH_ERROR")
    )
    return rows.join(per, "fetch_id", "left").withColumn("s", status).select("fetch_id", F.col("s").cast("bigint").alias("effective_status"), state.alias("state"), (ok & F.col("markup")).alias("usable"))


PAGE_STATES_SQL = f"""
WITH a AS (SELECT fetch_id, bool_or(ok) AS any_ok, list(coalesce(failure_kind, '')) AS kinds, bool_or(coalesce(cf_challenge, false)) AS cf, arg_max(coalesce(status, -1), (attempt_no, attempt_id)) AS last FROM {ATTEMPTS} GROUP BY fetch_id),
f AS (SELECT DISTINCT fetch_id, coalesce(fetch_ok, false) AS ok, coalesce(http_status, 0) AS hs, regexp_matches(coalesce(html, ''), '(?i)<!doctype|<html|<head|<body') AS markup FROM fetch_results),
j AS (SELECT f.*, kinds, any_ok, cf, last, len(list_filter(kinds, lambda k: k IN ('access_denied', 'waf_challenge'))) AS den FROM f LEFT JOIN a USING (fetch_id)),
s AS (SELECT *, CASE WHEN NOT ok AND hs = 0 AND kinds IS NOT NULL THEN CASE WHEN den > 0 THEN 403 WHEN last = -1 THEN 0 ELSE last END ELSE hs END AS eff FROM j)
SELECT fetch_id, CAST(eff AS BIGINT) AS effective_status, CASE WHEN ok THEN 'OK' WHEN cf OR list_contains(kinds, 'waf_challenge') THEN 'BOT_PROTECTION_CHALLENGE' WHEN eff IN (404, 410) THEN 'NOT_FOUND' WHEN eff >= 500 THEN 'SERVER_ERROR'
  WHEN list_contains(kinds, 'parser_failure') THEN 'PARSE_ERROR' WHEN kinds IS NOT NULL AND NOT coalesce(any_ok, false) AND (list_contains(kinds, 'not_found') OR den = len(kinds) OR den >= 2) THEN 'CRAWLER_BLOCKED' ELSE 'FETCH_ERROR' END AS state, ok AND markup AS usable FROM s
"""


def error_kind(message: Column) -> Column:
    """What a network error's message says: given up, certificates, names, or else a failure that may pass."""
    m = F.lower(message)
    has = lambda *words: m.rlike("|".join(words))
    return F.when(has("abort", "timeout"), "timeout").when(has("cert", "ssl", "tls"), "ssl_error").when(has("enotfound", "dns", "getaddrinfo", "name_not_resolved"), "dns_error").otherwise("timeout")


def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that failed without an answer, by what their message says against what was logged."""
    rows = attempts(spark, sf_dir).where("error is not null")
    return rows.groupBy("failure_kind", error_kind(F.col("error")).alias("by_message")).agg(F.count("*").alias("n"))


NETWORK_ERRORS_SQL = f"""
SELECT failure_kind, CASE WHEN contains(m, 'abort') OR contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'cert') OR contains(m, 'ssl') OR contains(m, 'tls') THEN 'ssl_error'
  WHEN contains(m, 'enotfound') OR contains(m, 'dns') OR contains(m, 'getaddrinfo') OR contains(m, 'name_not_resolved') THEN 'dns_error' ELSE 'timeout' END AS by_message, count(*) AS n
FROM (SELECT failure_kind, lower(error) AS m FROM {ATTEMPTS} WHERE error IS NOT NULL) GROUP BY 1, 2
"""

# -- bot gates -----------------------------------------------------------------------------------
#: Marks of bot gates by vendor (fixed patterns that must match); each entry is a list of patterns that must all occur.
VENDORS: dict[str, tuple[tuple[str, ...], ...]] = {
    "cloudflare": ((r"window\._cf_chl_opt\b",), (r"(?i)<title>\s*Just a moment\.\.\.\s*</title>",), (r"/cdn-cgi/challenge-platform/",), (r'id="cf-browser-verification"',), (r'class="cf-turnstile"',), (r"(?i)<title>\s*Attention Required!\s*</title>",)),
    "akamai": ((r"_abck=", r"ak_bmsc="), (r"(?i)sensor_data.*akamai",)),
    "imperva": ((r"<!-- Incapsula incident ID:",), (r"incap_ses_\w+", r"visid_incap_\w+")),
    "datadome": ((r"tag\.captcha-delivery\.com",), (r"window\.ddjskey\s*=",)),
    "perimeterx": ((r"_pxAppId\s*=",), (r'px-captcha|class="pxCaptcha"',)),
    "aws": ((r"aws-waf-token",), (r"(?i)awswaf.*checksum",)),
}
#: Titles that are nothing but a gate's phrase (fixed).
GATE_TITLE = r"(?i)^(?:verify you are human|human verification|bot check|ddos protection(?: by \w+)?|please verify you are( a)? human|you have been blocked|browser integrity check|security check required|checking your browser\.\.\.|please wait\.\.\.|one more step)$"
_GATE_TITLE_TEXT = r"(?is)<title[^>]*>(.{0,200}?)</title>"


def gate_vendor(html: Column) -> Column:
    """The vendor of the bot gate that html is, hcaptcha or title for the general signs, NULL if it is none."""
    out = None
    for vendor, ways in VENDORS.items():
        hit = F.lit(False)
        for way in ways:
            all_of = F.lit(True)
            for pattern in way:
                all_of = all_of & html.rlike(pattern)
            hit = hit | all_of
        hit = hit & (F.length(html) >= 10)
        out = F.when(hit, vendor) if out is None else out.when(hit, vendor)
    return out.when(html.rlike(r"hcaptcha\.com/1/api\.js") & F.left(html, F.lit(2000)).rlike("(?i)verify|bot|human"), "hcaptcha").when(H.trimmed(F.regexp_extract(html, _GATE_TITLE_TEXT, 1)).rlike(GATE_TITLE), "title")


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot gates by vendor signs, over pages with such signs put before them."""
    return augmented.challenge_pages(spark, sf_dir).select("fetch_id", gate_vendor(F.col("html")).alias("vendor")).distinct()


def _gate_sql(e: str) -> str:
    whens = " ".join(f"WHEN length({e}) >= 10 AND (" + " OR ".join("(" + " AND ".join(f"regexp_matches({e}, {H.q(p)})" for p in way) + ")" for way in ways) + f") THEN '{v}'" for v, ways in VENDORS.items())
    title = H.trimmed_sql(f"regexp_extract({e}, {H.q(_GATE_TITLE_TEXT)}, 1)")
    return f"CASE {whens} WHEN contains({e}, 'hcaptcha.com/1/api.js') AND regexp_matches({e}[1:2000], '(?i)verify|bot|human') THEN 'hcaptcha' WHEN regexp_matches({title}, {H.q(GATE_TITLE)}) THEN 'title' END"


CHALLENGES_SQL = f"SELECT DISTINCT fetch_id, {_gate_sql('html')} AS vendor FROM {augmented.CHALLENGES_SQL}"

# -- page type -----------------------------------------------------------------------------------
#: Schema types of articles (fixed values that must match).
ARTICLES = ("Article", "NewsArticle", "ReportageNewsArticle", "AnalysisNewsArticle", "AskPublicNewsArticle", "BackgroundNewsArticle", "OpinionNewsArticle", "ReviewNewsArticle", "BlogPosting", "LiveBlogPosting", "Report", "SatiricalArticle", "ScholarlyArticle", "TechArticle")
#: Schema types search results can be rich for, beside articles (fixed values that must match).
RICH = ("VideoObject", "BreadcrumbList", "FAQPage", "HowTo", "LocalBusiness", "Product", "Review", "Recipe", "Event", "JobPosting", "Course", "Dataset", "SoftwareApplication", "WebSite")
_TYPE_RULES = (
    (r"/(?:search|suche|buscar)\b", "search"), (r"/(?:tag|tags|topic|label)\b", "tag"), (r"/(?:author|authors|journalist|columnist|reporter)\b", "author"), (r"/(?:video|videos|watch)\b", "video_article"),
    (r"/\d{4}/\d{2}/|/[a-z0-9]+-[a-z0-9]+-[a-z0-9]+", "article"),
)


def type_by_url(url: Column) -> Column:
    p = F.lower(F.coalesce(U.path(url), url))
    out = F.when((p == "/") | (p == ""), "home")
    for pattern, kind in _TYPE_RULES:
        out = out.when(p.rlike(pattern), kind)
    return out.when(F.size(F.filter(F.split(p, "/"), lambda x: x != "")) <= 2, "section").otherwise("unknown")


def type_by_url_sql(e: str) -> str:
    p = f"lower(coalesce({U.path_sql(e)}, {e}))"
    return f"CASE WHEN {p} IN ('/', '') THEN 'home' " + " ".join(f"WHEN regexp_matches({p}, {H.q(r)}) THEN '{k}'" for r, k in _TYPE_RULES) + f" WHEN len(list_filter(string_split({p}, '/'), lambda x: x <> '')) <= 2 THEN 'section' ELSE 'unknown' END"


_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def entities(pages: DataFrame, *keep: str) -> DataFrame:
    """(fetch_id, keep, entity variant, no): JSON-LD objects of each page in order; lists and @graph spread one level, unreadable blocks skipped."""
    blocks = pages.select("fetch_id", *keep, F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("block", "body")).select("fetch_id", *keep, "block", F.try_parse_json("body").alias("v")).where("v is not null")
    many = F.expr("try_variant_get(v, '$', 'array<variant>')")
    graph = lambda o: F.expr(f"try_variant_get({o}, '$[\"@graph\"]', 'array<variant>')")
    tops = blocks.select("fetch_id", *keep, "block", F.posexplode(F.coalesce(many, F.array("v"))).alias("pos", "o"))
    spread = tops.select("fetch_id", *keep, "block", "pos", F.posexplode(F.coalesce(graph("o"), F.array("o"))).alias("sub", "entity"))
    return spread.where("schema_of_variant(entity) like 'OBJECT%'").select("fetch_id", *keep, "entity", F.struct("block", "pos", "sub").alias("no"))


_TYPES_OF = "coalesce(try_variant_get(entity, '$[\"@type\"]', 'array<string>'), array_compact(array(try_variant_get(entity, '$[\"@type\"]', 'string'))))"


def field_of(name: str) -> Column:
    """Whether a field of an entity is there as JavaScript has it: not missing, null, false, 0 or ""."""
    return F.coalesce(~F.expr(f"to_json(try_variant_get(entity, '$.{name}', 'variant'))").isin("null", "false", "0", '""', "0.0", "-0"), F.lit(False))


#: Per page type: the schema types whose first entity is looked at, and its fields.
ENTITY_FIELDS = {
    "article": (ARTICLES, ("headline", "datePublished", "author", "image", "dateModified", "publisher", "mainEntityOfPage", "description")),
    "author": (("Person",), ("name", "url", "image", "jobTitle", "sameAs")),
    "video_article": (("VideoObject",), ("name", "description", "thumbnailUrl", "uploadDate", "duration", "contentUrl", "embedUrl", "publisher")),
    "home": (("Organization", "NewsMediaOrganization", "Corporation"), ("name", "logo", "url")),
}
#: Which page type a page is checked as here, so that all are met.
AS_TYPE = "CASE fetch_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'home' WHEN 2 THEN 'author' ELSE 'video_article' END"
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?([+-]\d{2}:\d{2}|Z)?)?$"


def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: schema types found by JSON-LD, microdata and RDFa, those that can be rich results, fields present and missing in the first entity of the
    page type's own types, and the status: WARN if no types, if none fits the page type, if a field search engines need is missing, or a date isn't ISO."""
    pages = augmented.pages(spark, sf_dir).withColumn("page_type", F.expr(AS_TYPE)).select("fetch_id", "page_type", "html")  # redelivered ones fall together below
    found = entities(pages, "page_type").select("fetch_id", "page_type", "entity", "no", F.expr(_TYPES_OF).alias("types"))
    of_type = F.lit(False)
    for kind, (types, _) in ENTITY_FIELDS.items():
        of_type = of_type | (F.col("page_type") == kind) & F.arrays_overlap("types", F.array(*map(F.lit, types)))
    present, missing = [], []
    for kind, (_, fields) in ENTITY_FIELDS.items():
        for f in fields:
            here = (F.col("page_type") == kind)
            present.append(F.when(here & field_of(f), f))
            missing.append(F.when(here & ~field_of(f), f))
    dates = [F.expr(f"try_variant_get(entity, '$.{d}', 'string')") for d in ("datePublished", "dateModified")]
    is_text = [F.expr(f"schema_of_variant(try_variant_get(entity, '$.{d}', 'variant'))") == "STRING" for d in ("datePublished", "dateModified")]
    bad_date = (F.col("page_type") == "article") & (F.coalesce(is_text[0] & ~dates[0].rlike(_ISO), F.lit(False)) | F.coalesce(is_text[1] & ~dates[1].rlike(_ISO), F.lit(False)))
    facts = F.struct(F.array_compact(F.array(*present)).alias("present"), F.array_compact(F.array(*missing)).alias("missing"), bad_date.alias("bad_date"))
    per = found.groupBy("fetch_id").agg(F.collect_set("types").alias("ts"), F.min_by(F.when(of_type, facts), F.when(of_type, F.col("no"))).alias("f"))
    micro = F.regexp_extract_all("html", F.lit(r"(?i)itemtype=[\"']https?://schema\.org/([^\"']+)[\"']"), F.lit(1))
    rdfa = F.transform(F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)typeof=[\"']([^\"']+)[\"']"), F.lit(1)), lambda t: F.split(t, "[ \t\r\n\f]+"))), lambda t: F.regexp_replace(t, "^schema:", ""))
    rows = pages.select("fetch_id", "page_type", F.array_union(micro, rdfa).alias("other")).distinct().join(per, "fetch_id", "left")
    rows = rows.withColumn("types", F.array_sort(F.filter(F.array_union(F.coalesce(F.flatten("ts"), F.array().cast("array<string>")), "other"), lambda t: t != "")))
    has = lambda *names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    fits = F.when(F.col("page_type") == "article", has(*ARTICLES)).when(F.col("page_type") == "home", has("WebSite", "Organization", "NewsMediaOrganization", "Corporation", "WebPage", "CollectionPage")).when(F.col("page_type") == "author", has("Person", "ProfilePage")).otherwise(has("VideoObject"))
    needed = F.when(F.col("page_type") == "article", F.array(F.lit("headline"), F.lit("datePublished"))).when(F.col("page_type") == "video_article", F.array(F.lit("name"), F.lit("thumbnailUrl"))).otherwise(F.array().cast("array<string>"))
    lacking = F.coalesce(F.arrays_overlap(needed, "f.missing"), F.lit(False)) | F.coalesce("f.bad_date", F.lit(False))
    text = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    status = F.when((F.size("types") == 0) | ~fits | lacking, "WARN").otherwise("PASS")
    rich = F.filter("types", lambda t: t.isin(*ARTICLES, *RICH))
    return rows.select("fetch_id", "page_type", text(F.col("types")).alias("types"), text(rich).alias("rich"), text(F.col("f.present")).alias("present"), text(F.col("f.missing")).alias("missing"), status.alias("status"))


def _structured_sql() -> str:
    kinds = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(t) for t in types)}]" for k, (types, _) in ENTITY_FIELDS.items())
    fields = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(f) for f in fs)}]" for k, (_, fs) in ENTITY_FIELDS.items())
    rich = ", ".join(f"'{t}'" for t in (*ARTICLES, *RICH))
    truthy = "coalesce(json_extract(e, '$.' || f)::VARCHAR NOT IN ('null', 'false', '0', '\"\"'), false)"
    bad = " OR ".join(f"(json_type(e, '$.{d}') = 'VARCHAR' AND NOT regexp_matches(json_extract_string(e, '$.{d}'), {H.q(_ISO)}))" for d in ("datePublished", "dateModified"))
    return f"""
WITH p AS (SELECT DISTINCT fetch_id, html, {AS_TYPE} AS page_type FROM {augmented.SQL}),
b AS (SELECT fetch_id, page_type, unnest(range(len(x))) AS block, unnest(x) AS body FROM (SELECT fetch_id, page_type, regexp_extract_all(html, {H.q(_LD)}, 1) AS x FROM p)),
v AS (SELECT fetch_id, page_type, block, body::JSON AS j FROM b WHERE json_valid(body)),
o AS (SELECT fetch_id, page_type, block, unnest(range(len(l))) AS pos, unnest(l) AS o FROM (SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM v)),
g AS (SELECT fetch_id, page_type, block, pos, unnest(range(len(l))) AS sub, unnest(l) AS e FROM (SELECT *, CASE WHEN json_type(o, '$."@graph"') = 'ARRAY' THEN json_extract(o, '$."@graph"[*]') ELSE [o] END AS l FROM o)),
t AS (SELECT *, CASE WHEN json_type(e, '$."@type"') = 'ARRAY' THEN json_extract_string(e, '$."@type"[*]') WHEN json_extract_string(e, '$."@type"') IS NULL THEN [] ELSE [json_extract_string(e, '$."@type"')] END AS types FROM g WHERE json_type(e) = 'OBJECT'),
first AS (SELECT fetch_id, page_type, arg_min(e, (block, pos, sub)) AS e FROM t WHERE list_has_any(types, CASE page_type {kinds} END) GROUP BY ALL),
facts AS (SELECT fetch_id, string_agg(f, ',' ORDER BY f) FILTER (WHERE {truthy}) AS present, string_agg(f, ',' ORDER BY f) FILTER (WHERE NOT {truthy}) AS missing, bool_or(page_type = 'article' AND coalesce({bad}, false)) AS bad_date,
  bool_or(NOT {truthy} AND (page_type = 'article' AND f IN ('headline', 'datePublished') OR page_type = 'video_article' AND f IN ('name', 'thumbnailUrl'))) AS lacks FROM (SELECT fetch_id, page_type, e, unnest(CASE page_type {fields} END) AS f FROM first) GROUP BY fetch_id),
every AS (SELECT fetch_id, unnest(types) AS type FROM t UNION SELECT fetch_id, unnest(regexp_extract_all(html, '(?i)itemtype=["'']https?://schema\\.org/([^"'']+)["'']', 1)) FROM p
  UNION SELECT fetch_id, regexp_replace(unnest(flatten(list_transform(regexp_extract_all(html, '(?i)typeof=["'']([^"'']+)["'']', 1), lambda x: regexp_split_to_array(x, '[ \\t\\r\\n\\f]+')))), '^schema:', '') FROM p),
ty AS (SELECT fetch_id, list(type ORDER BY type) AS types FROM every WHERE type <> '' GROUP BY fetch_id),
j AS (SELECT p.fetch_id, p.page_type, coalesce(types, []) AS types, coalesce(present, '') AS present, coalesce(missing, '') AS missing, coalesce(bad_date, false) OR coalesce(lacks, false) AS lacking FROM p LEFT JOIN ty USING (fetch_id) LEFT JOIN facts USING (fetch_id))
SELECT fetch_id, page_type, array_to_string(types, ',') AS types, array_to_string(list_filter(types, lambda x: x IN ({rich})), ',') AS rich, present, missing,
  CASE WHEN len(types) = 0 OR lacking OR NOT CASE page_type WHEN 'article' THEN list_has_any(types, [{', '.join(repr(t) for t in ARTICLES)}]) WHEN 'home' THEN list_has_any(types, ['WebSite', 'Organization', 'NewsMediaOrganization', 'Corporation', 'WebPage', 'CollectionPage'])
    WHEN 'author' THEN list_has_any(types, ['Person', 'ProfilePage']) ELSE list_has_any(types, ['VideoObject']) END THEN 'WARN' ELSE 'PASS' END AS status FROM j
"""


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page type by address, refined by JSON-LD types (graphs included), og:type and article marks; and the category: by types, by og:type, by type and date."""
    pages = augmented.pages(spark, sf_dir).select("fetch_id", F.col("paged_url").alias("url"), "html")
    kinds = entities(pages).groupBy("fetch_id").agg(F.flatten(F.collect_set(F.expr(_TYPES_OF))).alias("types"))
    html = F.col("html")
    og = F.lower(F.coalesce(F.nullif(F.regexp_extract(html, r"(?i)<meta[^>]*property=[\"']og:type[\"'][^>]*content=[\"']([^\"']+)[\"']", 1), F.lit("")), F.regexp_extract(html, r"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*property=[\"']og:type[\"']", 1)))
    marks = pages.select("fetch_id", type_by_url(F.col("url")).alias("by_url"), og.alias("og"), html.rlike(r"(?i)<article[\s>]").alias("element"), html.rlike(r"(?i)<meta[^>]*property=[\"']article:published_time[\"']").alias("timed"), html.rlike(r"(?i)<[^>]*itemprop=[\"']datePublished[\"']").alias("dated"), html.rlike(r"(?i)<time[\s>]|itemprop=[\"']datePublished[\"']|article:published_time").alias("date")).distinct()
    rows = marks.join(kinds, "fetch_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    article, person = has(*ARTICLES), has("Person", "ProfilePage")
    kind = (
        F.when(F.col("by_url").isin("home", "search", "tag", "video_article"), F.col("by_url")).when((F.col("by_url") == "author") & person, "author").when(has("VideoObject") & article, "video_article")
        .when(article | (F.col("og") == "article") | F.col("element") & F.col("timed"), "article").when(person & (F.col("by_url") != "section"), "author").when(F.col("by_url") == "article", "article")
        .when(F.col("by_url").isin("unknown", "section") & F.col("element") & F.col("dated"), "article").otherwise(F.col("by_url"))
    )
    category = (
        F.when(has("NewsArticle", "ReportageNewsArticle", "AnalysisNewsArticle", "BackgroundNewsArticle", "OpinionNewsArticle", "ReviewNewsArticle"), "news").when(has("BlogPosting", "SatiricalArticle"), "opinion").when(has("TechArticle", "ScholarlyArticle", "Report"), "technical")
        .when(has("Product", "Offer", "Store"), "commercial").when(F.col("og") == "article", "news").when((F.col("page_type") == "article") & F.col("date"), "news").otherwise("unknown")
    )
    return rows.withColumn("page_type", kind).select("fetch_id", "by_url", "page_type", category.alias("category"))


def _page_types_sql() -> str:
    art = ", ".join(f"'{t}'" for t in ARTICLES)
    return f"""
WITH p AS (SELECT DISTINCT fetch_id, paged_url AS url, html FROM {augmented.SQL}),
v AS (SELECT fetch_id, b::JSON AS j FROM (SELECT fetch_id, unnest(regexp_extract_all(html, {H.q(_LD)}, 1)) AS b FROM p) WHERE json_valid(b)),
o AS (SELECT fetch_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS o FROM v),
e AS (SELECT fetch_id, o AS e FROM o UNION ALL SELECT fetch_id, unnest(json_extract(o, '$."@graph"[*]')) FROM o WHERE json_type(o, '$."@graph"') = 'ARRAY'),
ty AS (SELECT fetch_id, list(type) AS types FROM (SELECT fetch_id, unnest(CASE WHEN json_type(e, '$."@type"') = 'ARRAY' THEN json_extract_string(e, '$."@type"[*]') ELSE [json_extract_string(e, '$."@type"')] END) AS type FROM e) WHERE type IS NOT NULL GROUP BY 1),
m AS (SELECT fetch_id, {type_by_url_sql('url')} AS u, coalesce(types, []) AS t, lower(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*property=["'']og:type["''][^>]*content=["'']([^"'']+)["'']', 1), ''), regexp_extract(html, '(?i)<meta[^>]*content=["'']([^"'']+)["''][^>]*property=["'']og:type["'']', 1))) AS og,
  regexp_matches(html, '(?i)<article[\\s>]') AS el, regexp_matches(html, '(?i)<meta[^>]*property=["'']article:published_time["'']') AS pt, regexp_matches(html, '(?i)<[^>]*itemprop=["'']datePublished["'']') AS dp,
  regexp_matches(html, '(?i)<time[\\s>]|itemprop=["'']datePublished["'']|article:published_time') AS dt FROM p LEFT JOIN ty USING (fetch_id)),
k AS (SELECT *, CASE WHEN u IN ('home', 'search', 'tag', 'video_article') THEN u WHEN u = 'author' AND list_has_any(t, ['Person', 'ProfilePage']) THEN 'author' WHEN list_contains(t, 'VideoObject') AND list_has_any(t, [{art}]) THEN 'video_article'
  WHEN list_has_any(t, [{art}]) OR og = 'article' OR el AND pt THEN 'article' WHEN list_has_any(t, ['Person', 'ProfilePage']) AND u <> 'section' THEN 'author' WHEN u = 'article' THEN 'article' WHEN u IN ('unknown', 'section') AND el AND dp THEN 'article' ELSE u END AS page_type FROM m)
SELECT fetch_id, u AS by_url, page_type, CASE WHEN list_has_any(t, ['NewsArticle', 'ReportageNewsArticle', 'AnalysisNewsArticle', 'BackgroundNewsArticle', 'OpinionNewsArticle', 'ReviewNewsArticle']) THEN 'news' WHEN list_has_any(t, ['BlogPosting', 'SatiricalArticle']) THEN 'opinion'
  WHEN list_has_any(t, ['TechArticle', 'ScholarlyArticle', 'Report']) THEN 'technical' WHEN list_has_any(t, ['Product', 'Offer', 'Store']) THEN 'commercial' WHEN og = 'article' THEN 'news' WHEN page_type = 'article' AND dt THEN 'news' ELSE 'unknown' END AS category FROM k
"""


# -- canonical and paging ------------------------------------------------------------------------
def canonical_notes(html: Column, url: Column) -> dict[str, Column]:
    """has_canonical, tier (exact, lenient, clean, path or none of them) and query (tracking, other or none) of html's canonical address against url."""
    c = H.named(html, "link", "rel", "canonical", "href")
    base_c, base_u = U.canonical_base(c), U.canonical_base(url)
    query = lambda x: F.coalesce(U.part(x, 5), F.lit(""))
    same_path = F.coalesce(base_c == base_u, F.lit(False))
    tier = F.when(c.isNull(), None).when(U.canonical_strict(c) == U.canonical_strict(url), "exact").when(U.canonical_lenient(c) == U.canonical_lenient(url), "lenient").when(same_path & (query(c) == "") & (query(url) != ""), "clean").when(same_path, "path").otherwise("none")
    keys = F.transform(F.filter(F.split(query(c), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    policy = F.when(query(c) == "", "none").when(F.exists(keys, lambda k: ~k.isin(*U.CANONICAL_STRIPPED)), "other").otherwise("tracking")
    return {"has_canonical": c.isNotNull(), "tier": tier, "query": F.when(c.isNotNull(), policy)}


def canonical_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address of each page against its own (with paging put on some), in three tiers, and what its query holds."""
    cols = canonical_notes(F.col("html"), F.col("paged_url"))
    return augmented.pages(spark, sf_dir).select("fetch_id", *[c.alias(n) for n, c in cols.items()]).distinct()


def _canonical_sql() -> str:
    c = H.named_sql("html", "link", "rel", "canonical", "href")
    kept = ", ".join(f"'{k}'" for k in U.CANONICAL_STRIPPED)
    raw = lambda e: f"coalesce(nullif(regexp_replace({e}, '/+$', ''), ''), {e})"
    trim = lambda p: f"CASE WHEN {p} = '' THEN '/' ELSE coalesce(nullif(regexp_replace({p}, '/+$', ''), ''), '/') END"
    return f"""
WITH p AS (SELECT DISTINCT fetch_id, paged_url AS u, {c} AS c FROM {augmented.SQL}),
x AS (SELECT *, {U.host_sql('c')} AS hc, {U.host_sql('u')} AS hu, lower({U.part_sql('c', 1)}) || '://' || {U.host_sql('c')} AS oc, lower({U.part_sql('u', 1)}) || '://' || {U.host_sql('u')} AS ou, {U.part_sql('c', 4)} AS pc, {U.part_sql('u', 4)} AS pu, coalesce({U.part_sql('c', 5)}, '') AS qc, coalesce({U.part_sql('u', 5)}, '') AS qu FROM p),
n AS (SELECT *, CASE WHEN hc IS NULL THEN {raw('c')} ELSE oc || {trim('pc')} || CASE WHEN qc = '' THEN '' ELSE '?' || qc END END AS sc, CASE WHEN hu IS NULL THEN {raw('u')} ELSE ou || {trim('pu')} || CASE WHEN qu = '' THEN '' ELSE '?' || qu END END AS su,
  list_sort(list_filter(string_split(qc, '&'), lambda t: t <> '' AND split_part(t, '=', 1) NOT IN ({kept}))) AS kc, list_sort(list_filter(string_split(qu, '&'), lambda t: t <> '' AND split_part(t, '=', 1) NOT IN ({kept}))) AS ku FROM x),
l AS (SELECT *, CASE WHEN hc IS NULL THEN {raw('c')} ELSE oc || {trim('pc')} || CASE WHEN len(kc) = 0 THEN '' ELSE '?' || array_to_string(kc, '&') END END AS lc, CASE WHEN hu IS NULL THEN {raw('u')} ELSE ou || {trim('pu')} || CASE WHEN len(ku) = 0 THEN '' ELSE '?' || array_to_string(ku, '&') END END AS lu FROM n)
SELECT fetch_id, c IS NOT NULL AS has_canonical, CASE WHEN c IS NULL THEN NULL WHEN sc = su THEN 'exact' WHEN lc = lu THEN 'lenient' WHEN hc IS NOT NULL AND oc = ou AND regexp_replace(pc, '/+$', '') = regexp_replace(pu, '/+$', '') THEN CASE WHEN qc = '' AND qu <> '' THEN 'clean' ELSE 'path' END ELSE 'none' END AS tier,
  CASE WHEN c IS NULL THEN NULL WHEN qc = '' THEN 'none' WHEN len(kc) > 0 THEN 'other' ELSE 'tracking' END AS query FROM l
"""


def paging_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging of pages taken as sections (others have none): rel=next/prev and page numbers in the address, and whether the canonical address keeps
    to the page itself (ok), points to the first page (not ok) or elsewhere (a note)."""
    html, url = F.col("html"), F.col("paged_url")
    rel = lambda v: F.exists(H.tags(html, "link"), lambda a: F.coalesce(F.lower(H.attr(a, "rel")) == v, F.lit(False)))
    linked, label = rel("next") | rel("prev"), U.page_token(url)
    c = H.named(html, "link", "rel", "canonical", "href")
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    to = F.when(label.isNull() | c.isNull(), None).when(bare(c) == bare(url), "self").when(bare(c) == bare(U.without_page(url)), "base").otherwise("other")
    of = F.expr("fetch_id % 3 <> 2")
    pattern = F.nullif(F.concat_ws(" + ", F.when(linked, "rel=next/prev"), label), F.lit(""))
    rows = augmented.pages(spark, sf_dir).select("fetch_id", F.when(of, pattern).alias("pattern"), F.when(of, to).alias("canonical_to")).distinct()
    return rows.select("fetch_id", F.col("pattern").isNotNull().alias("detected"), "pattern", "canonical_to", F.coalesce(F.col("canonical_to") != "base", F.lit(True)).alias("policy_ok"))


def _paging_sql() -> str:
    c = H.named_sql("html", "link", "rel", "canonical", "href")
    rel = lambda v: f"len(list_filter({H.tags_sql('html', 'link')}, lambda a: lower({H.attr_sql('a', 'rel')}) = '{v}')) > 0"
    # the paging put on is taken off again by its own three forms
    first = "CASE fetch_id % 5 WHEN 0 THEN regexp_replace(u, '\\?page=2$', '') WHEN 1 THEN regexp_replace(u, '/page/3$', '') WHEN 2 THEN regexp_replace(u, '&p=4$', '') END"
    return f"""
WITH p AS (SELECT DISTINCT fetch_id, paged_url AS u, regexp_replace({c}, '/+$', '') AS c, {rel('next')} OR {rel('prev')} AS linked, CASE fetch_id % 5 WHEN 0 THEN '?page=N' WHEN 1 THEN '/page/N' WHEN 2 THEN '?p=N' END AS label FROM {augmented.SQL}),
q AS (SELECT fetch_id, CASE WHEN linked AND label IS NOT NULL THEN 'rel=next/prev + ' || label WHEN linked THEN 'rel=next/prev' ELSE label END AS pattern, CASE WHEN label IS NULL OR c IS NULL THEN NULL WHEN c = regexp_replace(u, '/+$', '') THEN 'self' WHEN c = regexp_replace({first}, '/+$', '') THEN 'base' ELSE 'other' END AS t FROM p)
SELECT fetch_id, fetch_id % 3 <> 2 AND pattern IS NOT NULL AS detected, CASE WHEN fetch_id % 3 <> 2 THEN pattern END AS pattern, CASE WHEN fetch_id % 3 <> 2 THEN t END AS canonical_to, fetch_id % 3 = 2 OR t IS NULL OR t <> 'base' AS policy_ok FROM q
"""


def registry() -> tuple[dict, dict[str, str]]:
    pairs = {
        "page_states": (page_states, PAGE_STATES_SQL), "network_errors": (network_errors, NETWORK_ERRORS_SQL), "challenges": (challenges, CHALLENGES_SQL), "structured_data": (structured_data, _structured_sql()),
        "page_types": (page_types, _page_types_sql()), "canonical_check": (canonical_check, _canonical_sql()), "paging_check": (paging_check, _paging_sql()),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
