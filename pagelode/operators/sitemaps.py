"""Robots and sitemap files of sites: what a crawl may fetch, what each file is, which sitemap counts, what indexes lead to, and news sitemaps.

Input is a table of fetched site files (site, url, source, ordinal, http_status, content_type, body).  No such table is
delivered, so ``site_files`` makes one out of the sites, with the cases decided by the site's number; the operators don't
know.  Its SQL text is one for both dialects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import q
from ..session import load, scratch

#: The moment ages are counted from.
AS_OF = "2024-07-01 00:00:00"
_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _url(loc: str, lastmod: str = "") -> str:
    return f"<url><loc>{loc}</loc>" + (f"<lastmod>{lastmod}</lastmod>" if lastmod else "") + "</url>"


def _news(loc: str, date: str = "", title: str = "") -> str:
    return f"<url><loc>{loc}</loc><news:news><news:publication><news:name>N</news:name></news:publication>" + (f"<news:publication_date>{date}</news:publication_date>" if date else "") + (f"<news:title>{title}</news:title>" if title else "") + "</news:news></url>"


_CHALLENGE = '<html><head><title>Just a moment...</title></head><body><script>window._cf_chl_opt = 1</script></body></html>'
#: source -> (path, status and body by cases of the site's number n; {d} stands for its domain)
_FILES = {
    "robots": ("/robots.txt", "CASE n % 9 WHEN 7 THEN 403 WHEN 8 THEN 404 ELSE 200 END", {
        4: ("User-agent: *\nDisallow: /tag # internal\nAllow: /tag/1\n\nUser-agent: crawl\nDisallow: /jobs\nSitemap: https://{d}/sitemap.xml\nSitemap: ftp://{d}/no.xml", "user-agent: a\nUser-Agent: b\nDisallow: /x\nallow:\nDisallow:\n# sitemap: https://{d}/no.xml\nSITEMAP:http://{d}/sitemap.xml",
            "User-agent: *\nDisallow: /\n", "nothing here\nDisallow: /lost\nUser-agent: other\nAllow: /o\n"),
    }),
    "sitemap": ("/sitemap.xml", "CASE n % 8 WHEN 3 THEN 403 WHEN 4 THEN 404 ELSE 200 END", {
        8: (f"<urlset {_NS}>" + _url("https://{d}/a", "2024-06-30") + _url("https://{d}/b", "June") + _url("ftp://{d}/c") + "</urlset>",
            f"<sitemapindex {_NS}><sitemap><loc>https://{{d}}/child-1.xml</loc></sitemap><sitemap><loc> https://{{d}}/child-2.xml </loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><lastmod>x</lastmod></sitemap></sitemapindex>",
            "<!doctype html><html><body>Home</body></html>", "denied", "gone", f"<urlset {_NS}><url></url><url><lastmod>2024-01-01</lastmod></url>" + _url("https://{d}/a") + "</urlset>", _CHALLENGE, "plain words"),
    }),
    "news": ("/news-sitemap.xml", "CASE n % 4 WHEN 3 THEN 500 ELSE 200 END", {
        4: ("<urlset xmlns:news=\"http://www.google.com/schemas/sitemap-news/0.9\">" + _news("https://{d}/n1", "2024-07-02T12:00:00Z", "T1") + _news("https://{d}/n2", "2024-06-20", "T2") + "</urlset>",
            "<urlset xmlns:news=\"x\">" + _news("https://{d}/n1") + _news("https://{d}/n2", "2024-06-02") + _news("https://{d}/n3", "soon") + "</urlset>",
            "<urlset>" + _url("https://{d}/g1") + _url("https://{d}/g2") + _url("https://{d}/g3", "2024-06-30") + "</urlset>", "oops"),
    }),
    "child1": ("/child-1.xml", "CASE n % 5 WHEN 4 THEN 404 ELSE 200 END", {1: ("<urlset>" + _url("https://{d}/1", "2024-06-29") + _url("https://{d}/2") + "</urlset>",)}),
    "child2": ("/child-2.xml", "200", {2: ("<sitemapindex><sitemap><loc>https://{d}/child-3.xml</loc></sitemap><sitemap><loc>https://{d}/child-1.xml</loc></sitemap></sitemapindex>", "<sitemapindex></sitemapindex>")}),
    "child3": ("/child-3.xml", "200", {1: ("<urlset>" + _url("https://{d}/3") + "</urlset>",)}),
}


def _files_sql() -> str:
    """One SELECT per file; the text is the same in both dialects (line breaks are written as chr(10))."""
    parts = []
    for i, (source, (path, status, bodies)) in enumerate(_FILES.items()):
        ((modulus, texts),) = bodies.items()
        lit = lambda t: "'" + t.replace("\n", "' || chr(10) || '").replace("{d}", "' || d || '") + "'"
        body = "CASE n % " + str(modulus) + " " + " ".join(f"WHEN {k} THEN {lit(t)}" for k, t in enumerate(texts)) + " END"
        parts.append(f"SELECT d AS site, 'https://' || d || '{path}' AS url, '{source}' AS source, {i} AS ordinal, {status} AS http_status, {body} AS body FROM s")
    return " UNION ALL ".join(parts)


SITES = "SELECT DISTINCT lower(domain) AS d, CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) AS n FROM sites WHERE domain IS NOT NULL"
FILES_SQL = f"WITH s AS ({SITES}), f AS ({_files_sql()})"


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "sites").select(F.lower("domain").alias("d"), F.regexp_extract("id", "([0-9]+)", 1).cast("bigint").alias("n")).where("d is not null").distinct()
    out = None
    for part in _files_sql().split(" UNION ALL "):
        cols = part.removeprefix("SELECT ").removesuffix(" FROM s")
        one = rows.selectExpr(*_columns_of(cols))
        out = one if out is None else out.unionByName(one)
    return out


def _columns_of(cols: str) -> list[str]:
    """The column expressions of one file's SELECT, which are known by their names."""
    names = ["site", "url", "source", "ordinal", "http_status", "body"]
    out, rest = [], cols
    for name in names:
        text, _, rest = rest.partition(f" AS {name}")
        out.append(f"{text.removeprefix(', ')} AS {name}")
    return out


# -- what a file is ------------------------------------------------------------------------------
_GATE = r"(?i)window\._cf_chl_opt\b|<title>\s*Just a moment\.\.\.\s*</title>|/cdn-cgi/challenge-platform/|id=\"cf-browser-verification\"|class=\"cf-turnstile\""
_URL_BLOCK, _MAP_BLOCK = r"(?is)<url[\s>].*?</url>", r"(?is)<sitemap[\s>].*?</sitemap>"
_LOC, _LASTMOD = r"(?is)<loc[^>]*>(.*?)</loc>", r"(?is)<lastmod[^>]*>(.*?)</lastmod>"
_CHILD = r"(?is)<sitemap[\s>].*?<loc[^>]*>(.*?)</loc>"
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?([+-]\d{2}:\d{2}|Z)?)?$"
_NEWS_TAGS = ("news:publication", "news:publication_date", "news:title")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def root_of(body: Column) -> Column:
    return F.when(body.rlike(r"(?i)<urlset[\s>]"), "urlset").when(body.rlike(r"(?i)<sitemapindex[\s>]"), "sitemapindex")


def sitemap_facts(files: DataFrame) -> DataFrame:
    """files with root, n_entries, share of entries without an address, n_urls, lastmod_pct, and their status in the order: refused, not found, failed,
    gate, web page, no root, more than half the entries without an address, found.  A refused file with an XML root counts as readable."""
    b, s = F.col("body"), F.col("http_status")
    root = root_of(b)
    blocks = F.when(root == "urlset", F.regexp_extract_all(b, F.lit(_URL_BLOCK), F.lit(0))).otherwise(F.regexp_extract_all(b, F.lit(_MAP_BLOCK), F.lit(0)))
    n_urls = F.regexp_count(b, F.lit(r"(?i)<url[\s>]"))
    rows = files.withColumn("root", root).withColumn("blocks", F.when(root.isNotNull(), blocks).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_entries", F.size("blocks")).withColumn("n_lost", F.size(F.filter("blocks", lambda x: _trim(F.regexp_extract(x, _LOC, 1)) == "")))
    bad = F.size(F.filter(F.regexp_extract_all(b, F.lit(_LASTMOD), F.lit(1)), lambda x: ~_trim(x).rlike(_ISO)))
    odd = F.size(F.filter("blocks", lambda x: (_trim(F.regexp_extract(x, _LOC, 1)) != "") & ~_trim(F.regexp_extract(x, _LOC, 1)).rlike("(?i)^https?://")))
    status = (
        F.when(s.isin(401, 403) & F.col("root").isNull(), "BLOCKED").when(s.isin(404, 410), "NOT_FOUND").when(~s.between(200, 299) & ~s.isin(401, 403), "ERROR").when(b.rlike(_GATE), "BOT_PROTECTION")
        .when(F.col("root").isNull(), F.when(b.rlike(r"(?i)^\s*<!doctype\s+html"), "SOFT_404").otherwise("INVALID_XML")).when(F.col("n_lost") > 0.5 * F.col("n_entries"), "INVALID_FORMAT").otherwise("FOUND")
    )
    return rows.select(
        *files.columns, "root", "n_entries", "n_lost", odd.alias("n_odd"), bad.alias("n_bad_dates"), b.rlike(r"(?i)xmlns\s*=\s*[\"']http://www\.sitemaps\.org/schemas/sitemap/0\.9[\"']").alias("has_namespace"), n_urls.alias("n_urls"),
        F.when(n_urls > 0, F.floor(F.regexp_count(b, F.lit(r"(?i)<lastmod[\s>]")) * 100.0 / n_urls + 0.5)).otherwise(0).cast("bigint").alias("lastmod_pct"), status.alias("status"),
    )


def sitemap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sitemap file with what it is and how far it keeps to the format."""
    rows = sitemap_facts(site_files(spark, sf_dir).where("source <> 'robots'"))
    as_big = [F.col(c).cast("bigint").alias(c) for c in ("n_entries", "n_lost", "n_odd", "n_bad_dates", "n_urls", "lastmod_pct")]
    return rows.select("site", "url", "root", "status", "has_namespace", *as_big)


_FACTS = f"""fx AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)<urlset[\\s>]') THEN 'urlset' WHEN regexp_matches(body, '(?i)<sitemapindex[\\s>]') THEN 'sitemapindex' END AS root FROM f WHERE source <> 'robots'),
fb AS (SELECT *, CASE root WHEN 'urlset' THEN regexp_extract_all(body, {q(_URL_BLOCK)}) WHEN 'sitemapindex' THEN regexp_extract_all(body, {q(_MAP_BLOCK)}) ELSE [] END AS blocks, len(regexp_extract_all(body, '(?i)<url[\\s>]')) AS n_urls FROM fx),
fl AS (SELECT *, list_transform(blocks, lambda x: trim(regexp_extract(x, {q(_LOC)}, 1))) AS locs FROM fb),
fs AS (SELECT *, len(blocks) AS n_entries, len(list_filter(locs, lambda x: x = '')) AS n_lost, len(list_filter(locs, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^https?://'))) AS n_odd,
  len(list_filter(regexp_extract_all(body, {q(_LASTMOD)}, 1), lambda x: NOT regexp_matches(trim(x), {q(_ISO)}))) AS n_bad_dates,
  CAST(CASE WHEN n_urls > 0 THEN floor(len(regexp_extract_all(body, '(?i)<lastmod[\\s>]')) * 100.0::DOUBLE / n_urls + 0.5) ELSE 0 END AS BIGINT) AS lastmod_pct FROM fl),
facts AS (SELECT *, CASE WHEN http_status IN (401, 403) AND root IS NULL THEN 'BLOCKED' WHEN http_status IN (404, 410) THEN 'NOT_FOUND' WHEN NOT http_status BETWEEN 200 AND 299 AND http_status NOT IN (401, 403) THEN 'ERROR' WHEN regexp_matches(body, {q(_GATE)}) THEN 'BOT_PROTECTION'
  WHEN root IS NULL THEN CASE WHEN regexp_matches(body, '(?i)^\\s*<!doctype\\s+html') THEN 'SOFT_404' ELSE 'INVALID_XML' END WHEN n_lost > 0.5 * n_entries THEN 'INVALID_FORMAT' ELSE 'FOUND' END AS status FROM fs)"""
STATUS_SQL = f"{FILES_SQL}, {_FACTS} SELECT site, url, root, status, contains(body, 'xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"') AS has_namespace, CAST(n_entries AS BIGINT) AS n_entries, CAST(n_lost AS BIGINT) AS n_lost, CAST(n_odd AS BIGINT) AS n_odd, CAST(n_bad_dates AS BIGINT) AS n_bad_dates, CAST(n_urls AS BIGINT) AS n_urls, lastmod_pct FROM facts"


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarser classes of a discovery: gate first, then the answer's status, then a root, a web page, anything else."""
    b, s = F.col("body"), F.col("http_status")
    kind = (
        F.when(b.rlike(_GATE), "CHALLENGE").when(s.isin(401, 403), "BLOCKED").when(s == 404, "NOT_FOUND").when(s >= 500, "ERROR")
        .when(s.between(200, 299), F.when(b.rlike(r"(?i)<(?:urlset|sitemapindex)[\s>]"), "FOUND").when(b.rlike(r"(?i)<html[\s>]"), "CONTENT_MISMATCH").otherwise("SOFT_404")).otherwise("ERROR")
    )
    return site_files(spark, sf_dir).where("source <> 'robots'").select("site", "url", kind.alias("class"))


CLASSES_SQL = f"""{FILES_SQL} SELECT site, url, CASE WHEN regexp_matches(body, {q(_GATE)}) THEN 'CHALLENGE' WHEN http_status IN (401, 403) THEN 'BLOCKED' WHEN http_status = 404 THEN 'NOT_FOUND' WHEN http_status BETWEEN 200 AND 299 THEN
  CASE WHEN regexp_matches(body, '(?i)<(urlset|sitemapindex)[\\s>]') THEN 'FOUND' WHEN regexp_matches(body, '(?i)<html[\\s>]') THEN 'CONTENT_MISMATCH' ELSE 'SOFT_404' END ELSE 'ERROR' END AS class FROM f WHERE source <> 'robots'"""

# -- robots --------------------------------------------------------------------------------------
_LINE = r"^(?i)({})\s*:\s*(.*)$"


def _robots_lines(files: DataFrame) -> DataFrame:
    """(site, ordinal, line) of readable robots files, comments and blanks off."""
    lines = files.where("source = 'robots' and http_status between 200 and 299").select("site", F.posexplode(F.split("body", r"\r?\n")).alias("ordinal", "raw"))
    return lines.withColumn("line", _trim(F.regexp_replace("raw", "#.*$", "")))


def robots_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: what its robots file is, how many groups have rules (of several agents in a row the last keeps them), its sitemaps, and whether everything is closed to all."""
    files = site_files(spark, sf_dir)
    lines = _robots_lines(files).where("line <> ''").select("site", "ordinal", F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)).alias("key"), _trim(F.regexp_replace("line", r"^[A-Za-z-]+\s*:", "")).alias("value"))
    agent = F.when(F.col("key") == "user-agent", F.struct("ordinal", "value"))
    under = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(Window.partitionBy("site").orderBy("ordinal")))
    rules = under.where("key in ('allow', 'disallow') and value <> '' and agent is not null")
    per = rules.groupBy("site").agg(F.count_distinct("agent.ordinal").alias("n_groups"), F.bool_or((F.col("agent.value") == "*") & (F.col("key") == "disallow") & (F.col("value") == "/")).alias("closed"))
    maps = lines.where("key = 'sitemap' and value rlike '(?i)^https?://'").groupBy("site").agg(F.count("*").alias("n_sitemaps"))
    s = F.col("http_status")
    status = F.when(s.isin(401, 403), "BLOCKED").when(s.isin(404, 410), "NOT_FOUND").when(~s.between(200, 299), "ERROR").when(F.col("body").rlike(_GATE), "BOT_PROTECTION").otherwise("FOUND")
    own = files.where("source = 'robots'").select("site", status.alias("status"))
    return own.join(per, "site", "left").join(maps, "site", "left").select("site", "status", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_sitemaps", F.lit(0)).alias("n_sitemaps"), F.coalesce("closed", F.lit(False)).alias("closed"))


ROBOTS_SQL = f"""{FILES_SQL}, r AS (SELECT site, http_status, body FROM f WHERE source = 'robots'),
l AS (SELECT site, unnest(range(len(x))) AS o, trim(regexp_replace(unnest(x), '#.*$', '')) AS line FROM (SELECT site, string_split(body, chr(10)) AS x FROM r WHERE http_status BETWEEN 200 AND 299)),
k AS (SELECT site, o, lower(regexp_extract(line, '^([A-Za-z-]+)\\s*:', 1)) AS key, trim(regexp_replace(line, '^[A-Za-z-]+\\s*:', '')) AS value FROM l WHERE line <> ''),
a AS (SELECT *, max(CASE WHEN key = 'user-agent' THEN o END) OVER (PARTITION BY site ORDER BY o) AS ao FROM k),
u AS (SELECT a.*, g.value AS agent FROM a JOIN k g ON g.site = a.site AND g.o = a.ao WHERE a.key IN ('allow', 'disallow') AND a.value <> '')
SELECT site, CASE WHEN http_status IN (401, 403) THEN 'BLOCKED' WHEN http_status IN (404, 410) THEN 'NOT_FOUND' ELSE 'FOUND' END AS status, (SELECT count(DISTINCT ao) FROM u WHERE u.site = r.site) AS n_groups,
 (SELECT count(*) FROM k WHERE k.site = r.site AND key = 'sitemap' AND regexp_matches(value, '(?i)^https?://')) AS n_sitemaps, coalesce((SELECT bool_or(agent = '*' AND key = 'disallow' AND value = '/') FROM u WHERE u.site = r.site), false) AS closed FROM r"""

#: Who crawls, in lower case.
AGENT = "mozilla/5.0 (compatible; audit-crawler/1.0)"


def merged_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """(site, ordinal, kind, path): rules under any agent line that is *, the crawler's name or a part of it.  Only the nearest line above counts; comments stay, as this reading has it."""
    lines = files.where("source = 'robots' and http_status between 200 and 299").select("site", F.posexplode(F.split("body", "\n")).alias("ordinal", "raw")).withColumn("line", _trim("raw"))
    low = F.lower("line")
    name = F.when(low.startswith("user-agent:"), _trim(F.substring(low, 12, 2**31 - 1)))
    under = lines.withColumn("agent", F.last(name, ignorenulls=True).over(Window.partitionBy("site").orderBy("ordinal")))
    ours = under.where((F.col("agent") == "*") | F.lit(agent).contains(F.col("agent")))
    kind = F.when(F.lower("line").startswith("disallow:"), "disallow").when(F.lower("line").startswith("allow:"), "allow")
    return ours.select("site", "ordinal", kind.alias("kind"), _trim(F.regexp_replace("line", r"(?i)^(?:dis)?allow:\s*", "")).alias("path")).where("kind is not null and path <> ''")


def may_fetch(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed): the longest rule that the path starts with wins, the first of equals; none allows."""
    rows = urls.select("url", U.host(F.col("url")).alias("site"), U.path(F.col("url")).alias("p")).where("url is not null").distinct()
    hit = F.when(F.col("p").startswith(F.col("path")), F.struct(F.length("path").alias("l"), (-F.col("ordinal")).alias("o"), "kind"))
    return rows.join(rules, "site", "left").groupBy("url").agg(F.max(hit).alias("m")).select("url", (F.coalesce(F.col("m.kind"), F.lit("allow")) == "allow").alias("allowed"))


def crawl_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return may_fetch(load(spark, sf_dir, "fetch_results"), merged_rules(site_files(spark, sf_dir)))


MERGED_SQL = f"""l AS (SELECT site, unnest(range(len(x))) AS o, trim(unnest(x)) AS line FROM (SELECT site, string_split(body, chr(10)) AS x FROM f WHERE source = 'robots' AND http_status BETWEEN 200 AND 299)),
ag AS (SELECT site, o AS start, lead(o, 1, 1000000) OVER (PARTITION BY site ORDER BY o) AS until, trim(substr(lower(line), 12)) AS agent FROM l WHERE starts_with(lower(line), 'user-agent:')),
rules AS (SELECT l.site, l.o, CASE WHEN starts_with(lower(line), 'dis') THEN 'disallow' ELSE 'allow' END AS kind, trim(regexp_replace(line, '(?i)^(dis)?allow:\\s*', '')) AS path FROM l JOIN ag ON ag.site = l.site AND l.o > start AND l.o < until WHERE (agent = '*' OR contains('{AGENT}', agent)) AND regexp_matches(line, '(?i)^(dis)?allow:') AND trim(regexp_replace(line, '(?i)^(dis)?allow:\\s*', '')) <> '')"""
ALLOWED_SQL = f"""{FILES_SQL}, {MERGED_SQL}, u AS (SELECT DISTINCT url, {U.host_sql('url')} AS site, {U.path_sql('url')} AS p FROM fetch_results WHERE url IS NOT NULL),
m AS (SELECT url, arg_max(kind, (length(path), -o)) AS kind FROM u JOIN rules USING (site) WHERE starts_with(p, path) GROUP BY url)
SELECT url, coalesce(kind, 'allow') = 'allow' AS allowed FROM u LEFT JOIN m USING (url)"""

# -- which sitemap counts ------------------------------------------------------------------------
#: Paths tried after what robots declares, in order.
PATHS = ("/sitemap.xml", "/news-sitemap.xml", "/child-1.xml")
_PRECEDENCE = ("BOT_PROTECTION", "BLOCKED", "INVALID_FORMAT", "INVALID_XML", "SOFT_404", "ERROR", "NOT_FOUND")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, source, place): sitemap addresses to try, in order: what robots declares, each followed by its form in the other scheme, then known
    paths in both schemes; of addresses alike but for case and trailing slashes the first."""
    files = site_files(spark, sf_dir)
    declared = _robots_lines(files).where("line rlike '(?i)^sitemap\\\\s*:'").select("site", "ordinal", _trim(F.regexp_replace("line", r"(?i)^sitemap\s*:", "")).alias("u")).where("u rlike '(?i)^https?://'")
    declared = declared.select("site", F.lit("robots").alias("source"), F.col("ordinal").alias("a"), F.posexplode(F.array("u", U.other_scheme(F.col("u")))).alias("b", "url"))
    known = files.select("site").distinct().select("site", F.lit("path").alias("source"), F.posexplode(F.array(*map(F.lit, PATHS))).alias("a", "p"))
    known = known.select("site", "source", (F.col("a") + 10_000).alias("a"), F.posexplode(F.array(F.concat(F.lit("https://"), "site", "p"), F.concat(F.lit("http://"), "site", "p"))).alias("b", "url"))
    every = declared.unionByName(known).withColumn("key", F.regexp_replace(F.lower("url"), "/+$", ""))
    once = every.groupBy("site", "key").agg(F.min(F.struct("a", "b", "url", "source")).alias("m"))
    return once.select("site", "m.url", "m.source", (F.col("m.a") * 2 + F.col("m.b")).alias("place"))


def sitemap_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site the sitemap that counts: the first candidate found; else, if robots declared any, its first, as it is if refused or gated and as merely
    DISCOVERED otherwise; else the first of the most telling failure.  Candidates that weren't fetched failed."""
    facts = sitemap_facts(site_files(spark, sf_dir).where("source <> 'robots'")).select("url", "status")
    tried = candidates(spark, sf_dir).join(facts, "url", "left").withColumn("status", F.coalesce("status", F.lit("ERROR")))
    rank = F.array_position(F.array(*map(F.lit, _PRECEDENCE)), F.col("status"))
    robots = F.col("source") == "robots"
    choice = F.struct(
        F.when(F.col("status") == "FOUND", 0).when(robots, 1).otherwise(2).alias("step"), F.when((F.col("status") == "FOUND") | robots, 0).otherwise(rank).alias("rank"), "place", "url",
        F.when(robots & ~F.col("status").isin("FOUND", "BLOCKED", "BOT_PROTECTION"), "DISCOVERED").otherwise(F.col("status")).alias("status"),
    )
    return tried.groupBy("site").agg(F.min(choice).alias("c"), F.count("*").alias("n_tried")).select("site", "n_tried", "c.url", "c.status")


CHOICE_SQL = f"""{FILES_SQL}, {_FACTS},
rl AS (SELECT site, unnest(range(len(x))) AS o, trim(regexp_replace(unnest(x), '#.*$', '')) AS line FROM (SELECT site, string_split(body, chr(10)) AS x FROM f WHERE source = 'robots' AND http_status BETWEEN 200 AND 299)),
de AS (SELECT site, o, trim(regexp_replace(line, '(?i)^sitemap\\s*:', '')) AS u FROM rl WHERE regexp_matches(line, '(?i)^sitemap\\s*:')),
c AS (SELECT site, 'robots' AS source, o * 2 AS place, u AS url FROM de WHERE starts_with(lower(u), 'http') UNION ALL SELECT site, 'robots', o * 2 + 1, CASE WHEN starts_with(u, 'https://') THEN 'http://' || u[9:] ELSE 'https://' || u[8:] END FROM de WHERE starts_with(lower(u), 'http')
  UNION ALL SELECT d, 'path', (10000 + i) * 2 + j, s || '://' || d || p FROM s AS sites_, (VALUES (0, '/sitemap.xml'), (1, '/news-sitemap.xml'), (2, '/child-1.xml')) AS paths(i, p), (VALUES (0, 'https'), (1, 'http')) AS schemes(j, s)),
o AS (SELECT site, arg_min(url, place) AS url, arg_min(source, place) AS source, min(place) AS place FROM c GROUP BY site, regexp_replace(lower(url), '/+$', '')),
t AS (SELECT o.*, coalesce(facts.status, 'ERROR') AS status FROM o LEFT JOIN facts USING (url)),
r AS (SELECT *, CASE WHEN status = 'FOUND' THEN 0 WHEN source = 'robots' THEN 1 ELSE 1 + list_position(['BOT_PROTECTION', 'BLOCKED', 'INVALID_FORMAT', 'INVALID_XML', 'SOFT_404', 'ERROR', 'NOT_FOUND'], status) END AS step FROM t)
SELECT site, count(*) AS n_tried, arg_min(url, (step, place)) AS url, arg_min(CASE WHEN source = 'robots' AND status NOT IN ('FOUND', 'BLOCKED', 'BOT_PROTECTION') THEN 'DISCOVERED' ELSE status END, (step, place)) AS status FROM r GROUP BY site"""


#: How many files a discovery looks at per site, as the feature has it.
MOST_FILES = 20


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, place, source, url, class): the files a discovery looks at, in order: what robots declares, what the site's pages link to, known paths in both schemes; alike ones once."""
    from ..plans.report import discovery_links

    first = candidates(spark, sf_dir).select("site", "url", "source", F.struct(F.when(F.col("source") == "robots", 0).otherwise(2).alias("step"), F.col("place").cast("string").alias("a"), F.col("place").cast("bigint").alias("b")).alias("o"))
    linked = discovery_links(spark, sf_dir).where("kind = 'sitemap'").select(U.host(F.col("url")).alias("site"), "url", F.lit("html").alias("source"), F.struct(F.lit(1).alias("step"), F.col("url").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("o")).where("site is not null")
    order = F.struct("o.step", F.when(F.col("o.step") == 1, F.col("o.a")).otherwise("").alias("a"), "o.b")
    every = first.unionByName(linked).select("site", "url", "source", order.alias("o"), F.regexp_replace(F.lower("url"), "/+$", "").alias("key"))
    once = every.groupBy("site", "key").agg(F.min(F.struct("o", "url", "source")).alias("m")).select("site", "m.o", "m.url", "m.source")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("o", "url"))).where(F.col("place") <= MOST_FILES)
    return ranked.join(file_classes(spark, sf_dir).select("url", "class"), "url", "left").select("site", F.col("place").cast("bigint").alias("place"), "source", "url", F.coalesce("class", F.lit("ERROR")).alias("class"))


def _discovery_sql() -> str:
    from ..plans.report import _discovery_sql as linked

    head = CHOICE_SQL[: CHOICE_SQL.index("\nt AS (SELECT o.*")].rstrip().rstrip(",")
    return head + f""",
dl AS ({linked()}),
al AS (SELECT site, url, source, CASE source WHEN 'robots' THEN 0 ELSE 2 END AS step, '' AS a, place AS b FROM o UNION ALL SELECT {U.host_sql('url')}, url, 'html', 1, url, 0 FROM dl WHERE kind = 'sitemap' AND {U.host_sql('url')} IS NOT NULL),
on1 AS (SELECT site, arg_min(url, (step, a, b, url)) AS url, arg_min(source, (step, a, b, url)) AS source, min((step, a, b)) AS k FROM al GROUP BY site, regexp_replace(lower(url), '/+$', '')),
rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k, url) AS place FROM on1),
cl AS ({CLASSES_SQL[len(FILES_SQL):]})
SELECT rk.site, place, source, rk.url, coalesce(cl.class, 'ERROR') AS class FROM rk LEFT JOIN cl USING (url) WHERE place <= {MOST_FILES}"""


# -- indexes -------------------------------------------------------------------------------------
def expand(files: DataFrame, most_depth: int = 3) -> DataFrame:
    """(site, url, depth, parent): files reached from the sitemaps, indexes followed level by level, each file once at its least depth.

    files: (site, url, root, body, source).  Levels are written to the shared folder."""
    kids = files.where("root = 'sitemapindex'").select("site", F.col("url").alias("parent"), F.explode(F.regexp_extract_all("body", F.lit(_CHILD), F.lit(1))).alias("url")).withColumn("url", _trim("url")).where("url <> ''").distinct()
    kids = scratch(kids, "children")
    level = scratch(files.where("source in ('sitemap', 'news')").select("site", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "level")
    seen = level
    for depth in range(1, most_depth + 1):
        found = kids.join(level.select("site", F.col("url").alias("parent")), ["site", "parent"]).groupBy("site", "url").agg(F.min("parent").alias("parent"))
        level = scratch(found.join(seen.select("site", "url"), ["site", "url"], "left_anti").select("site", "url", F.lit(depth).alias("depth"), "parent"), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site_files(spark, sf_dir).where("source <> 'robots'").withColumn("root", F.when(F.col("http_status").between(200, 299), root_of(F.col("body"))))
    return expand(rows).withColumn("depth", F.col("depth").cast("bigint"))


INDEX_SQL = FILES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k AS (SELECT DISTINCT site, url AS parent, trim(unnest(regexp_extract_all(body, {q(_CHILD)}, 1))) AS url FROM f WHERE source <> 'robots' AND http_status BETWEEN 200 AND 299 AND regexp_matches(body, '(?i)<sitemapindex[\\s>]')),
w AS (SELECT site, url, 0::BIGINT AS depth, NULL::VARCHAR AS parent FROM f WHERE source IN ('sitemap', 'news') UNION ALL SELECT k.site, k.url, w.depth + 1, k.parent FROM w JOIN k ON k.site = w.site AND k.parent = w.url WHERE w.depth < 3)
SELECT site, url, min(depth) AS depth, arg_min(parent, (depth, parent)) AS parent FROM w GROUP BY site, url"""


def index_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five children of each site's index, as the feature asks, with their answer, root, addresses and share with a date."""
    files = scratch(sitemap_facts(site_files(spark, sf_dir).where("source <> 'robots'")), "facts")
    kids = files.where("source = 'sitemap' and root = 'sitemapindex'").select("site", F.posexplode(F.slice(F.filter(F.transform(F.regexp_extract_all("body", F.lit(_CHILD), F.lit(1)), _trim), lambda x: x != ""), 1, 5)).alias("place", "url"))
    return kids.join(files.select("url", "http_status", "root", "n_urls", "lastmod_pct"), "url", "left").select("site", F.col("place").cast("bigint").alias("place"), "url", F.coalesce("http_status", F.lit(0)).cast("bigint").alias("http_status"), "root", F.coalesce("n_urls", F.lit(0)).cast("bigint").alias("n_urls"), F.coalesce("lastmod_pct", F.lit(0)).alias("lastmod_pct"))


CHILDREN_SQL = f"""{FILES_SQL}, {_FACTS}, k AS (SELECT site, unnest(range(len(x))) AS place, trim(unnest(x)) AS url FROM (SELECT site, regexp_extract_all(body, {q(_CHILD)}, 1)[1:5] AS x FROM facts WHERE source = 'sitemap' AND root = 'sitemapindex'))
SELECT k.site, k.place, k.url, CAST(coalesce(http_status, 0) AS BIGINT) AS http_status, root, CAST(coalesce(n_urls, 0) AS BIGINT) AS n_urls, coalesce(lastmod_pct, 0) AS lastmod_pct FROM k LEFT JOIN facts ON facts.url = k.url"""


# -- news ----------------------------------------------------------------------------------------
def read_time(text: Column) -> Column:
    """A date text as a timestamp: ISO dates and times; NULL for others."""
    t = F.regexp_replace(text, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mmXXX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def news_entries(files: DataFrame) -> DataFrame:
    """(site, url, place, loc, lastmod, published, title) of the entries of readable news sitemaps."""
    blocks = files.where("http_status between 200 and 299 and (body like '%xmlns:news=%' or body like '%<news:%')").select("site", "url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<url[^>]*>(.*?)</url>"), F.lit(1))).alias("place", "b"))
    get = lambda tag: F.nullif(_trim(F.regexp_extract("b", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return blocks.select("site", "url", "place", get("loc").alias("loc"), get("lastmod").alias("lastmod"), get("news:publication_date").alias("published"), get("news:title").alias("title"))


def news_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per news sitemap: entries, entries without date or title, share of entries no older than 48 hours (future ones count), news tags that are missing,
    and the status: WARNING over 1000 entries or under 30 % fresh."""
    files = site_files(spark, sf_dir)
    rows = news_entries(files)
    at = read_time(F.coalesce("published", "lastmod"))
    hours = (F.lit(AS_OF).cast("timestamp").cast("double") - at.cast("double")) / 3600.0
    per = rows.groupBy("site", "url").agg(F.count("*").alias("n"), F.count_if(F.col("published").isNull()).alias("n_undated"), F.count_if(F.col("title").isNull()).alias("n_untitled"), F.count_if(F.coalesce(hours <= 48, F.lit(False))).alias("fresh"))
    lacks = files.select("url", F.array_join(F.array_compact(F.array(*[F.when(~F.col("body").rlike(rf"(?i)<{t}[\s>]"), t) for t in _NEWS_TAGS])), ",").alias("missing_tags"))
    pct = F.floor(F.col("fresh") * 100.0 / F.col("n") + 0.5).cast("bigint")
    return per.join(lacks, "url").select("site", "url", "n", "n_undated", "n_untitled", pct.alias("fresh_pct"), "missing_tags", F.when((F.col("n") > 1000) | (pct < 30), "WARNING").otherwise("PASS").alias("status"))


NEWS_SQL = f"""{FILES_SQL}, e AS (SELECT site, url, body, unnest(regexp_extract_all(body, '(?is)<url[^>]*>(.*?)</url>', 1)) AS b FROM f WHERE http_status BETWEEN 200 AND 299 AND (contains(body, 'xmlns:news=') OR contains(body, '<news:'))),
x AS (SELECT site, url, body, nullif(trim(regexp_extract(b, '(?is)<news:publication_date[^>]*>(.*?)</news:publication_date>', 1)), '') AS p, nullif(trim(regexp_extract(b, '(?is)<news:title[^>]*>(.*?)</news:title>', 1)), '') AS t, nullif(trim(regexp_extract(b, {q(_LASTMOD)}, 1)), '') AS m FROM e),
y AS (SELECT *, coalesce(try_strptime(coalesce(p, m), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(coalesce(p, m), '%Y-%m-%d')) AS moment FROM x),
z AS (SELECT site, url, any_value(body) AS body, count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS n_undated, count(*) FILTER (WHERE t IS NULL) AS n_untitled, count(*) FILTER (WHERE moment >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR) AS fresh FROM y GROUP BY site, url),
w AS (SELECT *, CAST(floor(fresh * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS fresh_pct FROM z)
SELECT site, url, n, n_undated, n_untitled, fresh_pct, array_to_string(list_filter(['news:publication', 'news:publication_date', 'news:title'], lambda t: NOT regexp_matches(body, '(?i)<' || t || '[\\s>]')), ',') AS missing_tags, CASE WHEN n > 1000 OR fresh_pct < 30 THEN 'WARNING' ELSE 'PASS' END AS status FROM w"""


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per news sitemap, with indexing numbers made of the site's number: the index rate in percent and how bad that is: critical under 20 or with nothing in news,
    warning under 50; without numbers a warning unless the sitemap passes; missing tags alone are a warning; NULL if all is well."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("bigint")
    console = load(spark, sf_dir, "sites").select(F.lower("domain").alias("site"), n.alias("k")).where("site is not null").distinct().select("site", F.when(F.col("k") % 5 < 4, 10 + F.col("k") % 7).alias("submitted"), F.when(F.col("k") % 5 < 4, F.col("k") % 11).alias("indexed"), (F.col("k") % 3).alias("in_news"))
    rows = news_sitemaps(spark, sf_dir).join(console, "site", "left")
    rate = F.floor(F.col("indexed") * 1000.0 / F.col("submitted") + 0.5) / 10
    level = F.when(F.col("submitted").isNull() | (F.col("submitted") <= 0), F.when(F.col("status") != "PASS", "warning")).when((F.col("indexed") * 100.0 / F.col("submitted") < 20) | (F.col("in_news") == 0), "critical").when(F.col("indexed") * 100.0 / F.col("submitted") < 50, "warning")
    return rows.select("site", "url", rate.alias("rate"), F.coalesce(level, F.when(F.col("missing_tags") != "", "warning")).alias("severity"))


COMPLIANCE_SQL = NEWS_SQL.replace("SELECT site, url, n, n_undated", ", nw AS (SELECT site, url, n, n_undated", 1) + """),
c AS (SELECT d AS site, CASE WHEN n % 5 < 4 THEN 10 + n % 7 END AS submitted, CASE WHEN n % 5 < 4 THEN n % 11 END AS indexed, n % 3 AS in_news FROM s)
SELECT site, url, floor(indexed * 1000.0::DOUBLE / submitted + 0.5) / 10 AS rate, coalesce(CASE WHEN submitted IS NULL THEN CASE WHEN status <> 'PASS' THEN 'warning' END WHEN indexed * 100.0::DOUBLE / submitted < 20 OR in_news = 0 THEN 'critical' WHEN indexed * 100.0::DOUBLE / submitted < 50 THEN 'warning' END, CASE WHEN missing_tags <> '' THEN 'warning' END) AS severity FROM nw LEFT JOIN c USING (site)"""


def registry() -> tuple[dict, dict[str, str]]:
    pairs = {
        "sitemap_status": (sitemap_status, STATUS_SQL), "file_classes": (file_classes, CLASSES_SQL), "robots_report": (robots_report, ROBOTS_SQL), "crawl_allowed": (crawl_allowed, ALLOWED_SQL), "sitemap_choice": (sitemap_choice, CHOICE_SQL),
        "sitemap_discovery": (discovery, _discovery_sql()), "index_files": (index_files, INDEX_SQL), "index_children": (index_children, CHILDREN_SQL), "news_sitemaps": (news_sitemaps, NEWS_SQL), "news_compliance": (compliance, COMPLIANCE_SQL),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
