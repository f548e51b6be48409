"""Site files: robots.txt rules and their application, sitemap XML into rows, its checks, and candidate picking.

Input is a table (origin, url, body).  No such table is delivered, so ``robots_files`` and
``sitemap_files`` make the bodies out of the sites and pages at hand; the operators don't know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import q
from ..session import load

_BLOCK = r"(?is)<url>(.*?)</url>"
_LOC, _LASTMOD = r"(?is)<loc>\s*(.*?)\s*</loc>", r"(?is)<lastmod>\s*(.*?)\s*</lastmod>"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, body): a robots.txt per site that closes the first two page kinds of its runs, by the site's number."""
    rows = load(spark, sf_dir, "sites").select("id", "domain").where("domain is not null").distinct()
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("bigint") % 3
    body = F.concat(F.lit("User-agent: *\n"), F.when(n == 0, "Disallow: /tag\nAllow: /tag/1\n").when(n == 1, "Disallow: /search # internal\nDisallow: /author\n").otherwise("Disallow:\n"), F.lit("\nUser-agent: slowbot\nDisallow: /\nSitemap: https://"), F.col("domain"), F.lit("/sitemap.xml\n"))
    return rows.select(F.col("domain").alias("origin"), body.alias("body"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, grp, agent, ordinal, kind, path): rule lines with the agents of their group; comments and blanks dropped.

    A group starts at an agent line that doesn't follow another; the window runs within one file.
    """
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("ordinal", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    lines = lines.select("origin", "ordinal", F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[A-Za-z-]+\s*:", "")).alias("value"))
    by = Window.partitionBy("origin").orderBy("ordinal")
    starts = ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")).cast("int")
    grouped = lines.withColumn("grp", F.sum(starts).over(by))
    agents = grouped.where("key = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent"))
    rules = grouped.where("key in ('allow', 'disallow')").select("origin", "grp", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("key").alias("kind"), F.col("value").alias("path"))
    return rules.join(agents, ["origin", "grp"]).select("origin", F.col("grp").cast("bigint").alias("grp"), "agent", "ordinal", "kind", "path")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """(url, allowed): longest matching rule path wins, the first of equals; no match allows.  Joined by host, then prefix."""
    own = rules.where((F.col("agent") == agent) & (F.col("path") != "")).select("origin", "kind", "path", "ordinal")
    rows = urls.select("url", U.host(F.col("url")).alias("origin"), U.path(F.col("url")).alias("p")).where("url is not null").distinct()
    hits = rows.join(own, "origin", "left").select("url", F.when(F.col("p").startswith(F.col("path")), F.struct(F.length("path").alias("l"), (-F.col("ordinal")).alias("o"), "kind")).alias("hit"))
    return hits.groupBy("url").agg(F.max("hit").alias("m")).select("url", (F.coalesce(F.col("m.kind"), F.lit("allow")) == "allow").alias("allowed"))


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, body): one sitemap XML per site over its described pages, every fifth entry without a date."""
    rows = load(spark, sf_dir, "content_meta").select("meta_id", "site_id", "url", F.date_format("checked_at", "yyyy-MM-dd").alias("day")).where("url is not null").distinct()
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc>"), F.when(F.col("meta_id") % 5 > 0, F.concat(F.lit("<lastmod>"), F.col("day"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    chunk = (F.col("meta_id") / 500).cast("bigint")  # a site with very many pages has several files
    by = rows.groupBy("site_id", chunk.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("meta_id", entry.alias("e")))), lambda x: x.e), "").alias("x"))
    return by.select(F.concat_ws("/", "site_id", "part").alias("origin"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("x"), F.lit("</urlset>")).alias("body"))


def sitemap_rows(files: DataFrame) -> DataFrame:
    """(origin, ordinal, loc, lastmod) of every url block."""
    blocks = files.select("origin", F.posexplode(F.regexp_extract_all("body", F.lit(_BLOCK), F.lit(1))).alias("ordinal", "b"))
    return blocks.select("origin", F.col("ordinal").cast("bigint").alias("ordinal"), F.nullif(F.regexp_extract("b", _LOC, 1), F.lit("")).alias("loc"), F.nullif(F.regexp_extract("b", _LASTMOD, 1), F.lit("")).alias("lastmod"))


def sitemap_standards(files: DataFrame) -> DataFrame:
    """Per file: root, namespace, entries, share with a date, dates that aren't ISO, places that aren't addresses."""
    b = F.col("body")
    locs, dates = F.regexp_extract_all(b, F.lit(_LOC), F.lit(1)), F.regexp_extract_all(b, F.lit(_LASTMOD), F.lit(1))
    n = F.regexp_count(b, F.lit("(?i)<url>"))
    root = F.when(b.rlike("(?i)<sitemapindex"), "index").when(b.rlike("(?i)<urlset"), "urlset").when(b.rlike("(?i)<html"), "html").otherwise("none")
    return files.select(
        "origin", root.alias("root"), b.contains("http://www.sitemaps.org/schemas/sitemap/0.9").alias("has_namespace"), n.cast("bigint").alias("n_urls"),
        F.when(n > 0, F.floor(F.size(dates) * 100.0 / n + 0.5)).otherwise(0).cast("bigint").alias("lastmod_pct"), F.size(F.filter(dates, lambda d: ~d.rlike(ISO_DATE))).cast("bigint").alias("bad_dates"),
        F.size(F.filter(locs, lambda x: ~x.rlike("^https?://"))).cast("bigint").alias("bad_locs"),
    )


def pick_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a site's candidate sitemap addresses (declared, https, http), each kept once ignoring case and trailing slashes, best priority first, at most three as the feature asks."""
    rows = load(spark, sf_dir, "sites").select("id", F.lower("domain").alias("d")).where("d is not null").distinct()
    c = rows.select("id", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("priority"), F.concat(F.lit(a), F.col("d"), F.lit(b)).alias("url")) for p, (a, b) in enumerate([("https://", "/sitemap.xml"), ("https://", "/Sitemap.xml/"), ("http://", "/sitemap.xml"), ("https://", "/sitemap_index.xml"), ("https://", "/news-sitemap.xml")])])).alias("c")).select("id", "c.*")
    once = c.groupBy("id", F.regexp_replace(F.lower("url"), "/+$", "").alias("key")).agg(F.min_by("url", "priority").alias("url"), F.min("priority").alias("priority"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("priority"))
    return once.withColumn("rank", rank).where("rank <= 3").select("id", "url", F.col("rank").cast("bigint").alias("rank"))


def freshness(spark: SparkSession, sf_dir: str, as_of: str = "2025-01-01 00:00:00") -> DataFrame:
    """Age of described pages at a fixed moment: whole days, category, counted per site."""
    rows = load(spark, sf_dir, "content_meta").select("meta_id", "site_id", "checked_at").where("checked_at is not null").dropDuplicates(["meta_id"])
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("checked_at")) / 86_400_000_000)
    kind = F.when(days <= 2, "fresh").when(days <= 30, "recent").when(days <= 180, "aging").otherwise("stale")
    return rows.groupBy("site_id", kind.alias("age")).agg(F.count("*").alias("n"), F.min(days).cast("bigint").alias("youngest"))


def registry() -> tuple[dict, dict[str, str]]:
    robots_sql = "(SELECT domain AS origin, 'User-agent: *\n' || CASE CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'Disallow: /tag\nAllow: /tag/1\n' WHEN 1 THEN 'Disallow: /search # internal\nDisallow: /author\n' ELSE 'Disallow:\n' END || '\nUser-agent: slowbot\nDisallow: /\nSitemap: https://' || domain || '/sitemap.xml\n' AS body FROM (SELECT DISTINCT id, domain FROM sites WHERE domain IS NOT NULL))"
    rules_sql = f"""WITH l AS (SELECT origin, unnest(range(len(x))) AS ordinal, trim(regexp_replace(unnest(x), '#.*$', '')) AS line FROM (SELECT origin, string_split(body, chr(10)) AS x FROM {robots_sql})),
k AS (SELECT origin, ordinal, lower(regexp_extract(line, '^([A-Za-z-]+)\\s*:', 1)) AS key, trim(regexp_replace(line, '^[A-Za-z-]+\\s*:', '')) AS value FROM l WHERE line <> ''),
f AS (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY origin ORDER BY ordinal), '') <> 'user-agent' THEN 1 ELSE 0 END AS s FROM k),
g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY origin ORDER BY ordinal) AS BIGINT) AS grp FROM f),
rules AS (SELECT r.origin, r.grp, lower(a.value) AS agent, r.ordinal, r.key AS kind, r.value AS path FROM g r JOIN g a ON a.origin = r.origin AND a.grp = r.grp AND a.key = 'user-agent' WHERE r.key IN ('allow', 'disallow'))"""
    sitemaps_sql = "(SELECT concat_ws('/', site_id, part) AS origin, '<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || string_agg(e, '' ORDER BY meta_id) || '</urlset>' AS body FROM (SELECT DISTINCT meta_id, site_id, CAST(floor(meta_id / 500) AS BIGINT) AS part, '<url><loc>' || url || '</loc>' || CASE WHEN meta_id % 5 > 0 THEN '<lastmod>' || strftime(checked_at, '%Y-%m-%d') || '</lastmod>' ELSE '' END || '</url>' AS e FROM content_meta WHERE url IS NOT NULL) GROUP BY site_id, part)"
    u = U
    days = "floor((epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(checked_at)) / 86400000000::DOUBLE)"
    sql = {
        "robots_rules": f"{rules_sql} SELECT * FROM rules",
        "robots_allowed": f"""{rules_sql}, u AS (SELECT DISTINCT url, {u.host_sql('url')} AS origin, {u.path_sql('url')} AS p FROM audit_results WHERE url IS NOT NULL),
h AS (SELECT u.url, r.kind, row_number() OVER (PARTITION BY u.url ORDER BY length(r.path) DESC NULLS LAST, r.ordinal) AS rn FROM u LEFT JOIN rules r ON r.origin = u.origin AND r.agent = '*' AND r.path <> '' AND starts_with(u.p, r.path))
SELECT url, coalesce(kind, 'allow') = 'allow' AS allowed FROM h WHERE rn = 1""",
        "sitemap_rows": f"SELECT origin, ordinal, nullif(regexp_extract(b, {q(_LOC)}, 1), '') AS loc, nullif(regexp_extract(b, {q(_LASTMOD)}, 1), '') AS lastmod FROM (SELECT origin, unnest(range(len(x))) AS ordinal, unnest(x) AS b FROM (SELECT origin, regexp_extract_all(body, {q(_BLOCK)}, 1) AS x FROM {sitemaps_sql}))",
        "sitemap_standards": f"SELECT origin, 'urlset' AS root, true AS has_namespace, CAST(len(l) AS BIGINT) AS n_urls, CAST(CASE WHEN len(l) > 0 THEN floor(len(d) * 100.0::DOUBLE / len(l) + 0.5) ELSE 0 END AS BIGINT) AS lastmod_pct, CAST(len(list_filter(d, lambda x: NOT regexp_matches(x, {q(ISO_DATE)}))) AS BIGINT) AS bad_dates, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '^https?://'))) AS BIGINT) AS bad_locs FROM (SELECT origin, regexp_extract_all(body, {q(_LOC)}, 1) AS l, regexp_extract_all(body, {q(_LASTMOD)}, 1) AS d FROM {sitemaps_sql})",
        "sitemap_candidates": "WITH s AS (SELECT DISTINCT id, lower(domain) AS d FROM sites WHERE domain IS NOT NULL), c AS (SELECT id, 0 AS p, 'https://' || d || '/sitemap.xml' AS url FROM s UNION ALL SELECT id, 1, 'https://' || d || '/Sitemap.xml/' FROM s UNION ALL SELECT id, 2, 'http://' || d || '/sitemap.xml' FROM s UNION ALL SELECT id, 3, 'https://' || d || '/sitemap_index.xml' FROM s UNION ALL SELECT id, 4, 'https://' || d || '/news-sitemap.xml' FROM s), o AS (SELECT id, arg_min(url, p) AS url, min(p) AS p FROM c GROUP BY id, regexp_replace(lower(url), '/+$', '')) SELECT id, url, rank FROM (SELECT id, url, row_number() OVER (PARTITION BY id ORDER BY p) AS rank FROM o) WHERE rank <= 3",
        "freshness": f"SELECT site_id, CASE WHEN d <= 2 THEN 'fresh' WHEN d <= 30 THEN 'recent' WHEN d <= 180 THEN 'aging' ELSE 'stale' END AS age, count(*) AS n, CAST(min(d) AS BIGINT) AS youngest FROM (SELECT DISTINCT meta_id, site_id, {days} AS d FROM content_meta WHERE checked_at IS NOT NULL) GROUP BY 1, 2",
    }
    queries = {
        "robots_rules": lambda s, d: robots_rules(robots_files(s, d)),
        "robots_allowed": lambda s, d: robots_allowed(load(s, d, "audit_results"), robots_rules(robots_files(s, d))),
        "sitemap_rows": lambda s, d: sitemap_rows(sitemap_files(s, d)),
        "sitemap_standards": lambda s, d: sitemap_standards(sitemap_files(s, d)),
        "sitemap_candidates": pick_candidates,
        "freshness": freshness,
    }
    return queries, sql
