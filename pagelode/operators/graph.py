"""Link graphs: edges out of pages, degrees, orphans, bounded breadth-first crawl, calendar and paging traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..plans.pages import pages
from ..session import load, scratch


def _host(url: str) -> Column:
    """Host of a normalised address."""
    return F.regexp_extract(url, "^https?://([^/:?]+)", 1)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) normalised internal links of the fetched pages, each once; self links left out.  A page's own address is normalised once, before its links are spread."""
    rows = pages(spark, sf_dir).select("url", U.normalized(F.col("url")).alias("src"), F.array_distinct(F.regexp_extract_all("html", F.lit(H.QUOTED_HREF), F.lit(1))).alias("hrefs")).where("src is not null")
    rows = rows.select("url", "src", F.explode("hrefs").alias("href")).where("href <> '' and not href rlike '(?i)^(?:javascript|mailto|tel):'").distinct()
    edges = U.with_resolved(rows, "href", "url", "target").select("src", U.normalized(F.col("target")).alias("dst")).where("src <> dst")
    return edges.where(_host("src") == _host("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(url, n_in, n_out): both ends counted in one aggregation, hot targets combined on the map side."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("url").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(url, depth): shortest distance from the seeds, at most max_depth, level by level.

    Each level joins only the frontier with the edges and drops what was visited; levels are written to
    the shared folder, so lineage stays short and a lost executor costs one level.
    """
    edges = scratch(edges, "edges")
    frontier = scratch(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        visited = levels[0]
        for level in levels[1:]:
            visited = visited.unionByName(level)
        found = frontier.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        frontier = scratch(found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every address from its site's smallest page address, following links."""
    edges = links(spark, sf_dir)
    seeds = edges.groupBy(_host("src").alias("host")).agg(F.min("src").alias("url"))
    return bfs(edges, seeds).withColumn("depth", F.col("depth").cast("bigint"))


def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = degrees(links(spark, sf_dir))
    kind = F.when((F.col("n_in") >= 5) & (F.col("n_out") >= 3), "well").when((F.col("n_in") >= 2) & (F.col("n_out") >= 1), "moderate").otherwise("poor")
    return d.withColumn("cluster", kind)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages that no other page links to (anti join)."""
    linked = links(spark, sf_dir).select(F.col("dst").alias("url")).distinct()
    own = pages(spark, sf_dir).select(U.normalized(F.col("url")).alias("url")).where("url is not null").distinct()
    return own.join(linked, "url", "left_anti")


def suggestions(edges: DataFrame, alone: DataFrame) -> DataFrame:
    """(url, hub): for each url of alone, the page of its host with most links to it, five at least, that isn't the url itself nor linked from it; ties by address.  No hub is capped."""
    hubs = degrees(edges).where("n_in >= 5").select(_host("url").alias("host"), F.col("url").alias("hub"), "n_in")
    pairs = alone.select("url", _host("url").alias("host")).join(hubs, "host").where("hub <> url")
    left = pairs.join(edges.select(F.col("src").alias("url"), F.col("dst").alias("hub")), ["url", "hub"], "left_anti")
    return left.groupBy("url").agg(F.max(F.struct("n_in", "hub")).alias("best")).select("url", F.col("best.hub").alias("hub"))


def link_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each orphan, the best-linked page of its host that it doesn't link to already."""
    return suggestions(links(spark, sf_dir), orphans(spark, sf_dir))


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that differ only in their query or one trailing slash: groups of two or more, with their shortest member."""
    rows = load(spark, sf_dir, "content_meta").where("url is not null").select(F.explode(F.array("url", F.expr(VARIED))).alias("url")).distinct()
    base = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "")
    return rows.groupBy(base.alias("base")).agg(F.count("*").alias("n_urls"), F.min_by("url", F.struct(F.length("url"), "url")).alias("shortest")).where("n_urls > 1")


#: Addresses of measured pages with dates put into some, so that calendars are met; the text is of both dialects.
DATED = "CASE perf_id % 3 WHEN 0 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/events/2024/' || CAST(10 + perf_id % 3 AS VARCHAR(9)) || '/' || CAST(10 + perf_id % 17 AS VARCHAR(9)) WHEN 1 THEN url || '?date=2024' || CAST(perf_id % 5 AS VARCHAR(9)) ELSE url END"
#: The same with paging put on.
NUMBERED = "CASE perf_id % 3 WHEN 0 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/list/page/' || CAST(perf_id % 40 AS VARCHAR(9)) WHEN 1 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/all?offset=' || CAST(perf_id % 400 AS VARCHAR(9)) || '0000000000000000000' ELSE url END"
LEAST_TRAP, LEAST_LOOP = 10, 20


def calendar_traps(urls: DataFrame) -> DataFrame:
    """(base, n_urls): parts of sites under which ten addresses or more look like calendar pages; the base is the address cut at its date."""
    hits = urls.where("url is not null").distinct().where(U.any_of(F.col("url"), U.CALENDAR))
    return hits.groupBy(F.regexp_replace("url", U.CALENDAR_TAIL, "").alias("base")).agg(F.count("*").alias("n_urls")).where(F.col("n_urls") >= LEAST_TRAP)


_NUMBER = r"(?i)(?:page[=/]|p=|offset=|start=|pg[=/])([0-9]+)"


def paging_loops(urls: DataFrame) -> DataFrame:
    """(base, n_pages, highest): bases of twenty paged addresses or more; numbers of any length are read."""
    hits = urls.where("url is not null").distinct().where(U.any_of(F.col("url"), U.PAGING))
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"(?i)/page/\d+", ""), r"(?i)[?&](?:page|p|offset|start|pg)=\d+", ""), r"(?i)/pg/\d+", "")
    rows = hits.select(base.alias("base"), F.expr(f"try_cast(nullif(regexp_extract(url, '{_NUMBER}', 1), '') as decimal(38,0))").alias("number")).where("number is not null")
    return rows.groupBy("base").agg(F.count("*").alias("n_pages"), F.max("number").cast("string").alias("highest")).where(F.col("n_pages") >= LEAST_LOOP)


def measured_urls(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return load(spark, sf_dir, "page_performance").where("url is not null").select(F.expr(expression).alias("url"))


# -- a crawl -------------------------------------------------------------------------------------
def crawl(known: DataFrame, edges: DataFrame, seeds: DataFrame, rules: DataFrame, max_depth: int = 10, max_pages: int = 50) -> DataFrame:
    """(site, url, depth, status) of a breadth-first crawl of each site from its seed.

    known: (url, http_status, content_type, canonical), what fetching an address gives; others fail to be fetched.
    rules: (site, ordinal, kind, path) of robots files.  Each address is visited once, at its least depth.  Closed by robots or by the default
    patterns it is listed and not followed; only readable html is followed; a page whose canonical address, another than its own, was
    declared before (at a lesser depth, or at this one by an address that sorts lower) is a duplicate and not followed.  A site's crawl
    ends after max_pages, counted by depth and address.  Levels are written to the shared folder.
    """
    edges = scratch(edges, "edges")
    level = seeds.select("site", "url").distinct()
    done, canon = None, None
    for depth in range(max_depth + 1):
        from .sitemaps import may_fetch

        closed = may_fetch(level.select("url"), rules).where("not allowed").select("url", F.lit(True).alias("closed"))
        state = (
            F.when(F.col("closed"), "blocked_robots").when(U.denied(F.col("url")), "blocked_pattern").when(F.col("http_status").isNull(), "fetch_error").when(~F.col("http_status").between(200, 299), "http_error")
            .when(~F.coalesce(F.col("content_type"), F.lit("")).contains("text/html"), "skipped_non_html").otherwise("success")
        )
        rows = level.join(closed, "url", "left").join(known, "url", "left").select("site", "url", F.lit(depth).alias("depth"), state.alias("status"), F.when(state == "success", F.col("canonical")).alias("canonical"))
        before = F.row_number().over(Window.partitionBy("site", "canonical").orderBy("url")) > 1
        rows = rows.withColumn("again", F.col("canonical").isNotNull() & before)
        if canon is not None:
            rows = rows.join(canon.withColumn("seen", F.lit(True)), ["site", "canonical"], "left").withColumn("again", F.col("again") | F.coalesce("seen", F.lit(False)))
        rows = rows.withColumn("status", F.when(F.col("again") & (F.col("canonical") != F.col("url")), "duplicate_canonical").otherwise(F.col("status")))
        counted = rows.select("site", "url", "depth", "status", "canonical")
        if done is not None:  # the budget: what the site has already, then by address
            had = done.groupBy("site").agg(F.count("*").alias("had"))
            counted = counted.join(had, "site", "left")
        else:
            counted = counted.withColumn("had", F.lit(0))
        place = F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("site").orderBy("url"))
        rows = scratch(counted.withColumn("place", place).where(F.col("place") <= max_pages).select("site", "url", "depth", "status", "canonical"), "crawl")
        if rows.isEmpty():
            break
        done = rows if done is None else done.unionByName(rows)
        canon = done.where("canonical is not null").select("site", "canonical").distinct()
        new = rows.where("status = 'success'").select("site", F.col("url").alias("src")).join(edges, "src").select("site", F.col("dst").alias("url")).distinct()
        level = new.join(done.select("site", "url"), ["site", "url"], "left_anti")
    return done.select("site", "url", "depth", "status")


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl of every host of the fetched pages, by each address's last fetch."""
    from .sitemaps import merged_rules, site_files

    c = F.coalesce(H.named(F.col("html"), "link", "rel", "canonical", "href"), F.lit(""))
    last = load(spark, sf_dir, "fetch_results").select(U.normalized(F.col("url")).alias("url"), F.struct("fetched_at", "fetch_id").alias("o"), F.struct("http_status", "content_type", U.normalized(c).alias("canonical")).alias("f"))
    known = scratch(last.where("url is not null").groupBy("url").agg(F.max_by("f", "o").alias("f")).select("url", "f.*"), "known")
    seeds = known.groupBy(_host("url").alias("site")).agg(F.min("url").alias("url"))
    return crawl(known, links(spark, sf_dir), seeds, scratch(merged_rules(site_files(spark, sf_dir)), "rules")).withColumn("depth", F.col("depth").cast("bigint"))


def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site of the crawl: pages by outcome, pages deeper than four clicks, the error rate, and the status: FAIL over 30 % errors."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    per = crawl_pages(spark, sf_dir).groupBy("site").agg(
        F.count("*").alias("total"), n("success").alias("success"), n("http_error", "fetch_error").alias("errors"), n("blocked_robots", "blocked_pattern").alias("blocked"), n("duplicate_canonical").alias("duplicates"),
        n("skipped_non_html").alias("non_html"), F.count_if((F.col("depth") > 4) & (F.col("status") == "success")).alias("deep"), F.max("depth").alias("deepest"),
    )
    return per.withColumn("verdict", F.when(F.col("errors") / F.col("total") > 0.3, "FAIL").otherwise("PASS"))


def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host, over its fetched pages that any link leads to or from: links and their mean, pages with at most one link in (below the start) and under three, pages over
    three clicks deep, how well they hang together, and a score of 100 less faults."""
    edges = scratch(links(spark, sf_dir), "edges")
    seeds = edges.groupBy(_host("src").alias("host")).agg(F.min("src").alias("url"))
    depths = bfs(edges, seeds)
    rows = degrees(edges).where("n_out > 0").join(depths, "url", "left").withColumn("depth", F.coalesce("depth", F.lit(1)))  # unreached pages aren't starts
    well, moderate = (F.col("n_in") >= 5) & (F.col("n_out") >= 3), (F.col("n_in") >= 2) & (F.col("n_out") >= 1)
    per = rows.groupBy(_host("url").alias("host")).agg(
        F.count("*").alias("pages"), F.sum("n_out").alias("links"), F.count_if((F.col("n_in") <= 1) & (F.col("depth") > 0)).alias("orphans"), F.count_if((F.col("n_in") < 3) & (F.col("depth") > 0)).alias("weak"), F.count_if(F.col("depth") > 3).alias("deep"),
        F.count_if(well).alias("well"), F.count_if(~well & moderate).alias("moderate"), F.count_if(~well & ~moderate).alias("poor"),
    )
    mean = F.floor(F.col("links") * 10.0 / F.col("pages") + 0.5) / 10
    pct = lambda c: F.col(c) * 100.0 / F.col("pages")
    score = 100 - F.when(pct("orphans") > 30, 30).when(pct("orphans") > 15, 15).otherwise(0) - F.when(pct("deep") > 20, 15).otherwise(0) - F.when(mean < 3, 10).otherwise(0) - F.when(pct("poor") > 40, 10).otherwise(0)
    return per.select("*", mean.alias("mean_links"), score.cast("bigint").alias("score"), F.when(score < 50, "FAIL").when(score < 80, "WARNING").otherwise("PASS").alias("status"))


#: Addresses with variants put on, so that duplicates are met; the text is of both dialects.
VARIED = "CASE meta_id % 4 WHEN 0 THEN url || '?a=1' WHEN 1 THEN url || '/' WHEN 2 THEN url || '?b=2' ELSE url END"


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, base, n_urls, keep): addresses alike but for their query, or for one trailing slash, with the shortest of each group, which the others should name canonical."""
    meta = load(spark, sf_dir, "content_meta").where("url is not null")
    urls = meta.select(F.expr(VARIED).alias("url")).unionByName(meta.select("url")).distinct()
    at = F.struct(F.length("url"), F.col("url"))
    query = urls.groupBy(U.let(U.parts(F.col("url")), lambda p: F.when(F.size(p) == 6, F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[1]), F.when(p[3] == "", "/").otherwise(p[3])))).alias("base")).agg(F.count("*").alias("n_urls"), F.min_by("url", at).alias("keep")).where("n_urls > 1 and base is not null")
    slash = urls.groupBy(F.regexp_replace("url", "/$", "").alias("base")).agg(F.count("*").alias("n_urls"), F.min_by("url", at).alias("keep")).where("n_urls > 1")
    return query.select(F.lit("query").alias("kind"), "*").unionByName(slash.select(F.lit("slash").alias("kind"), "*"))


def duplicate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: groups of query variants and of slashes, addresses that should name another canonical, and the score: 100 less 10 for either kind."""
    rows = duplicate_groups(spark, sf_dir).withColumn("host", U.host(F.col("keep")))
    per = rows.groupBy("host").agg(F.count_if(F.col("kind") == "query").alias("n_query"), F.count_if(F.col("kind") == "slash").alias("n_slash"), F.sum(F.col("n_urls") - 1).alias("to_redirect"))
    return per.withColumn("score", (100 - F.when(F.col("n_query") > 0, 10).otherwise(0) - F.when(F.col("n_slash") > 0, 10).otherwise(0)).cast("bigint"))


def depth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses per depth of the crawl."""
    return crawl_depths(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


#: What asking for a link's target gives, made of its length; the text is of both dialects.
ANSWER = "CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END"


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, url, internal): addresses a page links to, resolved, each once; mail, phone and script links left out."""
    rows = pages(spark, sf_dir).select("fetch_id", F.col("url").alias("base"), F.array_distinct(F.regexp_extract_all("html", F.lit(H.QUOTED_HREF), F.lit(1))).alias("hrefs"))
    rows = rows.select("fetch_id", "base", F.explode("hrefs").alias("href")).where("href <> '' and not href rlike '(?i)^(?:javascript|mailto|tel):'").distinct()
    return U.with_resolved(rows, "href", "base", "url").select("fetch_id", "url", F.coalesce(U.host(F.col("url")) == U.host(F.col("base")), F.lit(False)).alias("internal")).distinct()


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page and how many of them are broken, inside the site and outside, by what asking for the target gives."""
    rows = page_targets(spark, sf_dir).withColumn("answer", F.expr(ANSWER))
    broken = ~F.col("answer").between(200, 399)
    return rows.groupBy("fetch_id").agg(F.count("*").alias("n_links"), F.count_if(broken & F.col("internal")).alias("broken_internal"), F.count_if(broken & ~F.col("internal")).alias("broken_external"))


def raw_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain crawl: addresses as written (only resolved), same host, each once at its least depth, without robots, patterns or canonicals."""
    rows = pages(spark, sf_dir).select("url", F.array_distinct(F.regexp_extract_all("html", F.lit(H.QUOTED_HREF), F.lit(1))).alias("hrefs")).select("url", F.explode("hrefs").alias("href")).where("href <> '' and not href rlike '(?i)^(?:javascript|mailto|tel):'").distinct()
    edges = U.with_resolved(rows, "href", "url", "target").select(F.col("url").alias("src"), F.col("target").alias("dst")).where("src <> dst").where(_host("src") == _host("dst")).distinct()
    seeds = edges.groupBy(_host("src").alias("host")).agg(F.min("src").alias("url"))
    return bfs(edges, seeds).withColumn("depth", F.col("depth").cast("bigint"))


def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of each site by outcome: success, errors by status, blocked, not HTML, empty."""
    rows = load(spark, sf_dir, "fetch_results").select("fetch_id", "site_id", "http_status", "fetch_ok", "content_type", F.coalesce(F.length("html"), F.lit(0)).alias("size"), "challenge_detected").dropDuplicates(["fetch_id"])
    kind = (
        F.when(F.col("challenge_detected"), "blocked").when(F.col("http_status") >= 400, "error").when(~F.coalesce(F.col("content_type"), F.lit("text/html")).rlike("(?i)html"), "non_html")
        .when(F.col("size") == 0, "empty").when(F.coalesce("fetch_ok", F.lit(False)), "success").otherwise("unknown")
    )
    return rows.groupBy("site_id", kind.alias("outcome")).agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


def _links_sql() -> str:
    from ..plans.pages import PAGE_SQL

    u = U
    return f"""h AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, {H.q(H.QUOTED_HREF)}, 1)) AS href FROM {PAGE_SQL}),
k AS (SELECT url, href FROM h WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(?:javascript|mailto|tel):')),
r AS (SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href
  ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || regexp_replace({u.path_sql('url')}, '[^/]*$', '') || href END AS target FROM k),
e AS (SELECT DISTINCT src, dst FROM (SELECT {u.normalized_sql('url')} AS src, {u.normalized_sql('target')} AS dst FROM r) WHERE src <> dst AND {u.host_sql('src')} = {u.host_sql('dst')})"""


_DUPLICATES_SQL = f"""
WITH u AS (SELECT {VARIED} AS url FROM content_meta WHERE url IS NOT NULL UNION SELECT url FROM content_meta WHERE url IS NOT NULL),
g AS (SELECT 'query' AS kind, lower({U.part_sql('url', 1)}) || '://' || {U.host_sql('url')} || {U.path_sql('url')} AS base, count(*) AS n_urls, arg_min(url, (length(url), url)) AS keep FROM u GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'slash', regexp_replace(url, '/$', ''), count(*), arg_min(url, (length(url), url)) FROM u GROUP BY 2 HAVING count(*) > 1)
"""


def registry() -> tuple[dict, dict[str, str]]:
    from ..plans.pages import PAGE_SQL

    u = U
    e = "WITH RECURSIVE " + _links_sql()
    deg = "d AS (SELECT url, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS url, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY url)"
    own = f"own AS (SELECT DISTINCT {U.normalized_sql('url')} AS url FROM {PAGE_SQL}), orph AS (SELECT url FROM own WHERE url IS NOT NULL AND url NOT IN (SELECT dst FROM e))"
    sql = {
        "internal_links": f"{e} SELECT src, dst FROM e",
        "link_degrees": f"{e}, {deg} SELECT url, n_in, n_out, CASE WHEN n_in >= 5 AND n_out >= 3 THEN 'well' WHEN n_in >= 2 AND n_out >= 1 THEN 'moderate' ELSE 'poor' END AS cluster FROM d",
        "orphans": f"{e}, {own} SELECT url FROM orph",
        "link_suggestions": f"{e}, {deg}, {own}, hub AS (SELECT {U.host_sql('url')} AS host, url AS hub, n_in FROM d WHERE n_in >= 5), pr AS (SELECT orph.url, hub, n_in FROM orph JOIN hub ON hub.host = {U.host_sql('orph.url')} WHERE hub <> orph.url AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = orph.url AND e.dst = hub)) SELECT url, arg_max(hub, (n_in, hub)) AS hub FROM pr GROUP BY url",
        "crawl_depths": f"{e}, s AS (SELECT min(src) AS url FROM e GROUP BY {U.host_sql('src')}), b AS (SELECT url, 0::BIGINT AS depth FROM s UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 10) SELECT url, min(depth) AS depth FROM b GROUP BY url",
        "depth_distribution": f"{e}, s AS (SELECT min(src) AS url FROM e GROUP BY {U.host_sql('src')}), b AS (SELECT url, 0::BIGINT AS depth FROM s UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 10) SELECT depth, count(*) AS n FROM (SELECT url, min(depth) AS depth FROM b GROUP BY url) GROUP BY depth",
        "link_status": f"WITH h AS (SELECT DISTINCT fetch_id, url AS base, unnest(regexp_extract_all(html, {H.q(H.QUOTED_HREF)}, 1)) AS href FROM {PAGE_SQL}), r AS (SELECT fetch_id, base, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1) || href ELSE regexp_extract(base, '^([A-Za-z]+://[^/?#]+)', 1) || regexp_replace({u.path_sql('base')}, '[^/]*$', '') || href END AS url FROM h WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(?:javascript|mailto|tel):')), d AS (SELECT DISTINCT fetch_id, url, coalesce({u.host_sql('url')} = {u.host_sql('base')}, false) AS internal FROM r), a AS (SELECT *, {ANSWER} AS answer FROM d) SELECT fetch_id, count(*) AS n_links, count(*) FILTER (WHERE answer NOT BETWEEN 200 AND 399 AND internal) AS broken_internal, count(*) FILTER (WHERE answer NOT BETWEEN 200 AND 399 AND NOT internal) AS broken_external FROM a GROUP BY fetch_id",
        "raw_crawl": f"{e}, re AS (SELECT DISTINCT url AS src, target AS dst FROM r WHERE url <> target AND {U.host_sql('url')} = {U.host_sql('target')}), s AS (SELECT min(src) AS url FROM re GROUP BY {U.host_sql('src')}), b AS (SELECT url, 0::BIGINT AS depth FROM s UNION SELECT re.dst, b.depth + 1 FROM b JOIN re ON re.src = b.url WHERE b.depth < 10) SELECT url, min(depth) AS depth FROM b GROUP BY url",
        "crawl_summary": "SELECT site_id, CASE WHEN challenge_detected THEN 'blocked' WHEN http_status >= 400 THEN 'error' WHEN NOT regexp_matches(coalesce(content_type, 'text/html'), '(?i)html') THEN 'non_html' WHEN size = 0 THEN 'empty' WHEN coalesce(fetch_ok, false) THEN 'success' ELSE 'unknown' END AS outcome, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM (SELECT DISTINCT fetch_id, site_id, http_status, fetch_ok, content_type, coalesce(length(html), 0) AS size, challenge_detected FROM fetch_results) GROUP BY 1, 2",
        "query_variants": f"SELECT base, count(*) AS n_urls, arg_min(url, (length(url), url)) AS shortest FROM (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS base FROM (SELECT url FROM content_meta WHERE url IS NOT NULL UNION SELECT {VARIED} FROM content_meta WHERE url IS NOT NULL)) GROUP BY base HAVING count(*) > 1",
        "calendar_traps": f"SELECT regexp_replace(url, {H.q(U.CALENDAR_TAIL)}, '') AS base, count(*) AS n_urls FROM (SELECT DISTINCT {DATED} AS url FROM page_performance WHERE url IS NOT NULL) WHERE {U.any_of_sql('url', U.CALENDAR)} GROUP BY 1 HAVING count(*) >= 10",
        "paging_loops": f"SELECT regexp_replace(regexp_replace(regexp_replace(url, '(?i)/page/\\d+', ''), '(?i)[?&](page|p|offset|start|pg)=\\d+', ''), '(?i)/pg/\\d+', '') AS base, count(*) AS n_pages, CAST(max(CAST(nullif(regexp_extract(url, {H.q(_NUMBER)}, 1), '') AS DECIMAL(38,0))) AS VARCHAR) AS highest FROM (SELECT DISTINCT {NUMBERED} AS url FROM page_performance WHERE url IS NOT NULL) WHERE {U.any_of_sql('url', U.PAGING)} GROUP BY 1 HAVING count(*) >= 20",
        "link_report": f"""{e}, {deg}, s AS (SELECT min(src) AS url FROM e GROUP BY {U.host_sql('src')}), b AS (SELECT url, 0::BIGINT AS depth FROM s UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.url WHERE b.depth < 10), bd AS (SELECT url, min(depth) AS depth FROM b GROUP BY url),
rw AS (SELECT d.url, n_in, n_out, coalesce(depth, 1) AS depth FROM d LEFT JOIN bd USING (url) WHERE n_out > 0),
p AS (SELECT {U.host_sql('url')} AS host, count(*) AS pages, CAST(sum(n_out) AS BIGINT) AS links, count(*) FILTER (WHERE n_in <= 1 AND depth > 0) AS orphans, count(*) FILTER (WHERE n_in < 3 AND depth > 0) AS weak, count(*) FILTER (WHERE depth > 3) AS deep, count(*) FILTER (WHERE n_in >= 5 AND n_out >= 3) AS well,
  count(*) FILTER (WHERE NOT (n_in >= 5 AND n_out >= 3) AND n_in >= 2) AS moderate, count(*) FILTER (WHERE n_in < 2) AS poor FROM rw GROUP BY 1),
q AS (SELECT *, floor(links * 10.0::DOUBLE / pages + 0.5) / 10 AS mean_links FROM p),
z AS (SELECT *, 100 - CASE WHEN orphans * 100.0 / pages > 30 THEN 30 WHEN orphans * 100.0 / pages > 15 THEN 15 ELSE 0 END - CASE WHEN deep * 100.0 / pages > 20 THEN 15 ELSE 0 END - CASE WHEN mean_links < 3 THEN 10 ELSE 0 END - CASE WHEN poor * 100.0 / pages > 40 THEN 10 ELSE 0 END AS sc FROM q)
SELECT host, pages, links, orphans, weak, deep, well, moderate, poor, mean_links, CAST(sc AS BIGINT) AS score, CASE WHEN sc < 50 THEN 'FAIL' WHEN sc < 80 THEN 'WARNING' ELSE 'PASS' END AS status FROM z""",
        "duplicate_groups": _DUPLICATES_SQL + "SELECT * FROM g",
        "duplicate_score": _DUPLICATES_SQL + f"SELECT {U.host_sql('keep')} AS host, count(*) FILTER (WHERE kind = 'query') AS n_query, count(*) FILTER (WHERE kind = 'slash') AS n_slash, CAST(sum(n_urls - 1) AS BIGINT) AS to_redirect, CAST(100 - CASE WHEN bool_or(kind = 'query') THEN 10 ELSE 0 END - CASE WHEN bool_or(kind = 'slash') THEN 10 ELSE 0 END AS BIGINT) AS score FROM g GROUP BY 1",
    }
    return {"internal_links": links, "link_degrees": link_degrees, "orphans": orphans, "link_suggestions": link_suggestions, "crawl_depths": crawl_depths, "depth_distribution": depth_distribution, "link_status": link_status, "crawl_summary": crawl_summary, "query_variants": query_variants, "calendar_traps": lambda s, d: calendar_traps(measured_urls(s, d, DATED)), "paging_loops": lambda s, d: paging_loops(measured_urls(s, d, NUMBERED)), "crawl_pages": crawl_pages, "raw_crawl": raw_crawl, "crawl_report": crawl_report, "link_report": link_report, "duplicate_groups": duplicate_groups, "duplicate_score": duplicate_score}, sql
