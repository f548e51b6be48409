"""Runs as they are kept and shown: status of appended events, breakdown of the latest run, exports, redirects, probes, and small text and number rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.html import q
from ..operators import sitemaps
from ..session import load
from . import augmented
from .history import LATEST_RUN_SQL, RECOMMENDATIONS_SQL, RESULTS, RUNS, latest_run, recommendations, results, runs, with_priority


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status, at): the state of each run after its last event; events (run_id, status, at, ordinal) are only ever appended."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "ordinal")).alias("e")).select("run_id", "e.status", "e.at")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every run by its events: it was running from its start, and what it came to from its end."""
    r = runs(spark, sf_dir)
    began = r.where("started_at is not null").select(F.col("id").alias("run_id"), F.lit("RUNNING").alias("status"), F.col("started_at").alias("at"), F.lit(0).alias("ordinal"))
    ended = r.where("finished_at is not null").select(F.col("id").alias("run_id"), "status", F.col("finished_at").alias("at"), F.lit(1).alias("ordinal"))
    return run_status(began.unionByName(ended))


RUN_STATES_SQL = f"SELECT id AS run_id, CASE WHEN finished_at IS NOT NULL AND (started_at IS NULL OR finished_at >= started_at) THEN status ELSE 'RUNNING' END AS status, CASE WHEN finished_at IS NOT NULL AND (started_at IS NULL OR finished_at >= started_at) THEN finished_at ELSE started_at END AS at FROM {RUNS} WHERE started_at IS NOT NULL OR finished_at IS NOT NULL"


def latest_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each site's latest completed run: results by status, P0 recommendations, P0 and P1 ones, and the mean score to one place."""
    per = results(spark, sf_dir, with_priority("P0").alias("p0"), with_priority("P1").alias("p1")).groupBy("run_id").agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warnings"), ("FAIL", "failed"))], F.sum("p0").alias("critical"), F.sum(F.col("p0") + F.col("p1")).alias("top_issues"), F.avg("score").alias("mean"), F.count("*").alias("pages"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return latest_run(spark, sf_dir).join(per, "run_id", "left").select("site_id", "run_id", *map(zero, ("pages", "passed", "warnings", "failed", "critical", "top_issues")), (F.floor(F.col("mean") * 10 + 0.5) / 10).alias("score"))


LATEST_BREAKDOWN_SQL = f"""
WITH l AS ({LATEST_RUN_SQL}), r AS (SELECT *, len(list_filter(coalesce(recs, []), lambda x: x.priority = 'P0')) AS p0, len(list_filter(coalesce(recs, []), lambda x: x.priority = 'P1')) AS p1 FROM {RESULTS})
SELECT l.site_id, l.run_id, count(r.id) AS pages, count(*) FILTER (WHERE r.status = 'PASS') AS passed, count(*) FILTER (WHERE r.status = 'WARN') AS warnings, count(*) FILTER (WHERE r.status = 'FAIL') AS failed,
  CAST(coalesce(sum(p0), 0) AS BIGINT) AS critical, CAST(coalesce(sum(p0 + p1), 0) AS BIGINT) AS top_issues, floor(avg(score) * 10 + 0.5) / 10 AS score FROM l LEFT JOIN r ON r.run_id = l.run_id GROUP BY 1, 2
"""


def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each run in the order they were made, ties by id."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "id"))
    return results(spark, sf_dir).select("run_id", "id", "url", "status", rank.cast("bigint").alias("place"))


RUN_PAGES_SQL = f"SELECT run_id, id, url, status, row_number() OVER (PARTITION BY run_id ORDER BY created_at NULLS FIRST, id) AS place FROM {RESULTS}"


def tracker_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for an issue tracker of every failed or warned result: priority High if failed, else Medium; the areas of its recommendations, each once, in order."""
    rows = results(spark, sf_dir, F.col("recommendations")).where("status in ('FAIL', 'WARN')")
    areas = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce("recommendations", F.array()), lambda r: r.area)))), ", ")
    text = F.concat(F.lit("["), F.when(F.col("status") == "FAIL", "High").otherwise("Medium"), F.lit("] "), F.coalesce("url", F.lit("-")), F.when(areas == "", "").otherwise(F.concat(F.lit(": "), areas)))
    return rows.select("run_id", "id", text.alias("line"))


TRACKER_SQL = f"""
SELECT run_id, id, '[' || CASE status WHEN 'FAIL' THEN 'High' ELSE 'Medium' END || '] ' || coalesce(url, '-') || CASE WHEN len(a) = 0 THEN '' ELSE ': ' || array_to_string(a, ', ') END AS line
FROM (SELECT *, list_sort(list_distinct(list_filter(list_transform(coalesce(recs, []), lambda r: r.area), lambda x: x IS NOT NULL))) AS a FROM {RESULTS}) WHERE status IN ('FAIL', 'WARN')
"""


def check_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results of each run each view shows: all, critical (failed with a P0), issues (failed or warned), passed."""
    rows = results(spark, sf_dir, with_priority("P0").alias("p0"))
    return rows.groupBy("run_id").agg(F.count("*").alias("everything"), F.count_if((F.col("status") == "FAIL") & (F.col("p0") > 0)).alias("critical"), F.count_if(F.col("status").isin("FAIL", "WARN")).alias("issues"), F.count_if(F.col("status") == "PASS").alias("passed"))


CHECK_FILTERS_SQL = f"SELECT run_id, count(*) AS everything, count(*) FILTER (WHERE status = 'FAIL' AND len(list_filter(coalesce(recs, []), lambda x: x.priority = 'P0')) > 0) AS critical, count(*) FILTER (WHERE status IN ('FAIL', 'WARN')) AS issues, count(*) FILTER (WHERE status = 'PASS') AS passed FROM {RESULTS} GROUP BY run_id"


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown section per result: its address and status, then a line per recommendation, in list order.  A result's section is bounded by its document."""
    lines = recommendations(spark, sf_dir).where("message is not null").select("id", "pos", F.concat(F.lit("- ["), F.coalesce("priority", F.lit("-")), F.lit("] "), F.coalesce("area", F.lit("-")), F.lit(": "), "message").alias("l"))
    body = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x.l), "\n").alias("body"))
    head = F.concat(F.lit("## "), F.coalesce("url", F.lit("-")), F.lit(" ("), F.coalesce("status", F.lit("-")), F.lit(")"))
    return results(spark, sf_dir).join(body, "id", "left").select("run_id", "id", F.concat_ws("\n", head, "body").alias("text"))


MARKDOWN_PAGES_SQL = f"""
WITH b AS (SELECT id, string_agg('- [' || coalesce(priority, '-') || '] ' || coalesce(area, '-') || ': ' || message, chr(10) ORDER BY pos) AS body FROM ({RECOMMENDATIONS_SQL}) WHERE message IS NOT NULL GROUP BY id)
SELECT run_id, r.id, concat_ws(chr(10), '## ' || coalesce(url, '-') || ' (' || coalesce(status, '-') || ')', body) AS text FROM {RESULTS} r LEFT JOIN b ON b.id = r.id
"""


def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, hop, from_url, to_url): each step of a fetch's redirects, from the addresses left to the final one."""
    rows = load(spark, sf_dir, "fetch_results").select("fetch_id", F.filter("redirect_chain", lambda x: x.isNotNull()).alias("c"), "final_url").where("size(c) > 0").distinct()
    way = rows.select("fetch_id", F.array_append("c", F.col("final_url")).alias("w"))
    steps = way.select("fetch_id", F.posexplode(F.slice("w", F.lit(1), F.size("w") - 1)).alias("hop", "from_url"), "w")
    return steps.select("fetch_id", F.col("hop").cast("bigint").alias("hop"), "from_url", F.get("w", F.col("hop") + 1).alias("to_url"))


REDIRECT_HOPS_SQL = """
WITH c AS (SELECT DISTINCT fetch_id, list_filter(redirect_chain, lambda x: x IS NOT NULL) AS c, final_url FROM fetch_results),
s AS (SELECT fetch_id, unnest(range(len(c))) AS hop, unnest(c) AS from_url, list_append(c, final_url) AS w FROM c WHERE len(c) > 0)
SELECT fetch_id, hop, from_url, w[hop + 2] AS to_url FROM s
"""


def site_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: the first 500 characters of a robots file that answers, whether there is a sitemap, and whether a crawl without robots file may go on."""
    files = sitemaps.site_files(spark, sf_dir).where("source in ('robots', 'sitemap')")
    ok = F.col("http_status").between(200, 299)
    return files.groupBy("site").agg(F.max(F.when((F.col("source") == "robots") & ok, F.left("body", F.lit(500)))).alias("robots"), F.bool_or((F.col("source") == "sitemap") & ok).alias("has_sitemap")).select("site", "robots", "has_sitemap", F.col("robots").isNull().alias("open"))


PROBES_SQL = f"{sitemaps.FILES_SQL} SELECT site, max(body[1:500]) FILTER (WHERE source = 'robots' AND http_status BETWEEN 200 AND 299) AS robots, bool_or(source = 'sitemap' AND http_status BETWEEN 200 AND 299) AS has_sitemap, max(body) FILTER (WHERE source = 'robots' AND http_status BETWEEN 200 AND 299) IS NULL AS open FROM f WHERE source IN ('robots', 'sitemap') GROUP BY site"


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site with an index: its children, their addresses together, and whether there are none, as in a stale index."""
    kids = sitemaps.index_children(spark, sf_dir)
    return kids.groupBy("site").agg(F.count("*").alias("n_children"), F.sum("n_urls").alias("n_urls")).withColumn("stale", F.col("n_urls") == 0)


INDEX_TOTALS_SQL = "SELECT site, count(*) AS n_children, CAST(sum(n_urls) AS BIGINT) AS n_urls, sum(n_urls) = 0 AS stale FROM (" + sitemaps.CHILDREN_SQL + ") GROUP BY site"

#: Paths that old addresses led to, tried on a site after a move; {c} is the page's category (fixed).
MOVED = ("/search/{c}/2", "/morearticles/{c}", "/morearticles/{c}/2", "/archive/page/2", "/{c}/page/2")


def migration_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, probed, http_status, verdict): what became of the listing addresses of each page's category, by answers made of the addresses' lengths:
    answered or redirected PASS, not there FAIL, anything else WARNING; and an address that never was: not there PASS, answered FAIL."""
    rows = load(spark, sf_dir, "audit_results").select("url").where("url is not null").distinct().select("url", F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1).alias("o"), U.category_segment(F.col("url")).alias("c"))
    paths = [F.concat(F.lit(p.split("{c}")[0]), *([F.col("c"), F.lit(p.split("{c}")[1])] if "{c}" in p else [])) for p in MOVED]
    long = rows.select("url", F.posexplode(F.array(*[F.concat("o", p) for p in paths], F.concat("o", F.lit("/this-should-not-exist-12345")))).alias("k", "probed"))
    status = F.element_at(F.array(*map(F.lit, (200, 301, 404, 410, 500, 0))), (F.length("probed") % 6 + 1).cast("int"))
    missing = F.col("http_status").isin(404, 410)
    made_up = F.col("k") == len(MOVED)
    good = F.col("http_status").between(200, 299)
    verdict = F.when(made_up, F.when(missing, "PASS").when(good, "FAIL").otherwise("WARNING")).when(good | F.col("http_status").isin(301, 302, 307, 308), "PASS").when(missing, "FAIL").otherwise("WARNING")
    return long.withColumn("http_status", status).select("url", "probed", F.col("http_status").cast("bigint").alias("http_status"), verdict.alias("verdict"))


MIGRATION_SQL = f"""
WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS o, list_filter(string_split(coalesce({U.path_sql('url')}, ''), '/'), lambda x: x <> '') AS s FROM audit_results WHERE url IS NOT NULL),
c AS (SELECT url, o, CASE WHEN len(s) >= 2 THEN s[len(s) - 1] ELSE coalesce(s[1], 'news') END AS c FROM u),
p AS (SELECT url, unnest(range(6)) AS k, o || unnest(['/search/' || c || '/2', '/morearticles/' || c, '/morearticles/' || c || '/2', '/archive/page/2', '/' || c || '/page/2', '/this-should-not-exist-12345']) AS probed FROM c),
s AS (SELECT *, CAST([200, 301, 404, 410, 500, 0][length(probed) % 6 + 1] AS BIGINT) AS http_status FROM p)
SELECT url, probed, http_status, CASE WHEN k = 5 THEN CASE WHEN http_status IN (404, 410) THEN 'PASS' WHEN http_status = 200 THEN 'FAIL' ELSE 'WARNING' END WHEN http_status IN (200, 301) THEN 'PASS' WHEN http_status IN (404, 410) THEN 'FAIL' ELSE 'WARNING' END AS verdict FROM s
"""


def title_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message each page's title calls for, with its length filled in; NULL if it is of good length."""
    title = H.title(F.col("html"))
    n = F.length(title)
    message = F.when(title.isNull(), "Missing title tag").when(n < 15, F.format_string("Title too short (%d chars, min 15)", n)).when(n > 65, F.format_string("Title too long (%d chars, max 65)", n))
    return load(spark, sf_dir, "fetch_results").where("html <> ''").select("fetch_id", message.alias("message")).distinct()


TITLE_MESSAGES_SQL = f"SELECT DISTINCT fetch_id, CASE WHEN t IS NULL THEN 'Missing title tag' WHEN length(t) < 15 THEN 'Title too short (' || length(t) || ' chars, min 15)' WHEN length(t) > 65 THEN 'Title too long (' || length(t) || ' chars, max 65)' END AS message FROM (SELECT fetch_id, {H.title_sql('html')} AS t FROM fetch_results WHERE html <> '')"


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result as one JSON document; fields without a value are left out."""
    return results(spark, sf_dir).select("id", F.to_json(F.struct("url", "page_type", "status", "score")).alias("json"))


RESULT_JSON_SQL = f"SELECT id, CAST(json_merge_patch('{{}}', json_object('url', url, 'page_type', page_type, 'status', status, 'score', score)) AS VARCHAR) AS json FROM {RESULTS}"


def shift_risk(images: Column, frames: Column, adverts: Column) -> Column:
    """Risk of layout shift, added up in doubles in this order: images without size over 3 and over 10, frames over 2, advert marks."""
    part = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return part(images > 3, 0.1) + part(images > 10, 0.15) + part(frames > 2, 0.05) + part(adverts, 0.1)


def layout_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout-shift risk of each page, over counts made of the page's own elements and its id, so that sums at the borders are met."""
    html = F.col("html")
    images = F.size(F.filter(F.regexp_extract_all(html, F.lit(H.IMG), F.lit(0)), lambda t: ~t.rlike(r"(?i)\bwidth\s*=") | ~t.rlike(r"(?i)\bheight\s*="))) + F.expr("fetch_id % 13")
    risk = shift_risk(images, F.regexp_count(html, F.lit("(?i)<iframe")) + F.expr("fetch_id % 4"), F.expr("fetch_id % 2 = 0"))
    rows = augmented.pages(spark, sf_dir).select("fetch_id", risk.alias("risk")).distinct()
    return rows.select("fetch_id", "risk", F.when(F.col("risk") > 0.25, "poor").when(F.col("risk") > 0.1, "needs-improvement").otherwise("good").alias("grade"))


LAYOUT_SHIFT_SQL = f"""
WITH c AS (SELECT DISTINCT fetch_id, len(list_filter(regexp_extract_all(html, {q(H.IMG)}), lambda t: NOT regexp_matches(t, '(?i)\\bwidth\\s*=') OR NOT regexp_matches(t, '(?i)\\bheight\\s*='))) + fetch_id % 13 AS i, len(regexp_extract_all(html, '(?i)<iframe')) + fetch_id % 4 AS f FROM {augmented.SQL}),
r AS (SELECT fetch_id, CASE WHEN i > 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN i > 10 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN f > 2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN fetch_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS risk FROM c)
SELECT fetch_id, risk, CASE WHEN risk > 0.25::DOUBLE THEN 'poor' WHEN risk > 0.1::DOUBLE THEN 'needs-improvement' ELSE 'good' END AS grade FROM r
"""


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest link texts of each page; ties by first appearance."""
    texts = F.filter(F.transform(F.regexp_extract_all("html", F.lit(H.ANCHOR), F.lit(1)), H.visible), lambda t: (t != "") & (F.length(t) < 100))
    rows = load(spark, sf_dir, "fetch_results").where("html <> ''").select("fetch_id", texts.alias("a")).dropDuplicates(["fetch_id"]).select("fetch_id", F.posexplode("a").alias("place", "anchor"))
    counts = rows.groupBy("fetch_id", "anchor").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("fetch_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where("rank <= 10").select("fetch_id", "anchor", "n", F.col("rank").cast("bigint").alias("rank"))


PAGE_ANCHORS_SQL = f"""
WITH p AS (SELECT DISTINCT fetch_id, list_filter(list_transform(regexp_extract_all(html, {q(H.ANCHOR)}, 1), lambda x: {H.visible_sql('x')}), lambda t: t <> '' AND length(t) < 100) AS a FROM fetch_results WHERE html <> ''),
x AS (SELECT fetch_id, unnest(a) AS anchor, unnest(range(len(a))) AS place FROM p), c AS (SELECT fetch_id, anchor, count(*) AS n, min(place) AS first FROM x GROUP BY ALL)
SELECT fetch_id, anchor, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10
"""


def heading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, level, place, text): headings of each page by level, in order, as text."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), H.inner_texts(F.col("html"), f"h{k}").alias("texts")) for k in range(1, 7)])
    rows = load(spark, sf_dir, "fetch_results").where("html <> ''").select("fetch_id", F.explode(levels).alias("l")).select("fetch_id", F.col("l.level").cast("bigint").alias("level"), F.posexplode("l.texts").alias("place", "text")).distinct()
    return rows.withColumn("place", F.col("place").cast("bigint"))


HEADING_TEXTS_SQL = "SELECT DISTINCT fetch_id, level, place, text FROM (" + " UNION ALL ".join(f"SELECT fetch_id, {k}::BIGINT AS level, unnest(range(len(t))) AS place, unnest(t) AS text FROM (SELECT fetch_id, {H.inner_texts_sql('html', f'h{k}')} AS t FROM fetch_results WHERE html <> '')" for k in range(1, 7)) + ")"


def with_uuid(df: DataFrame, column: str = "id") -> DataFrame:
    """df with a random key; write the result before it is used twice, as it is drawn anew each time it is computed."""
    return df.withColumn(column, F.uuid())


def registry() -> tuple[dict, dict[str, str]]:
    pairs = {
        "run_states": (run_states, RUN_STATES_SQL), "latest_breakdown": (latest_breakdown, LATEST_BREAKDOWN_SQL), "run_pages": (run_pages, RUN_PAGES_SQL), "tracker_export": (tracker_export, TRACKER_SQL), "check_filters": (check_filters, CHECK_FILTERS_SQL),
        "markdown_pages": (markdown_pages, MARKDOWN_PAGES_SQL), "redirect_hops": (redirect_hops, REDIRECT_HOPS_SQL), "site_probes": (site_probes, PROBES_SQL), "index_totals": (index_totals, INDEX_TOTALS_SQL), "migration_probes": (migration_probes, MIGRATION_SQL),
        "title_messages": (title_messages, TITLE_MESSAGES_SQL), "result_json": (result_json, RESULT_JSON_SQL), "layout_shift": (layout_shift, LAYOUT_SHIFT_SQL), "page_anchors": (page_anchors, PAGE_ANCHORS_SQL), "heading_texts": (heading_texts, HEADING_TEXTS_SQL),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
