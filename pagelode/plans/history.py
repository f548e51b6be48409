"""Audit history: sites, runs and results joined, tallied, ranked, paged and compared.

Redelivered rows are dropped by id on the narrow columns each query needs.  Results reach runs by
aggregation before the join, so a site with very many runs or a run with very many results is combined
on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load

RUNS = "(SELECT DISTINCT id, site_id, status, started_at, finished_at FROM audit_runs)"
RESULTS = "(SELECT id, any_value(audit_run_id) AS run_id, any_value(url) AS url, any_value(page_type) AS page_type, any_value(status) AS status, any_value(composite_score) AS score, any_value(recommendations) AS recs, any_value(created_at) AS created_at FROM audit_results GROUP BY id)"
SITES = "(SELECT DISTINCT id, domain, project_name, website_url, created_at, updated_at, last_audit_at FROM sites)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "audit_runs").select("id", "site_id", "status", "started_at", "finished_at").dropDuplicates(["id"])


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sites").drop("last_form_values").dropDuplicates(["id"])


def results(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """id, run_id, url, page_type, status, score, created_at and more columns of each result once."""
    rows = load(spark, sf_dir, "audit_results")
    return rows.select("id", F.col("audit_run_id").alias("run_id"), "url", "page_type", "status", F.col("composite_score").alias("score"), "created_at", *more).dropDuplicates(["id"])


def with_priority(p: str) -> Column:
    return F.size(F.filter(F.coalesce("recommendations", F.array()), lambda r: r.priority == p)).cast("bigint")


def round1(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the number of runs, completed and running ones, last audit first; sites without runs stay."""
    tally = runs(spark, sf_dir).groupBy("site_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "COMPLETED").alias("n_completed"), F.count_if(F.col("status") == "RUNNING").alias("n_running"))
    joined = sites(spark, sf_dir).join(tally.withColumnRenamed("site_id", "id"), "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_runs", "n_completed", "n_running")]
    return joined.select("id", "domain", "last_audit_at", "created_at", *zero).orderBy(F.col("last_audit_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")


PROJECT_LIST_SQL = f"""
SELECT s.id, s.domain, s.last_audit_at, s.created_at, count(r.id) AS n_runs, count(r.id) FILTER (WHERE r.status = 'COMPLETED') AS n_completed,
  count(r.id) FILTER (WHERE r.status = 'RUNNING') AS n_running
FROM {SITES} s LEFT JOIN {RUNS} r ON r.site_id = s.id GROUP BY ALL
"""


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: passed, warned and failed results, P0 recommendations, mean score to one place, duration in whole milliseconds of seconds."""
    per = results(spark, sf_dir, with_priority("P0").alias("p0")).groupBy("run_id").agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warnings"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.sum("p0").alias("critical"), F.count("score").alias("n_scores"), F.sum(F.col("score").cast("decimal(20,4)")).alias("total"),
    )
    seconds = F.unix_micros("finished_at") - F.unix_micros("started_at")
    out = runs(spark, sf_dir).join(per.withColumnRenamed("run_id", "id"), "id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("passed", "warnings", "failed", "critical")]
    return out.select("id", "site_id", "status", *zero, round1(F.col("total").cast("double") / F.col("n_scores")).alias("mean_score"), (F.floor(seconds / 1e6 + 0.5) * 1000).cast("bigint").alias("duration_ms"))


AUDIT_HISTORY_SQL = f"""
SELECT r.id, r.site_id, r.status, count(x.id) FILTER (WHERE x.status = 'PASS') AS passed, count(x.id) FILTER (WHERE x.status = 'WARN') AS warnings, count(x.id) FILTER (WHERE x.status = 'FAIL') AS failed,
  CAST(coalesce(sum(len(list_filter(coalesce(x.recs, []), lambda c: c.priority = 'P0'))), 0) AS BIGINT) AS critical,
  floor(CAST(sum(CAST(x.score AS DECIMAL(20,4))) AS DOUBLE) / nullif(count(x.score), 0) * 10 + 0.5) / 10 AS mean_score,
  CAST(floor((epoch_us(r.finished_at) - epoch_us(r.started_at)) / 1e6::DOUBLE + 0.5) * 1000 AS BIGINT) AS duration_ms
FROM {RUNS} r LEFT JOIN {RESULTS} x ON x.run_id = r.id GROUP BY r.id, r.site_id, r.status, r.started_at, r.finished_at
"""


def audit_page(spark: SparkSession, sf_dir: str, page: int = 2, limit: int = 20) -> DataFrame:
    """One page of the history, newest first, ties by id: the paging operator."""
    rows = runs(spark, sf_dir).select("id", "site_id", "status", "started_at")
    return rows.orderBy(F.col("started_at").desc_nulls_last(), "id").offset((page - 1) * limit).limit(limit)


AUDIT_PAGE_SQL = f"SELECT id, site_id, status, started_at FROM {RUNS} ORDER BY started_at DESC NULLS LAST, id LIMIT 20 OFFSET 20"


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed run of each site: an aggregate, not a ranking of all runs."""
    done = runs(spark, sf_dir).where("status = 'COMPLETED' and finished_at is not null")
    last = done.groupBy("site_id").agg(F.max(F.struct("finished_at", "id")).alias("m"))
    return last.select("site_id", F.col("m.id").alias("run_id"), F.col("m.finished_at").alias("finished_at"))


LATEST_RUN_SQL = f"""
SELECT site_id, id AS run_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY finished_at DESC, id DESC) AS rn
  FROM {RUNS} WHERE status = 'COMPLETED' AND finished_at IS NOT NULL) WHERE rn = 1
"""


def backfill_last_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose last audit is missing take it from their latest completed run."""
    last = latest_run(spark, sf_dir).select(F.col("site_id").alias("id"), "finished_at")
    return sites(spark, sf_dir).join(last, "id", "left").select("id", F.coalesce("last_audit_at", "finished_at").alias("last_audit_at"), (F.col("last_audit_at").isNull() & F.col("finished_at").isNotNull()).alias("filled"))


BACKFILL_SQL = f"""
WITH l AS ({LATEST_RUN_SQL})
SELECT s.id, coalesce(s.last_audit_at, l.finished_at) AS last_audit_at, s.last_audit_at IS NULL AND l.finished_at IS NOT NULL AS filled FROM {SITES} s LEFT JOIN l ON l.site_id = s.id
"""


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recommendation (lateral unnest), with its place in the list."""
    rows = results(spark, sf_dir, F.col("recommendations"))
    one = rows.select("id", "run_id", F.posexplode("recommendations").alias("pos", "r"))
    return one.select("id", "run_id", F.col("pos").cast("bigint").alias("pos"), "r.priority", "r.area", "r.message")


RECOMMENDATIONS_SQL = f"""
SELECT id, run_id, pos, r.priority AS priority, r.area AS area, r.message AS message FROM
  (SELECT id, run_id, unnest(range(len(recs))) AS pos, unnest(recs) AS r FROM {RESULTS})
"""


def recommendations_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations by priority and area with subtotals (rollup)."""
    one = recommendations(spark, sf_dir)
    return one.rollup("priority", "area").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_results"), F.grouping_id().cast("bigint").alias("level"))


BY_AREA_SQL = f"SELECT priority, area, count(*) AS n, count(DISTINCT id) AS n_results, CAST(grouping(priority, area) AS BIGINT) AS level FROM ({RECOMMENDATIONS_SQL}) GROUP BY ROLLUP (priority, area)"


def results_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return rows.groupBy(F.coalesce("page_type", F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.min("score").alias("low"), F.max("score").alias("high"))


BY_TYPE_SQL = f"SELECT coalesce(page_type, 'unknown') AS page_type, count(*) AS n, count(*) FILTER (WHERE status = 'FAIL') AS failed, min(score) AS low, max(score) AS high FROM {RESULTS} GROUP BY 1"


def results_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types against statuses, as columns."""
    rows = results(spark, sf_dir).groupBy(F.coalesce("page_type", F.lit("unknown")).alias("page_type")).pivot("status", ["PASS", "WARN", "FAIL"]).agg(F.count(F.lit(1)))
    return rows.select("page_type", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")])


PIVOT_SQL = f"SELECT coalesce(page_type, 'unknown') AS page_type, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("PASS", "WARN", "FAIL")) + f" FROM {RESULTS} GROUP BY 1"


def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the tallies and the score of a site from one completed run to the next, by lag within (site, month) joined across months."""
    from ..operators.snapshots import following

    history = audit_history(spark, sf_dir).where("status = 'COMPLETED'")
    heads = runs(spark, sf_dir).where("status = 'COMPLETED' and started_at is not null").select("id", "site_id", "started_at")
    pairs = following(heads, "site_id", "started_at", "id")
    a, b = history.alias("a"), history.alias("b")
    j = pairs.join(a, F.col("a.id") == pairs["id"]).join(b, F.col("b.id") == pairs["next_key"])
    return j.select(
        F.col("a.site_id").alias("site_id"), F.col("a.id").alias("run_a"), F.col("b.id").alias("run_b"), (F.col("b.passed") - F.col("a.passed")).alias("passed_delta"),
        (F.col("b.failed") - F.col("a.failed")).alias("failed_delta"), round1(F.col("b.mean_score") - F.col("a.mean_score")).alias("score_delta"),
    )


RUN_DELTAS_SQL = f"""
WITH h AS ({AUDIT_HISTORY_SQL}), s AS (SELECT h.*, r.started_at FROM h JOIN {RUNS} r USING (id) WHERE h.status = 'COMPLETED' AND r.started_at IS NOT NULL),
w AS (SELECT site_id, id AS run_a, lead(id) OVER o AS run_b, lead(passed) OVER o - passed AS passed_delta, lead(failed) OVER o - failed AS failed_delta,
  floor((lead(mean_score) OVER o - mean_score) * 10 + 0.5) / 10 AS score_delta FROM s WINDOW o AS (PARTITION BY site_id ORDER BY started_at, id))
SELECT * FROM w WHERE run_b IS NOT NULL
"""


def page_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages improved, regressed or unchanged in status between consecutive snapshots of a site (inner join on url)."""
    from ..operators.snapshots import following, last_statuses

    snaps = load(spark, sf_dir, "audit_snapshots")
    heads = snaps.where("pages is not null").select("id", "site_id", "snapshot_at").distinct()
    pairs = following(heads, "site_id", "snapshot_at", "id").select(F.col("id").alias("a"), F.col("next_key").alias("b"))
    rank = F.coalesce(F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).when(F.col("status") == "PASS", 2), F.lit(-1))
    states = last_statuses(snaps).select("snapshot_id", "url", rank.alias("rank"))
    left = states.select(F.col("snapshot_id").alias("a"), "url", F.col("rank").alias("ra")).join(pairs, "a")
    both = left.join(states.select(F.col("snapshot_id").alias("b"), "url", F.col("rank").alias("rb")), ["b", "url"])
    move = F.when(F.col("rb") > F.col("ra"), "improved").when(F.col("rb") < F.col("ra"), "regressed").otherwise("unchanged")
    return both.select(F.col("b").alias("snapshot_id"), move.alias("move")).groupBy("snapshot_id").pivot("move", ["improved", "regressed", "unchanged"]).agg(F.count(F.lit(1))).na.fill(0)


PAGE_MOVES_SQL = """
WITH heads AS (SELECT DISTINCT id, site_id, snapshot_at FROM audit_snapshots WHERE pages IS NOT NULL),
pairs AS (SELECT id AS a, lead(id) OVER (PARTITION BY site_id ORDER BY snapshot_at, id) AS b FROM heads),
one AS (SELECT id, any_value(pages) AS pages FROM audit_snapshots WHERE pages IS NOT NULL GROUP BY id),
flat AS (SELECT id, unnest(pages) AS p, unnest(range(len(pages))) AS pos FROM one),
last AS (SELECT id, p.url AS url, arg_max(coalesce(p.status, ''), pos) AS status FROM flat WHERE p IS NOT NULL AND p.url IS NOT NULL GROUP BY ALL),
r AS (SELECT id, url, CASE status WHEN 'FAIL' THEN 0 WHEN 'WARN' THEN 1 WHEN 'PASS' THEN 2 ELSE -1 END AS rank FROM last)
SELECT b AS snapshot_id, count(*) FILTER (WHERE y.rank > x.rank) AS improved, count(*) FILTER (WHERE y.rank < x.rank) AS regressed, count(*) FILTER (WHERE y.rank = x.rank) AS unchanged
FROM pairs JOIN r x ON x.id = a JOIN r y ON y.id = b AND y.url = x.url GROUP BY 1
"""


def new_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P0 messages new in or gone from each snapshot against the one before (set difference both ways)."""
    from ..operators.snapshots import following

    snaps = load(spark, sf_dir, "audit_snapshots").where("pages is not null")
    heads = snaps.select("id", "site_id", "snapshot_at").distinct()
    pairs = following(heads, "site_id", "snapshot_at", "id").select(F.col("id").alias("a"), F.col("next_key").alias("b"))
    recs = F.flatten(F.transform("pages", lambda p: F.coalesce(p.recommendations, F.array())))
    p0 = snaps.select("id", F.explode(F.array_distinct(F.transform(F.filter(recs, lambda r: r.priority == "P0"), lambda r: r.message))).alias("message")).where("message is not null").distinct()
    now = p0.join(pairs.select(F.col("b").alias("id")), "id", "left_semi").select(F.col("id").alias("snapshot_id"), "message")
    before = p0.join(pairs.select(F.col("a").alias("id"), F.col("b").alias("snapshot_id")), "id").select("snapshot_id", "message")
    return now.subtract(before).withColumn("change", F.lit("new")).unionByName(before.subtract(now).withColumn("change", F.lit("resolved")))


NEW_CRITICAL_SQL = """
WITH heads AS (SELECT DISTINCT id, site_id, snapshot_at FROM audit_snapshots WHERE pages IS NOT NULL),
pairs AS (SELECT id AS a, lead(id) OVER (PARTITION BY site_id ORDER BY snapshot_at, id) AS b FROM heads),
p0 AS (SELECT DISTINCT id, r.message AS message FROM (SELECT id, unnest(p.recommendations) AS r FROM (SELECT id, unnest(pages) AS p FROM audit_snapshots)) WHERE r.priority = 'P0' AND r.message IS NOT NULL),
now AS (SELECT b AS snapshot_id, message FROM pairs JOIN p0 ON p0.id = b), prior AS (SELECT b AS snapshot_id, message FROM pairs JOIN p0 ON p0.id = a WHERE b IS NOT NULL)
SELECT *, 'new' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM prior) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM prior EXCEPT SELECT * FROM now)
"""


def site_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots and sitemap fields of each run's JSON, by path; unreadable or missing JSON gives NULLs."""
    rows = load(spark, sf_dir, "audit_runs").select("id", F.try_parse_json("site_checks").alias("v")).dropDuplicates(["id"])
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("id", get("$.robots.status", "string").alias("robots"), get("$.sitemap.status", "string").alias("sitemap"), get("$.sitemap.urlCount", "bigint").alias("url_count"), F.coalesce(F.size(get("$.robots.sitemapsFound", "array<string>")), F.lit(0)).cast("bigint").alias("n_sitemaps"))


SITE_CHECKS_SQL = """
SELECT id, json_extract_string(j, '$.robots.status') AS robots, json_extract_string(j, '$.sitemap.status') AS sitemap, TRY_CAST(json_extract_string(j, '$.sitemap.urlCount') AS BIGINT) AS url_count,
  CAST(coalesce(json_array_length(j, '$.robots.sitemapsFound'), 0) AS BIGINT) AS n_sitemaps
FROM (SELECT id, CASE WHEN json_valid(c) THEN c END AS j FROM (SELECT id, any_value(site_checks) AS c FROM audit_runs GROUP BY id))
"""


def upsert_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites merged with the hosts of fetched pages by domain: known domains keep their row, unknown ones are inserted (merge by key, newest wins)."""
    from ..functions.urls import host

    known = sites(spark, sf_dir).select("domain", "id", F.coalesce("updated_at", "created_at").alias("at")).where("domain is not null")
    seen = load(spark, sf_dir, "fetch_results").select(host(F.col("url")).alias("domain"), F.lit(None).cast("string").alias("id"), F.col("fetched_at").alias("at")).where("domain is not null")
    both = known.unionByName(seen)
    merged = both.groupBy("domain").agg(F.max("id").alias("id"), F.max("at").alias("updated_at"), F.count("id").alias("n"))
    return merged.select("domain", "id", "updated_at", F.when(F.col("n") > 0, "updated").otherwise("inserted").alias("action"))


UPSERT_SQL = """
WITH u AS (SELECT DISTINCT domain, id, coalesce(updated_at, created_at) AS seen FROM sites WHERE domain IS NOT NULL
  UNION ALL SELECT {host}, NULL, fetched_at FROM fetch_results WHERE {host} IS NOT NULL)
SELECT domain, max(id) AS id, max(seen) AS updated_at, CASE WHEN count(id) > 0 THEN 'updated' ELSE 'inserted' END AS action FROM u GROUP BY domain
"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of runs and results after sites without any completed run are deleted, by chained anti joins."""
    all_runs = runs(spark, sf_dir)
    keep = all_runs.where("status = 'COMPLETED'").select("site_id").distinct()
    gone = sites(spark, sf_dir).select(F.col("id").alias("site_id")).join(keep, "site_id", "left_anti")
    left_runs = all_runs.join(gone, "site_id", "left_anti")
    left_results = results(spark, sf_dir).join(left_runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return left_runs.agg(F.count("*").alias("n")).select(F.lit("audit_runs").alias("table"), "n").unionByName(left_results.agg(F.count("*").alias("n")).select(F.lit("audit_results").alias("table"), "n"))


CASCADE_SQL = f"""
WITH gone AS (SELECT id FROM {SITES} WHERE id NOT IN (SELECT site_id FROM {RUNS} WHERE status = 'COMPLETED' AND site_id IS NOT NULL)),
r AS (SELECT * FROM {RUNS} x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = x.site_id))
SELECT 'audit_runs' AS "table", count(*) AS n FROM r UNION ALL SELECT 'audit_results', count(*) FROM {RESULTS} x WHERE x.run_id IN (SELECT id FROM r)
"""


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved form values: allowed keys only, trimmed, blanks dropped, as (site, key, value) rows."""
    allowed = ["homeUrl", "articleUrl", "sectionUrl", "tagUrl", "searchUrl", "authorUrl", "videoUrl"]
    rows = load(spark, sf_dir, "sites").select("id", F.explode("last_form_values").alias("key", "value"))
    return rows.where(F.col("key").isin(allowed)).select("id", "key", F.regexp_replace("value", r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "").alias("value")).where("value <> ''").distinct()


FORM_VALUES_SQL = """
SELECT DISTINCT id, key, regexp_replace(v, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS value FROM
  (SELECT id, e.key AS key, e.value AS v FROM (SELECT id, unnest(map_entries(last_form_values)) AS e FROM sites))
WHERE key IN ('homeUrl', 'articleUrl', 'sectionUrl', 'tagUrl', 'searchUrl', 'authorUrl', 'videoUrl') AND regexp_replace(v, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') <> ''
"""


def registry() -> tuple[dict, dict[str, str]]:
    from ..functions.urls import host_sql

    pairs = {
        "project_list": (project_list, PROJECT_LIST_SQL), "audit_history": (audit_history, AUDIT_HISTORY_SQL), "audit_history_page": (audit_page, AUDIT_PAGE_SQL),
        "latest_completed_run": (latest_run, LATEST_RUN_SQL), "backfill_last_audit": (backfill_last_audit, BACKFILL_SQL), "recommendations": (recommendations, RECOMMENDATIONS_SQL),
        "recommendations_by_area": (recommendations_by_area, BY_AREA_SQL), "results_by_type": (results_by_type, BY_TYPE_SQL), "results_pivot": (results_pivot, PIVOT_SQL),
        "run_deltas": (run_deltas, RUN_DELTAS_SQL), "page_moves": (page_moves, PAGE_MOVES_SQL), "new_critical": (new_critical, NEW_CRITICAL_SQL), "site_checks": (site_checks, SITE_CHECKS_SQL),
        "upsert_sites": (upsert_sites, UPSERT_SQL.format(host=host_sql("url"))), "cascade_delete": (cascade_delete, CASCADE_SQL), "form_values": (form_values, FORM_VALUES_SQL),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
