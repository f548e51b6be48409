"""Fetch logs: attempts per fetch classified by what became of them, and page performance by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load

ATTEMPTS = "(SELECT DISTINCT attempt_id, fetch_id, attempt_no, profile, status, ok, failure_kind, elapsed_ms, html_length, cf_challenge, error FROM fetch_attempts)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["attempt_id", "fetch_id", "attempt_no", "profile", "status", "ok", "failure_kind", "elapsed_ms", "html_length", "cf_challenge", "error"]
    return load(spark, sf_dir, "fetch_attempts").select(*cols).dropDuplicates(["attempt_id"])


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the status and length of each attempt say about it, beside the kind logged."""
    s = F.col("status")
    kind = (
        F.when(s.isin(401, 403), "access_denied").when(s.isin(404, 410), "not_found").when(s >= 500, "server_error")
        .when(s.between(200, 299) & (F.coalesce("html_length", F.lit(0)) < 50), "empty_body").when(s.between(200, 299), "success").when(s.isNull(), "unknown").otherwise("access_denied")
    )
    return attempts(spark, sf_dir).groupBy("failure_kind", kind.alias("by_status")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


FAILURE_KINDS_SQL = f"""
SELECT failure_kind, CASE WHEN status IN (401, 403) THEN 'access_denied' WHEN status IN (404, 410) THEN 'not_found' WHEN status >= 500 THEN 'server_error'
  WHEN status BETWEEN 200 AND 299 AND coalesce(html_length, 0) < 50 THEN 'empty_body' WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN status IS NULL THEN 'unknown' ELSE 'access_denied' END AS by_status,
  count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM {ATTEMPTS} GROUP BY 1, 2
"""


def attempt_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fetch: number of attempts, the first that succeeded, the profiles in order, and the total time."""
    per = attempts(spark, sf_dir).groupBy("fetch_id").agg(
        F.count("*").alias("n_attempts"), F.min(F.when(F.col("ok"), F.col("attempt_no"))).cast("bigint").alias("first_ok"), F.sum("elapsed_ms").alias("total_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt_no", "profile"))), lambda x: x.profile), " > ").alias("profiles"), F.bool_or(F.coalesce("cf_challenge", F.lit(False))).alias("challenged"),
    )
    return per


ATTEMPT_CHAINS_SQL = f"""
SELECT fetch_id, count(*) AS n_attempts, CAST(min(attempt_no) FILTER (WHERE ok) AS BIGINT) AS first_ok, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms,
  string_agg(profile, ' > ' ORDER BY attempt_no, profile) AS profiles, bool_or(coalesce(cf_challenge, false)) AS challenged FROM {ATTEMPTS} GROUP BY fetch_id
"""


def blocked_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure it is that a fetch was blocked, from its attempts: any success NONE; any not found or all denied HIGH; two denied MEDIUM; else LOW; no attempts LOW."""
    denied = F.col("failure_kind").isin("access_denied", "waf_challenge")
    per = attempts(spark, sf_dir).groupBy("fetch_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(F.col("failure_kind") == "not_found").alias("n_missing"), F.count_if(denied).alias("n_denied"))
    fetches = load(spark, sf_dir, "fetch_results").select("fetch_id").distinct()
    level = F.when(F.col("n").isNull(), "LOW").when(F.col("n_ok") > 0, "NONE").when((F.col("n_missing") > 0) | (F.col("n_denied") == F.col("n")), "HIGH").when(F.col("n_denied") >= 2, "MEDIUM").otherwise("LOW")
    return fetches.join(per, "fetch_id", "left").select("fetch_id", level.alias("confidence"))


BLOCKED_SQL = f"""
WITH a AS (SELECT fetch_id, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE failure_kind = 'not_found') AS n_missing,
  count(*) FILTER (WHERE failure_kind IN ('access_denied', 'waf_challenge')) AS n_denied FROM {ATTEMPTS} GROUP BY fetch_id)
SELECT f.fetch_id, CASE WHEN n IS NULL THEN 'LOW' WHEN n_ok > 0 THEN 'NONE' WHEN n_missing > 0 OR n_denied = n THEN 'HIGH' WHEN n_denied >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT DISTINCT fetch_id FROM fetch_results) f LEFT JOIN a USING (fetch_id)
"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect hops per fetch and whether the host changed on the way."""
    from ..functions.urls import host

    rows = load(spark, sf_dir, "fetch_results").select("fetch_id", F.coalesce(F.size("redirect_chain"), F.lit(0)).cast("bigint").alias("hops"), F.coalesce(host(F.col("final_url")) != host(F.col("url")), F.lit(False)).alias("host_changed"))
    return rows.distinct()


def daily_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements per day and status, and how late they came in on average, in whole seconds."""
    rows = load(spark, sf_dir, "page_performance").select("perf_id", F.date_format("measured_at", "yyyy-MM-dd").alias("day"), "status", (F.unix_seconds("received_at") - F.unix_seconds("measured_at")).alias("lag_s")).dropDuplicates(["perf_id"])
    return rows.groupBy("day", "status").agg(F.count("*").alias("n"), F.max("lag_s").alias("max_lag_s"), F.floor(F.sum("lag_s") / F.count("lag_s")).alias("mean_lag_s"))


DAILY_SQL = """
SELECT strftime(m, '%Y-%m-%d') AS day, status, count(*) AS n, max(l) AS max_lag_s, CAST(floor(sum(l) / count(l)) AS BIGINT) AS mean_lag_s FROM
 (SELECT perf_id, any_value(measured_at) AS m, any_value(status) AS status, CAST(floor(epoch_us(any_value(received_at)) / 1000000) - floor(epoch_us(any_value(measured_at)) / 1000000) AS BIGINT) AS l FROM page_performance GROUP BY perf_id) GROUP BY 1, 2
"""


def slowest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three slowest measured loads of each page type: top-k by partial ranking."""
    rows = load(spark, sf_dir, "page_performance").select("perf_id", "page_type", "load_ms").where("load_ms is not null").dropDuplicates(["perf_id"])
    rank = F.row_number().over(Window.partitionBy("page_type").orderBy(F.desc("load_ms"), "perf_id"))
    return rows.withColumn("rank", rank).where("rank <= 3").withColumn("rank", F.col("rank").cast("bigint"))


SLOWEST_SQL = """
SELECT * FROM (SELECT perf_id, page_type, load_ms, row_number() OVER (PARTITION BY page_type ORDER BY load_ms DESC, perf_id) AS rank FROM
 (SELECT DISTINCT perf_id, page_type, load_ms FROM page_performance WHERE load_ms IS NOT NULL)) WHERE rank <= 3
"""


def registry() -> tuple[dict, dict[str, str]]:
    from ..functions.urls import host_sql

    redirects_sql = f"SELECT DISTINCT fetch_id, CAST(coalesce(len(redirect_chain), 0) AS BIGINT) AS hops, coalesce({host_sql('final_url')} <> {host_sql('url')}, false) AS host_changed FROM fetch_results"
    pairs = {
        "failure_kinds": (failure_kinds, FAILURE_KINDS_SQL), "attempt_chains": (attempt_chains, ATTEMPT_CHAINS_SQL), "blocked_confidence": (blocked_confidence, BLOCKED_SQL),
        "redirects": (redirects, redirects_sql), "daily_status": (daily_status, DAILY_SQL), "slowest_pages": (slowest_pages, SLOWEST_SQL),
    }
    return {n: f for n, (f, _) in pairs.items()}, {n: s for n, (_, s) in pairs.items()}
