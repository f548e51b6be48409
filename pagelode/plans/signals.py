"""Nested audit data as analytics: weighted means of signals, found types, and text measures of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.shredding import OVERALL_SQL, QUANTILES_SQL, RANKED_SQL, SIGNALS, TYPE_COUNTS_SQL, TYPES_WANTED, WEIGHTED_SQL, shred, signal_rows, type_rows
from ..session import load, scratch
from . import augmented


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per result and signal category: sum of score times weight over sum of weights, in percent to one place; signals without weight don't count."""
    rows = signal_rows(scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", (SIGNALS + "[].*", SIGNALS + ".*.*")), "nodes"))
    typed = rows.select("id", "category", F.expr("try_cast(score as double)").alias("s"), F.expr("try_cast(weight as double)").alias("w")).where("w > 0 and s is not null")
    per = typed.groupBy(F.col("id").alias("result_id"), "category").agg(F.count("*").alias("n"), _mean().alias("mean"))
    return per.select("result_id", "category", "n", (F.floor(F.col("mean") * 1000 + 0.5) / 10).alias("score"))


def _mean():
    """Weighted mean; summed as decimals, so that it doesn't depend on the order of the rows."""
    exact = lambda c: F.sum(c.cast("decimal(30,9)")).cast("double")
    return exact(F.col("s") * F.col("w")) / exact(F.col("w"))


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per result: the weighted mean over all its signals in whole percent; 50 for a result without any that counts."""
    results = load(spark, sf_dir, "audit_results").select(F.col("id").alias("result_id")).where("id is not null").distinct()
    rows = signal_rows(scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", (SIGNALS + "[].*", SIGNALS + ".*.*")), "nodes"))
    per = rows.select(F.col("id").alias("result_id"), F.expr("try_cast(score as double)").alias("s"), F.expr("try_cast(weight as double)").alias("w")).where("w > 0 and s is not null").groupBy("result_id").agg(_mean().alias("mean"))
    return results.join(per, "result_id", "left").select("result_id", F.coalesce(F.floor(F.col("mean") * 100 + 0.5), F.lit(50)).cast("bigint").alias("score"))


def signals_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each result by weight, the heaviest first, those without weight last; ties in document order."""
    rows = signal_rows(scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", (SIGNALS + "[].*", SIGNALS + ".*.*")), "nodes"))
    rows = rows.select(F.col("id").alias("result_id"), F.col("name").alias("signal"), F.expr("try_cast(weight as double)").alias("weight"), "child_pos")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("result_id").orderBy(F.col("weight").desc_nulls_last(), "child_pos")).cast("bigint"))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type was found, and in how many results."""
    rows = type_rows(scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", TYPES_WANTED), "nodes"))
    return rows.groupBy(F.col("name").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_results"))


def signal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest, median and highest score of each signal (the median as an order statistic)."""
    rows = signal_rows(scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", (SIGNALS + "[].*", SIGNALS + ".*.*")), "nodes"))
    typed = rows.select(F.col("name").alias("signal"), F.expr("try_cast(score as double)").alias("s")).where("s is not null")
    return typed.groupBy("signal").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.expr("percentile_disc(0.5) within group (order by s)").alias("median"), F.max("s").alias("high"))


_META = "(SELECT meta_id, any_value(site_id) AS site_id, any_value(url) AS url, any_value(title) AS title, any_value(lang) AS lang, any_value(hreflang_tags) AS tags FROM content_meta GROUP BY meta_id)"


def _meta(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return load(spark, sf_dir, "content_meta").select("meta_id", *cols).dropDuplicates(["meta_id"])


def title_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most repeats of a word of more than three letters in a title, and the share of different words."""
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    rows = _meta(spark, sf_dir, "title").where("title is not null").select("meta_id", words.alias("w")).where("size(w) > 0")
    most = F.array_max(F.transform(F.array_distinct("w"), lambda x: F.size(F.filter("w", lambda y: y == x))))
    return rows.select("meta_id", F.size("w").cast("bigint").alias("n"), most.cast("bigint").alias("most"), (F.floor(F.size(F.array_distinct("w")) * 100.0 / F.size("w") + 0.5) / 100).alias("unique_share"))


TITLE_REPETITION_SQL = rf"""
SELECT meta_id, CAST(len(w) AS BIGINT) AS n, CAST(list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) AS BIGINT) AS most,
  floor(len(list_distinct(w)) * 100.0::DOUBLE / len(w) + 0.5) / 100 AS unique_share
FROM (SELECT meta_id, list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}]+'), lambda t: length(t) > 3) AS w FROM {_META} WHERE title IS NOT NULL) WHERE len(w) > 0
"""


def hreflang_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language alternatives of each described page, each pair once."""
    rows = _meta(spark, sf_dir, "hreflang_tags").select("meta_id", F.explode("hreflang_tags").alias("t"))
    return rows.select("meta_id", F.lower("t.hreflang").alias("lang"), F.col("t.href").alias("href")).where("lang is not null and href is not null").distinct()


HREFLANG_SQL = f"SELECT DISTINCT meta_id, lower(t.hreflang) AS lang, t.href AS href FROM (SELECT meta_id, unnest(tags) AS t FROM {_META}) WHERE t.hreflang IS NOT NULL AND t.href IS NOT NULL"


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a page by its address alone, against the kind that was noted."""
    path = U.path(F.col("url"))
    kind = (
        F.when(path == "/", "home").when(F.col("url").rlike(r"(?i)[?&](?:q|s|search|query)=|/search(?:/|$)"), "search").when(path.rlike("(?i)^/(?:tag|tags|topic)/"), "tag").when(path.rlike("(?i)^/(?:author|authors|by)/"), "author")
        .when(path.rlike("(?i)^/(?:video|videos|watch)/"), "video").when(path.rlike("(?i)^/(?:section|category)/"), "section").when(path.rlike("(?i)/[^/]*[0-9][^/]*/?$|/[^/]+-[^/]+-[^/]+"), "article").otherwise("section")
    )
    rows = load(spark, sf_dir, "audit_results").select("id", "url", "page_type").dropDuplicates(["id"]).where("url is not null")
    return rows.groupBy("page_type", kind.alias("by_url")).agg(F.count("*").alias("n"))


_P = U.path_sql("url")
PAGE_KINDS_SQL = rf"""
SELECT page_type, CASE WHEN {_P} = '/' THEN 'home' WHEN regexp_matches(url, '(?i)[?&](?:q|s|search|query)=|/search(?:/|$)') THEN 'search' WHEN regexp_matches({_P}, '(?i)^/(?:tag|tags|topic)/') THEN 'tag'
  WHEN regexp_matches({_P}, '(?i)^/(?:author|authors|by)/') THEN 'author' WHEN regexp_matches({_P}, '(?i)^/(?:video|videos|watch)/') THEN 'video' WHEN regexp_matches({_P}, '(?i)^/(?:section|category)/') THEN 'section'
  WHEN regexp_matches({_P}, '(?i)/[^/]*[0-9][^/]*/?$|/[^/]+-[^/]+-[^/]+') THEN 'article' ELSE 'section' END AS by_url, count(*) AS n
FROM (SELECT id, any_value(url) AS url, any_value(page_type) AS page_type FROM audit_results GROUP BY id) WHERE url IS NOT NULL GROUP BY 1, 2
"""


def microdata_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types named by itemtype and typeof attributes, schema prefixes stripped."""
    from .augmented import pages

    found = F.concat(F.regexp_extract_all("html", F.lit(r"(?i)itemtype=[\"'](?:https?://schema\.org/)?([^\"']+)[\"']"), F.lit(1)), F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)typeof=[\"']([^\"']+)[\"']"), F.lit(1)), lambda t: F.split(t, "[ \t\r\n\f]+"))))
    return pages(spark, sf_dir).select("fetch_id", F.explode(F.transform(found, lambda t: F.regexp_replace(t, "^schema:", ""))).alias("type")).where("type <> ''").distinct()


MICRODATA_SQL = r"""
SELECT DISTINCT fetch_id, regexp_replace(t, '^schema:', '') AS type FROM (SELECT fetch_id, unnest(list_concat(regexp_extract_all(html, '(?i)itemtype=["''](?:https?://schema\.org/)?([^"'']+)["'']', 1),
  flatten(list_transform(regexp_extract_all(html, '(?i)typeof=["'']([^"'']+)["'']', 1), lambda x: regexp_split_to_array(x, '[ \t\r\n\f]+'))))) AS t FROM {a}) WHERE t <> ''
"""


def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient reading of date texts (ISO dates, ISO times, day-month-year), NULL where unreadable, and the ISO test, over texts made of run times."""
    at = F.col("started_at")
    texts = F.explode(F.array(F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "dd.MM.yyyy"), F.lit("soon")))
    rows = load(spark, sf_dir, "audit_runs").select("id", "started_at").distinct().where("started_at is not null").select("id", texts.alias("text"))
    # the session's zone is UTC; fixed shapes are tried in turn and nothing throws
    value = F.coalesce(F.try_to_timestamp("text", F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp("text", F.lit("yyyy-MM-dd")), F.try_to_timestamp("text", F.lit("dd.MM.yyyy")))
    return rows.select("id", "text", F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias("value"), F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?$").alias("iso"))


DATE_VALUES_SQL = r"""
WITH t AS (SELECT DISTINCT id, started_at AS a FROM audit_runs WHERE started_at IS NOT NULL),
x AS (SELECT id, unnest([strftime(a, '%Y-%m-%d'), strftime(a, '%Y-%m-%dT%H:%M:%SZ'), strftime(a, '%d.%m.%Y'), 'soon']) AS text FROM t)
SELECT id, text, strftime(coalesce(try_strptime(text, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%d.%m.%Y')), '%Y-%m-%d %H:%M:%S') AS value,
  regexp_matches(text, '^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?$') AS iso FROM x
"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per language, spellings folded to the primary tag (en-GB, EN_us -> en), with share of the site."""
    lang = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})", 1), F.lit("")), F.lit("unknown"))
    rows = _meta(spark, sf_dir, "site_id", "lang").groupBy("site_id", lang.alias("language")).agg(F.count("*").alias("n"))
    total = rows.groupBy("site_id").agg(F.sum("n").alias("total"))
    return rows.join(total, "site_id").select("site_id", "language", "n", (F.floor(F.col("n") * 1000.0 / F.col("total") + 0.5) / 10).alias("pct"))


LANGUAGES_SQL = f"""
WITH l AS (SELECT site_id, coalesce(nullif(regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})', 1), ''), 'unknown') AS language, count(*) AS n FROM {_META} WHERE site_id IS NOT NULL GROUP BY 1, 2)
SELECT site_id, language, n, floor(n * 1000.0::DOUBLE / sum(n) OVER (PARTITION BY site_id) + 0.5) / 10 AS pct FROM l
"""


def registry() -> tuple[dict, dict[str, str]]:
    pairs = {
        "title_repetition": (title_repetition, TITLE_REPETITION_SQL), "hreflang_pairs": (hreflang_pairs, HREFLANG_SQL), "page_kinds": (page_kinds, PAGE_KINDS_SQL), 
        "microdata_types": (microdata_types, MICRODATA_SQL.format(a=augmented.SQL)), "date_values": (date_values, DATE_VALUES_SQL), "languages": (languages, LANGUAGES_SQL),
    }
    queries = {n: f for n, (f, _) in pairs.items()} | {"weighted_scores": weighted_scores, "overall_scores": overall_scores, "signals_ranked": signals_ranked, "type_counts": type_counts, "signal_quantiles": signal_quantiles}
    return queries, {n: s for n, (_, s) in pairs.items()} | {"weighted_scores": WEIGHTED_SQL, "type_counts": TYPE_COUNTS_SQL, "overall_scores": OVERALL_SQL, "signals_ranked": RANKED_SQL, "signal_quantiles": QUANTILES_SQL}
