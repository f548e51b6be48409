"""Queries of the operators in this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding_repair, leakage, main_content, mixing, near_duplicates, radix_percentiles, residue, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": residue.found,
        "p2_percentiles": radix_percentiles.percentiles,
        "p2_from_days": radix_percentiles.from_days,
        "p3_found": near_duplicates.found,
        "p3_classes": near_duplicates.classes,
        "p3_links": near_duplicates.class_links,
        "p4_found": main_content.found,
        "p7_found": encoding_repair.found,
        "p7_restored": encoding_repair.restored,
        "p8_found": leakage.found,
        "p8_edited": leakage.edited,
        "p8_per_item": leakage.per_item,
        "p9_mix": mixing.taken,
        "p9_shares": mixing.shares,
        "p10_found": truncation.found,
        "p10_rates": truncation.rates,
    }


def oracle_sql() -> dict[str, str]:
    words = "regexp_extract_all(lower(regexp_replace({}, '<[^>]*>', ' ', 'g')), '[\\w\\p{{L}}\\p{{N}}]+')"
    leaks = f"""
WITH i AS (SELECT item_id, {words.format('passage')} AS w FROM eval_items),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[p:p+11], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
dg AS (SELECT DISTINCT doc_id, list_aggregate(w[p:p+11], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
    return {
        "p2_percentiles": radix_percentiles.PERCENTILES_SQL,
        "p2_from_days": radix_percentiles.FROM_DAYS_SQL,
        "p8_found": leaks + "SELECT doc_id, item_id FROM hits",
        "p8_per_item": leaks + "SELECT item_id, count(*) AS n_docs FROM hits GROUP BY item_id",
    }
