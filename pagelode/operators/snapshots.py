"""What changed between consecutive full snapshots (problem 5).

Pages are normalised to (site, url, number of the snapshot, digest of status and recommendation set) and moved once, by site
and url; all that follows is done where they lie.  Every state counts for its own snapshot and against the next one, so
that the sum of the signs per (site, url, snapshot, state) is EXCEPT ALL both ways: identical rows cancel, what is
left over is new or old.  The residues of both sides are then put together by key, a full join on (site, url, snapshot)
that needs no exchange, and labelled.  Only residues are given their snapshot's id.

Defined results: a snapshot without pages (NULL) is passed over, an empty list is a state; redelivered
snapshots count once; of a url listed repeatedly the last entry holds; entries that are NULL or have no
url are passed over; NULL status is a value; NULL and empty recommendation lists are alike; ties in time
are ordered by id; snapshots without a site are a site of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, scratch, small


def following(heads: DataFrame, group: str, at: str, key: str, unit: str = "month") -> DataFrame:
    """(key, next_key): the row after each row of its group in the order (at, key).

    Ordered within calendar buckets first and across the buckets' first rows second, so that a group
    that holds a large part of all rows is never sorted in one task.
    """
    rows = heads.select(group, at, key).withColumn("_bucket", F.date_trunc(unit, F.col(at)))
    inner = Window.partitionBy(group, "_bucket").orderBy(at, key)
    ranked = rows.withColumn("_next", F.lead(key).over(inner))
    first = rows.groupBy(group, "_bucket").agg(F.min_by(key, F.struct(at, key)).alias("_first"))
    across = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(group).orderBy("_bucket"))).select(group, "_bucket", "_after")
    joined = ranked.join(across, [group, "_bucket"], "left")
    return joined.select(key, F.coalesce("_next", "_after").alias("next_key")).where("next_key is not null")


def numbered(heads: DataFrame, group: str, at: str, key: str, unit: str = "month") -> DataFrame:
    """group, key, no, is_last: each row's number in its group in the order (at, key), from 1, and whether it is the last.

    Numbered within calendar buckets first, the buckets' counts added up second, so that a group
    that holds a large part of all rows is never sorted in one task.
    """
    rows = heads.select(group, at, key).withColumn("_bucket", F.coalesce(F.date_trunc(unit, F.col(at)), F.timestamp_micros(F.lit(0))))
    inner = Window.partitionBy(group, "_bucket").orderBy(at, key)
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(group)
    counts = counts.withColumn("_before", F.sum("_n").over(along.orderBy("_bucket")) - F.col("_n")).withColumn("_all", F.sum("_n").over(along)).drop("_n")
    no = F.col("_before") + F.col("_rn")
    return rows.withColumn("_rn", F.row_number().over(inner)).join(counts, [group, "_bucket"]).select(group, key, no.alias("no"), (no == F.col("_all")).alias("is_last"))


def page_states(snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """(site, url, no, is_last, state): one row per snapshot and url, lying by site and url; state is a digest of status and the set of (priority, area, message).

    places: (site, id, no, is_last) of the snapshots."""
    recs = "array_sort(array_distinct(transform(filter(coalesce(p.recommendations, array()), r -> r is not null), r -> to_json(struct(r.priority, r.area, r.message), map('ignoreNullFields', 'false')))))"
    rows = snapshots.where("pages is not null").select("id", "pages").join(small(places.select("id", "site", "no", "is_last")), "id")
    rows = rows.select("site", "no", "is_last", F.posexplode("pages").alias("pos", "p")).where("p is not null and p.url is not null")
    # a status is written after its length, so that no status and list look like another pair
    state = F.expr(f"unhex(md5(concat(coalesce(concat(length(p.status), ':', p.status), '-'), concat_ws('\n', {recs}))))")
    rows = rows.select("site", F.col("p.url").alias("url"), F.col("no").cast("int").alias("no"), "is_last", "pos", state.alias("state")).repartition("site", "url")
    return rows.groupBy("site", "url", "no", "is_last").agg(F.max_by("state", "pos").alias("state"))


def last_statuses(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, url, status): the last entry of each url of each snapshot."""
    rows = snapshots.where("pages is not null").select(F.col("id").alias("snapshot_id"), F.posexplode("pages").alias("pos", "p")).where("p is not null and p.url is not null")
    return rows.groupBy("snapshot_id", F.col("p.url").alias("url")).agg(F.max_by("p.status", "pos").alias("status"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, url, change_kind): pages added, removed or changed from each snapshot of a site to the next."""
    site = F.when(F.col("site_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("site_id").cast("string")))
    taken = snapshots.select(F.col("id").cast("string").alias("id"), site.alias("site"), "snapshot_at", "pages")
    heads = taken.where("pages is not null").groupBy("id").agg(F.min_by(F.struct("site", "snapshot_at"), F.struct("snapshot_at", "site")).alias("h")).select("id", "h.*")
    places = scratch(numbered(heads, "site", "snapshot_at", "id"), "places")
    states = page_states(taken, places)
    for_next = F.when(~F.col("is_last"), F.struct((F.col("no") + 1).alias("at"), F.lit(-1).alias("sign")))
    own = F.when(F.col("no") > 1, F.struct(F.col("no").alias("at"), F.lit(1).alias("sign")))
    signed = states.select("site", "url", "state", F.explode(F.array_compact(F.array(own, for_next))).alias("e")).select("site", "url", "e.at", "state", "e.sign")
    residue = signed.groupBy("site", "url", "at", "state").agg(F.sum("sign").alias("surplus")).where("surplus <> 0")
    both = residue.groupBy("site", "url", "at").agg(F.max(F.col("surplus") > 0).alias("is_new"), F.max(F.col("surplus") < 0).alias("is_old"))
    kind = F.when(F.col("is_new") & F.col("is_old"), "changed").when(F.col("is_new"), "added").otherwise("removed")
    ids = small(places.select("site", F.col("no").alias("at"), F.col("id").alias("snapshot_id")))
    return both.select("site", F.col("at").cast("bigint").alias("at"), "url", kind.alias("change_kind")).join(ids, ["site", "at"]).select("snapshot_id", "url", "change_kind")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(load(spark, sf_dir, "audit_snapshots"))


FOUND_SQL = """
WITH heads AS (SELECT DISTINCT id, site_id, snapshot_at FROM audit_snapshots WHERE pages IS NOT NULL),
later AS (SELECT id, lead(id) OVER (PARTITION BY site_id ORDER BY snapshot_at, id) AS next_id FROM heads),
one AS (SELECT id, any_value(pages) AS pages FROM audit_snapshots WHERE pages IS NOT NULL GROUP BY id),
flat AS (SELECT id, unnest(pages) AS p, unnest(range(len(pages))) AS pos FROM one),
last AS (SELECT id, p.url AS url, arg_max(struct_pack(status := p.status,
    recs := CASE WHEN p.recommendations IS NULL THEN [] ELSE list_sort(list_distinct(list_transform(p.recommendations, lambda r: to_json([r.priority, r.area, r.message])::VARCHAR))) END), pos) AS s
  FROM flat WHERE p IS NOT NULL AND p.url IS NOT NULL GROUP BY id, p.url),
new AS (SELECT l.id, l.url, l.s FROM last l JOIN later ON later.next_id = l.id),
old AS (SELECT later.next_id AS id, l.url, l.s FROM last l JOIN later ON later.id = l.id WHERE later.next_id IS NOT NULL)
SELECT coalesce(n.id, o.id) AS snapshot_id, coalesce(n.url, o.url) AS url,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.id = o.id AND n.url = o.url
WHERE n.id IS NULL OR o.id IS NULL OR n.s.status IS DISTINCT FROM o.s.status OR n.s.recs IS DISTINCT FROM o.s.recs
"""
