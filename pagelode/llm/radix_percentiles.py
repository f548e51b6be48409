"""Percentiles of very large numeric columns (problem 2) by radix selection.

Floating values are mapped to order-preserving 64-bit integers.  A first histogram counts the high
32-bit digit of every value per group and metric; only the digit that holds a target rank is followed,
into a histogram of the low 32 bits.  A digit bucket that holds a single distinct value (the rule for
whole milliseconds) needs no second pass, and if all do, the second pass isn't run.  Results are exact
order statistics: the smallest value whose cumulative share reaches the target.

Digests (``digest``) are histograms of the high ``DIGEST_BITS`` bits per day; adding counts merges them,
and a percentile read off merged digests errs by less than one bucket: 2**-(DIGEST_BITS-12) relative.

Rows move once a pass, by group and salt, and groups that aren't hot are counted and ranked where they lie, so the
width of the digits costs no shuffle.  Groups that hold more than 1/(2*partitions) of all rows are found
first; by counting there are fewer than 2*partitions of them, so that list may be broadcast.  They are
salted, counted in their slices and added up; all others are counted and ranked where they lie.

Defined results: NULL, NaN, infinite and negative values are left out (negative fillers can't be times
or sizes), zeros stay; redelivered rows (same perf_id) count once; groups or metrics without values
yield no row; NULL site or page type is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, scratch

METRICS = ("load_ms", "html_kb", "ttfb_ms")
PERCENTS = (50, 75, 90, 95, 99)
DIGEST_BITS = 20
_LOW = (1 << 32) - 1


def to_key(values: np.ndarray) -> np.ndarray:
    """float64 -> int64 that sorts alike; -0.0 sorts as 0.0."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_key(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _keyed(metrics: tuple[str, ...]):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cols, names = [], []
            for name, col in zip(batch.schema.names, batch.columns, strict=True):
                if name in metrics:
                    x = col.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                    ok = np.isfinite(x) & (x >= 0)
                    col = pa.array(to_key(np.where(ok, x, 0.0)), mask=~ok)
                cols.append(col)
                names.append(name)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return batches


def keyed_rows(perf: DataFrame, *more: str) -> DataFrame:
    """perf_id, site_id, page_type, the metrics as keys (NULL where left out), and more columns."""
    rows = perf.select(F.col("perf_id").cast("bigint"), F.col("site_id").cast("string"), F.col("page_type").cast("string"), *[F.col(m).cast("double") for m in METRICS], *more)
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"{c} {'bigint' if c in METRICS else kinds[c]}" for c in rows.columns)
    return rows.mapInArrow(_keyed(METRICS), ddl)


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    stack = ", ".join(f"'{m}', {m}" for m in METRICS)
    return rows.select(*keys, F.expr(f"stack({len(METRICS)}, {stack}) as (metric, k)")).where("k is not null")


def _salted(perf: DataFrame) -> DataFrame:
    """Rows by (site_id, page_type, salt), redelivered ones dropped; salt is 0 but for hot groups."""
    rows = keyed_rows(perf)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = scratch(perf.groupBy(F.col("site_id").cast("string").alias("hs"), F.col("page_type").cast("string").alias("hp")).agg(F.count("*").alias("n")), "groups")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("n") * (2 * parts) > F.lit(total)).select("hs", "hp")
    same = F.col("site_id").eqNullSafe(F.col("hs")) & F.col("page_type").eqNullSafe(F.col("hp"))
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), same, "left").drop("hs", "hp")
    salt = F.when(F.col("is_hot"), 1 + F.pmod(F.xxhash64("perf_id"), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    moved = marked.withColumn("salt", salt).drop("is_hot").repartition("site_id", "page_type", "salt")
    return moved.dropDuplicates(["site_id", "page_type", "salt", "perf_id"])


def _rank_targets(percents: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.expr(f"(n_all * {p} + 99) div 100").alias("rank")) for p in percents])).alias("t")


def exact_percentiles(perf: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(site_id, page_type, metric, pct, n, value): exact percentiles per group."""
    group = ["site_id", "page_type", "metric"]
    values = _long(_salted(perf), "site_id", "page_type", "salt").withColumn("digit", F.shiftright("k", 32))
    lying = ["site_id", "page_type", "salt"]
    # "slice" is the salt as an aggregate: a filter on it stays above the exchange, so that both branches read the same one
    first = values.groupBy(*lying, "metric", "digit").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("salt").alias("slice"))

    def ranked_by(hist: DataFrame, keys: list[str]) -> DataFrame:
        whole = Window.partitionBy(*keys)
        return hist.withColumn("cum", F.sum("n").over(whole.orderBy("digit"))).withColumn("n_all", F.sum("n").over(whole)).select(*group, "digit", "n", "lo", "hi", "cum", "n_all")

    # groups that aren't hot are ranked where they lie; of hot ones the cells are added up over the slices
    cold = ranked_by(first.where("slice = 0"), [*lying, "metric"])
    hot = first.where("slice > 0").groupBy(*group, "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranked = cold.unionByName(ranked_by(hot, group))
    # each digit keeps the targets whose rank falls into it
    targets = ranked.select(*group, "digit", "n", "lo", "hi", "cum", "n_all", _rank_targets(percents)).select("*", "t.pct", "t.rank").drop("t")
    targets = targets.where("rank <= cum and rank > cum - n")
    targets = scratch(targets, "radix")
    done = targets.where("lo = hi").select(*group, "pct", "n_all", F.col("lo").alias("k"))
    rest = targets.where("lo <> hi")
    if not rest.isEmpty():
        follow = rest.select(*group, "digit").distinct()
        null_safe = [values[c].eqNullSafe(follow[c]) for c in group] + [values["digit"] == follow["digit"]]
        low = values.join(follow, null_safe, "left_semi").groupBy(*group, "digit", "k").agg(F.count("*").alias("m"))
        low = low.withColumn("at", F.sum("m").over(Window.partitionBy(*group, "digit").orderBy("k")))
        left, right = rest.alias("l"), low.alias("r")
        join = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group] + [F.col("l.digit") == F.col("r.digit")]
        inside = F.expr("l.rank - (l.cum - l.n)")
        hits = left.join(right, join).where((inside <= F.col("r.at")) & (inside > F.col("r.at") - F.col("r.m")))
        done = done.unionByName(hits.select(*[F.col(f"l.{c}").alias(c) for c in group], F.col("l.pct").alias("pct"), F.col("l.n_all").alias("n_all"), F.col("r.k").alias("k")))
    return _decoded(done.withColumnRenamed("n_all", "n"))


def _decoded(rows: DataFrame) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            value = pa.array(from_key(batch.column(5).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], value], names=["site_id", "page_type", "metric", "pct", "n", "value"])

    return rows.select("site_id", "page_type", "metric", "pct", F.col("n").cast("bigint"), "k").mapInArrow(batches, "site_id string, page_type string, metric string, pct int, n bigint, value double")


def digest(perf: DataFrame, day: str = "measured_at") -> DataFrame:
    """(day, site_id, page_type, metric, bucket, n): a day's mergeable digest; buckets are high bits of the keys."""
    rows = keyed_rows(perf.withColumn("_day", F.to_date(day)), "_day").dropDuplicates(["perf_id"])
    long = _long(rows, "_day", "site_id", "page_type")
    return long.groupBy(F.col("_day").alias("day"), "site_id", "page_type", "metric", F.shiftright("k", 64 - DIGEST_BITS).alias("bucket")).agg(F.count("*").alias("n"))


def merged_percentiles(digests: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(site_id, page_type, metric, pct, n, value) from any number of digests added up; value is its bucket's lower edge."""
    group = ["site_id", "page_type", "metric"]
    hist = digests.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    ranked = hist.withColumn("cum", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))).withColumn("n_all", F.sum("n").over(Window.partitionBy(*group)))
    hits = ranked.select(*group, "bucket", "n", "cum", "n_all", _rank_targets(percents)).where("t.rank <= cum and t.rank > cum - n")
    return _decoded(hits.select(*group, F.col("t.pct").alias("pct"), F.col("n_all").alias("n"), F.shiftleft("bucket", 64 - DIGEST_BITS).alias("k")))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_percentiles(load(spark, sf_dir, "page_performance"))


def from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_percentiles(digest(load(spark, sf_dir, "page_performance")))


PERCENTILES_SQL = """
WITH once AS (SELECT perf_id, any_value(site_id) AS site_id, any_value(page_type) AS page_type, any_value(load_ms) AS load_ms, any_value(html_kb) AS html_kb, any_value(ttfb_ms) AS ttfb_ms
  FROM page_performance GROUP BY perf_id),
long AS (SELECT site_id, page_type, 'load_ms' AS metric, CAST(load_ms AS DOUBLE) AS v FROM once
  UNION ALL SELECT site_id, page_type, 'html_kb', html_kb FROM once
  UNION ALL SELECT site_id, page_type, 'ttfb_ms', CAST(ttfb_ms AS DOUBLE) FROM once),
ok AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, page_type, metric ORDER BY v) AS rn, count(*) OVER (PARTITION BY site_id, page_type, metric) AS n FROM ok),
p AS (SELECT CAST(unnest([50, 75, 90, 95, 99]) AS INTEGER) AS pct)
SELECT site_id, page_type, metric, pct, n, v AS value FROM r, p WHERE rn = (n * pct + 99) // 100
"""
#: Percentiles from digests are the exact ones brought down to their bucket's edge: eight bits after the leading one.
FROM_DAYS_SQL = f"""
WITH x AS ({PERCENTILES_SQL})
SELECT site_id, page_type, metric, pct, n, CASE WHEN value = 0 THEN 0::DOUBLE ELSE floor(value / pow(2, floor(log2(value)) - 8)) * pow(2, floor(log2(value)) - 8) END AS value FROM x
"""
