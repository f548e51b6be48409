"""Sources and sinks: tables by name, JDBC, and the text exports of recommendations and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import history


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table from files of any format Spark reads; a schema, if given, spares the inference scan."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, properties: Mapping[str, str]) -> DataFrame:
    """A database table read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=dict(properties))


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 8, properties: Mapping[str, str] | None = None) -> None:
    """df into a database table over at most so many connections."""
    many = df.coalesce(partitions) if df.rdd.getNumPartitions() > partitions else df
    many.write.jdbc(url, table, mode=mode, properties=dict(properties or {}))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options: str) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, with a header."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """children with the rows of the parents that occur in new replaced by new."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def _quoted(name: str):
    return F.concat(F.lit('"'), F.replace(F.coalesce(name, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def recommendation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations as quoted CSV lines, with the result and place they come from."""
    rows = history.recommendations(spark, sf_dir)
    return rows.select("id", "pos", F.concat_ws(",", _quoted("priority"), _quoted("area"), _quoted("message")).alias("line"))


CSV_SQL = "SELECT id, pos, " + " || ',' || ".join(f"""'"' || replace(coalesce({c}, ''), '"', '""') || '"'""" for c in ("priority", "area", "message")) + f" AS line FROM ({history.RECOMMENDATIONS_SQL})"


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per result, its recommendations as a checklist text: P0 first, then P1 and P2, in list order within.  A result's list is bounded by its document."""
    rows = history.recommendations(spark, sf_dir).where("message is not null")
    order = F.coalesce(F.nullif(F.array_position(F.array(F.lit("P0"), F.lit("P1"), F.lit("P2")), F.col("priority")), F.lit(0)), F.lit(9))
    line = F.concat(F.lit("[ ] ["), F.coalesce("area", F.lit("-")), F.lit("] "), F.col("message"))
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "pos", line.alias("line")))).alias("l"))
    return per.select("id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))


CHECKLIST_SQL = f"""
SELECT id, string_agg('[ ] [' || coalesce(area, '-') || '] ' || message, chr(10) ORDER BY CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 ELSE 9 END, pos) AS text
FROM ({history.RECOMMENDATIONS_SQL}) WHERE message IS NOT NULL GROUP BY id
"""


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown table row per completed run."""
    h = history.audit_history(spark, sf_dir).where("status = 'COMPLETED'")
    cells = [F.col("site_id"), F.col("passed"), F.col("warnings"), F.col("failed"), F.col("critical"), F.coalesce(F.format_string("%.1f", "mean_score"), F.lit("-"))]
    return h.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |")).alias("line"))


MARKDOWN_SQL = f"SELECT id, '| ' || concat_ws(' | ', site_id, passed, warnings, failed, critical, coalesce(format('{{:.1f}}', mean_score), '-')) || ' |' AS line FROM ({history.AUDIT_HISTORY_SQL}) WHERE status = 'COMPLETED'"


def registry() -> tuple[dict, dict[str, str]]:
    return {"recommendation_csv": recommendation_csv, "checklist": checklist, "markdown_report": markdown_report}, {"recommendation_csv": CSV_SQL, "checklist": CHECKLIST_SQL, "markdown_report": MARKDOWN_SQL}
