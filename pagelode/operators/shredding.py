"""Nested records into related flat tables (problem 6) by adjacency-table shredding.

A document becomes nodes (id, node, parent, label, ordinal, path, kind, scalar), numbered in document
order.  Object nodes are then joined with their scalar children, and the children are pivoted into
the columns of an entity table that keeps the parent link.  ``shred`` takes the paths wanted and
leaves the rest of the document out of the table, as a column pruning of the nested side.

Defined results: NULL, empty or invalid JSON (NaN and Infinity included) yields nothing; a document
held as a JSON string, repeatedly if need be, or under ``payload`` is unwrapped; key spelling
(camelCase, snake_case) is folded for paths; null children have no position; repeated children stay;
redelivered records count once; very deep documents are walked with a stack of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, scratch, spread

NODE_DDL = "id string, node int, parent int, label string, ordinal int, path string, kind string, scalar string"
_NODE = pa.schema([("id", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("scalar", pa.string())])
_FOLD = re.compile(r"[^a-z0-9]")


def fold(key: str) -> str:
    """layeredScore, layered_score -> layeredscore."""
    return _FOLD.sub("", key.lower())


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _decode(text: str) -> object:
    return json.loads(text, parse_constant=_refuse)


def unwrap(text: str | None, wrapper: str = "payload") -> object:
    """The document in text, out of any JSON strings and wrapper objects around it; None if there is none."""
    value: object = text
    try:
        while True:
            if isinstance(value, str):
                value = _decode(value)
            elif isinstance(value, dict) and wrapper in value and isinstance(value[wrapper], (str, dict)) and not any(isinstance(v, (dict, list)) for k, v in value.items() if k != wrapper):
                value = value[wrapper]
            else:
                return value if isinstance(value, (dict, list)) else None
    except (ValueError, RecursionError):
        return None


def _scalar(value: object) -> str | None:
    return value if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False)


_TOKEN = re.compile(r"\[\]|[^.\[\]]+")


class Wanted(dict):
    """path -> whether it leads to or is one of the wanted paths, remembered.  A * stands for any one key."""

    def __init__(self, patterns: Iterable[str]) -> None:
        super().__init__()
        self.patterns = [_TOKEN.findall(p) for p in patterns]

    def __missing__(self, path: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        have = _TOKEN.findall(path)
        hit = not self.patterns or any(len(have) <= len(p) and all(h == w or (w == "*" and h != "[]") for h, w in zip(have, p, strict=False)) for p in self.patterns)
        self[path] = hit
        return hit


def nodes_of(doc: object, wanted: Wanted) -> Iterator[tuple]:
    """(node, parent, label, ordinal, path, kind, scalar) of a document, in document order.

    Paths are folded keys joined by dots; list entries have their list's path with [] after it, however
    deep lists are nested in lists.  Only nodes on the way to or at a wanted path are given.
    """
    number = 0
    stack: list[tuple[object, int, str | None, int, str]] = [(doc, -1, None, 0, "")]
    while stack:
        value, parent, label, ordinal, path = stack.pop()
        if not wanted[path]:
            continue
        me, number = number, number + 1
        if isinstance(value, dict):
            yield me, parent, label, ordinal, path, "object", None
            stack += reversed([(v, me, k, i, f"{path}.{fold(k)}" if path else fold(k)) for i, (k, v) in enumerate(value.items())])
        elif isinstance(value, list):
            yield me, parent, label, ordinal, path, "list", None
            inner = path if path.endswith("[]") else path + "[]"
            stack += reversed([(v, me, None, i, inner) for i, v in enumerate(value)])
        else:
            yield me, parent, label, ordinal, path, "null" if value is None else "scalar", _scalar(value)


def shred(records: DataFrame, id_col: str, json_col: str, wanted: Iterable[str] = ()) -> DataFrame:
    """The adjacency table of records' documents (restricted to the wanted paths, if any)."""
    paths = tuple(wanted)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = Wanted(paths)
        for batch in source:
            cols: list[list] = [[] for _ in range(8)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = unwrap(text.as_py())
                if doc is not None:
                    for row in nodes_of(doc, keep):
                        cols[0].append(rid)
                        for col, value in zip(cols[1:], row, strict=True):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE, strict=True)], schema=_NODE)

    rows = records.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("json")).where("id is not null and json is not null")
    return spread(rows).mapInArrow(batches, NODE_DDL)


def entity(nodes: DataFrame, members: Column, fields: dict[str, str]) -> DataFrame:
    """(id, node, parent, label, scalar, <fields>): member nodes joined with their scalar children, pivoted.

    fields: column name -> folded label of the child.  Both sides are reduced to one row per (id, node)
    before the join, which also drops redelivered documents.
    """
    own = nodes.where(members).groupBy("id", "node").agg(*[F.min(c).alias(c) for c in ("parent", "label", "kind", "scalar")])
    kids = nodes.where(F.col("kind") == "scalar").withColumn("_key", F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")).where(F.col("_key").isin(*fields.values()))
    wide = kids.groupBy("id", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("_key") == k, F.col("scalar"))).alias(c) for c, k in fields.items()])
    return own.join(wide, ["id", "node"], "left")


def positions(members: DataFrame) -> DataFrame:
    """Adds child_pos: the member's place among its record's members, from 0, in document order."""
    return members.withColumn("child_pos", (F.row_number().over(Window.partitionBy("id").orderBy("node")) - 1).cast("int"))


SIGNALS, TYPES = "layeredscore.signals", "structureddata.typesfound"
TYPES_WANTED = (TYPES + "[].name", TYPES + "[].type", TYPES + ".*")


def _depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit(".")))


def signal_rows(nodes: DataFrame) -> DataFrame:
    """One row per signal: entries of a list, or values of a keyed object, with the signal's scalar fields."""
    below = (F.col("path") == SIGNALS + "[]") & F.col("kind").isin("object", "scalar") | F.col("path").startswith(SIGNALS + ".") & (_depth(F.col("path")) == 2) & (F.col("kind") != "null")
    fields = {"signal_id": "id", "category": "category", "score": "score", "weight": "weight", "availability": "availability"}
    rows = positions(entity(nodes, below, fields))
    return rows.withColumn("name", F.coalesce("label", F.when(F.col("kind") == "scalar", F.col("scalar")).otherwise(F.col("signal_id"))))


def type_rows(nodes: DataFrame) -> DataFrame:
    """One row per found type: a scalar alone, entries of (nested) lists, or an object's name."""
    at = (F.col("path").isin(TYPES, TYPES + "[]")) & F.col("kind").isin("scalar", "object") & ~((F.col("path") == TYPES) & (F.col("kind") == "object"))
    keyed = F.col("path").startswith(TYPES + ".") & (_depth(F.col("path")) == 2) & (F.col("kind") != "null")
    rows = positions(entity(nodes.withColumn("label", F.when(F.col("path") != TYPES, F.col("label"))), at | keyed, {"type_name": "name", "type_at": "type"}))
    return rows.withColumn("name", F.coalesce("label", F.when(F.col("kind") == "scalar", F.col("scalar")).otherwise(F.coalesce("type_name", "type_at"))))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (SIGNALS + "[].id", SIGNALS + ".*", *TYPES_WANTED)
    nodes = scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", wanted), "nodes")  # read four times below
    row = lambda df, kind: df.select(F.col("id").alias("result_id"), F.lit(kind).alias("child_kind"), "child_pos", F.col("name").alias("child_name"))
    return row(signal_rows(nodes), "signal").unionByName(row(type_rows(nodes), "type"))


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of every result as an entity table with its parent link."""
    nodes = scratch(shred(load(spark, sf_dir, "audit_results"), "id", "data", (SIGNALS + "[].*", SIGNALS + ".*.*")), "nodes")
    rows = signal_rows(nodes)
    return rows.select(F.col("id").alias("result_id"), "child_pos", F.col("name").alias("signal"), "category", F.expr("try_cast(score as double)").alias("score"), F.expr("try_cast(weight as double)").alias("weight"), "availability")


#: The nodes on the way to signals and types of every readable document, once each, with folded paths: for DuckDB, whose json_tree does the shredding.
_NODES_SQL = """
WITH RECURSIVE once AS (SELECT id, any_value(data) AS d FROM audit_results WHERE id IS NOT NULL GROUP BY id),
u AS (SELECT id, 0 AS n, d::JSON AS j FROM once WHERE json_valid(d) UNION ALL
  SELECT id, n + 1, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$')::JSON ELSE json_extract(j, '$.payload') END FROM u
  WHERE n < 20 AND (json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) OR json_type(j) = 'OBJECT' AND json_type(j, '$.payload') IN ('VARCHAR', 'OBJECT')
    AND len(list_filter(json_keys(j), lambda k: k <> 'payload' AND json_type(j, '$."' || k || '"') IN ('OBJECT', 'ARRAY'))) = 0)),
doc AS (SELECT id, arg_max(j, n) AS j FROM u GROUP BY id),
t AS (SELECT doc.id AS rid, x.id AS node, x.parent, x.key, x.type, x.value FROM doc, json_tree(doc.j) AS x WHERE json_type(doc.j) IN ('OBJECT', 'ARRAY')),
p AS (SELECT rid, node, parent, NULL::VARCHAR AS label, type, value, '' AS path FROM t WHERE parent IS NULL UNION ALL
  SELECT t.rid, t.node, t.parent, CASE WHEN p.type = 'OBJECT' THEN t.key END, t.type, t.value,
    CASE WHEN p.type = 'ARRAY' THEN CASE WHEN ends_with(p.path, '[]') THEN p.path ELSE p.path || '[]' END WHEN p.path = '' THEN regexp_replace(lower(t.key), '[^a-z0-9]', '', 'g') ELSE p.path || '.' || regexp_replace(lower(t.key), '[^a-z0-9]', '', 'g') END
  FROM p JOIN t ON t.rid = p.rid AND t.parent = p.node WHERE p.path = '' OR starts_with(p.path, 'layeredscore') OR starts_with(p.path, 'structureddata')),
kid AS (SELECT rid, parent AS node, max(json_extract_string(value, '$')) FILTER (WHERE k = 'id') AS id, max(json_extract_string(value, '$')) FILTER (WHERE k = 'name') AS name, max(json_extract_string(value, '$')) FILTER (WHERE k = 'type') AS type,
  max(json_extract_string(value, '$')) FILTER (WHERE k = 'category') AS category, max(json_extract_string(value, '$')) FILTER (WHERE k = 'score') AS score, max(json_extract_string(value, '$')) FILTER (WHERE k = 'weight') AS weight, max(json_extract_string(value, '$')) FILTER (WHERE k = 'availability') AS availability
  FROM (SELECT *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS k FROM p WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')) GROUP BY rid, parent),
m AS (SELECT p.*, type NOT IN ('OBJECT', 'ARRAY', 'NULL') AS is_scalar, len(path) - len(replace(path, '.', '')) AS dots FROM p),
sig AS (SELECT m.rid, m.node, coalesce(m.label, CASE WHEN is_scalar THEN json_extract_string(value, '$') ELSE kid.id END) AS name, kid.category, kid.score, kid.weight, kid.availability FROM m LEFT JOIN kid USING (rid, node)
  WHERE path = 'layeredscore.signals[]' AND m.type NOT IN ('NULL', 'ARRAY') OR starts_with(path, 'layeredscore.signals.') AND dots = 2 AND m.type <> 'NULL'),
typ AS (SELECT m.rid, m.node, coalesce(CASE WHEN path <> 'structureddata.typesfound' THEN m.label END, CASE WHEN is_scalar THEN json_extract_string(value, '$') ELSE coalesce(kid.name, kid.type) END) AS name FROM m LEFT JOIN kid USING (rid, node)
  WHERE path = 'structureddata.typesfound' AND is_scalar OR path = 'structureddata.typesfound[]' AND m.type NOT IN ('NULL', 'ARRAY') OR starts_with(path, 'structureddata.typesfound.') AND dots = 2 AND m.type <> 'NULL')
"""
FOUND_SQL = _NODES_SQL + """SELECT rid AS result_id, 'signal' AS child_kind, CAST(row_number() OVER (PARTITION BY rid ORDER BY node) - 1 AS INTEGER) AS child_pos, name AS child_name FROM sig
UNION ALL SELECT rid, 'type', CAST(row_number() OVER (PARTITION BY rid ORDER BY node) - 1 AS INTEGER), name FROM typ"""
SIGNAL_TABLE_SQL = _NODES_SQL + "SELECT rid AS result_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY node) - 1 AS INTEGER) AS child_pos, name AS signal, category, TRY_CAST(score AS DOUBLE) AS score, TRY_CAST(weight AS DOUBLE) AS weight, availability FROM sig"
TYPE_COUNTS_SQL = _NODES_SQL + "SELECT name AS type, count(*) AS n, count(DISTINCT rid) AS n_results FROM typ GROUP BY name"
WEIGHTED_SQL = _NODES_SQL + """, w AS (SELECT rid, category, TRY_CAST(score AS DOUBLE) AS s, TRY_CAST(weight AS DOUBLE) AS w FROM sig)
SELECT rid AS result_id, category, count(*) AS n, floor(CAST(sum(CAST(s * w AS DECIMAL(30,9))) AS DOUBLE) / CAST(sum(CAST(w AS DECIMAL(30,9))) AS DOUBLE) * 1000 + 0.5) / 10 AS score FROM w WHERE w > 0 AND s IS NOT NULL GROUP BY 1, 2"""
OVERALL_SQL = _NODES_SQL + """, w AS (SELECT rid, TRY_CAST(score AS DOUBLE) AS s, TRY_CAST(weight AS DOUBLE) AS w FROM sig),
mm AS (SELECT rid, floor(CAST(sum(CAST(s * w AS DECIMAL(30,9))) AS DOUBLE) / CAST(sum(CAST(w AS DECIMAL(30,9))) AS DOUBLE) * 100 + 0.5) AS v FROM w WHERE w > 0 AND s IS NOT NULL GROUP BY rid)
SELECT id AS result_id, CAST(coalesce(v, 50) AS BIGINT) AS score FROM once LEFT JOIN mm ON mm.rid = once.id"""
RANKED_SQL = _NODES_SQL + """, w AS (SELECT rid, name, TRY_CAST(weight AS DOUBLE) AS weight, CAST(row_number() OVER (PARTITION BY rid ORDER BY node) - 1 AS INTEGER) AS child_pos FROM sig)
SELECT rid AS result_id, name AS signal, weight, child_pos, row_number() OVER (PARTITION BY rid ORDER BY weight DESC NULLS LAST, child_pos) AS place FROM w"""
QUANTILES_SQL = _NODES_SQL + """, q AS (SELECT name AS signal, TRY_CAST(score AS DOUBLE) AS s FROM sig)
SELECT signal, count(*) AS n, min(s) AS low, quantile_disc(s, 0.5) AS median, max(s) AS high FROM q WHERE s IS NOT NULL GROUP BY signal"""
