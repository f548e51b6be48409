"""Evaluation passages inside training text (problem 8) by pigeonhole edit matching.

A leak is a run of ``RUN`` words of a passage that a document holds with at most ``budget`` word edits
(insertions, deletions, replacements); ``found`` asks for none, ``edited`` for up to ``EDITS`` and reports how many.
Each passage is cut into consecutive pieces so short (``piece_width``) that any RUN words in a row hold budget+1
whole pieces: with no more errors than budget, at least one of them is in the document without any.
Documents are scanned for exact piece hits (rolling hashes of their word windows against the pieces'
hashes); each hit is verified by Myers' bit-parallel edit distance between every RUN-word window of the passage
around the piece and the document's words around the hit.  That distance decides; nothing else does.

The passages are sent to the tasks; a set of more than ``MAX_ITEM_WORDS`` words is scanned for in blocks of that
size, one after another, each block's hits being written before the next is read.

Defined results: mark-up tags become blanks in both; NULL or blank texts and passages shorter than RUN
words leak nothing; repeated rows count once; whole texts are scanned; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, scratch, spread
from .near_duplicates import WordHashes

RUN, EDITS = 12, 2
MAX_ITEM_WORDS = 2_000_000
_TAG = re.compile(r"<[^>]*>")
_WORDS = re.compile(r"\w+")
_MIX = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(_TAG.sub(" ", text).lower())


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all width-word windows of 64-bit word hashes; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc += words[j : j + n] * _MIX[j]
    acc ^= acc >> np.uint64(31)
    return acc * np.uint64(0x9E3779B97F4A7C15)


def myers_distance(pattern: list, text: list) -> int:
    """Least edit distance between pattern and any part of text: Myers' bit-parallel algorithm over symbols."""
    m = len(pattern)
    if m == 0:
        return 0
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        best = min(best, score)
    return best


def piece_width(run: int, budget: int) -> int:
    """The longest pieces of which any run words in a row of the passage hold budget+1 whole ones."""
    return max(p for p in range(1, run + 1) if (run - p + 1) // p >= budget + 1)


class Passages:
    """The items' words, and a sorted array of piece hashes with where each piece lies."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, budget: int = 0) -> None:
        known = WordHashes()
        self.run, self.budget, self.piece = run, budget, piece_width(run, budget)
        self.words: list[tuple[int, list[str]]] = []
        self.sets: dict[tuple[int, int], frozenset[str]] = {}
        hashes, where = [], []
        for item_id, passage in items:
            words = words_of(passage or "")
            if len(words) < run:
                continue
            at = len(self.words)
            self.words.append((item_id, words))
            h = window_hashes(np.array([known[w] for w in words], np.uint64), self.piece)
            for start in range(0, len(words) - self.piece + 1, self.piece):
                hashes.append(h[start])
                where.append((at, start))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.where = [where[i] for i in order]

    def leaked(self, words: list[str], hashes: np.ndarray) -> dict[int, int]:
        """item -> least number of errors with which words hold a run of it, within the budget."""
        found: dict[int, int] = {}
        if not len(self.hashes) or not len(hashes):
            return found
        at = np.searchsorted(self.hashes, hashes)
        hits = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes)
        for j in hits.tolist():
            k = int(at[j])
            while k < len(self.hashes) and self.hashes[k] == hashes[j]:
                item, start = self.where[k]
                k += 1
                item_id, passage = self.words[item]
                if found.get(item_id, 1):
                    errors = self._errors(item, passage, start, words, j)
                    if errors <= self.budget and errors < found.get(item_id, errors + 1):
                        found[item_id] = errors
        return found

    def _errors(self, item: int, passage: list[str], start: int, words: list[str], j: int) -> int:
        """Least distance of a run of the passage around the piece at start from the words around j.

        A run that lacks more of its different words there than the budget is farther than that, and isn't measured."""
        best = self.budget + 1
        around = None
        for s in range(max(0, start + self.piece - self.run), min(start, len(passage) - self.run) + 1):
            first = j - (start - s)
            if first + self.run <= 0 or first >= len(words):
                continue
            if around is None:  # the words that any of these runs is compared with
                around = set(words[max(0, j - self.run - self.budget) : j + self.run + self.budget])
            of = self.sets.get((item, s))
            if of is None:
                of = self.sets[item, s] = frozenset(passage[s : s + self.run])
            if len(of & around) < len(of) - self.budget:
                continue
            context = words[max(0, first - self.budget) : first + self.run + self.budget]
            best = min(best, myers_distance(passage[s : s + self.run], context))
            if best == 0:
                break
        return best


def leaks(documents: DataFrame, items: DataFrame, budget: int = 0) -> DataFrame:
    """(doc_id, item_id, errors): every document with every item it leaks within the budget, and the least errors."""
    spark = documents.sparkSession
    held = items.select(F.col("item_id").cast("bigint"), F.col("passage").cast("string")).where("item_id is not null and length(passage) > 0").dropDuplicates(["item_id"])
    n_words = held.agg(F.coalesce(F.sum(F.size(F.split("passage", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-n_words // MAX_ITEM_WORDS))
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and length(trim(text)) > 0"))
    out = None
    for b in range(blocks):
        rows = (held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else held).collect()  # about MAX_ITEM_WORDS words
        shared = spark.sparkContext.broadcast([(r.item_id, r.passage) for r in rows])
        part = docs.mapInArrow(_scan(shared, budget), "doc_id bigint, item_id bigint, errors int")
        if blocks > 1:
            part = scratch(part, "leaks")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("errors").alias("errors"))


def _scan(shared, budget: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, known = Passages(shared.value, RUN, budget), WordHashes()
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("errors", pa.int32())])
        for batch in source:
            cols: list[list] = [[], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for item_id, errors in passages.leaked(words, window_hashes(np.array([known[w] for w in words], np.uint64), passages.piece)).items():
                    for col, x in zip(cols, (doc_id, item_id, errors), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return batches


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, errors): leaks with up to EDITS word edits in a run; those of no error are ``found``."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), EDITS)


def per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, n_docs): which test items leaked, and into how many documents."""
    return found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
