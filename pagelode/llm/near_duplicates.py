"""Near-duplicate main bodies (problem 3) by covering locality-sensitive hashing.

Each body becomes a sketch of min-hash symbols over its three-word shingles, those of the exact check.
``SEGMENTS`` segments of 2**(RADIUS+1)-1 parts (of ``PARTS`` symbols) are taken from it.  In each segment a
covering family of bit masks (all non-zero words of the Hadamard code) selects the parts that form a
table key: two segments that differ in at most RADIUS parts agree on every part of at least one mask, so
they meet in that table.  By the pigeonhole principle every pair whose segments differ in at most
SEGMENTS*(RADIUS+1)-1 symbols (51 of 130 here) collides somewhere.  Colliding pairs then pass a Hamming
ball on ``HASHES`` two-bit digits, one of each min-hash (carried with the key, so far pairs end inside the
join), and what is left is compared exactly.

A symbol of two bodies agrees with probability J, their similarity, whatever the edits.  At J = 0.5 a segment
hits with 0.25 (parts agree with 0.25, 0.25, 0.5), so all tables miss a pair with 0.75**26 = 0.0006 and the
ball, whose digits differ with 0.375, drops it with 0.0003: a pair at the threshold is missed with 0.0009, a closer
one less.  Unrelated bodies of one language (J about 0.15) pass the ball with 0.00004.

Equal bodies are folded into one class first; only class representatives are sketched into tables
and linked, and the links are spread over the members at the end.  No bucket, partner or candidate
is capped; hot keys are split by the adaptive skew join.

Defined results: NULL or empty html, pages with residue and pages without a main body have no
pairs; bodies of fewer than three words pair only if equal; redelivered rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, scratch, spread
from .html_events import Page
from .main_content import main_blocks
from .residue import has_residue

RADIUS, SEGMENTS, PARTS = 1, 26, ((0, 1), (2, 3), (4,))
WIDTH = sum(len(p) for p in PARTS)
SYMBOLS = SEGMENTS * WIDTH
HASHES, BALL = 192, 95
SHINGLE_WORDS, SIMILARITY = 3, 0.5

_WORDS = re.compile(r"\w+")
_RNG = np.random.default_rng(20240101)
_A = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_MIX = _RNG.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_SKETCH = [f"s{i}" for i in range(1, 7)]  # three words of high bits, three of low bits


def covering_masks(radius: int) -> list[tuple[int, ...]]:
    """Positions kept by each mask: position i (1..2**(radius+1)-1) is kept by mask v if <i, v> is odd.
    For any ``radius`` positions some non-zero v is orthogonal to all of them, so its mask avoids them."""
    n = 2 ** (radius + 1)
    return [tuple(i - 1 for i in range(1, n) if bin(i & v).count("1") % 2) for v in range(1, n)]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the width-word windows of 64-bit word hashes."""
    n = max(1, len(words) - width + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        acc += words[j : j + n] * _MIX[j]
    acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return (acc >> np.uint64(32)).astype(np.uint32)


def _mins(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 2048):  # very long texts in pieces
        out = np.minimum(out, (hashes[at : at + 2048, None] * a + b).min(axis=0))
    return out


def sketch(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the segments as int32; the digits as six int64, three of high and three of low bits)."""
    low = _mins(_shingles(word_hashes, SHINGLE_WORDS), _A, _B)
    digits = ((low * np.uint32(2654435761)) >> np.uint32(30)).astype(np.uint8)
    return low[:SYMBOLS].view(np.int32), np.packbits(np.concatenate([digits >> 1, digits & 1])).view(np.int64)


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_BODY = pa.schema(
    [("fetch_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), *[(s, pa.int64()) for s in _SKETCH], ("symbols", pa.list_(pa.int32())), ("words", pa.string())]
)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        cols: list[list] = [[] for _ in _BODY]
        for fetch_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(html.as_py())
            main = main_blocks(page)
            if not main or has_residue(page):
                continue
            words = _WORDS.findall(" ".join(page.blocks[i - 1].text for i in main).lower())
            if not words:
                continue
            text = " ".join(words)
            digest = xxhash.xxh3_128_intdigest(text)
            symbols, bits = sketch(np.array([known[w] for w in words], np.uint64))
            row = (fetch_id, (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63), *bits.tolist(), symbols, text)
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BODY, strict=True)], schema=_BODY)


def bodies(fetches: DataFrame) -> DataFrame:
    """(fetch_id, h1, h2: hash of the body, s1 to s6: digits of the sketch, symbols, words) of every page with a body."""
    pages = fetches.select(F.col("fetch_id").cast("bigint"), F.col("html").cast("string")).where("length(html) > 0 and fetch_id is not null")
    return spread(pages).mapInArrow(_bodies, f"fetch_id bigint, h1 bigint, h2 bigint, {', '.join(f'{x} bigint' for x in _SKETCH)}, symbols array<int>, words string")


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of representatives that meet in some table and whose sketches are within the ball."""
    masks = covering_masks(RADIUS)
    keys = F.array(
        *[F.xxhash64(F.lit(s * len(masks) + m), *[F.col("symbols")[s * WIDTH + i] for part in kept for i in PARTS[part]]) for s in range(SEGMENTS) for m, kept in enumerate(masks)]
    )
    table = reps.select(F.explode(keys).alias("key"), F.col("rep").alias("id"), *_SKETCH)
    a, b = table.alias("a"), table.alias("b")
    near = F.expr(" + ".join(f"bit_count((a.s{i} ^ b.s{i}) | (a.s{i + 3} ^ b.s{i + 3}))" for i in (1, 2, 3)) + f" <= {BALL}")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shingle_set(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[j:] for j in range(SHINGLE_WORDS)), strict=False))

    last, right = None, set()  # rows come sorted by b from the join before
    for batch in batches:
        out_a, out_b = [], []
        for a, b, wa, wb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if b != last:
                last, right = b, shingle_set(wb.as_py())
            left = shingle_set(wa.as_py())
            common = len(left & right)
            if common and common >= SIMILARITY * (len(left) + len(right) - common):
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)


def near_duplicate_links(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links between class representatives a < b, members (rep, fetch_id)) of ``bodies`` output."""
    made = scratch(made, "bodies")
    per_class = made.groupBy("h1", "h2").agg(F.min_by(F.struct("fetch_id", *_SKETCH, "symbols"), "fetch_id").alias("r"))
    reps = per_class.select(F.col("r.fetch_id").alias("rep"), *[f"r.{s}" for s in _SKETCH], "r.symbols")
    pairs = scratch(candidates(reps), "pairs")
    texts = made.select("fetch_id", "words")
    ids = pairs.select(F.col("a").alias("fetch_id")).unionByName(pairs.select(F.col("b").alias("fetch_id"))).distinct()
    texts = texts.join(ids, "fetch_id", "left_semi").dropDuplicates(["fetch_id"])
    left = pairs.join(texts.select(F.col("fetch_id").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(texts.select(F.col("fetch_id").alias("b"), F.col("words").alias("wb")), "b")
    links = both.select("a", "b", "wa", "wb").mapInArrow(_exact, "a bigint, b bigint")
    members = made.select("fetch_id", "h1", "h2").distinct().join(per_class.select("h1", "h2", F.col("r.fetch_id").alias("rep")), ["h1", "h2"]).select("rep", "fetch_id")
    return links, members


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of near-duplicate fetches, the smaller id first."""
    links, members = near_duplicate_links(bodies(load(spark, sf_dir, "fetch_results")))
    members = scratch(members, "members")
    shared = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    left = links.unionByName(shared).join(members.select(F.col("rep").alias("a"), F.col("fetch_id").alias("x")), "a")
    both = left.join(members.select(F.col("rep").alias("b"), F.col("fetch_id").alias("y")), "b").where("a <> b or x < y")
    return both.select(F.least("x", "y").alias("fetch_id_a"), F.greatest("x", "y").alias("fetch_id_b"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fetch with a body: its class of equal bodies and how many other classes it is linked to."""
    links, members = near_duplicate_links(bodies(load(spark, sf_dir, "fetch_results")))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(degree, "rep", "left").select("fetch_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_a, class_b): the links between classes of equal bodies, the smaller id first; with the membership of ``classes`` they say all that ``found`` does, without its squares."""
    links, _ = near_duplicate_links(bodies(load(spark, sf_dir, "fetch_results")))
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
