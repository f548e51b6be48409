"""Token counts with a public byte-level BPE vocabulary, read from a file named by parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-splitting pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> None:
    """Have the driver serve the vocabulary to executors that don't have it at its path, once per application."""
    key = spark.sparkContext.applicationId, path
    if key not in _SENT and os.path.isfile(path):
        _SENT.add(key)
        spark.sparkContext.addFile(path)


def _at_worker(path: str) -> str:
    return path if os.path.isfile(path) else SparkFiles.get(os.path.basename(path))


def with_token_counts(rows: DataFrame, text_col: str, out_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows without text_col, with out_col: its number of tokens (0 for NULL).  Whole texts are encoded."""
    kept = [c for c in rows.columns if c != text_col]
    _send(rows.sparkSession, vocabulary)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(_at_worker(vocabulary)).encode_ordinary
        for batch in source:
            counts = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*kept, out_col])

    kinds = dict(rows.dtypes)
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{out_col}` bigint"])
    return rows.select(F.col(text_col).cast("string"), *kept).mapInArrow(batches, ddl)
