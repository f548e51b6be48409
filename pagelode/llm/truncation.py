"""Texts cut off by field limits or in transfer (problem 10).

Lengths of each source, in characters and in bytes and without any mark put after the stop, give
discrete hazards h(L) = n(length = L) / n(length >= L) by window functions.  Each hazard is tested
against the pooled hazard of its neighbours with a binomial tail, and the false discovery rate over all
sources, units and lengths is controlled (Benjamini-Hochberg).  Texts at a significant length are judged by
the test: every ending there that isn't complete is a cut (``by`` is ``limit``), forms where their own hazard is
significant.  Cuts in transfer leave no length behind, so away from the limits, and only there, an ending counts if it
shows by itself that it isn't one (``by`` is ``ending``): inside a tag, a character reference or a running
sentence, or before a mark.

Endings that may be complete without a full stop (forms): addresses, directives and labelled lists
("Tags: a, b"), list entries, signatures, lines without letters.  A whole one falls on a limit by chance, so
they are flagged where the hazard of forms alone is significant: where more of them end than at the
lengths around.  One or two forms cut at a limit can't be told from whole ones and aren't flagged.

The discovery rate is controlled without a global order: p-values are counted per source and in ``STEPS`` classes of
their logarithm, and the largest class edge that Benjamini-Hochberg passes is the cut-off, so a limit may be missed
whose p-value lies between the exact cut-off and the next lower edge (a factor of 1.07), never one added.

Defined results: NULL and blank texts are no cases; trailing blanks don't count; source spellings that
differ in case, blanks or hyphens are one, NULL sources are one source; a mark after a finished sentence
is no cut; repeated rows count once; whole texts are measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, scratch
from .mixing import source_key

#: Neighbouring lengths on either side, and how close ones are skipped (limits cut at word or character bounds).
REACH, GAP = 25, 2
#: False discovery rate, and the least number of texts of a significant length.
FDR, LEAST = 0.001, 3
#: Classes of -log p by which the discovery rate is controlled, and the least p told apart.
STEPS, LEAST_P = 10_000, 1e-300
#: Kinds of endings that show a cut in transfer, away from limits.
IN_TRANSFER = ("broken", "marked", "running")

_POINTERS = "read more|more|continue reading|weiterlesen|mehr|lire la suite|suite|la suite|leer más|más|seguir leyendo"
#: Marks and pointers put after a stop (fixed).
MARK = rf"(?i)\s*(?:(?:…|\.\.\.)\s*(?:{_POINTERS})?|\[\s*(?:\.\.\.|…|(?:…\s*|\.\.\.\s*)?(?:{_POINTERS}))\s*\]|\((?:\.\.\.|…|{_POINTERS})\)|»\s*(?:{_POINTERS}))$"
_CLOSERS = r"[\"”»’“'\)\]]*"
_TERMINAL = rf"[.!?。]{_CLOSERS}(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>)*$"
_FINISHED = rf"[.!?。]{_CLOSERS}(?:\s|<)"
_OPEN_TAG, _OPEN_COMMENT = r"^(?:/?[A-Za-z][^<>]*|/|!-[^>]*)?$", r"<!-[^>]*$"  # after the last "<"; from any
_OPEN_REFERENCE = r"^#?[A-Za-z0-9]{0,8}$"  # after the last "&"
_FORM = r"^\s*(?:https?://\S+|[A-Z][A-Za-z-]*:\s+\S+|(?:[-*•–]|\d{1,3}[.)])\s+.*|[\p{Lu}][\p{L}-]*\s?:\s+[^.!?]*,[^.!?]*|(?:—|–|--)\s*\p{L}.*)$"


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars and bytes of the text without trailing blanks and mark, and the kind of its ending:
    complete, form (complete without a stop), broken (inside a tag or reference), marked, running (an unfinished
    sentence in a text of sentences), open (a few words without a stop)."""
    # a pattern anchored at the end scans the whole text for each of its starts: where a cheaper test settles it, that is asked first
    text = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    last = F.right("core", F.lit(1))
    rows = documents.select(F.col("doc_id").cast("bigint"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("s", text).where(F.length("s") > 0)
    # a lone straight quote after an unfinished sentence is the exporter's, not the text's
    quotes = F.length("s") - F.length(F.replace(F.col("s"), F.lit('"')))
    stray = F.col("s").endswith('"') & (quotes % 2 == 1) & ~F.right("s", F.lit(2)).rlike(r"^[.!?]\"$")
    may_mark = F.expr("s like '%…%' or s like '%...%' or s like '%[%' or s like '%(%' or s like '%»%'")
    rows = rows.withColumn("core", F.when(stray, F.expr("left(s, length(s) - 1)")).when(may_mark, F.regexp_replace("s", MARK, "")).otherwise(F.col("s"))).where(F.length("core") > 0)
    tail = F.regexp_replace(F.substring_index("core", "\n", -1), r"(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>)+$", "")
    marked = F.length("core") < F.length("s")
    kind = (
        F.when(F.col("core").contains("<") & (F.substring_index("core", "<", -1).rlike(_OPEN_TAG) | F.col("core").contains("<!-") & F.col("core").rlike(_OPEN_COMMENT)), "broken")
        .when(F.col("core").contains("&") & F.substring_index("core", "&", -1).rlike(_OPEN_REFERENCE), "broken")
        .when(last.isin(".", "!", "?", "。") | last.rlike(r"[\"”»’“'\)\]>]") & F.col("core").rlike(_TERMINAL), "complete")
        .when(marked, "marked")
        .when(tail.rlike(_FORM), "form")
        .when(~tail.rlike(r"\p{L}"), "form")
        .when(F.col("core").rlike(_FINISHED) | (F.size(F.split(F.trim(tail), r"\s+")) >= 4), "running")
        .otherwise("open")
    )
    return rows.select("doc_id", "source", F.length("core").alias("chars"), F.octet_length("core").alias("bytes"), kind.alias("kind")).dropDuplicates(["doc_id"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p), by its terms from k up."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log) if log > -745 else 0.0
    i, odds = k, p / (1 - p)
    while i < n:
        term *= (n - i) / (i + 1) * odds
        total += term
        i += 1
        if term <= total * 1e-12:
            break
    return min(1.0, total)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, n, nk, nn = (batch.column(c).to_pylist() for c in ("n", "at_risk", "near_n", "near_at_risk"))
        # half an event more than seen keeps empty neighbourhoods from having hazard 0
        p = [binomial_tail(a, b, ((c or 0) + 0.5) / ((d or 0) + 1.0)) if a >= LEAST else 1.0 for a, b, c, d in zip(k, n, nk, nn, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])


def length_limits(ends: DataFrame) -> DataFrame:
    """(source, unit, length, n, at_risk, p): the lengths whose hazards stand out from their neighbours'.

    The windows run over the histogram of lengths, which is bounded by sources times the longest text.
    """
    long = ends.select("source", F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (unit, length)"))
    hist = long.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    hist = hist.withColumn("at_risk", F.sum("n").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # lengths that don't occur are at risk too: as many texts as at the next length that does
    prior = F.coalesce(F.lag("length").over(by), F.col("length") - 1)
    hist = hist.withColumn("span", F.least(F.col("length") - prior, F.lit(2 * REACH + 1)))
    near = lambda c, a, b: F.coalesce(F.sum(c).over(by.rangeBetween(a, b)), F.lit(0))
    exposed = F.col("at_risk") * F.col("span")
    hist = hist.withColumn("near_n", near("n", -REACH, -GAP) + near("n", GAP, REACH)).withColumn("near_at_risk", near(exposed, -REACH, -GAP) + near(exposed, GAP, REACH))
    kinds = ", ".join(f"{c} {t}" for c, t in hist.dtypes)
    tested = scratch(hist.mapInArrow(_tails, kinds + ", p double"), "hazards")
    m = tested.count()
    # Benjamini-Hochberg over classes of p instead of a global order: at most STEPS counts come to the driver
    step = math.log(LEAST_P) / STEPS
    small = tested.where(f"p <= {FDR}").withColumn("k", F.floor(F.log(F.greatest("p", F.lit(LEAST_P))) / F.lit(step)).cast("int"))  # p <= exp(k * step)
    counts = dict(small.groupBy("k").count().collect())
    cut, below = None, sum(counts.values())
    for k in range(min(counts, default=0), STEPS + 1):
        if below and math.exp(k * step) <= FDR * below / m:
            cut = k
            break
        below -= counts.get(k, 0)
    return small.where(F.col("k") >= F.lit(STEPS + 1 if cut is None else cut)).select("source", "unit", "length", "n", "at_risk", "p")


def cut_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(endings with columns at_limit, cut and by, limits); by says what decided a cut: limit or ending."""
    ends = scratch(endings(documents), "endings")
    limits = scratch(length_limits(ends), "limits")
    at = lambda unit: limits.where(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.lit(True).alias(f"{unit}_limit"))
    joined = ends.join(at("chars"), ["source", "chars"], "left").join(at("bytes"), ["source", "bytes"], "left")
    forms = scratch(length_limits(ends.where("kind = 'form'")), "form_limits")
    of_forms = lambda unit: forms.where(F.col("unit") == unit).select("source", F.lit("form").alias("kind"), F.col("length").alias(unit), F.lit(True).alias(f"{unit}_form"))
    joined = joined.join(of_forms("chars"), ["source", "kind", "chars"], "left").join(of_forms("bytes"), ["source", "kind", "bytes"], "left")
    at_limit = F.coalesce("chars_limit", F.lit(False)) | F.coalesce("bytes_limit", F.lit(False))
    # at a limit the test decides: all but complete endings and forms are cut, forms where it is a limit of forms; elsewhere the ending decides
    by_limit = at_limit & ~F.col("kind").isin("complete", "form") | F.coalesce("chars_form", "bytes_form", F.lit(False))
    by = F.when(by_limit, "limit").when(~at_limit & F.col("kind").isin(*IN_TRANSFER), "ending")
    return joined.select("doc_id", "source", "chars", "bytes", "kind", at_limit.alias("at_limit"), by.isNotNull().alias("cut"), by.alias("by")), limits


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = cut_documents(load(spark, sf_dir, "documents"))
    return rows.where("cut").select("doc_id")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_cut, n_at_limit, n_by_ending, cut_rate, limits): how often each source truncates, where, and how many
    of the cuts the length test decided and how many only the ending."""
    rows, limits = cut_documents(load(spark, sf_dir, "documents"))
    per = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("by") == "limit").alias("n_at_limit"), F.count_if(F.col("by") == "ending").alias("n_by_ending"))
    where = limits.groupBy("source").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "length", "unit"))).alias("limits"))
    return per.join(where, "source", "left").withColumn("cut_rate", F.col("n_cut") / F.col("n_docs"))
