"""Quality rules: hashed n-gram log-likelihood ratio of trusted documents to the raw corpus.

Two multinomials over hashed word 1-grams and 2-grams are counted in one pass: one over every
document, one over the trusted ones. Each bucket's weight is the log of the ratio of its trusted
count to the count that the raw corpus leads one to expect, both with ``pseudo`` added, so that rare
buckets weigh nothing. A document's score is the mean weight of its n-grams; documents whose
score is at least ``threshold`` are kept, all by the same rule.

What leaves a task is one row per bucket it has seen (at most 2^bits); what reaches the driver are
the summed buckets, again at most 2^bits rows whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.llm.frames import pick
from premia.llm.words import (
    byte_class,
    covered,
    find_words,
    hash_spans,
    hash_windows,
    in_document,
    not_space,
    pieces,
    window_starts,
)

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = T.StructType(
    [T.StructField(name, T.LongType()) for name in BASE]
    + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def _buckets(hashes: np.ndarray, words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-grams and 2-grams, and the document of each."""

    pairs = hash_windows(hashes, 2)
    ok = window_starts(words, 2)
    shift = np.uint64(64 - bits)
    both = np.concatenate([hashes >> shift, pairs[ok] >> shift]).astype(np.int64)
    return both, np.concatenate([words.doc, words.doc[: len(pairs)][ok]])


def _counter(bits: int):
    def count(batches):
        raw = np.zeros(1 << bits, dtype=np.int64)
        good = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), dtype=bool)
            for first, end, data, offsets in pieces(batch.column("text")):
                words = find_words(data, offsets, not_space())
                buckets, doc = _buckets(hash_spans(data, words.starts, words.ends), words, bits)
                raw += np.bincount(buckets, minlength=1 << bits)
                chosen = trusted[first:end][doc]
                if chosen.any():
                    good += np.bincount(buckets[chosen], minlength=1 << bits)
        seen = np.flatnonzero(raw)
        for i in range(0, len(seen), 50_000):
            at = seen[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "raw": raw[at], "good": good[at]})

    return count


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids labelled good and not toxic, the first by a hash of the id."""

    ids = (
        pick(labels, "doc_id", "quality", "toxic")
        .where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
        .select("doc_id")
    )
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_weights(docs: DataFrame, labels: DataFrame, bits: int = 18, pseudo: float = 20.0, trusted_rows: int = 100_000) -> np.ndarray:
    """Weight of each of the 2^bits buckets. Raw counts cover all of ``docs``; the trusted sample is bounded."""

    trusted = trusted_ids(labels, trusted_rows).withColumn("trusted", F.lit(True))
    marked = pick(docs, "doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")  # at most trusted_rows ids
    marked = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = (
        marked.mapInArrow(_counter(bits), "bucket int, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toArrow()  # at most 2^bits rows
    )
    raw = np.zeros(1 << bits)
    good = np.zeros(1 << bits)
    at = sums.column("bucket").to_numpy()
    raw[at] = sums.column("raw").to_numpy()
    good[at] = sums.column("good").to_numpy()
    if not good.sum():
        return np.zeros(1 << bits, dtype=np.float32)
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + pseudo) / (expected + pseudo)).astype(np.float32)


def _base_counts(data, offsets, words, hashes) -> dict[str, np.ndarray]:
    """The five counts of each document."""

    n = len(offsets) - 1
    out = {"n_words": words.per_doc}
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out["word_chars"] = np.bincount(words.doc, points[words.ends] - points[words.starts], n).astype(np.int64)
    symbols = np.flatnonzero(byte_class(*SYMBOLS)[data])
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, symbols, side="right") - 1, minlength=n).astype(np.int64)

    lines = find_words(data, offsets, ~byte_class(0x0A))
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_hash = in_document(hash_spans(data, lines.starts, lines.ends), lines.doc)[worded]
    line_doc = lines.doc[worded]
    _, kept = np.unique(line_hash, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[kept], minlength=n)

    windows = hash_windows(hashes, 3)
    at = np.flatnonzero(window_starts(words, 3))
    _, inverse, counts = np.unique(in_document(windows[at], words.doc[at]), return_inverse=True, return_counts=True)
    twice = covered(at[counts[inverse] > 1], 3, len(words.doc))
    out["n_repeat_words"] = np.bincount(words.doc[twice], minlength=n)
    return out


def _judge(weights, bits: int, threshold: float, carry: Sequence[str], schema: pa.Schema):
    def judge(batches):
        table = weights.value
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                n = end - first
                words = find_words(data, offsets, not_space())
                hashes = hash_spans(data, words.starts, words.ends)
                out = _base_counts(data, offsets, words, hashes)
                buckets, doc = _buckets(hashes, words, bits)
                grams = np.bincount(doc, minlength=n)
                score = np.bincount(doc, table[buckets], n) / np.maximum(grams, 1)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                rows = batch.slice(first, n)
                columns = [rows.column(name) for name in carry]
                columns += [pa.array(out[name].astype(np.int64)) for name in BASE]
                columns += [pa.array(failed), pa.array(np.round(score, 9)), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return judge


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    bits: int = 18,
    pseudo: float = 20.0,
    threshold: float = -0.05,
    trusted_rows: int = 100_000,
) -> DataFrame:
    """Every document with its counts, its score and the verdict ``kept``.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic; ``carry`` names the input
    columns that are passed on, others are dropped. A NULL or empty text has zero words and fails. Repeated rows are
    judged alike, each in its own row. Labels that disagree make a document untrusted; without
    any trusted document (empty tables too) every weight and score is 0. Equal scores and thresholds keep.
    """

    weights = docs.sparkSession.sparkContext.broadcast(fit_weights(docs, labels, bits, pseudo, trusted_rows))
    columns = list(dict.fromkeys([*carry, "text"]))
    source = pick(docs, *columns)
    fields = [source.schema[name] for name in carry] + RESULT.fields
    shape = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return source.mapInArrow(_judge(weights, bits, threshold, carry, to_arrow_schema(shape)), shape)
