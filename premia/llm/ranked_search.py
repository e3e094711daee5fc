"""Ranked lexical search through hashed max-sketches.

A query batch is a block of items. One scan counts what scores need: documents, terms, and the documents that hold each
query term. A second scan takes documents a few megabytes at a time: the impacts of all of a document's terms fold into a
sketch, by hash, as coordinatewise maxima. Looking a batch's terms up in the sketches gives sums that no exact score
exceeds, for a coordinate is at least the impact of any term that falls into it. For each item, documents are then
scored exactly in descending order of these bounds, until a bound is below the item's tenth score so far.

Texts never move: bounds and exact scores are taken where a document is read, and a task sends on at most ``top`` rows an
item. Only a block of query terms is broadcast; more items take more blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick
from premia.llm.words import find_words, hash_spans, in_document, lowered, pieces

COORDINATES = 4096  # of a sketch
SKETCHES = 256  # documents whose sketches are held at a time
UNIT = 1_000_000_000


def term_bytes() -> np.ndarray:
    """Bytes of terms once A-Z are lower-cased: 0-9, a-z and all beyond ASCII."""

    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Document, hash and frequency of each distinct term of each document, by in_document key; the keys; terms a document."""

    data = lowered(data)
    words = find_words(data, offsets, term_bytes())
    hashes = hash_spans(data, words.starts, words.ends)
    keys, at, times = np.unique(in_document(hashes, words.doc), return_index=True, return_counts=True)
    return words.doc[at], hashes[at], times.astype(np.int64), keys, words.per_doc


class Batch(NamedTuple):
    """A block of items: their distinct terms' hashes in order, and each item's terms as places in them."""

    items: list
    hashes: np.ndarray
    terms: np.ndarray  # places in hashes, item by item
    first: np.ndarray  # of each item's terms; one more entry


def batches(items: DataFrame, block_terms: int) -> Iterator[Batch]:
    """The items that have terms, in blocks of at most ``block_terms`` (item, term) entries or of one item."""

    ids: list = []
    held: list[np.ndarray] = []

    def batch() -> Batch:
        hashes, terms = np.unique(np.concatenate(held), return_inverse=True)
        return Batch(list(ids), hashes, terms.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in held])]))

    for row in pick(items, "item_id", "text").where("text IS NOT NULL").toLocalIterator():
        data = np.frombuffer(row["text"].encode(), dtype=np.uint8)
        own = np.unique(_terms(data, np.array([0, len(data)]))[1])
        if not len(own):
            continue
        if held and sum(map(len, held)) + len(own) > block_terms:
            yield batch()
            ids, held = [], []
        ids.append(row["item_id"])
        held.append(own)
    if held:
        yield batch()


def _counter(shared):
    """For each query term of the block, the documents that hold it; documents under -1, terms under -2."""

    def count(rows):
        known = shared.value.hashes
        df = np.zeros(len(known) + 2, dtype=np.int64)
        for rows_batch in rows:
            for _, _, data, offsets in pieces(rows_batch.column("text")):
                _, hashes, _, _, per_doc = _terms(data, offsets)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                df[:-2] += np.bincount(place[known[place] == hashes], minlength=len(known))
                df[-1] += np.count_nonzero(per_doc)
                df[-2] += per_doc.sum()
        seen = np.flatnonzero(df)
        term = np.where(seen >= len(known), seen - len(known) - 2, seen)
        yield pa.RecordBatch.from_pydict({"term": term.astype(np.int64), "n": df[seen]})

    return count


def _sketches(doc: np.ndarray, hashes: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
    """Each document's impacts folded into coordinatewise maxima."""

    sketch = np.zeros(n_docs * COORDINATES, dtype=np.int64)
    np.maximum.at(sketch, doc * COORDINATES + (hashes % np.uint64(COORDINATES)).astype(np.int64), impacts)
    return sketch.reshape(n_docs, COORDINATES)


class _Best:
    """The ``top`` rows of an item so far: the least of them is the heap's head. Equal scores: the smaller id is better."""

    def __init__(self, top: int) -> None:
        self.top, self.heap = top, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, doc) -> None:
        entry = (score, _Last(doc))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif self.heap[0] < entry:
            heapq.heapreplace(self.heap, entry)


class _Last:
    """Orders ids from the worst: NULL, then descending."""

    __slots__ = ("doc",)

    def __init__(self, doc) -> None:
        self.doc = doc

    def __lt__(self, other) -> bool:
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc

    def __eq__(self, other) -> bool:
        return self.doc == other.doc


def _ranker(shared, weights: np.ndarray, n_docs: int, n_terms: int, top: int, schema: pa.Schema):
    def impact(times, length):
        # 64-bit whole numbers: n * N stays below 2^63 / 90, which is 10^17.
        return (UNIT * times) // (1000 * times + 8 * (100 - 90 + (90 * length * n_docs) // n_terms))

    def rescore(best, bounds, low, keys, impacts, id_of):
        """Score documents exactly by descending bound, item by item, while a bound reaches the item's least score."""

        batch = shared.value
        least = np.array([b.least() for b in best])
        for item in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
            terms = batch.terms[batch.first[item] : batch.first[item + 1]]
            some = np.flatnonzero(bounds[:, item] >= least[item])
            some = some[np.argsort(-bounds[some, item], kind="stable")]
            for i in range(0, len(some), 16):
                part = some[i : i + 16]
                if bounds[part[0], item] < best[item].least():
                    break
                key = in_document(np.tile(batch.hashes[terms], len(part)), np.repeat(part + low, len(terms)))
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                exact = np.where(keys[place] == key, impacts[place], 0).reshape(len(part), -1) @ weights[terms]
                for row, score in zip((part + low).tolist(), exact.tolist()):
                    if score >= best[item].least():
                        best[item].add(score, id_of(row))

    def rank(rows):
        batch = shared.value
        n_items = len(batch.items)
        weight = weights[batch.terms]
        coordinate = (batch.hashes % np.uint64(COORDINATES)).astype(np.int64)[batch.terms]
        best = [_Best(top) for _ in range(n_items)]
        for rows_batch in rows:
            ids = rows_batch.column("doc_id")
            for start, end, data, offsets in pieces(rows_batch.column("text")):
                doc, hashes, times, keys, per_doc = _terms(data, offsets)
                if not len(doc):
                    continue
                impacts = impact(times, per_doc[doc])
                by_doc = np.argsort(doc, kind="stable")
                for low in range(0, end - start, SKETCHES):
                    high = min(low + SKETCHES, end - start)
                    some = by_doc[np.searchsorted(doc[by_doc], low) : np.searchsorted(doc[by_doc], high)]
                    sketch = _sketches(doc[some] - low, hashes[some], impacts[some], high - low)
                    bounds = np.add.reduceat(sketch[:, coordinate] * weight, batch.first[:-1], axis=1)
                    rescore(best, bounds, low, keys, impacts, lambda row, start=start, ids=ids: ids[start + row].as_py())
        found = [(item, entry[1].doc, entry[0]) for item in range(n_items) for entry in best[item].heap]
        if found:
            item, doc_ids, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([batch.items[i] for i in item], doc_ids, scores, item), schema)], schema=schema)

    return rank


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_terms: int = 50_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``top`` best documents with a score above 0.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z. Equal scores rank by
    ascending doc_id, NULL ids last; repeated rows are ranked each. A NULL or empty text has no terms: it is
    never found and not counted. An item without terms gives no rows; repeated items give rows each, with ranks of their own.
    Empty tables give no rows. Other columns are dropped. Terms count as equal if their 64-bit hashes are.
    """

    spark = docs.sparkSession
    source = pick(docs, "doc_id", "text")
    item_type, id_type = pick(items, "item_id").schema["item_id"].dataType, source.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType()), T.StructField("number", T.LongType())])
    found = None
    for number, batch in enumerate(batches(items, block_terms)):
        shared = spark.sparkContext.broadcast(batch)
        counted = source.select("text").mapInArrow(_counter(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {row["term"]: row["n"] for row in counted.collect()}  # at most a row a term of the block
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        if not n_docs:
            break
        weights = np.zeros(len(batch.hashes), dtype=np.int64)
        for term, df in counts.items():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        ranked = source.mapInArrow(_ranker(shared, weights, n_docs, n_terms, top, to_arrow_schema(shape)), shape)
        ranked = ranked.withColumn("block", F.lit(number))
        found = ranked if found is None else found.unionAll(ranked)
    if found is None:
        found = spark.createDataFrame([], shape).withColumn("block", F.lit(0))
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
