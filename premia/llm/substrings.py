"""Exact repeated passages through fixed-block anchors.

With windows of L words and blocks of b = (L + 1) // 2 words, every window holds one whole block of its
document's own grid 0, b, 2b, ... So:

1. Index and probe. The blocks of all documents are the index; the rolling b-word windows of all documents
   probe it. A block is an anchor hit if its words occur anywhere else. Probes carry no identity: a
   piece of text sends each distinct hash once, packed by bucket, and a block counts as hit if two
   probes meet it. Hits within a piece are settled there. A 32-bit remainder of the hash is enough here,
   since a false hit only costs a look in step 2.
2. Extend. Around each hit the block is grown to every L-word window that holds it; these windows are
   counted exactly (64-bit hash within buckets of a second hash). A window occurring twice is a repeat, and
   overlapping repeats join into maximal exact repeats.
3. Cut. The words that repeats cover are removed from each document.

Equal texts share a key, and so one list of hits; a hot passage sends at most one probe and one index
entry per piece. Nothing is paired, so the work is linear in the words whatever the groups' sizes. Bucket counts follow
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick, stored, text_key, width
from premia.llm.words import covered, find_words, hash_spans, hash_windows, mixed, not_space, pieces, window_starts

PIECE_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 4

SENT = "bucket int, probes binary, entries binary, settled binary"
HIT = "key_a long, key_b long, place int"

PLACE = [("a", "<i8"), ("b", "<i8"), ("place", "<i4")]
SETTLED = np.dtype(PLACE)
COARSE = np.dtype([("value", "<u4"), *PLACE])
EXACT = np.dtype([("value", "<u8"), *PLACE])


def _by_bucket(bucket, rows, n_buckets):
    """The bytes of the rows of each bucket."""

    order = np.argsort(bucket, kind="stable")
    rows = rows[order]
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()
    return [rows[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]


def _records(kind, key_a, key_b, place, value=None):
    out = np.empty(len(place), dtype=kind)
    out["a"], out["b"], out["place"] = key_a, key_b, place
    if value is not None:
        out["value"] = value
    return out


def _sent(kind, bucket, value, key_a, key_b, place, wanted, n_buckets):
    """What a piece sends about its windows, one row per bucket.

    Probes: each distinct value once. Of the ``wanted`` windows: those whose value occurs once in the piece as
    entries, the others as settled.
    """

    _, first, inverse, counts = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    single = counts[inverse] == 1
    own, done = np.flatnonzero(wanted & single), np.flatnonzero(wanted & ~single)
    short = value.astype(kind["value"])
    probes = _by_bucket(bucket[first], short[first], n_buckets)
    entries = _by_bucket(bucket[own], _records(kind, key_a[own], key_b[own], place[own], short[own]), n_buckets)
    # Settled places only pass through: a common passage would fill the bucket of its hash, so they are dealt out by place.
    through = (mixed(key_a[done].view(np.uint64) + place[done].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
    settled = _by_bucket(through, _records(SETTLED, key_a[done], key_b[done], place[done]), n_buckets)
    kept = [k for k in range(n_buckets) if probes[k] or settled[k]]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(kept, pa.int32()),
            "probes": pa.array([probes[k] for k in kept], pa.binary()),
            "entries": pa.array([entries[k] for k in kept], pa.binary()),
            "settled": pa.array([settled[k] for k in kept], pa.binary()),
        }
    )


def _one_of_equals(key_a, key_b):
    """Mask of the rows that stand for all rows of their text within a piece."""

    _, first = np.unique(mixed(key_a.view(np.uint64)) ^ key_b.view(np.uint64), return_index=True)
    chosen = np.zeros(len(key_a), dtype=bool)
    chosen[first] = True
    return chosen


def _prober(block: int, n_buckets: int):
    """Step 1, map side."""

    def probe(batches):
        for batch in batches:
            keys_a = batch.column("key_a").to_numpy()
            keys_b = batch.column("key_b").to_numpy()
            for start, end, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                words = find_words(data, offsets, not_space())
                hashes = hash_windows(hash_spans(data, words.starts, words.ends), block)
                at = np.flatnonzero(window_starts(words, block))
                if not len(at):
                    continue
                hashes, doc = hashes[at], words.doc[at]
                place = at - words.first[doc]
                rows_a, rows_b = keys_a[start:end], keys_b[start:end]
                wanted = (place % block == 0) & _one_of_equals(rows_a, rows_b)[doc]
                bucket = ((hashes >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
                # Whole hashes are compared within the piece; their low halves are sent.
                yield _sent(COARSE, bucket, hashes, rows_a[doc], rows_b[doc], place, wanted, n_buckets)

    return probe


def _met(kind: np.dtype):
    """Reduce side of both steps: settled places, and entries whose value at least two pieces name."""

    def met(table: pa.Table) -> pa.Table:
        def column(name, dtype):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)

        probes = np.sort(column("probes", kind["value"]))
        twice = probes[1:][probes[1:] == probes[:-1]]
        entries, settled = column("entries", kind), column("settled", SETTLED)
        hits = entries[np.isin(entries["value"], twice)]
        return pa.table(
            {
                "key_a": np.concatenate([hits["a"], settled["a"]]),
                "key_b": np.concatenate([hits["b"], settled["b"]]),
                "place": np.concatenate([hits["place"], settled["place"]]),
            }
        )

    return met


def _lists(sent: DataFrame, kind: np.dtype) -> DataFrame:
    """One row per text: the distinct places of its hits."""

    hits = sent.groupBy("bucket").applyInArrow(_met(kind), HIT)
    return hits.groupBy("key_a", "key_b").agg(F.collect_set("place").alias("places"))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of an Arrow list column; NULL is an empty list."""

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def _extender(window: int, block: int, n_buckets: int):
    """Step 2, map side: every window that holds a hit block."""

    def extend(batches):
        for batch in batches:
            keys_a = batch.column("key_a").to_numpy()
            keys_b = batch.column("key_b").to_numpy()
            places, owner = _flat(batch.column("places"))
            for start, end, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                words = find_words(data, offsets, not_space())
                word_hashes = hash_spans(data, words.starts, words.ends)
                hashes = hash_windows(word_hashes, window)
                if not len(hashes):
                    continue
                mine = (owner >= start) & (owner < end)
                anchor = words.first[owner[mine] - start] + places[mine]
                # Windows from block - 1 words before the anchor to the anchor itself.
                edge = np.zeros(len(hashes) + block + 1, dtype=np.int32)
                np.add.at(edge, np.maximum(anchor - (window - block), 0), 1)
                np.add.at(edge, np.minimum(anchor + 1, len(edge) - 1), -1)
                near = np.cumsum(edge)[: len(hashes)] > 0
                at = np.flatnonzero(near & window_starts(words, window))
                if not len(at):
                    continue
                second = hash_windows(mixed(word_hashes + np.uint64(window)), window)[at]
                doc = words.doc[at]
                rows_a, rows_b = keys_a[start:end], keys_b[start:end]
                yield _sent(
                    EXACT, (second % np.uint64(n_buckets)).astype(np.int32), hashes[at],
                    rows_a[doc], rows_b[doc], at - words.first[doc], _one_of_equals(rows_a, rows_b)[doc], n_buckets,
                )

    return extend


def _cutter(window: int, carry: Sequence[str], schema: pa.Schema):
    """Step 3."""

    def cut(batches):
        for batch in batches:
            places, owner = _flat(batch.column("places"))
            for start, end, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                words = find_words(data, offsets, not_space())
                n = len(words.doc)
                mine = (owner >= start) & (owner < end)
                gone = covered(np.sort(words.first[owner[mine] - start] + places[mine]), window, n) if mine.any() else np.zeros(n, bool)
                removed = np.bincount(words.doc, gone, end - start).astype(np.int64)
                raw = data.tobytes()
                texts, runs = [], []
                for i in range(end - start):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    spans = zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())
                    if removed[i]:
                        drop = gone[a:b]
                        texts.append(b" ".join([raw[x:y] for (x, y), out in zip(spans, drop.tolist()) if not out]))
                        steps = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                        runs.append([{"first": x, "end": y} for x, y in steps.reshape(-1, 2).tolist()])
                    else:
                        texts.append(b" ".join([raw[x:y] for x, y in spans]))
                        runs.append([])
                rows = batch.slice(start, end - start)
                columns = [rows.column(name) for name in carry]
                columns += [pa.array(words.per_doc), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())]
                columns.append(pa.array(runs, schema.field("repeats").type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cut


def cut_repeats(docs: DataFrame, carry: Sequence[str] = ("doc_id",), window: int = 35) -> DataFrame:
    """Every document without the words of passages that occur more than once.

    Adds n_words, n_removed, kept_text (the words that stay, joined by single spaces) and repeats (maximal
    runs of removed words, as word numbers from ``first`` to before ``end``). A word goes if a window of ``window``
    words that covers it starts at any other place, in this document or another; all occurrences go, none is
    kept as the original. Windows are judged on the input. A NULL or empty text has no words and kept_text ''.
    Repeated rows count as occurrences of each other. ``carry`` names the input columns passed on; others are dropped.
    """

    if window < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    block = (window + 1) // 2
    n_buckets = BUCKETS_PER_PARTITION * width(spark)
    keyed = pick(docs, *dict.fromkeys([*carry, "text"])).withColumns(dict(zip(("key_a", "key_b"), text_key())))

    sent = keyed.select("text", "key_a", "key_b").mapInArrow(_prober(block, n_buckets), SENT)
    hits = stored(_lists(sent, COARSE), "hits")
    near = keyed.join(hits, ["key_a", "key_b"])
    repeats = _lists(near.mapInArrow(_extender(window, block, n_buckets), SENT), EXACT)
    whole = keyed.join(repeats, ["key_a", "key_b"], "left").select(*dict.fromkeys([*carry, "text"]), "places")
    run = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    shape = T.StructType(
        [keyed.schema[name] for name in carry]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
        + [T.StructField("kept_text", T.StringType()), T.StructField("repeats", T.ArrayType(run))]
    )
    return whole.mapInArrow(_cutter(window, carry, to_arrow_schema(shape)), shape)
