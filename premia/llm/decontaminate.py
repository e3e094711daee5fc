"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Items and documents are lower-cased (A-Z only) and cut into words. Each item gives its windows of ``window``
consecutive words (a shorter item is one window). The automaton runs over word numbers instead of
characters, so that a window is ten nodes; a document is scanned once, only where words of the benchmark stand
in a row, and every match is checked against the window's bytes. Word numbers lead back to the original text's characters.

An automaton holds at most ``block_windows`` windows. The benchmark is read on the driver item by item and
cut into blocks of that size; a benchmark that fits one block needs one scan, a larger one a scan a block,
each adding to what the one before found. Only a block is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick
from premia.llm.words import find_words, hash_spans, lowered, pieces

SPAN = T.StructType(
    [
        T.StructField("first_word", T.IntegerType()),
        T.StructField("end_word", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
    ]
)
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
]


def word_bytes() -> np.ndarray:
    """Bytes of words once A-Z are lower-cased: 0-9, a-z and all beyond ASCII."""

    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _normal(text: bytes) -> list[bytes]:
    data = lowered(np.frombuffer(text, dtype=np.uint8))
    words = find_words(data, np.array([0, len(data)]), word_bytes())
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]


def blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows with the items that have them, at most ``block_windows`` (window, item) pairs at a time."""

    items = pick(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"
    )
    block: dict[tuple[bytes, ...], set[str]] = {}
    size = 0
    for row in items.where("text IS NOT NULL").toLocalIterator():
        words = _normal(row["text"].encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners = block.setdefault(tuple(words[i : i + window]), set())
            if row["item"] not in owners:
                owners.add(row["item"])
                size += 1
            if size >= block_windows:
                yield block
                block, size = {}, 0
    if block:
        yield block


def _automaton(block):
    """Automaton over word numbers, hashes of the words in order, and the length of the shortest window."""

    words = sorted({word for window in block for word in window})
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(word) for word in words])
    hashes = hash_spans(joined, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes)
    number = {words[i]: k + 1 for k, i in enumerate(order.tolist())}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, owners in block.items():
        machine.add_word(tuple(number[word] for word in window), (window, owners))
    machine.make_automaton()
    return machine, hashes[order], min(map(len, block))


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of a mask."""

    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)


def _scanner(shared, carry: Sequence[str], schema: pa.Schema, again: bool):
    def scan(batches):
        machine, known, least = _automaton(shared.value)
        for batch in batches:
            earlier_items = batch.column("items").to_pylist() if again else None
            earlier_spans = batch.column("spans").to_pylist() if again else None
            for start, end, original, offsets in pieces(batch.column("text")):
                data = lowered(original)
                words = find_words(data, offsets, word_bytes())
                hashes = hash_spans(data, words.starts, words.ends)
                place = np.searchsorted(known, hashes)
                numbers = np.where(known[np.minimum(place, len(known) - 1)] == hashes, place + 1, 0)
                hit = np.zeros(len(hashes), dtype=bool)
                items: list[set[str]] = [set() for _ in range(end - start)]
                if again:
                    for i in range(end - start):
                        items[i].update(earlier_items[start + i] or ())
                        for span in earlier_spans[start + i] or ():
                            hit[words.first[i] + span["first_word"] : words.first[i] + span["end_word"]] = True
                # Runs of benchmark words within a document; a break after each document's last word.
                wall = np.flatnonzero(words.per_doc)
                spread = np.zeros(len(numbers) + len(wall), dtype=np.int64)
                shift = np.searchsorted(wall, words.doc)
                spread[np.arange(len(numbers)) + shift] = numbers
                back = np.zeros(len(spread), dtype=np.int64)
                back[np.arange(len(numbers)) + shift] = np.arange(len(numbers))
                for a, b in _runs(spread > 0).tolist():
                    if b - a < least:
                        continue
                    base = int(back[a])
                    for last, (window, owners) in machine.iter(tuple(spread[a:b].tolist())):
                        first = base + last - len(window) + 1
                        spans = zip(words.starts[first : base + last + 1].tolist(), words.ends[first : base + last + 1].tolist())
                        if all(data[x:y].tobytes() == word for (x, y), word in zip(spans, window)):
                            hit[first : base + last + 1] = True
                            items[int(words.doc[first])].update(owners)
                n_hit = np.bincount(words.doc, hit, end - start).astype(np.int64)
                spans = [_spans(words, hit, i, original, offsets) if n_hit[i] else [] for i in range(end - start)]
                rows = batch.slice(start, end - start)
                columns = [rows.column(name) for name in carry]
                columns += [pa.array(words.per_doc), pa.array(n_hit)]
                columns.append(pa.array([sorted(x) for x in items], pa.list_(pa.string())))
                columns.append(pa.array(spans, schema.field("spans").type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def _spans(words, hit, i, original, offsets) -> list[dict[str, int]]:
    """Maximal runs of hit words of document ``i``, with their characters in the original text."""

    a, b = int(words.first[i]), int(words.first[i + 1])
    text = original[offsets[i] : offsets[i + 1]]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    out = []
    for x, y in _runs(hit[a:b]).tolist():
        start, stop = words.starts[a + x] - offsets[i], words.ends[a + y - 1] - offsets[i]
        out.append({"first_word": x, "end_word": y, "start_char": int(points[start]), "end_char": int(points[stop])})
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    window: int = 10,
    block_windows: int = 200_000,
) -> DataFrame:
    """Every document with n_words, n_hit (words inside any occurrence of a window), items (ids of the items that
    own such windows, as sorted strings) and spans (maximal runs of hit words, with the original text's characters).

    A NULL or empty text has no words and no hits; items without words have no window. An item without an id
    counts under the name ''. Items that share a window are all named; repeated items count once, repeated documents each. With an
    empty benchmark nothing is hit. ``carry`` names the input columns passed on; others are dropped.
    """

    spark = docs.sparkSession
    source = pick(docs, *dict.fromkeys([*carry, "text"]))
    passed = list(dict.fromkeys([*carry, "text"]))
    shape = T.StructType([*[source.schema[name] for name in passed], *FOUND])
    frame = source
    again = False
    for block in blocks(benchmark, window, block_windows):
        shared = spark.sparkContext.broadcast(block)
        frame = frame.mapInArrow(_scanner(shared, passed, to_arrow_schema(shape), again), shape)
        again = True
    if not again:
        nothing = spark.sparkContext.broadcast({(b"\x00",): {""}})  # no text has this word
        frame = frame.mapInArrow(_scanner(nothing, passed, to_arrow_schema(shape), False), shape)
    return frame.select(*carry, "n_words", "n_hit", "items", "spans")
