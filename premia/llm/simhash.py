"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints that differ in at most two bits share at least six of their eight positional bytes.
The index therefore lists each distinct fingerprint under every choice of six byte positions, so
that any pair reaching the guaranteed minimum meets in a list; pairs of a list are tallied (how many
positional bytes agree), those with six or more are kept and verified by counting the differing bits.
A list holds fingerprints that differ in two given bytes only, so at most 65,536, whatever the corpus.
Equal fingerprints are one entry, however many documents share them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.components import components
from premia.llm.frames import pick, stored, text_key
from premia.llm.words import pieces

BYTES = 8
SHARED = 6  # of 8 positional bytes: two differing bits touch at most two of them


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist())]
    table = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, BYTES)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(table), 1 << 16):
        counts += np.unpackbits(table[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _marker(carry: Sequence[str], schema: pa.Schema):
    def mark(batches):
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                raw = data.tobytes()
                prints = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                rows = batch.slice(first, end - first)
                columns = [rows.column(name) for name in carry] + [pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return mark


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``print``, the 64-bit fingerprint as a signed long; a text without words has 0."""

    source = pick(docs, *dict.fromkeys([*carry, "text"]))
    shape = T.StructType([*[source.schema[name] for name in carry], T.StructField("print", T.LongType())])
    return source.mapInArrow(_marker(carry, to_arrow_schema(shape)), shape)


def _lists() -> Column:
    """Every choice of byte positions with the fingerprint's bytes there."""

    entries = []
    for number, kept in enumerate(combinations(range(BYTES), SHARED)):
        mask = sum(0xFF << (8 * k) for k in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        entries.append(F.struct(F.lit(number).alias("choice"), F.col("print").bitwiseAND(F.lit(signed)).alias("bytes")))
    return F.inline(F.array(*entries))


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints that differ in at most ``bits`` (two or fewer) bits."""

    if bits > BYTES - SHARED:
        raise ValueError("the index guarantees shared bytes for two differing bits at most")
    index = prints.select("print", _lists())
    met = index.withColumn("n", F.count("*").over(Window.partitionBy("choice", "bytes"))).where("n > 1")
    a = met.select("choice", "bytes", F.col("print").alias("a"))
    b = met.select("choice", "bytes", F.col("print").alias("b"))
    odd = F.col("a").bitwiseXOR(F.col("b"))
    tally = reduce(
        lambda x, y: x + y,
        [F.when(F.shiftrightunsigned(odd, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(BYTES)],
    )
    pairs = a.join(b, ["choice", "bytes"]).where(F.col("a") < F.col("b"))
    return pairs.where((tally >= SHARED) & (F.bit_count(odd) <= bits)).select("a", "b").distinct()


def classes(docs: DataFrame, carry: Sequence[str] = ("doc_id",), bits: int = 2) -> DataFrame:
    """The carried columns (doc_id among them), print, root (the component's smallest fingerprint) and component_id of every row."""

    marked = stored(fingerprints(docs, carry), "prints")
    distinct = stored(marked.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct")
    stars = components(links(distinct.select("print"), bits))
    rooted = distinct.join(stars.withColumnRenamed("node", "print"), "print", "left")
    rooted = rooted.select("print", "low", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(least, "root").select("print", "root", "component_id"), "named")
    return marked.join(named, "print").select(*carry, "print", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, print and component_id of every row: the smallest doc_id reachable over links.

    A NULL or empty text, or one of spaces only, has fingerprint 0 and is linked like any other. Repeated
    rows share a component. NULL ids are never the smallest; a component with no other id has a NULL component_id.
    Columns beyond doc_id and text are dropped. An empty table gives an empty one.
    """

    return classes(docs, bits=bits).select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, columns: Sequence[str], bits: int = 2) -> DataFrame:
    """``columns`` (doc_id and text among them) of one document of each component: that with the smallest id.

    NULL ids come last; of rows with the same id the one with the smallest text hash stays, of equal rows one. Texts are
    fingerprinted once; the documents that stay are found again by id and text hash.
    """

    keyed = pick(docs, *columns).withColumns(dict(zip(("key_a", "key_b"), text_key())))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_a", "key_b")
    marked = classes(keyed.select("doc_id", "text", "key_a", "key_b"), ("doc_id", "key_a", "key_b"), bits)
    first = marked.groupBy("root").agg(F.min(order).alias("first"))
    first = first.select(*[F.col(f"first.{name}").alias(f"keep_{name}") for name in ("doc_id", "key_a", "key_b")])
    same = keyed["doc_id"].eqNullSafe(first["keep_doc_id"])
    same = same & (keyed["key_a"] == first["keep_key_a"]) & (keyed["key_b"] == first["keep_key_b"])
    return keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", "key_a", "key_b"]).select(*columns)
