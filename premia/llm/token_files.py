"""Token ids as ORC files: integer run-length encoding in stripes, row indexes and Bloom filters on document ids.

Documents are ranged by id, sorted, encoded as they are written, and stored one row a document: its ids, how many, and
where they start in the file. Files follow each other in ascending order of ids, so that a document's place in the whole
corpus is its place in the file plus the ids of the files before, a sum over one row a file. ORC keeps the smallest and
largest id and a Bloom filter of each few rows and stripe: a read by document id skips the stripes and rows without it, and a
large file is read stripe by stripe in parallel.

Texts are encoded by the tokenizers library. Byte-level BPE never joins a word with the one before a space, so texts are
cut there, and each distinct piece of a task is encoded once.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick, shared_folder, text_key, width

END = 0
HELD = 6 << 20  # characters of pieces that a worker keeps
PENDING = 3 << 20  # characters encoded before their rows are passed on

ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


#: Where byte-level BPE always cuts: before a space that a word follows, around other white space, between letters and a mark.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\s!-/:-@\[-`{-~]|\Z)| ?\S+|\s+(?!\S)|\s")
#: White space in one library's eyes only; a text with these is one piece.
ODD = re.compile("[\x1c-\x1f\u180e]")


class Encoder:
    """Ids of whole texts by a tokenizer file of byte-level BPE; texts of special tokens are ordinary text.

    Each distinct piece is encoded once, many at a time as lines of one text: a line end is a token of its own.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.line = self.library(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | None, int] = {None: 0}  # the end of a text
        self.ids, self.sizes, self.held = np.array([END], dtype=np.int32), np.array([1]), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        plain = [piece for piece in fresh if "\n" not in piece and len(self.line) == 1]
        alone = [piece for piece in fresh if "\n" in piece or len(self.line) != 1]
        flat, sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if plain:
            ids = np.array(self.library(["\n".join(plain) + "\n"])[0], dtype=np.int32)
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) == len(plain):
                flat, sizes = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
            else:  # a piece with white space at its end, which joins the line end
                plain, alone = [], fresh
        found = self.library(alone)
        self.known.update(zip(chain(plain, alone), range(len(self.known), len(self.known) + len(fresh))))
        self.ids = np.concatenate([self.ids, flat, *[np.array(ids, dtype=np.int32) for ids in found]])
        self.sizes = np.concatenate([self.sizes, sizes, [len(ids) for ids in found]]).astype(np.int64)
        self.held += sum(map(len, fresh))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and how many each text has."""

        cut = [[text] if ODD.search(text) else PIECES.findall(text) for text in texts]
        if self.held > HELD:
            self._forget()
        self._learn(list(set().union(*cut) - self.known.keys()))
        counts = np.array([len(parts) + 1 for parts in cut], dtype=np.int64)
        number = np.fromiter(
            map(self.known.__getitem__, chain.from_iterable(chain(parts, (None,)) for parts in cut)), dtype=np.int64, count=int(counts.sum())
        )
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        begins = (np.cumsum(self.sizes) - self.sizes)[number]
        ids = self.ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])]
        last = np.cumsum(counts) - 1
        return ids, np.diff(ends[last], prepend=0)


def worker_encoder(path: str) -> Encoder:
    """The worker process's encoder of this file; functions are sent by value, so it is kept with the library's module."""

    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _writer(path: str, schema: pa.Schema):
    """Rows of a sorted partition with their ids, the file's number, and the place of the first id in the file."""

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, start = None, 0
        for batch in batches:
            column = batch.column("text")
            first, texts, waiting = 0, [], 0
            for i in range(len(column)):
                texts.append(column[i].as_py() or "")
                waiting += len(texts[-1])
                if waiting < PENDING and i + 1 < len(column):
                    continue
                coder = coder or worker_encoder(path)
                ids, lengths = coder.encode(texts)
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                rows = batch.column("doc_id").slice(first, i + 1 - first)
                columns = [rows, pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(start + ends - lengths), pa.array(lengths), lists.cast(schema.field("ids").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                start += int(ends[-1])
                first, texts, waiting = i + 1, [], 0

    return encode


def write(docs: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Write every document's ids, each followed by the end id 0, as ORC files in ascending order of doc_id; the folder.

    NULL ids come first; rows with equal ids are ordered by a hash of the text. A NULL or empty text has the end id alone.
    Repeated rows are written each. An empty table gives a folder without rows. Other columns are dropped.
    """

    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    keyed = pick(docs, "doc_id", "text").withColumns(dict(zip(("key_a", "key_b"), text_key())))
    order = [F.asc_nulls_first("doc_id"), F.asc("key_a"), F.asc("key_b")]
    ranged = keyed.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    shape = T.StructType(
        [keyed.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    ranged.mapInArrow(_writer(tokenizer, to_arrow_schema(shape)), shape).write.options(**ORC).orc(folder)
    return folder


def read(spark: SparkSession, folder: str, id_type: T.DataType, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids from the files; ``where`` on doc_id prunes stripes and rows."""

    shape = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    rows = spark.read.schema(shape).orc(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a file
    bases, base = [], 0
    for row in totals:
        bases.append((row["part"], base))
        base += row["n"]
    table = spark.createDataFrame(bases, "part int, base long")
    if where is not None:
        rows = rows.where(where)
    joined = rows.join(F.broadcast(table), "part")  # a row a file
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def _checker(schema: pa.Schema):
    def check(batches):
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.cast(pa.large_list(pa.int32()))
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch.column(name) for name in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return check


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers) of rows as read() gives them."""

    shape = T.StructType([*[rows.schema[name] for name in ("doc_id", "start", "n_tokens")], T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(_checker(to_arrow_schema(shape)), shape)
