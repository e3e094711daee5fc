"""Byte-level BPE encoding of whole texts by overlapping chunks, and decoding.

A text of more than ``chunk`` characters is cut into chunks that overlap. Chunks are pre-tokenised in parallel,
in whatever tasks they land. A chunk that starts inside a pre-token gets its first boundaries wrong, but
the pattern never looks back, so from the first boundary on which two neighbouring chunks agree they agree for good: there
they are stitched, and each piece between boundaries belongs to one chunk. Pieces are encoded by merging the pair of lowest rank, many at a time in arrays,
with a bounded cache. Decoding concatenates the raw bytes of the ids.
Texts of one chunk need no stitching and no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.frames import pick

CACHE = 300_000  # pieces kept between batches, about 80 MB
SHORT_BYTES = 64
NO_RANK = 1 << 40
LOOK_AHEAD = 3  # characters beyond a match that may have shaped it
ROWS = 256  # texts turned into an Arrow batch at a time

CODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens whose bytes join to a token: sorted keys (left << 32 | right) and the joint token's ranks."""

    keys, joint = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                joint.append(rank)
    order = np.argsort(np.array(keys, dtype=np.uint64))
    return np.array(keys, dtype=np.uint64)[order], np.array(joint, dtype=np.int64)[order]


class Coder:
    """Encodes pieces by rank: the neighbours whose union has the lowest rank merge, the leftmost first, until none has one.

    Pieces of the same length are merged side by side, one merge of each at a time, as rows of an array.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.keys, self.joint = pairs or pair_table(ranks)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.cache: dict[str, list[int]] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        if not len(self.keys):
            return np.full(wanted.shape, NO_RANK)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.joint[place], NO_RANK)

    def _merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of one length."""

        n = len(pieces[0])
        ids = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, n)]
        pairs = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            width = ids.shape[1]
            if width > 1:
                at = pairs.argmin(axis=1)
                low = pairs[np.arange(len(rows)), at]
            done = np.ones(len(rows), dtype=bool) if width == 1 else low == NO_RANK
            for row, found in zip(rows[done].tolist(), ids[done].tolist()):
                out[row] = found
            if done.all():
                break
            more = ~done
            rows, ids, pairs, at, low = rows[more], ids[more], pairs[more], at[more], low[more]
            line = np.arange(len(rows))
            ids[line, at] = low
            # Drop the right partner, and the pair that has merged.
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(len(rows), width - 1)
            pairs = pairs[np.arange(width - 1) != at[:, None]].reshape(len(rows), width - 2)
            after = np.flatnonzero(at < width - 2)
            pairs[after, at[after]] = self._pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            pairs[before, at[before] - 1] = self._pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Have the ids of all these pieces in the cache."""

        if len(self.cache) > CACHE:
            self.cache.clear()
        by_length: dict[int, list[str]] = {}
        for piece in set(pieces).difference(self.cache):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = [whole]
            elif len(raw) > SHORT_BYTES:
                self.cache[piece] = self.merge_long(raw)
            else:
                by_length.setdefault(len(raw), []).append(piece)
        for group in by_length.values():
            self.cache.update(zip(group, self._merge_rows([piece.encode() for piece in group])))

    def merge_long(self, raw: bytes) -> list[int]:
        """Neighbours are linked by position and candidates wait in a heap, so a piece of n bytes takes n log n."""

        import heapq

        n = len(raw)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
        start = list(range(-1, n))  # start of the part before the one that starts here
        heap = []
        for i in range(n - 1):
            rank = self.ranks.get(raw[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i] = stop
            end[middle] = 0
            if stop < n:
                start[stop] = i
                joined = self.ranks.get(raw[i : end[stop]])
                if joined is not None:
                    heapq.heappush(heap, (joined, i, end[stop]))
            if i > 0:
                before = start[i]
                joined = self.ranks.get(raw[before:stop])
                if joined is not None:
                    heapq.heappush(heap, (joined, before, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> list[int]:
        if text not in self.cache:
            self.learn([text])
        return self.cache[text]

    def encode_all(self, texts: Sequence[str]) -> list[list[int]]:
        parts = [self.find(text) for text in texts]
        self.learn(chain.from_iterable(parts))
        ids = self.cache.__getitem__
        return [list(chain.from_iterable(map(ids, part))) for part in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _coder(shared, pattern: str) -> Coder:
    ranks, *pairs = shared.value
    return Coder(ranks, pattern, tuple(pairs))


def _whole(shared, pattern: str, carry: Sequence[str], schema: pa.Schema):
    """Texts of one chunk."""

    def encode(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, ROWS):
                rows = batch.slice(i, ROWS)
                ids = coder.encode_all([text or "" for text in texts.slice(i, ROWS).to_pylist()])
                yield _coded(rows, ids, coder, carry, schema)

    return encode


def _coded(rows, ids, coder, carry, schema):
    columns = [rows.column(name) for name in carry]
    columns.append(pa.array(ids, schema.field("ids").type))
    columns.append(pa.array([coder.decode(x) for x in ids], schema.field("decoded").type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _cutter(chunk: int, overlap: int):
    """Overlapping chunks of long texts; a chunk and its number a row."""

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                for k, at in enumerate(range(0, len(text), chunk)):
                    part, last = text[at : at + chunk + overlap], at + chunk >= len(text)
                    yield pa.RecordBatch.from_pydict({"row": [row], "number": [k], "last": [last], "text": [part]}, schema=CHUNK)

    return cut


CHUNK = pa.schema([("row", pa.string()), ("number", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])


def _pretokenise(shared, pattern: str, chunk: int):
    """Boundaries of each chunk, and the ids of each piece with their counts.

    Boundaries are relative to the chunk. Those that the chunk's end may have shaped are left out, but for the
    chunk that ends its text.
    """

    def pretokenise(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                ends, ids, counts = [], [], []
                coder.learn(coder.find(text))
                for match in coder.spans(text):
                    if not row["last"] and match.end() > len(text) - LOOK_AHEAD:
                        break
                    found = coder.piece(match.group())
                    ends.append(match.end())
                    ids += found
                    counts.append(len(found))
                yield pa.RecordBatch.from_pydict(
                    {"row": [row["row"]], "number": [row["number"]], "text": [text[:chunk]], "ends": [ends], "ids": [ids], "counts": [counts]},
                    schema=PARTS,
                )

    return pretokenise


INTS = pa.list_(pa.int32())
PARTS = pa.schema([("row", pa.string()), ("number", pa.int32()), ("text", pa.string()), ("ends", INTS), ("ids", INTS), ("counts", INTS)])
PARTS_SQL = "row string, number int, text string, ends array<int>, ids array<int>, counts array<int>"


def stitch(parts: list[dict], chunk: int, coder: Coder) -> list[int]:
    """Ids of a text from its chunks in order.

    ``at`` is the last boundary known to be right. If the next chunk has a boundary there, its pieces go on from
    there. If a chunk has none left (a pre-token longer than the overlap), pieces are found anew from ``at`` on until a
    boundary of a chunk is met.
    """

    import bisect

    ids: list[int] = []
    total = sum(len(part["text"]) for part in parts)
    at = 0
    tables = []
    for part in parts:
        base = part["number"] * chunk
        ends = [base + x for x in part["ends"]]
        # A chunk's own start counts as a boundary only for the first chunk.
        starts = {base: 0} if part["number"] == 0 else {}
        starts.update({x: i + 1 for i, x in enumerate(ends)})
        where = [0]
        for n in part["counts"]:
            where.append(where[-1] + n)
        tables.append((ends, starts, where, part["ids"]))
    while at < total:
        found = False
        # The newest chunk that has this boundary carries furthest.
        for k in range(min(at // chunk, len(tables) - 1), max(-1, at // chunk - 2), -1):
            ends, starts, where, own = tables[k]
            i = starts.get(at)
            if i is None or i >= len(ends):
                continue
            # Go on in this chunk up to the first boundary that the next chunk has too.
            stop = len(ends)
            if k + 1 < len(tables):
                first = bisect.bisect_left(ends, (k + 1) * chunk, lo=i)
                following = tables[k + 1][1]
                for j in range(first, len(ends)):
                    if ends[j] in following and following[ends[j]] < len(tables[k + 1][0]):
                        stop = j + 1
                        break
            ids += own[where[i] : where[stop]]
            at = ends[stop - 1]
            found = True
            break
        if not found:
            piece = _next_piece(parts, chunk, at, total, coder)
            ids += coder.piece(piece)
            at += len(piece)
    return ids


def _next_piece(parts, chunk: int, at: int, total: int, coder: Coder) -> str:
    """The pre-token that starts at ``at``, read from as many chunks as it takes."""

    size = chunk
    while True:
        k = at // chunk
        text, have = parts[k]["text"][at - k * chunk :], k + 1
        while len(text) < size and have < len(parts):
            text += parts[have]["text"]
            have += 1
        match = next(coder.spans(text))
        if have == len(parts) or match.end() <= len(text) - LOOK_AHEAD:
            return match.group()
        size *= 2


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    carry: Sequence[str] = ("doc_id",),
    chunk: int = 32_768,
    overlap: int = 1_024,
) -> DataFrame:
    """Every document with ids (array of ranks) and decoded (the ids' raw bytes), without special tokens.

    A NULL or empty text has no ids. Equal texts have equal ids; repeated rows are all returned. ``carry`` names the input columns
    passed on; others are dropped. The rank file is read on the driver (``ranks_path`` is a parameter) and broadcast: a
    vocabulary has a fixed size. An id array holds a whole text, so the rows' bound is the longest text.
    """

    if not 0 < overlap <= chunk:
        raise ValueError("the overlap is at least one character and at most a chunk")
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, *pair_table(ranks)))
    passed = list(dict.fromkeys([*carry, "text"]))
    source = pick(docs, *passed)
    shape = T.StructType([*[source.schema[name] for name in carry], *CODED])
    schema = to_arrow_schema(shape)
    short = F.length(F.coalesce("text", F.lit(""))) <= chunk
    single = source.where(short).mapInArrow(_whole(shared, pattern, carry, schema), shape)

    # Long texts: equal ones are coded once, under the hash of the text.
    long = source.where(~short).withColumn("row", F.sha2("text", 256))
    texts = long.groupBy("row").agg(F.first("text").alias("text"))
    chunks = texts.mapInArrow(_cutter(chunk, overlap), "row string, number int, last boolean, text string")
    spread = chunks.repartition("row", "number")
    parts = spread.mapInArrow(_pretokenise(shared, pattern, chunk), PARTS_SQL)
    joined = parts.groupBy("row").applyInArrow(_joiner(shared, pattern, chunk), "row string, ids array<int>, decoded binary")
    whole = long.join(joined, "row").select(*carry, "ids", "decoded")
    return single.unionAll(whole)


def _joiner(shared, pattern: str, chunk: int):
    def join(table: pa.Table) -> pa.Table:
        coder = _coder(shared, pattern)
        parts = sorted(table.to_pylist(), key=lambda part: part["number"])
        ids = stitch(parts, chunk, coder)
        return pa.table(
            {"row": [parts[0]["row"]], "ids": pa.array([ids], INTS), "decoded": pa.array([coder.decode(ids)], pa.binary())}
        )

    return join
