"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Count. One job counts the training words by hash; buckets are ranges of the hash, so each bucket's sorted array is a slice of
the sorted vocabulary and a word's number is its rank. A second job counts pairs of word numbers. A
bucket holds all pairs of its contexts, but for frequent contexts, whose pairs are spread over as many buckets as
their share of all tokens asks for. Both jobs send each distinct entry of a piece of text once, packed by bucket.
Store. Buckets write sorted key arrays with counts to the shared folder; per-word statistics (pair types by count
as a context, distinct contexts as a word) are written beside the vocabulary's slices.
Score. Workers map those files and look up the distinct words and pairs of a piece in sorted order.

The arrays grow with the corpus and are never gathered: the driver sees a few numbers per bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.arrays import Arrays, save
from premia.llm.frames import pick, shared_folder, width
from premia.llm.words import find_words, hash_spans, lowered, mixed, not_space, pieces

PIECE_BYTES = 4 << 20
HELD_TOKENS = 4_000_000  # counted together before they are sent
END = np.uint64(0xE0D0C0B0A0908070)  # stands for the end of a text among the word hashes
START_ID = np.uint32(0xFFFFFFFF)
UNKNOWN_ID = np.uint32(0xFFFFFFFE)


def held_out() -> Column:
    """crc32(doc_id as text) mod 7 is 2; a NULL id is not."""

    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(data, offsets, words, values, end):
    """Values of the words with ``end`` after each text; and each token's text."""

    n = len(offsets) - 1
    out = np.empty(len(values) + n, dtype=values.dtype)
    doc = np.empty(len(out), dtype=np.int64)
    at = np.arange(len(values)) + words.doc
    out[at], doc[at] = values, words.doc
    at = words.first[1:] + np.arange(n)
    out[at], doc[at] = end, np.arange(n)
    return out, doc


def _read(batches):
    """Pieces of lower-cased texts: (rows, bytes, offsets, words, word hashes)."""

    for batch in batches:
        for start, end, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
            data = lowered(data)
            words = find_words(data, offsets, not_space())
            yield batch.slice(start, end - start), data, offsets, words, hash_spans(data, words.starts, words.ends)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted numbers then compress well."""

    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _unplaned(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _packed(bucket, keys, counts):
    """One row per bucket: its keys and their counts; ``bucket`` is in order."""

    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    rows = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array([int(bucket[a]) for a, _ in rows], pa.int32()),
            "keys": pa.array([_planes(keys[a:b]) for a, b in rows], pa.binary()),
            "counts": pa.array([_planes(counts[a:b].astype("<u4")) for a, b in rows], pa.binary()),
        }
    )


PACKED = "bucket int, keys binary, counts binary"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket in order, and the sums of their counts."""

    keys = np.concatenate([_unplaned(x, "<u8") for x in table.column("keys").to_pylist()])
    counts = np.concatenate([_unplaned(x, "<u4") for x in table.column("counts").to_pylist()])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _word_counter(shift: int):
    def count(batches):
        held, size = [], 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _packed((keys >> np.uint64(shift)).astype(np.int64), keys, counts)

        for _, data, offsets, words, hashes in _read(batches):
            held.append(_tokens(data, offsets, words, hashes, END)[0])
            size += len(held[-1])
            if size >= HELD_TOKENS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return count


def _word_keeper(folder: str):
    def keep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _merged(table)
        save(folder, f"words-{bucket}", keys)
        save(folder, f"counts-{bucket}", counts.astype("<u8"))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())]})

    return keep


class Vocabulary:
    """Slices of the sorted vocabulary and the first number of each."""

    def __init__(self, folder: str, shift: int, first: np.ndarray, texts: int, tokens: int) -> None:
        self.folder, self.shift, self.first = folder, shift, first
        self.texts, self.tokens = texts, tokens
        self.types = int(first[-1])

    def look_up(self, arrays: Arrays, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of sorted distinct hashes (UNKNOWN_ID if never seen in training), and their counts."""

        ids = np.full(len(hashes), UNKNOWN_ID, dtype=np.uint32)
        counts = np.zeros(len(hashes), dtype=np.int64)
        bucket = (hashes >> np.uint64(self.shift)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(len(self.first)))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            known = arrays.get(f"words-{k}", "<u8")
            if not len(known):
                continue
            part = hashes[cuts[k] : cuts[k + 1]]
            place = np.minimum(np.searchsorted(known, part), len(known) - 1)
            found = known[place] == part
            ids[cuts[k] : cuts[k + 1]] = np.where(found, self.first[k] + place, UNKNOWN_ID)
            counts[cuts[k] : cuts[k + 1]] = np.where(found, arrays.get(f"counts-{k}", "<u8")[place], 0)
        return ids, counts

    def numbered(self, arrays: Arrays, data, offsets, words, hashes):
        """Distinct words with numbers and counts; each token's place among them; each token's text."""

        tokens, doc = _tokens(data, offsets, words, hashes, END)
        distinct, place = np.unique(tokens, return_inverse=True)
        ids, counts = self.look_up(arrays, distinct)
        return ids, counts, place, doc


def _pairs(ids, counts, place, doc, texts: int, tokens: int, n_buckets: int):
    """Key (context, word) and bucket of every token, and the count of its context."""

    own = ids[place]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    context = np.empty(len(own), dtype=np.int64)
    context[1:] = counts[place][:-1]
    start = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(own)]
    before[start], context[start] = START_ID, texts
    keys = (before.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)
    spread = np.maximum(1, -(-context * n_buckets // max(1, tokens))).astype(np.uint64)
    spread = np.minimum(spread, np.uint64(n_buckets))
    bucket = (mixed(before.astype(np.uint64)) % np.uint64(n_buckets) + mixed(own.astype(np.uint64)) % spread) % np.uint64(n_buckets)
    return keys, bucket.astype(np.int64), context


def _pair_counter(words: Vocabulary, n_buckets: int):
    def count(batches):
        arrays = Arrays(words.folder)
        for _, data, offsets, spans, hashes in _read(batches):
            ids, counts, place, doc = words.numbered(arrays, data, offsets, spans, hashes)
            keys, bucket, _ = _pairs(ids, counts, place, doc, words.texts, words.tokens, n_buckets)
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            bucket = bucket[first]
            order = np.argsort(bucket, kind="stable")
            yield _packed(bucket[order], keys[order], n[order])

    return count


STATS = "slice int, contexts binary, one binary, two binary, more binary, words binary, cont binary"
STAT_NAMES = ("contexts", "one", "two", "more", "words", "cont")


def _by_slice(first: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> dict[int, list[bytes]]:
    """Per slice of the vocabulary: packed local numbers of the ids (in order) and packed columns.

    The start of a text, which is a context only, has a slice of its own after the last.
    """

    cuts = np.append(np.searchsorted(ids, np.append(first, np.int64(UNKNOWN_ID))), len(ids))
    out = {}
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        base = first[k] if k < len(first) - 1 else int(START_ID)
        out[min(k, len(first) - 1)] = [_planes(x[a:b].astype("<u4")) for x in (ids - base, *columns)]
    return out


def _pair_keeper(folder: str, first: np.ndarray):
    def keep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _merged(table)
        save(folder, f"pairs-{bucket}", keys)
        short = np.minimum(counts, 0xFFFF).astype("<u2")
        save(folder, f"short-{bucket}", short)
        save(folder, f"long-{bucket}", counts[short == 0xFFFF].astype("<u8"))
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts == 1, counts == 2, counts >= 3)]
        left = _by_slice(first, context[at], *sums)
        right = _by_slice(first, *np.unique(word, return_counts=True))
        rows = [(k, *left.get(k, [b""] * 4), *right.get(k, [b""] * 2)) for k in sorted({*left, *right})]
        # How many pairs occur once, twice, three and four times.
        tally = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], dtype="<u8")
        rows.append((-1, tally.tobytes(), b"", b"", b"", b"", b""))
        return pa.table(
            {"slice": pa.array([row[0] for row in rows], pa.int32())}
            | {name: pa.array([row[i] for row in rows], pa.binary()) for i, name in enumerate(STAT_NAMES, 1)}
        )

    return keep


def _stat_keeper(folder: str, sizes: np.ndarray):
    """Sum up the statistics of a slice and write them by word number; report how continuation counts are distributed."""

    def keep(table: pa.Table) -> pa.Table:
        k = table.column("slice")[0].as_py()
        rows = table.to_pylist()
        tally = np.zeros(4, dtype=np.int64)
        if k < 0:
            for row in rows:
                tally += np.frombuffer(row["contexts"], "<u8").astype(np.int64)
            return _summary(k, tally, 0, 0)
        n = int(sizes[k])
        sums = {name: np.zeros(n, dtype=np.int64) for name in ("one", "two", "more", "cont")}
        for row in rows:
            for numbers, names in (("contexts", ("one", "two", "more")), ("words", ("cont",))):
                ids = _unplaned(row[numbers], "<u4")
                for name in names:
                    sums[name][ids] += _unplaned(row[name], "<u4").astype(np.int64)
        for name, values in sums.items():
            save(folder, f"{name}-{k}", values.astype("<u4"))
        if k == len(sizes) - 1:  # the start of a text is never a word
            return _summary(k, tally, 0, 0)
        cont = sums["cont"]
        return _summary(k, np.array([(cont == i).sum() for i in (1, 2, 3, 4)]), int(cont.sum()), int((cont >= 3).sum()))

    return keep


def _summary(k: int, tally, total: int, more: int) -> pa.Table:
    row = {"slice": pa.array([k], pa.int32()), **{f"n{i + 1}": [int(x)] for i, x in enumerate(tally)}, "total": [total], "more": [more]}
    return pa.table(row)


SUMMARY = "slice int, n1 long, n2 long, n3 long, n4 long, total long, more long"


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more; 0.5, 1 and 1.5 where counts of counts are missing."""

    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


class Model:
    """What workers need besides the files."""

    def __init__(self, words: Vocabulary, n_buckets: int, pair_cuts, word_cuts, pair_types: int, word_tally) -> None:
        self.words, self.n_buckets = words, n_buckets
        self.pair_cuts, self.word_cuts = np.array([0.0, *pair_cuts]), np.array([0.0, *word_cuts])
        self.pair_types = pair_types
        saved = sum(d * n for d, n in zip(word_cuts, word_tally))
        #: Mass of the uniform distribution over the vocabulary and one unknown word.
        self.uniform = (saved / pair_types if pair_types else 1.0) / (words.types + 1)

    def _stats(self, arrays: Arrays, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics of distinct words, 0 where unknown; ids of known words are in order."""

        out = {name: np.zeros(len(ids), dtype=np.float64) for name in ("one", "two", "more", "cont")}
        known = np.flatnonzero(ids < UNKNOWN_ID)
        numbers = ids[known].astype(np.int64)
        cuts = np.searchsorted(numbers, self.words.first)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = known[cuts[k] : cuts[k + 1]]
            local = numbers[cuts[k] : cuts[k + 1]] - self.words.first[k]
            for name, values in out.items():
                values[part] = arrays.get(f"{name}-{k}", "<u4")[local]
        return out

    def _pair_counts(self, arrays: Arrays, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        bucket = bucket[first]
        order = np.argsort(bucket, kind="stable")  # keys stay in order within a bucket
        found = np.zeros(len(keys), dtype=np.int64)
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            stored_keys = arrays.get(f"pairs-{k}", "<u8")
            if not len(stored_keys):
                continue
            mine = order[cuts[k] : cuts[k + 1]]
            place = np.minimum(np.searchsorted(stored_keys, keys[mine]), len(stored_keys) - 1)
            short = arrays.get(f"short-{k}", "<u2")
            count = np.where(stored_keys[place] == keys[mine], short[place], 0).astype(np.int64)
            if (count == 0xFFFF).any():
                escaped = np.flatnonzero(np.asarray(short) == 0xFFFF)
                big = count == 0xFFFF
                count[big] = arrays.get(f"long-{k}", "<u8")[np.searchsorted(escaped, place[big])]
            found[mine] = count
        return found[inverse]

    def log_probabilities(self, arrays: Arrays, data, offsets, spans, hashes):
        """Per token: its text, the count of its word, and log10 of its probability after its context."""

        ids, counts, place, doc = self.words.numbered(arrays, data, offsets, spans, hashes)
        stats = self._stats(arrays, ids)
        cont = stats["cont"]
        kept = np.maximum(cont - self.word_cuts[np.minimum(cont, 3).astype(np.int64)], 0)
        low = kept / max(1, self.pair_types) + self.uniform
        saved = sum(d * stats[name] for d, name in zip(self.pair_cuts[1:], ("one", "two", "more")))
        keys, bucket, context = _pairs(ids, counts, place, doc, self.words.texts, self.words.tokens, self.n_buckets)
        pair = self._pair_counts(arrays, keys, bucket)
        before = np.concatenate([[0.0], saved[place][:-1]])
        start = (keys >> np.uint64(32)) == np.uint64(START_ID)
        k = len(self.words.first) - 1
        first = [arrays.get(f"{name}-{k}", "<u4") for name in ("one", "two", "more")]
        before[start] = sum(float(d) * float(x[0]) for d, x in zip(self.pair_cuts[1:], first) if len(x))
        lower = low[place]
        share = np.maximum(pair - self.pair_cuts[np.minimum(pair, 3)], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            full = (share + before * lower) / context
        return doc, counts[place], np.log10(np.where(context > 0, full, lower))


def train(rows: DataFrame) -> Model:
    """Count and store the model of all ``rows`` (text)."""

    spark = rows.sparkSession
    folder = shared_folder(spark, "model")
    # Each bucket of pairs reports to each slice of the vocabulary, so both are kept few: about two buckets and half a
    # slice per shuffle partition.
    n_buckets = 2 * width(spark)
    bits = max(1, math.ceil(math.log2(n_buckets / 4)))
    shift = 64 - bits
    texts = rows.select("text")
    kept = texts.mapInArrow(_word_counter(shift), PACKED).groupBy("bucket").applyInArrow(_word_keeper(folder), "bucket int, types long, tokens long")
    slices = {row["bucket"]: row for row in kept.collect()}  # one row per bucket
    sizes = np.array([slices[k]["types"] if k in slices else 0 for k in range(1 << bits)], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if first[-1] >= int(UNKNOWN_ID):
        raise ValueError("the vocabulary does not fit 32-bit word numbers")
    tokens = sum(row["tokens"] for row in slices.values())
    n_texts = texts.count()
    words = Vocabulary(folder, shift, first, n_texts, tokens)
    paired = texts.mapInArrow(_pair_counter(words, n_buckets), PACKED).groupBy("bucket").applyInArrow(_pair_keeper(folder, first), STATS)
    stats = paired.groupBy("slice").applyInArrow(_stat_keeper(folder, np.append(sizes, 1)), SUMMARY)
    found = stats.collect()  # one row per slice of the vocabulary
    pairs = next((row for row in found if row["slice"] < 0), None)
    slices_found = [row for row in found if row["slice"] >= 0]
    tally = [sum(row[f"n{i}"] for row in slices_found) for i in (1, 2, 3, 4)]
    more = sum(row["more"] for row in slices_found)
    pair_types = sum(row["total"] for row in slices_found)
    pair_cuts = discounts(*[pairs[f"n{i}"] for i in (1, 2, 3, 4)]) if pairs else discounts(0, 0, 0, 0)
    return Model(words, n_buckets, pair_cuts, discounts(*tally), pair_types, (tally[0], tally[1], more))


SCORED = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)
SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model: Model):
    def score(batches):
        arrays = Arrays(model.words.folder)
        n_all, v = model.words.tokens, model.words.types
        for rows, data, offsets, spans, hashes in _read(batches):
            n = rows.num_rows
            doc, counts, logs = model.log_probabilities(arrays, data, offsets, spans, hashes)
            base = np.log10((counts + 1) / (n_all + v + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("held_out"), pa.array(spans.per_doc + 1),
                    pa.array(np.bincount(doc, counts > 0, n).astype(np.int64)), pa.array(np.full(n, n_all, dtype=np.int64)),
                    pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, logs, n)),
                ],
                schema=SCORED,
            )

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document.

    Learns from all documents that are not held out. Tokens are the lower-cased words (A-Z only) and one end per text; a NULL or
    empty text is its end alone. score is the model's log10 probability of the text, base_score that of counts with one added.
    Repeated rows are trained on and scored one by one; a NULL id is trained on. With nothing to learn from, the model is uniform over one
    unknown word. An empty table gives no rows; other columns are dropped.
    """

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    scored = rows.mapInArrow(_scorer(model), SCORED_SQL)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
