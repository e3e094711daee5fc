"""Language identification by error-correcting output codes.

Each language has a codeword; each of its bits is predicted by a binary classifier over hashed byte n-grams, a log ratio of the mean
n-gram distribution of the languages with that bit to that of the others. A text's bit margin is the mean
weight of its n-grams. Decoding adds up, for each codeword, the logistic losses of its bits, each weighted by how far the bit's classifier
tells its two sides apart, and takes the nearest codeword; close seconds are flagged as ambiguous.

All training texts are counted: a task sends one row per language and bucket, so what is shuffled and gathered is
bounded by languages x 2^bits, whatever the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.frames import pick
from premia.llm.words import pieces

ORDERS = (2, 4)
CODE_BITS = 31  # longest codeword
PRIOR = 0.5
SPREAD = 8.0  # margins are scaled so that a typical one has this loss
UNKNOWN = "und"


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, other ASCII as separators, two separators before each text; and each byte's text."""

    table = np.full(256, 0x20, dtype=np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes + 2)
    out = np.full(len(data) + 2 * n + 2, 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + 2 * (np.repeat(np.arange(n), sizes) + 1)] = table[data]
    return out, doc


def _grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram without two separators in a row."""

    text, doc = _folded(data, offsets)
    gap = text == 0x20
    double = gap[:-1] & gap[1:]
    wide = text.astype(np.uint64)
    buckets, owners = [], []
    for n in ORDERS:
        count = len(doc)
        if count + n > len(text):
            count = len(text) - n + 1
        value = np.full(max(count, 0), n, dtype=np.uint64)
        ok = np.ones(max(count, 0), dtype=bool)
        for j in range(n):
            value = value * np.uint64(257) + wide[j : j + count]
            if j < n - 1:
                ok &= ~double[j : j + count]
        hashed = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        buckets.append(hashed[ok].astype(np.int64))
        owners.append(doc[:count][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def _counter(bits: int):
    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for start, end, data, offsets in pieces(batch.column("text")):
                buckets, doc = _grams(data, offsets, bits)
                present = sorted(set(names[start:end]))
                number = {name: i for i, name in enumerate(present)}
                kind = np.array([number[name] for name in names[start:end]], dtype=np.int64)[doc]
                sums = np.bincount((kind << bits) + buckets, minlength=len(present) << bits).reshape(-1, 1 << bits)
                for name in present:
                    if name not in tables:
                        tables[name] = np.zeros(1 << bits, dtype=np.int64)
                    tables[name] += sums[number[name]]
        for name, sums in tables.items():
            seen = np.flatnonzero(sums)
            # A language with texts but without n-grams is still a language.
            seen = seen if len(seen) else np.zeros(1, dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * len(seen), "bucket": seen.astype(np.int32), "n": sums[seen]}
            )

    return count


def codewords(count: int, seed: int = 20) -> np.ndarray:
    """A matrix of +1 and -1 with a row per language; all splits if they are few, else the best of seeded draws."""

    if count < 2:
        return np.ones((count, 1), dtype=np.int8)
    if (1 << (count - 1)) - 1 <= CODE_BITS:
        columns = []
        for number in range(1, 1 << (count - 1)):
            columns.append([1 if i == count - 1 or not number >> i & 1 else -1 for i in range(count)])
        return np.array(columns, dtype=np.int8).T
    draw = np.random.RandomState(seed)
    best, reach = None, -1
    for _ in range(50):
        code = np.where(draw.rand(count, CODE_BITS) < 0.5, -1, 1).astype(np.int8)
        if (np.abs(code.sum(axis=0)) == count).any():
            continue
        least = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(count), 2))
        if least > reach:
            best, reach = code, least
    return best


class Model:
    """Bit classifiers, codewords and the weight of each bit's loss."""

    def __init__(self, languages: list[str], counts: np.ndarray, bits: int) -> None:
        self.languages = languages
        self.bits = bits
        self.code = codewords(len(languages)).astype(np.float64)
        share = (counts + PRIOR) / (counts + PRIOR).sum(axis=1, keepdims=True)
        columns = []
        for bit in self.code.T:
            if (bit > 0).all():
                columns.append(np.zeros(share.shape[1]))
            else:
                columns.append(np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)))
        self.weights = np.array(columns, dtype=np.float32).T
        # Expected margin of each language on each bit; a bit counts by its smallest.
        expected = share @ self.weights * self.code
        self.trust = np.maximum(expected.min(axis=0), 1e-6)
        self.scale = SPREAD / self.trust
        self.trust = self.trust / self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its share of the decoded evidence, and the gap to the second nearest."""

        bent = margins * self.scale
        loss = np.stack([(self.trust * np.logaddexp(0, -bent * word)).sum(axis=1) for word in self.code], axis=1)
        evidence = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share = evidence / evidence.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ranked = np.sort(share, axis=1)
        gap = ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0.0)
        return best, share.max(axis=1), gap


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of the rows to learn from: those with a language whose crc32(doc_id as text) mod 5 is not 0."""

    return pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out()).select("text", "lang")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, bits: int = 15) -> Model | None:
    """Learn from all rows of (text, lang); None if there are none."""

    sums = rows.mapInArrow(_counter(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most languages x 2^bits rows
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << bits))
    counts[[number[name] for name in names], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(languages, counts, bits)


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode()))


PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]
)
PREDICTED_SQL = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def _predictor(model: Model | None, close: float):
    def predict(batches):
        letter = np.zeros(256, dtype=bool)
        letter[0x41:0x5B] = letter[0x61:0x7B] = True
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column("text")):
                n = end - start
                plain = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(letter[data], out=plain[1:])
                worded = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~worded & (offsets[1:] > offsets[:-1])).tolist():
                    worded[i] = _has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
                names, score, gap = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n)
                if model is not None:
                    buckets, doc = _grams(data, offsets, model.bits)
                    grams = np.maximum(np.bincount(doc, minlength=n), 1)
                    margins = np.stack(
                        [np.bincount(doc, column[buckets], n) / grams for column in np.ascontiguousarray(model.weights.T)], axis=1
                    )
                    best, share, gap = model.decode(margins)
                    names = np.where(worded, np.array(model.languages, dtype=object)[best], UNKNOWN)
                    score = np.where(worded, share, 0.0)
                rows = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), rows.column("held_out"), pa.array(names.tolist(), pa.string()),
                        pa.array(np.round(score, 9)), pa.array(worded & (gap < close)),
                    ],
                    schema=PREDICTED,
                )

    return predict


def identify(docs: DataFrame, bits: int = 15, close: float = 0.1) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous (the second language is within ``close``) of every document.

    Learns from the rows that are not held out and have a language. A text that is NULL or has no letter is 'und' with score 0, as
    is every text if there is nothing to learn from; with one language every text with a letter has it. Equal losses go to the language first in order.
    A NULL id is not held out. Repeated rows are predicted alike, all returned; other columns are dropped.
    """

    model = fit(training_rows(docs), bits)  # at most 2^bits x CODE_BITS weights
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(_predictor(model, close), PREDICTED_SQL)
