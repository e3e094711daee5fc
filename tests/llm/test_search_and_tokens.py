"""Ranked search against scores of all documents; token files against the library's ids, and what a read of them skips."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plain_versions import LOWER
from premia.llm import ranked_search, token_files

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def plain_search(rows, items, top):
    counts = [(i, collections.Counter(terms(text))) for i, text in rows]
    counts = [(i, found) for i, found in counts if found]
    total = sum(sum(found.values()) for _, found in counts)
    df = collections.Counter(term for _, found in counts for term in found)
    out = []
    for item, text in items:
        scores = []
        for i, found in counts:
            m = 100 - 90 + 90 * sum(found.values()) * len(counts) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[term] + 1))) * (10**9 * found[term] // (1000 * found[term] + 8 * m))
                for term in set(terms(text)) if term in found
            )
            if score > 0:
                scores.append((-score, i is None, i, score))
        out += [(item, rank, i, score) for rank, (*_, i, score) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def found_by(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_search_ranks_as_scores_of_all_documents_do(spark, awkward, docs, no_docs):
    items = [("a", awkward[7][1][:300]), ("b", "alpha betas, gamma!"), ("c", None), ("d", "... ---"), ("e", "漢字 É"), ("f", "nowhere"), ("g", "Alpha ALPHA alpha")]
    bench = spark.createDataFrame([(i, text, "x") for i, text in items], "item_id string, text string, TEXT string")
    for top in (1, 10, 100):
        assert found_by(ranked_search.search(docs, bench, top)) == plain_search(awkward, items, top)
    assert found_by(ranked_search.search(docs, bench, 3, block_terms=5)) == plain_search(awkward, items, 3)
    assert ranked_search.search(no_docs, bench).count() == 0
    assert ranked_search.search(docs, bench.limit(0)).count() == 0
    twice = found_by(ranked_search.search(docs, bench.unionAll(bench), 2))
    assert twice == sorted(plain_search(awkward, items, 2) * 2, key=repr)


def test_no_bound_is_below_a_score():
    rng = np.random.default_rng(2)
    doc = np.sort(rng.integers(0, 50, 20_000))
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    impacts = rng.integers(1, 10**6, 20_000)
    sketch = ranked_search._sketches(doc, hashes, impacts, 50)
    assert (sketch[doc, (hashes % np.uint64(ranked_search.COORDINATES)).astype(int)] >= impacts).all()
    assert len(np.unique(sketch)) > 1000


def test_many_short_and_one_very_long_text(spark):
    rows = [(i, "alpha" if i % 3 else None) for i in range(5000)] + [(5000, "alpha beta " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    items = [(1, "beta alpha")]
    assert found_by(ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == plain_search(rows, items, 10)


def library():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


def test_pieces_are_encoded_as_whole_texts_are():
    texts = ["", " ", "  a", "a  b", "a \n b", "don't  stop it's I'll x'sy", " x\x1c y", "a　b c", "x \x85y z", "<|endoftext|> a <|endoftext|>",
             "漢字 漢 字" * 50, "a\tb c\n\nd  e \n", "½x ²y_z __ -- a.b.c", "é́ ñ ß ǅ", "a᠎b c", "x\r\ny \r\n z", "9a 9 a9 A.9", "ÀÉ, Ö!ß"]
    coder = token_files.Encoder(FILE)
    coder.encode(["warm it's up\n"])
    ids, sizes = coder.encode(texts)
    got = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [found.ids + [0] for found in library().encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts)[0].tolist() == ids.tolist()


def test_files_give_back_every_document(spark, awkward, docs, no_docs):
    folder = token_files.write(docs, FILE)
    rows = token_files.read(spark, folder, T.LongType()).collect()
    assert sorted(row.doc_id or -1 for row in rows) == sorted(i or -1 for i, _ in awkward)
    coder = library()
    wanted = collections.Counter((i, tuple(coder.encode(text or "", add_special_tokens=False).ids + [0])) for i, text in awkward)
    assert collections.Counter((row.doc_id, tuple(row.ids)) for row in rows) == wanted
    start = 0
    for row in sorted(rows, key=lambda row: row.start):
        assert row.start == start and row.n_tokens == len(row.ids)
        start += row.n_tokens
    in_order = [-1 if row.doc_id is None else row.doc_id for row in sorted(rows, key=lambda row: row.start)]
    assert in_order == sorted(in_order)
    sums = {(row.doc_id, row.start): row.ids_crc32 for row in token_files.checksums(token_files.read(spark, folder, T.LongType())).collect()}
    assert sums == {(row.doc_id, row.start): zlib.crc32(np.array(row.ids, "<u4").tobytes()) for row in rows}
    empty = token_files.write(no_docs, FILE)
    assert token_files.read(spark, empty, T.LongType()).count() == 0


def test_a_read_by_id_skips_rows(spark):
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    folder = token_files.write(docs, FILE)

    def read(where):
        found = token_files.read(spark, folder, T.LongType(), where)
        rows = found.collect()
        leaves = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in leaves and "doc_id" in leaves.split("PushedFilters")[1]
        return rows

    assert [row.doc_id for row in read(F.col("doc_id") == 2000)] == [2000]
    assert read(F.col("doc_id") == 2001) == []  # within the bounds of a stripe: only its Bloom filter can tell
    assert scanned(spark, folder, F.col("doc_id") == 2000) <= 1000
    assert scanned(spark, folder, F.col("doc_id") == 2001) == 0


def scanned(spark, folder, where):
    """Rows that the ORC reader hands on before the filter."""

    frame = spark.read.orc(folder).where(where).select("doc_id")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
