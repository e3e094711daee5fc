"""The whole pipeline against plain versions of its stages, over the smallest given tables."""

import collections
import hashlib
import math
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from premia.llm.bpe import read_ranks
from plain_versions import SPACED, base_counts, contaminated, kept_by_pairs, repeats

FOLDER = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


def grams(text):
    words = re.findall(SPACED, text)
    return words + [" ".join(pair) for pair in zip(words, words[1:])]


def plain_quality(docs, labels):
    good_ids = {i for i, quality, toxic in labels if quality == 1 and not toxic}
    raw, good = collections.Counter(), collections.Counter()
    for i, text in docs.items():
        raw.update(grams(text))
        if i in good_ids:
            good.update(grams(text))
    share = sum(good.values()) / sum(raw.values())
    kept = []
    for i, text in docs.items():
        n, *_, repeated = base_counts(text)
        found = grams(text)
        score = sum(math.log((good[g] + 20) / (raw[g] * share + 20)) for g in found) / max(1, len(found))
        if n >= 50 and 100 * repeated <= 50 * n and score >= -0.05:
            kept.append(i)
    return {i: docs[i] for i in kept}


def test_every_stage_does_its_work(spark):
    docs = {i: text or "" for i, text, *_ in table("documents")}
    good = plain_quality(docs, table("labels"))
    single = {i: good[i] for i in kept_by_pairs(list(good.items()))}
    cut = {}
    for (i, text), (n, gone, left) in zip(single.items(), repeats(list(single.values()), 35)):
        if not gone:
            cut[i] = text
        elif gone < n:
            cut[i] = left
    hits = {i: n_hit for i, _, n_hit, _ in contaminated(list(cut.items()), table("benchmark"))}
    clean = {i: text for i, text in cut.items() if not hits[i]}
    assert len(docs) > len(good) > len(single) >= len(cut) > len(clean) > 50

    library = tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    got = {row.doc_id: row for row in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean)
    for i, text in clean.items():
        assert list(got[i].ids) == library.encode_ordinary(text)
        assert got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


@pytest.mark.parametrize("number", range(5))
def test_stages_take_empty_and_odd_tables(spark, tmp_path, number):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT int, kept boolean"
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    rows = [(1, None, None, None, None, 1, True), (None, "a b", "en", "s", 3, 1, True), (1, "", "en", "s", 0, 1, True)]
    stage(spark, spark.createDataFrame(rows + rows, schema), str(tmp_path)).collect()
