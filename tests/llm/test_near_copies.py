"""The near-dedup stage of the pipeline against all pairs."""

import collections
import random

import duckdb

import corpus_pipeline
from conftest import prose
from plain_versions import kept_by_pairs
from premia.llm import near_copies, simhash


def kept_by_stage(spark, rows):
    docs = spark.createDataFrame([(i, text, "en", "s", len(text or "")) for i, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(row.doc_id for row in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())


def test_near_copies_beyond_two_bits_go(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    changed = words[:40] + ["other"] + words[41:]  # 5 of 96 shingles differ: 91 / 101
    apart = [w if k not in (20, 50, 80) else "new" for k, w in enumerate(words)]  # 15 differ: 81 / 111
    rows = [(1, " ".join(words)), (2, " ".join(changed).upper()), (3, " ".join(apart))]
    assert kept_by_stage(spark, rows) == kept_by_pairs(rows) == [1, 3]


def test_stage_finds_every_pair(spark):
    """Chains and crowds of edited texts, a line common to all, equal, short and empty texts."""

    rng = random.Random(7)
    line = prose(rng, 30)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (6, prose(rng, 200))]
    for family in range(6):
        base = [f"{family}x{rng.randrange(500)}" for _ in range(120)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = text
            rows.append((10 + len(rows), " ".join(text) + "\n" + line))
    want = kept_by_pairs(rows)
    assert 20 < len(want) < len(rows) - 50
    assert kept_by_stage(spark, rows) == want


def test_stage_on_the_smallest_documents(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert kept_by_stage(spark, rows) == kept_by_pairs(rows)


def test_simhash_classes_come_first_and_are_checked(spark, monkeypatch):
    """The stage's first links are op8's: texts within two bits that are similar. Texts with one fingerprint that are not similar stay apart."""

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    refrain = " ".join(["one two three"] * 80)
    rows = [(1, " ".join(base)), (2, " ".join([*base, "w7"])), (3, refrain + " " + prose(rng, 40)), (4, refrain + " " + prose(rng, 40)), (5, prose(rng, 200))]
    bits = {i: simhash.fingerprint(text.encode()) & (2**64 - 1) for i, text in rows}
    assert (bits[1] ^ bits[2]).bit_count() <= 2 and (bits[3] ^ bits[4]).bit_count() <= 2 < (bits[1] ^ bits[5]).bit_count()
    found, plain = [], near_copies.simhash_links

    def seen(*given):
        found.append(plain(*given))
        return found[-1]

    monkeypatch.setattr(near_copies, "simhash_links", seen)
    assert kept_by_stage(spark, rows) == kept_by_pairs(rows) == [1, 3, 4, 5]
    assert len(found) == 1 and found[0].count() == 1


def test_keeps_the_smallest_id_and_the_columns(spark, docs, no_docs):
    assert near_copies.keep_one(no_docs, ["doc_id", "text"]).count() == 0
    got = near_copies.keep_one(docs, ["doc_id", "text"])
    assert got.columns == ["doc_id", "text"]
    ids = collections.Counter(row.doc_id for row in got.collect())
    assert max(ids.values()) == 1 and ids[8] == 1 and 9 not in ids and 1 in ids and 2 not in ids
