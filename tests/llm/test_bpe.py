"""Encoding against the tiktoken library, with chunks small enough that texts are stitched everywhere."""

import random

import public_tokenizers
import pytest
import tiktoken

from premia.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = list("abcdeÜßé漢字१२³½ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0​ 　'!?.,0123_😀́\U0001d7d8") + ["'ll", "'s", "'re", "   ", "the ", " ning"]


def sample(rng, size):
    return "".join(rng.choice(ALPHABET) for _ in range(size))


def coder():
    return bpe.Coder(RANKS, public_tokenizers.PATTERN)


def test_encoding_equals_the_library():
    rng = random.Random(1)
    own = coder()
    for size in [0, 1, 2, 3, 5, 8, 40, 300] * 40:
        text = sample(rng, size)
        ids = own.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def parts_of(text, chunk, overlap, own):
    cut = range(0, max(len(text), 1), chunk)
    rows = [text[a : a + chunk + overlap] for a in cut]
    out = []
    for k, part in enumerate(rows):
        ends, ids, counts = [], [], []
        for match in own.spans(part):
            if k < len(rows) - 1 and match.end() > len(part) - bpe.LOOK_AHEAD:
                break
            found = own.piece(match.group())
            ends.append(match.end())
            ids += found
            counts.append(len(found))
        out.append({"number": k, "text": part[:chunk], "ends": ends, "ids": ids, "counts": counts})
    return out


@pytest.mark.parametrize("chunk,overlap", [(1, 1), (2, 1), (5, 3), (7, 7), (20, 6), (64, 10)])
def test_stitching_equals_the_library(chunk, overlap):
    rng = random.Random(chunk)
    own = coder()
    texts = [sample(rng, rng.choice([30, 90, 200])) for _ in range(60)]
    texts += ["a" * 300, " " * 200, " " * 100 + "x", "!" * 150 + "'ll", "x'll " * 40, "12345" * 30, "\n" * 50 + " a" * 50]
    for text in texts:
        assert bpe.stitch(parts_of(text, chunk, overlap, own), chunk, own) == LIBRARY.encode_ordinary(text), text


def test_a_long_piece_merges_as_in_the_library():
    rng = random.Random(3)
    own = coder()
    for text in ["ab" * 3000, "".join(rng.choice("abcdehiknorst") for _ in range(5000)), "=" * 4000]:
        assert own.encode(text) == LIBRARY.encode_ordinary(text)


def test_rows_on_spark(spark):
    rng = random.Random(5)
    long = [sample(rng, 900), "a" * 700, sample(rng, 900)]
    rows = [(1, "the cat"), (2, None), (3, ""), (4, long[0]), (4, long[0]), (None, long[1]), (6, long[2])]
    docs = spark.createDataFrame([(i, text, 0, "x") for i, text in rows], "doc_id long, text string, ids int, TEXT string")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, chunk=100, overlap=10).collect()
    want = [(i, LIBRARY.encode_ordinary(text or ""), (text or "").encode()) for i, text in rows]
    assert sorted((repr(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((repr(a), b, c) for a, b, c in want)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0
