"""Documents with the awkward cases that every operator has to take."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ",", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): NULLs, blanks, a very long text, repeated rows, shared and repeated passages, odd characters."""

    rng = random.Random(11)
    passage = prose(rng, 60)
    inner = prose(rng, 40)
    same = prose(rng, 90)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word"), (5, "two words"), (None, "no id here"), (None, None),
        (6, prose(rng, 120) + " " + passage), (7, passage + "\n" + prose(rng, 30)), (8, same), (9, same), (9, same),
        (10, inner + " x " + inner), (11, "a " * 200), (12, prose(rng, 6000) + " " + passage), (13, "\x1c\x85 漢字 ½ ß"),
        (14, "!!! ### $$$ %%%\n\nline\nline\n"), (15, same + " tail"), (16, prose(rng, 34)), (17, prose(rng, 35)),
        (18, passage.upper()), (19, "\ud7ff\U0010ffff é é"),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 150))) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The rows with clashing extra columns."""

    rows = [(i, text, "x", 1, None, "en", "s", len(text or "")) for i, text in awkward]
    schema = "doc_id long, text string, TEXT string, n_words int, key_a string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
