"""The operators on whole texts against plain versions of their contracts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from premia.llm import decontaminate, kneser_ney, languages, quality, shards, simhash, substrings
from plain_versions import LOWER, SPACED, base_counts, contaminated, fingerprint, grouped, repeats



def rows_of(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


# Substring dedup


@pytest.mark.parametrize("window", [35, 34, 2, 7])
def test_repeats_are_cut(docs, awkward, window):
    want = [(i, *found) for (i, _), found in zip(awkward, repeats([text for _, text in awkward], window))]
    got = rows_of(substrings.cut_repeats(docs, window=window), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(want, key=repr)


def test_maximal_repeats_are_named(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d")], "doc_id long, text string")
    got = {row.doc_id: [tuple(x) for x in row.repeats] for row in substrings.cut_repeats(docs).collect()}
    assert got == {1: [(2, 52)], 2: [(0, 50)]}


def test_pieces_meet_each_other(spark, monkeypatch, awkward):
    """One text a piece, so that nothing is settled inside a piece but repeats of a text within itself."""

    monkeypatch.setattr(substrings, "PIECE_BYTES", 1)
    docs = spark.createDataFrame(awkward, "doc_id long, text string").repartition(3)
    want = [(i, *found) for (i, _), found in zip(awkward, repeats([text for _, text in awkward], 35))]
    assert rows_of(substrings.cut_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)


# SimHash


def test_near_duplicates(docs, awkward):
    prints = [fingerprint(text) for _, text in awkward]
    number = grouped(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(awkward, prints):
        if i is not None:
            least[number[p]] = min(i, least.get(number[p], i))
    want = [(i, p - (1 << 64) if p >> 63 else p, least.get(number[p])) for (i, _), p in zip(awkward, prints)]
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "print", "component_id") == sorted(want, key=repr)
    kept = simhash.keep_one(docs, ["doc_id", "text"]).collect()
    assert len(kept) == len(set(number.values()))
    assert {row.doc_id for row in kept if row.doc_id is not None} == set(least.values())


def test_links_among_random_prints(spark):
    rng = np.random.RandomState(4)
    base = rng.randint(0, 1 << 62, 40)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.randint(1, 5), replace=False)
            x = (b ^ sum(1 << int(f) for f in flips)) & (1 << 64) - 1
            values.add(x - (1 << 64) if x >> 63 else x)
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {tuple(row) for row in simhash.links(prints).collect()} == want


def test_long_chains_become_one_component(spark):
    from premia.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (7, 7), (90, 100)], "a long, b long")
    got = {row.node: row.root for row in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}


# Decontamination


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, docs, awkward, block):
    texts = [text for _, text in awkward]
    items = [(1, texts[7][:200]), (2, texts[9].upper()), (10, "word"), (9, "漢字"), (3, None), (4, ""), (None, "two, words!"), (1, texts[7][:200]), (5, texts[9])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, benchmark, block_windows=block)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "items") == contaminated(awkward, items)
    for row in decontaminate.find_contamination(docs, benchmark, ("doc_id", "text"), block_windows=block).collect():
        words = sum(span.end_word - span.first_word for span in row.spans)
        assert words == row.n_hit
        for span in row.spans:
            part = row.text[span.start_char : span.end_char].translate(LOWER)
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part)) == span.end_word - span.first_word


def test_an_empty_benchmark_hits_nothing(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {row.n_hit for row in decontaminate.find_contamination(docs, nothing).collect()} == {0}


# Quality rules


def test_base_counts_and_verdicts(spark, docs, awkward):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (100, 1, 1), (101, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    want = sorted(((i, *base_counts(text)) for i, text in awkward), key=repr)
    assert sorted((tuple(row[name] for name in ("doc_id", *quality.BASE)) for row in got), key=repr) == want
    for row in got:
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert row.base_failed == failed
        assert row.kept == (not failed and row.quality_score >= -0.05)


def test_weights_equal_plain_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit_weights(docs, labels, bits=18, pseudo=2.0)
    # a 3 of 9 n-grams, b 2, c 1, ab 1, ba 1, bc 1; trusted a 2, b 1, ab 1, ba 1.
    def want(good, raw):
        return np.log((good + 2) / (raw * 5 / 9 + 2))

    expected = sorted([want(2, 3), want(1, 2), want(0, 1), want(1, 1), want(1, 1), want(0, 1)])
    assert np.allclose(sorted(weights[weights != 0]), expected)


# Languages


def test_languages_are_told_apart(spark):
    rng = np.random.RandomState(2)
    sets = {"aa": ["tha", "ing", "ou"], "bb": ["sch", "über", "ich"], "cc": ["ción", "ñar", "los"]}
    rows = [(i, " ".join(rng.choice(sets[name], 12)), name) for i, name in enumerate(list(sets) * 60)]
    odd = [(1000, None, "aa"), (1001, "12 !?", "bb"), (None, "schich", None), (1003, "ich " * 20000, None), (1004, "½ é", None), (1005, "", "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {row.doc_id: row for row in languages.identify(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].lang_pred == name for i, _, name in rows)
    assert any(got[i].held_out for i, _, _ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1005)] == ["und"] * 3
    assert got[None].lang_pred == got[1003].lang_pred == "bb" and got[1004].lang_pred != "und"
    assert all(0 <= row.score <= 1 for row in got.values())


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [row.lang_pred for row in languages.identify(none).collect()] == ["und"]


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(count):
    code = languages.codewords(count)
    least = min((code[a] != code[b]).sum() for a in range(count) for b in range(a))
    assert least >= min(4, 1 << (count - 2))


# Kneser-Ney


def plain_model(train):
    """Textbook interpolated modified Kneser-Ney over pairs; probability of a word after a context."""

    pairs = collections.Counter()
    for text in train:
        tokens = ["<s>"] + re.findall(SPACED, (text or "").translate(LOWER)) + ["</s>"]
        pairs.update(zip(tokens, tokens[1:]))
    words = collections.Counter(b for (_, b), n in pairs.items() for _ in range(n))

    def cuts(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        return (0, *kneser_ney.discounts(*n))

    cont = collections.Counter(b for _, b in pairs)
    context = collections.Counter()
    kinds = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in pairs.items():
        context[a] += n
        kinds[a][min(n, 3)] += 1
    high, low = cuts(pairs.values()), cuts(cont.values())
    total = len(pairs)
    spare = sum(low[min(c, 3)] for c in cont.values())

    def one(w):
        c = cont[w]
        kept = max(c - low[min(c, 3)], 0) / total if total else 0
        return kept + (spare / total if total else 1.0) / (len(words) + 1)

    def two(a, w):
        if not context[a]:
            return one(w)
        c = pairs[a, w]
        saved = sum(high[k] * kinds[a][k] for k in (1, 2, 3))
        return (max(c - high[min(c, 3)], 0) + saved * one(w)) / context[a]

    return words, two


def test_scores_equal_the_textbook(docs, awkward):
    import math
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    words, two = plain_model([text for i, text in awkward if not out(i)])
    n_all, types = sum(words.values()), len(words)
    got = kneser_ney.score_documents(docs).collect()
    want = []
    for i, text in awkward:
        tokens = ["<s>"] + re.findall(SPACED, (text or "").translate(LOWER)) + ["</s>"]
        score = sum(math.log10(two(a, b)) for a, b in zip(tokens, tokens[1:]))
        base = sum(math.log10((words[w] + 1) / (n_all + types + 1)) for w in tokens[1:])
        want.append((i, out(i), len(tokens) - 1, sum(words[w] > 0 for w in tokens[1:]), n_all, round(base, 6), round(score, 6)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    # After any context, all words and one unknown word share the whole probability.
    for context in ["<s>", "alpha", "never seen"]:
        assert math.isclose(sum(two(context, w) for w in words) + two(context, "never seen"), 1.0)


def test_a_model_of_nothing(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = kneser_ney.score_documents(docs).first()
    assert (row.n_known, row.train_tokens, row.score) == (0, 0, 0.0)


# Sharding


def test_shards_are_even_and_slots_gapless(docs, awkward):
    for count in (1, 5, 8):
        got = shards.kd_shards(docs, count).collect()
        size = {}
        slots = collections.defaultdict(list)
        for row in got:
            size[row.shard] = size.get(row.shard, 0) + row.size
            slots[row.shard].append(row.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert set(size) <= set(range(count))  # one text here outweighs all others, so a shard may stay empty
        want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in awkward), key=repr)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
        biggest = max(r.size for r in got)
        assert max(size.values()) <= sum(size.values()) / count + biggest


def test_shards_of_many_equal_sizes_are_near_equal(spark):
    docs = spark.createDataFrame([(i, f"text {i:05d}", 10, "en") for i in range(3000)], "doc_id long, text string, n_chars long, lang string")
    size = collections.Counter(row.shard for row in shards.kd_shards(docs, 7).collect())
    assert max(size.values()) <= 1.05 * 3000 / 7 and min(size.values()) >= 0.95 * 3000 / 7
    by_bytes = shards.kd_shards(docs, target_bytes=26 * 300).select("shard").distinct().count()
    assert by_bytes == 10


def test_repeated_rows_are_cut_between_rows(spark):
    """Most rows are one and the same: the law holds for them as for any other."""

    rows = [(7, "the same text", 13, "en")] * 4000 + [(100 + i, f"other text {i}", 12, "de") for i in range(998)]
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string"), 40).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for row in got:
        size[row.shard] += row.size
        slots[row.shard].append(row.slot)
    mean = sum(size.values()) / 40
    assert len(got) == 4998 and set(size) == set(range(40))
    assert max(size.values()) <= 1.1 * mean and min(size.values()) >= 0.9 * mean
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def plain_tree(points, sizes, count, limit):
    """Shard of every point: split along the widest dimension at the code nearest to the weighted quantile."""

    shard = [0] * len(points)

    def split(members, first, k):
        if k == 1 or not members:
            for i in members:
                shard[i] = first
            return
        extents = [max(points[i][d] for i in members) - min(points[i][d] for i in members) for d in range(len(points[0]))]
        widest = extents.index(max(extents))
        weights = collections.Counter()
        for i in members:
            weights[points[i][widest]] += sizes[i]
        target, below = sum(weights.values()) * (k // 2) / k, 0.0
        for code in sorted(weights):
            if below + weights[code] >= target:
                break
            below += weights[code]
        assert weights[code] <= limit  # no cut inside a code here
        edge = code + (target - below > weights[code] / 2)
        split([i for i in members if points[i][widest] < edge], first, k // 2)
        split([i for i in members if points[i][widest] >= edge], first + k // 2, k - k // 2)

    split(list(range(len(points))), 0, count)
    return shard


@pytest.mark.parametrize("count", [2, 5, 8])
def test_shards_match_a_plain_tree(spark, count):
    rng = random.Random(count)
    rows = [(i, "x" * rng.randrange(40), int(2 ** rng.uniform(0, 20)), int(2 ** rng.uniform(0, 12))) for i in range(600)]
    sizes = [len(text) + 16 for _, text, *_ in rows]
    columns = []
    for d in (2, 3):
        values = [math.log2(1 + row[d]) for row in rows]
        low, high = min(values), max(values)
        columns.append([math.floor((v - low) * ((shards.LEVELS - 1) / (high - low))) for v in values])
    want = plain_tree(list(zip(*columns)), sizes, count, sum(sizes) / count)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, other long")
    got = shards.kd_shards(docs, count, dimensions=("n_chars", "other"), tolerance=1.0)
    assert {row.doc_id: row.shard for row in got.collect()} == dict(enumerate(want))


# Empty tables


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert quality.quality_rules(no_docs, labels).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs, ["doc_id", "text"]).count() == 0
    assert substrings.cut_repeats(no_docs).count() == 0
    assert decontaminate.find_contamination(no_docs, benchmark).count() == 0
    assert languages.identify(no_docs).count() == 0
    assert kneser_ney.score_documents(no_docs).count() == 0
    assert shards.kd_shards(no_docs, 40).count() == 0
