"""Near copies: SimHash classes first, checked by the exact Jaccard similarity of 5-word shingles, then what SimHash cannot see.

Every text has op8's fingerprint; fingerprints are linked by op8's index of positional bytes (``simhash.links``), and each member of a
class they form is compared exactly with the class's leader. Two bits of SimHash reach a part of the texts with a similarity of 0.8 only,
and a class may hold texts that are less similar: members that its leader does not take, and texts in no class, are searched for further, by longer signatures
in a byte-position index with count filtering. A text's signature has 128 bytes; each is drawn from the least of its shingles under a hash of its own, so that two texts agree at a
place with the probability of their similarity (and by chance one time in 256). Texts are listed under each four bytes in a row of the first 64: of two with a
similarity of 0.8, less than one pair in four thousand has none of 16 such pieces in common, and with 0.9 one in two million. Bytes
that agree are tallied, pairs with fewer than ``SHARED`` go (a pair of 0.8 has 102 on average, with a deviation of 4.5), and the sets of
the others are compared exactly.

Texts with equal sets are one node, represented by one row. What SimHash joined is one component from the start. In a first round (or more) a list links the members outside its leader's component
to that leader, another one each round; a member is compared with the leader most like it. Lists that then still hold several components are
crowds, mostly of texts that share a passage. Their texts are indexed once more, by whole shingles: in one order of all shingles, rare ones
first, two sets with a similarity of 0.8 share one among the first fifth of each, at places that leave room for enough others. This
misses no pair of a crowd and drops those that only share the passage. A component's inside is never compared, so a large group of
near copies costs about a comparison a member and round. Texts stay where they are: signatures, shingles of crowds and ids move, then the sets
of rows in pairs, and at the end each text that stays, once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm import simhash
from premia.llm.components import components
from premia.llm.frames import pick, stored, text_key
from premia.llm.words import CHAIN, find_words, hash_spans, hash_windows, lowered, mixed, not_space, pieces, run_sums, window_starts

SHINGLE = 5  # words
PLACES = 128  # bytes of a signature
LISTED = 64  # of them, in pieces of four
SHARED = 86  # places that a pair must have in common
ROUNDS = 1
BITS = 18  # of the table of shingle counts
SLOTS = 1 << 22  # of the filter by which rows in pairs are found


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by document and hash, their documents, and the place of each document's first; one more entry.

    Words are runs without ASCII spaces, A-Z as a-z. A text of fewer words is one shingle.
    """

    n_docs = len(offsets) - 1
    words = find_words(lowered(data), offsets, not_space())
    hashes = hash_spans(lowered(data), words.starts, words.ends)
    at = np.flatnonzero(window_starts(words, SHINGLE))
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < SHINGLE))
    whole = run_sums(hashes, CHAIN, words.first[short], words.first[short + 1])
    whole = mixed(whole + words.per_doc[short].astype(np.uint64))
    found = np.concatenate([hash_windows(hashes, SHINGLE)[at], whole])
    doc = np.concatenate([words.doc[at], short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    found, doc = found[fresh], doc[fresh]
    first = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=n_docs), out=first[1:])
    return found, doc, first


def _prints(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each document's set; that of the empty set is 0."""

    total = np.zeros(len(found) + 1, dtype=np.uint64)
    np.cumsum(mixed(found + np.uint64(SHINGLE)), out=total[1:])
    n = np.diff(first)
    out = mixed(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out.view(np.int64)


def _signatures(found: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each document's signature as eight longs; those of empty sets are zeros."""

    n_docs = len(first) - 1
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((n_docs, PLACES), dtype=np.uint8)
    if len(some):
        for place in range(PLACES):
            factor = mixed(np.array([place + 1], dtype=np.uint64)) | np.uint64(1)
            least = np.minimum.reduceat(found * factor, first[some])
            out[some, place] = mixed(least).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1) * (PLACES // 8), pa.int32()), pa.array(out.reshape(-1).view("<i8")))


def _marker(carry: Sequence[str], schema: pa.Schema):
    def mark(batches):
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column("text")):
                found, _, first = _shingles(data, offsets)
                rows = batch.slice(start, end - start)
                raw = data.tobytes()
                sims = [simhash.fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [rows.column(name) for name in carry] + [pa.array(_prints(found, first)), pa.array(sims, pa.int64())]
                columns += [pa.array(np.diff(first)), _signatures(found, first).cast(schema.field("signature").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return mark


def _wanted_pieces(batches, wanted):
    """(keys, shingles, documents, first) of the rows whose slot is wanted."""

    for batch in batches:
        keys = batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
        rows = batch.filter(pa.array(wanted.value[(keys % np.uint64(SLOTS)).astype(np.int64)]))
        for start, end, data, offsets in pieces(rows.column("text")):
            yield rows.column("row").slice(start, end - start), *_shingles(data, offsets)


def _lister(wanted):
    """The sets, by halves of the hashes."""

    def lists(batches):
        for keys, found, doc, _ in _wanted_pieces(batches, wanted):
            sets = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (found >> np.uint64(32)))
            first = np.searchsorted(sets, np.arange(len(keys) + 1, dtype=np.uint64) << np.uint64(32))
            values = pa.array(sets.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)], names=["row", "shingles"])

    return lists


def _counter(wanted):
    """Shingles by the upper bits of their hash."""

    def count(batches):
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for _, found, _, _ in _wanted_pieces(batches, wanted):
            counts += np.bincount((found >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        for i in range(0, len(seen), 50_000):
            at = seen[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": counts[at]})

    return count


def _indexer(wanted, ranks):
    """The first fifth of each set: shingles of rare buckets first."""

    def index(batches):
        for keys, found, doc, first in _wanted_pieces(batches, wanted):
            order = np.lexsort((found, ranks.value[(found >> np.uint64(64 - BITS)).astype(np.int64)], doc))
            n = np.diff(first)[doc]
            place = np.arange(len(doc)) - first[doc]
            at = np.flatnonzero(place <= n - (4 * n + 4) // 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[order][at].view(np.int64)), keys.take(pa.array(doc[at])), pa.array(n[at].astype(np.int32)), pa.array(place[at].astype(np.int32))],
                names=["shingle", "row", "n", "place"],
            )

    return index


def _slots(rows: DataFrame):
    """A filter, of fixed size, of the column ``row``; rows that share a slot pass as well."""

    slots = rows.select(F.pmod("row", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()  # at most SLOTS
    marks = np.zeros(SLOTS, dtype=bool)
    marks[slots.column("slot").to_numpy()] = True
    return rows.sparkSession.sparkContext.broadcast(marks)


def _tally(a: str, b: str) -> Column:
    """Places at which two signatures agree: bytes of their exclusive or that are zero."""

    low = F.lit(0x7F7F7F7F).cast("long")

    def zeros(x: Column, y: Column) -> Column:
        odd = x.bitwiseXOR(y)
        halves = (odd.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(odd, 32))
        return sum(32 - F.bit_count((half.bitwiseAND(low) + low).bitwiseOR(half).bitwiseOR(low)) for half in halves)

    return F.aggregate(F.zip_with(a, b, zeros), F.lit(0), lambda x, y: x + y)


def _may(a: str, b: str) -> Column:
    """Can the two sets (columns n_ and s_ of each) be similar, by their sizes and signatures?"""

    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (_tally(f"s_{a}", f"s_{b}") >= SHARED)


def _near(pairs: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is 0.8 or more: 9 |A and B| >= 4 (|A| + |B|)."""

    rows = nodes.select("print", "row")
    wanted = _slots(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct().join(rows, "print"))
    sets = keyed.select("row", "text").mapInArrow(_lister(wanted), "row long, shingles array<int>")
    sets = sets.join(rows, "row").dropDuplicates(["row"])
    left = sets.select(F.col("print").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("print").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = 9 * both >= 4 * (F.size("of_a") + F.size("of_b"))
    return pairs.join(right, "b").join(left, "a").where(similar).select("a", "b")


def _posted(crowd: DataFrame, keyed: DataFrame) -> DataFrame:
    """(shingle, print, n, place) of the first fifth of the sets of a crowd's texts (print, row), without shingles of one text alone."""

    wanted = _slots(crowd)
    texts = keyed.select("row", "text")
    sums = texts.mapInArrow(_counter(wanted), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(1 << BITS)  # at most 2^BITS rows
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    ranks = crowd.sparkSession.sparkContext.broadcast((4 * np.log2(counts)).astype(np.uint8))
    posted = texts.mapInArrow(_indexer(wanted, ranks), "shingle long, row long, n int, place int").join(crowd.select("row", "print"), "row")
    posted = stored(posted.groupBy("shingle", "print").agg(F.min("n").alias("n"), F.min("place").alias("place")), "posted")
    return stored(posted.join(posted.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1").select("shingle"), "shingle"), "shared")


def _fits(a: str, b: str) -> Column:
    """Can sets that share a shingle at these places be similar, if it is the first they share?"""

    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (9 * most >= 4 * (n_a + n_b)) & (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b))


def _measured(nodes: DataFrame, side: str) -> DataFrame:
    """Each print, named ``side``, with its set's size and signature."""

    return nodes.select(F.col("print").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))


def simhash_links(keyed: DataFrame, nodes: DataFrame, sims: DataFrame) -> DataFrame:
    """Links (a, b) between prints by op8's method: leaders of its classes of fingerprints with those members that are similar.

    ``sims`` (print, sim): the fingerprints of each print's texts. A class's inside is not compared otherwise.
    """

    roots = components(simhash.links(sims.select(F.col("sim").alias("print")).distinct())).withColumnRenamed("node", "sim")
    members = sims.join(roots, "sim", "left").select("print", F.coalesce("root", "sim").alias("class")).distinct()
    members = stored(members, "members")
    lead = members.groupBy("class").agg(F.min_by("print", F.xxhash64("print")).alias("a"), F.count("*").alias("many"))
    pairs = members.join(lead.where("many > 1"), "class").where("print <> a").select("a", F.col("print").alias("b")).distinct()
    pairs = pairs.join(_measured(nodes, "b"), "b").join(_measured(nodes, "a"), "a").where(_may("a", "b")).select("a", "b")
    return stored(_near(stored(pairs, "pairs"), keyed, nodes), "near")


def links(keyed: DataFrame, nodes: DataFrame, sims: DataFrame) -> DataFrame:
    """Links (a, b) between prints: their components are those of all pairs met with a similarity of 0.8 or more."""

    parts = [
        F.struct(F.lit(2 * i + half).alias("band"), F.shiftrightunsigned(F.element_at("signature", i + 1), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)).alias("piece"))
        for i in range(LISTED // 8)
        for half in (0, 1)
    ]
    index = nodes.where("n > 0").select("print", F.inline(F.array(*parts)))
    lists = index.groupBy("band", "piece").agg(F.count("*").alias("many")).where("many > 1")
    met = stored(index.join(lists.drop("many"), ["band", "piece"]), "met")
    a, b = _measured(nodes, "a"), _measured(nodes, "b")

    def best(pairs: DataFrame) -> DataFrame:
        """Each member's leader that is most like it."""

        pairs = pairs.distinct().join(b, "b").join(a, "a").where(_may("a", "b")).select("a", "b", _tally("s_a", "s_b").alias("tally"))
        return pairs.groupBy("b").agg(F.max(F.struct("tally", "a")).alias("best")).select("best.a", "b")

    def near(pairs: DataFrame) -> DataFrame:
        return stored(_near(stored(pairs, "pairs"), keyed, nodes), "near")

    def rooted(rows: DataFrame) -> DataFrame:
        return stored(rows.join(stars, "print", "left").withColumn("root", F.coalesce("root", "print")).select(*rows.columns, "root"), "rooted")

    linked = simhash_links(keyed, nodes, sims)
    stars = components(linked).withColumnRenamed("node", "print")
    listed = rooted(met)
    for number in range(ROUNDS):
        lead = F.min(F.struct(F.xxhash64("print", F.lit(number)), F.struct("print", "root").alias("member"))).alias("lead")
        lead = listed.groupBy("band", "piece").agg(lead, F.min("root").alias("low"), F.max("root").alias("high"))
        led = listed.join(lead.where("low <> high").select("band", "piece", "lead.member"), ["band", "piece"]).where("root <> member.root")
        found = near(best(led.select(F.col("member.print").alias("a"), F.col("print").alias("b"))))
        linked = linked.unionAll(found)
        stars = components(linked).withColumnRenamed("node", "print")
        listed = rooted(met)

    several = listed.groupBy("band", "piece").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    crowd = listed.join(several, ["band", "piece"], "left_semi").select("print").distinct()
    posted = _posted(stored(crowd.join(nodes.select("print", "row"), "print"), "crowd"), keyed)
    lead = posted.groupBy("shingle").agg(F.min(F.struct("place", "n", "print")).alias("lead"))
    led = rooted(posted).alias("x").join(lead, "shingle").where((F.col("x.print") != F.col("lead.print")) & _fits("x", "lead"))
    linked = linked.unionAll(near(best(led.select(F.col("lead.print").alias("a"), F.col("x.print").alias("b")))))
    stars = components(linked).withColumnRenamed("node", "print")

    listed = rooted(posted)
    several = listed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    listed = stored(listed.join(several.select("shingle"), "shingle"), "several")
    x, y = listed.alias("x"), listed.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.print") < F.col("y.print"))
    rest = x.join(y, apart & _fits("x", "y")).select(F.col("x.print").alias("a"), F.col("y.print").alias("b")).distinct()
    rest = rest.join(b, "b").join(a, "a").where(_may("a", "b")).select("a", "b")
    return linked.unionAll(near(rest))


def keep_one(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` (doc_id and text among them) of one document of each component of near copies: that with the smallest id.

    NULL ids come last; of rows with the same id the one with the smallest text hash stays, of equal rows one. Texts
    without words are copies of each other.
    """

    keyed = pick(docs, *columns).withColumns(dict(zip(("key_a", "key_b"), text_key())))
    keyed = keyed.withColumn("row", F.xxhash64("doc_id", "key_a", "key_b"))
    carry = ("doc_id", "key_a", "key_b", "row")
    shape = T.StructType([*[keyed.schema[name] for name in carry], T.StructField("print", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("n", T.LongType()), T.StructField("signature", T.ArrayType(T.LongType()))])
    marked = keyed.select("text", *carry).mapInArrow(_marker(carry, to_arrow_schema(shape)), shape)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), *carry)
    marked = marked.groupBy("print", "sim").agg(F.min(order).alias("first"), F.first(F.struct("n", "signature")).alias("same"))
    sims = stored(marked, "marked")
    nodes = sims.groupBy("print").agg(F.min("first").alias("first"), F.first("same").alias("same"))
    nodes = stored(nodes.select("print", "first", "first.row", "same.*"), "nodes")
    stars = components(links(keyed, nodes, sims.select("print", "sim"))).withColumnRenamed("node", "print")
    kept = nodes.select("print", "first").join(stars, "print", "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select("first.row", *[F.col(f"first.{name}").alias(f"keep_{name}") for name in carry[:3]])
    same = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("key_a") == F.col("keep_key_a")) & (F.col("key_b") == F.col("keep_key_b"))
    return keyed.join(kept, "row").where(same).dropDuplicates(["row", "doc_id", "key_a", "key_b"]).select(*columns)
