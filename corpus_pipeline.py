"""A corpus pipeline over ``documents``: quality rules, near-duplicates, repeated passages, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import bpe, decontaminate, near_copies, quality, substrings
from premia.llm.frames import pick, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OPTIONAL = {"lang": "string", "source": "string", "n_chars": "bigint"}


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, *COLUMNS, optional=OPTIONAL)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rejected ones go. NULL and empty texts have too few words and go."""

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(_documents(docs), labels, COLUMNS).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (Jaccard similarity of 5-word shingles of 0.8 or more): that with
    the smallest id; ids that are NULL come last."""

    return near_copies.keep_one(_documents(docs), COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 or more words that occur again. Untouched documents keep their exact text; of
    the others the words that stay are joined by single spaces and n_chars is counted anew. A document that loses all its words goes."""

    cut = substrings.cut_repeats(_documents(docs), COLUMNS)
    touched = F.col("n_removed") > 0
    left = cut.where(~touched | (F.col("n_removed") < F.col("n_words")))
    return left.select(
        "doc_id", F.when(touched, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(touched, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; the others go whole."""

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(_documents(docs), benchmark, COLUMNS).where("n_hit = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (the whole text's tokens), n_tokens, and digests of the ids and of the bytes they decode to."""

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(_documents(docs), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", keep_one_of_each),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokens),
]

#: Stages 1, 2 and 5 (hashed features, hashed shingles, BPE merges) have no SQL form; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again by the next."""

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage{number}")
    return docs
