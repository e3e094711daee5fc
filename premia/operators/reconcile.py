"""Reconciliation of published tables, files and texts with recomputed ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.operators.paths import keyed
from premia.operators.policy import exact_cover

# Path rules of the published manifest.
OUTPUT_FILE = "paper/paper.pdf"
ASSET_FOLDERS = ("paper/figures/", "paper/tables/")
EVIDENCE_FOLDER = "paper/evidence/"
TEST_FOLDER = "tests/"
SOURCE_SUFFIXES = ("py", "tex", "bib")
# Column names that would reveal row-level data.
BANNED_COLUMNS = (
    "ask", "asset_id", "bid", "contract_id", "expiration", "expiry", "option_id", "option_symbol",
    "order_id", "quote_time", "strike", "symbol", "timestamp", "trade_id", "underlying_symbol",
)


def role_of(path: Column) -> Column:
    asset = path.startswith(ASSET_FOLDERS[0]) | path.startswith(ASSET_FOLDERS[1])
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return (
        F.when(path == OUTPUT_FILE, "output")
        .when(asset, "frozen-asset")
        .when(path.startswith(EVIDENCE_FOLDER), "evidence")
        .when(path.startswith(TEST_FOLDER), "test")
        .when(suffix.isin(*SOURCE_SUFFIXES), "source")
        .otherwise("documentation")
    )


def producer_of(path: Column) -> Column:
    asset = path.startswith(ASSET_FOLDERS[0]) | path.startswith(ASSET_FOLDERS[1])
    return (
        F.when(path.startswith(EVIDENCE_FOLDER), "analysis.pipeline")
        .when(path == OUTPUT_FILE, "lualatex+bibtex")
        .when(asset, "historical-derived-asset")
        .otherwise("maintained-source")
    )


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder as (path relative to it, content).

    The scan skips empty files, so those are added from the scan's own file listing.
    """

    root = folder.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    relative = F.substring_index("path", root, -1).alias("path")
    filled = files.select(relative, "content")
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "path string").select(relative)
    empty = listed.join(filled.select("path"), "path", "left_anti")
    return filled.unionByName(empty.withColumn("content", F.lit("").cast("binary")))


def file_manifest(files: DataFrame) -> DataFrame:
    """Role, producer, size and SHA-256 of every file row (path, content)."""

    path = F.col("path")
    content = F.col("content").cast("binary")
    return files.select(
        path,
        role_of(path).alias("role"),
        producer_of(path).alias("producer"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(content, 256).alias("sha256"),
    )


def unsafe_path(path: Column) -> Column:
    """Absolute, empty, or with empty, ``.`` or ``..`` parts."""

    return (path == "") | path.rlike(r"(^|/)(\.{0,2})(/|$)") | path.contains("\\")


def manifest_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per problem of a manifest against the actual files."""

    copies = manifest.groupBy("path").agg(F.count("*").alias("_copies"))
    duplicates = copies.where("_copies > 1").select("path", F.lit("duplicate_path").alias("problem"))
    facts = actual.select(
        "path", *[F.col(name).alias(f"_{name}") for name in ("role", "producer", "bytes", "sha256")]
    )
    joined = manifest.join(facts, "path", "left")
    unsafe, absent = unsafe_path(F.col("path")), F.col("_sha256").isNull()

    def differs(name: str) -> Column:
        return F.when(~unsafe & ~absent & (F.col(name) != F.col(f"_{name}")), f"{name}_differs")

    found = F.array(
        F.when(unsafe, "unsafe_path"),
        F.when(~unsafe & absent, "missing_file"),
        *[differs(name) for name in ("role", "producer", "bytes", "sha256")],
    )
    rows = joined.select("path", F.explode(F.array_compact(found)).alias("problem"))
    unlisted = actual.join(manifest, "path", "left_anti").select(
        "path", F.lit("unlisted_file").alias("problem")
    )
    return rows.unionByName(duplicates).unionByName(unlisted).distinct()


def inventory_diff(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the inventory missing from the manifest, and unexpected manifest rows."""

    return exact_cover(inventory, manifest, ["path"])


def hash_membership(frozen: DataFrame, actual: DataFrame, provenance: DataFrame) -> DataFrame:
    """Whether frozen files keep their hash and whether that hash has provenance."""

    known = provenance.select(F.col("sha256").alias("expected")).distinct().withColumn("_known", F.lit(True))
    joined = frozen.join(actual.select("path", "sha256"), "path", "left").join(known, "expected", "left")
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256") == F.col("expected"), "same")
        .otherwise("differs")
    )
    return joined.select("path", status.alias("status"), F.coalesce("_known", F.lit(False)).alias("in_provenance"))


def banned_columns(columns: DataFrame, deny: Sequence[str] = BANNED_COLUMNS) -> DataFrame:
    """Denied columns of a (table_name, column_name) catalog, compared trimmed and lower-cased."""

    name = F.lower(F.trim("column_name"))
    return columns.select("table_name", name.alias("column_name")).where(name.isin(*deny)).distinct()


def domain_closure(
    df: DataFrame, keys: Sequence[str], column: str, expected: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Per group: expected values missing, unexpected values, row count, and closure."""

    per_value = keyed(df, keys).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    listed = F.col(column).isin(*expected)
    sums = per_value.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        (F.lit(len(expected)) - F.count_if(listed)).alias("missing_values"),
        F.count_if(~F.coalesce(listed, F.lit(False))).alias("unexpected_values"),
    )
    closed = (F.col("missing_values") == 0) & (F.col("unexpected_values") == 0)
    return sums.withColumn("closed", closed if rows is None else closed & (F.col("rows") == rows))


def label_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Whole-value replacement in every string column."""

    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.replace(dict(names), subset=text)


def summary_differences(
    observed: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    rtol: float = 1e-12,
    atol: float = 1e-12,
) -> DataFrame:
    """Cells that differ beyond atol + rtol x expected; NULL equals NULL only."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"_has_{name}"), F.struct(
            *[F.col(c).cast("double").alias(c) for c in columns]
        ).alias(f"_{name}"))

    joined = cells(observed, "a").join(cells(expected, "b"), list(keys), "full_outer")
    listed = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_a.{c}").alias("observed"),
                F.col(f"_b.{c}").alias("expected"),
            )
            for c in columns
        ]
    )
    a, b = F.col("observed"), F.col("expected")
    same = F.coalesce(F.abs(a - b) <= F.abs(b) * rtol + atol, a.isNull() & b.isNull())
    return joined.select(*keys, F.inline(listed)).where(~same)


def identity_failures(table: DataFrame, keys: Sequence[str], periods: float = 12.0) -> DataFrame:
    """One row per failed identity of a performance table."""

    years = F.try_divide(F.lit(float(periods)), F.col("observations").cast("double"))
    from_wealth = F.when(F.col("defaulted"), -1.0).otherwise(F.pow("terminal_wealth", years) - 1.0)
    product = F.col("sharpe") * F.col("annualized_volatility")
    failed = F.array(
        F.when(F.abs(F.col("cagr") - from_wealth) > F.abs(from_wealth) * 1e-5 + 1e-14, "cagr_from_wealth"),
        F.when(
            F.abs(F.col("annualized_mean_return") - product) > F.abs(product) * 1e-5 + 1e-8,
            "mean_is_sharpe_times_volatility",
        ),
        F.when(F.col("defaulted") & F.col("sharpe").isNotNull(), "defaulted_has_sharpe"),
        F.when(F.col("defaulted") & (F.col("terminal_wealth") != 0.0), "defaulted_has_wealth"),
    )
    return table.select(*keys, F.explode(F.array_compact(failed)).alias("failed_check"))


def share_failures(table: DataFrame, keys: Sequence[str], share: str, part: str, rest: str) -> DataFrame:
    """One row per group whose share is not part / (part + rest); a share of nothing fails too."""

    whole = F.try_divide(F.col(part).cast("double"), (F.col(part) + F.col(rest)).cast("double"))
    right = F.coalesce(F.abs(F.col(share) - whole) <= F.abs(whole) * 1e-5 + 1e-8, F.lit(False))
    return table.where(~right).select(*keys, F.lit(f"{share}_is_part_of_whole").alias("failed_check"))


def rendered(df: DataFrame, keys: Sequence[str], template: str, columns: Sequence[str]) -> DataFrame:
    """Report lines with fixed decimals."""

    return df.select(*keys, F.format_string(template, *[F.col(c) for c in columns]).alias("line"))


def report_rows(lines: DataFrame, published: DataFrame) -> DataFrame:
    """Whether each rendered line occurs in a published text (one trimmed line per row)."""

    text = published.select(F.trim("value").alias("line")).distinct().withColumn("_seen", F.lit(True))
    return lines.withColumn("line", F.trim("line")).join(text, "line", "left").withColumn(
        "published", F.coalesce("_seen", F.lit(False))
    ).drop("_seen")


def required_text(claims: DataFrame, keys: Sequence[str], text: str, phrase: str) -> DataFrame:
    """Whether any text of a group contains a phrase."""

    return keyed(claims, keys).groupBy(*keys).agg(F.bool_or(F.col(text).contains(phrase)).alias("stated"))


def json_key_audit(documents: DataFrame, keys: Sequence[str], text: str, banned: str) -> DataFrame:
    """Occurrences of a key at any depth of JSON texts (quotes inside strings are escaped)."""

    hits = F.regexp_count(F.col(text), F.lit(rf'(?<!\\)"\Q{banned}\E"\s*:'))
    return keyed(documents, keys).groupBy(*keys).agg(
        F.count("*").alias("documents"),
        F.count_if(hits > 0).alias("documents_with_key"),
        F.sum(hits).alias("occurrences"),
    )


def append_ledger(ledger: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch that may be appended: keys the ledger already has never change."""

    return batch.join(ledger.select(*keys), list(keys), "left_anti")
