"""URL filters as a sort-merge range join; DataFrame functions only.

A host is written with its labels reversed, so that a domain and all its subdomains share a prefix. A url
probes the rules of its own host and of each domain above it (no more of them than the longest rule host has labels).
Among the rules of one domain a path prefix p is the interval [p, p + 0xFF) of path bytes, and such
intervals are nested or apart. Probes, interval starts and interval ends are sorted together and swept: the
running sum of starts less ends is the height of the stack of open intervals, and the innermost open rule is
the last one pushed at the present height. The longest rule over all probes of a url wins.

Sweeps run per (domain, salt): urls are salted by their hash, the rules of a domain are repeated for each
salt, so a domain that holds most urls is spread over ``spark.sql.shuffle.partitions`` sweeps. Equal rows are
counted before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.frames import pick, width

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"  # host and path after the first ://


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; '' if the url is NULL or has no ://."""

    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, or NULL) and verdict of every page.

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and all subdomains if the url's path
    starts with its path; the longest rule (characters of host and path; of equal ones that with the longer host) wins, and pages that no rule fits get
    ``default``. Of rules with the same host and path a block wins. Rules with a NULL are ignored; without rules every page
    gets the default. A NULL url, or one without ://, has an empty host and path. Repeated rows are judged alike and all
    returned. Other columns are dropped.
    """

    spark = pages.sparkSession
    salts = width(spark)
    given = pick(rules, "host", "path", "verdict").dropna()
    given = given.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict")
    # 'block' is the greater of the two words.
    given = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    deepest = given.agg(F.max(F.size(_labels(F.col("host"))))).first()[0] or 1  # one number

    parts = (
        pick(pages, "page_id", "url")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .groupBy("page_id", "host", "path")
        .agg(F.count("*").alias("copies"))
        .withColumn("labels", F.slice(_labels(F.col("host")), 1, deepest))
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    )
    none = F.lit(None)
    probes = parts.select(
        F.array_join(F.slice("labels", F.lit(1), F.col("depth")), ".").alias("domain"),
        F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int").alias("salt"),
        F.col("path").cast("binary").alias("key"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("step"),
        none.cast("string").alias("rule"),
        none.cast("int").alias("rule_host"),
        none.cast("string").alias("verdict"),
        "page_id", "host", "copies",
    )
    ends = given.select(
        F.array_join(_labels(F.col("host")), ".").alias("domain"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host"),
        "verdict",
        F.explode(F.array(
            F.struct(F.col("path").cast("binary").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
            F.struct(F.concat(F.col("path").cast("binary"), F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
        )).alias("edge"),
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    edges = ends.select(
        "domain", "salt", "edge.key", "edge.kind", "edge.step", "rule", "rule_host", "verdict",
        none.cast(probes.schema["page_id"].dataType).alias("page_id"), none.cast("string").alias("host"), none.cast("long").alias("copies"),
    )
    sweep = Window.partitionBy("domain", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("domain", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pushed = F.when(F.col("kind") == 0, F.struct(F.length("rule").alias("size"), "rule_host", "rule", "verdict"))
    swept = (
        probes.unionByName(edges)
        .withColumn("height", F.sum("step").over(sweep))
        .withColumn("open", F.last(pushed, ignorenulls=True).over(level))
        .where("kind = 1")
    )
    best = swept.groupBy("page_id", "host", "key").agg(F.max("open").alias("best"), F.first("copies").alias("copies"))
    return best.select(
        "page_id",
        "host",
        F.col("key").cast("string").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
