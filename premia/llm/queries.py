"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import bpe, conversations, decontaminate, frames, kneser_ney, languages, quality, ranked_search, shards, simhash, substrings
from premia.llm import token_files, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark, folder):
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_quality_rules")
def op3(spark, folder):
    return quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_simhash")
def op8(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark, folder):
    cut = substrings.cut_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


RANKS = "byte_bpe_50k.tiktoken"


@query("op10_byte_bpe")
def op10(spark, folder):
    import public_tokenizers

    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_kd_sharding")
def op2(spark, folder):
    placed = shards.kd_shards(table(spark, folder, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


RULES = """
('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
('com', '/de/', 'block')
"""

OP4_SQL = rf"""
WITH rules(rh, rp, verdict) AS (VALUES {RULES}),
p AS (SELECT row_number() OVER () AS k, page_id,
             coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages),
best AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (k)
"""


@query("op4_url_filters", OP4_SQL)
def op4(spark, folder):
    rules = spark.sql(f"SELECT * FROM VALUES {RULES} AS rules(host, path, verdict)")
    return urls.filter_urls(table(spark, folder, "pages"), rules)


BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1), 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)
OP5_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS chief FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM chief THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM chief THEN chief END AS refers_to
FROM g
"""


@query("op5_warc", OP5_SQL)
def op5(spark, folder):
    captures = warc.archive(table(spark, folder, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_kneser_ney")
def op6(spark, folder):
    scored = kneser_ney.score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_language_id")
def op9(spark, folder):
    return languages.identify(table(spark, folder, "documents"))


#: Reflected CRC-32 of a short text, a byte and then eight shifts at a time.
CRC = """
xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length({0}) + 1),
    lambda i: [CAST(ascii(substr({0}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)
"""

OP11_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format("key")} % 20 AS hit
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
damaged AS (
  SELECT c, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged),
t AS (
  SELECT c, turn, role, text, i, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM numbered),
gap(f, g, p, e) AS (VALUES ('S','S',0,''), ('P','P',0,''), ('A','A',0,''), ('E','E',0,''), ('S','A',3,'I'), ('P','A',3,'I'), ('E','A',3,'I'),
  ('A','E',3,'I'), ('S','E',6,'II'), ('P','E',6,'II'), ('E','E',6,'II'), ('A','A',6,'II')),
edit(x, f, g, p, e) AS (VALUES ('s','S','P',0,'K'), ('u','S','A',0,'K'), ('u','P','A',0,'K'), ('u','E','A',0,'K'), ('a','A','E',0,'K'),
  ('*','S','A',3,'R'), ('*','P','A',3,'R'), ('*','E','A',3,'R'), ('*','A','E',3,'R'),
  ('*','S','S',4,'D'), ('*','P','P',4,'D'), ('*','A','A',4,'D'), ('*','E','E',4,'D')),
walk AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 'S' AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM t
  UNION ALL
  SELECT w.c, w.i + 1, edit.g,
         min({{'cost': w.best.cost + gap.p + edit.p + CASE WHEN edit.e <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END,
              'audit': w.best.audit || gap.e || edit.e}})
  FROM walk w JOIN t ON t.c = w.c AND t.i = w.i + 1 JOIN gap ON gap.f = w.state
       JOIN edit ON edit.f = gap.g AND (edit.x = '*' OR edit.x = t.x) AND (edit.e = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.c, w.i, edit.g),
sizes AS (SELECT c, max(i) AS n FROM t GROUP BY c),
best AS (
  SELECT w.c, min({{'cost': w.best.cost + gap.p, 'audit': w.best.audit || gap.e}}) AS best
  FROM walk w JOIN sizes z ON z.c = w.c AND z.n = w.i JOIN gap ON gap.f = w.state AND gap.g IN ('S', 'E') GROUP BY w.c),
step AS (
  SELECT c, p, e, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY p) AS i,
         sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY p) AS j
  FROM (SELECT c, p, substr(audit, CAST(p AS BIGINT), 1) AS e FROM (SELECT c, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM best))),
system AS (SELECT DISTINCT step.c FROM step JOIN t USING (c, i) WHERE e = 'K' AND j = 1 AND x = 's'),
repaired AS (
  SELECT step.c, string_agg(CASE WHEN e = 'K' THEN role WHEN (j + CASE WHEN system.c IS NULL THEN 0 ELSE 1 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM step LEFT JOIN t ON t.c = step.c AND t.i = step.i AND e <> 'I' LEFT JOIN system ON system.c = step.c WHERE e <> 'D' GROUP BY step.c),
facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY c)
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM src) s LEFT JOIN facts USING (c) LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Turns dropped, emptied, robbed of their ends, repeated or given to the user, by a checksum of conversation and turn."""

    rows = frames.pick(rows, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")))
    hit = F.crc32(key.cast("binary")) % 20
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


@query("op11_conversation_repair", OP11_SQL)
def op11(spark, folder):
    rows = table(spark, folder, "conversations")
    found = conversations.summarize(conversations.repair(damaged(rows))).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


@query("op12_token_files")
def op12(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents")
    written = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read(spark, written, docs.schema["doc_id"].dataType))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce({LOWER.format("text")}, ''), '{TERM}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(coalesce({LOWER.format("text")}, ''), '{TERM}')) AS w FROM benchmark),
bt AS (SELECT q, item_id, unnest(w) AS term FROM b),
t AS (SELECT k, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM bt) GROUP BY 1, 2),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM t, g GROUP BY term, nn),
m AS (SELECT k, doc_id, 100 - 90 + ((90 * CAST(len(w) AS BIGINT) * nn) // ll) AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q, item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM bt JOIN t USING (term) JOIN f USING (term) JOIN m USING (k) GROUP BY q, item_id, k, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark, folder):
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
