"""Queries on sources, sinks and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.operators import paths, reconcile as ops
from premia.plans.inputs import load, view
from premia.plans.registry import VIEWS, oracle, query
from premia.session import scratch_folder, written
from premia.sources import tables as io

GROUP = ["config", "strategy"]


@query(
    "scan_parquet",
    """SELECT l_returnflag, count(*) AS rows, round(sum(l_quantity) + 1e-11::DOUBLE, 3) + 0.0e0 AS quantity FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""",
    quantity=3,
)
def scan_parquet(t):
    rows = io.read_parquet(
        t.spark, f"{t.folder}/lineitem.parquet", ["l_returnflag", "l_quantity"],
        "l_shipdate", "1997-01-01", "1998-01-01",
    )
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


LEDGER = T.StructType(
    [
        T.StructField("config", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("return_date", T.DateType()),
        T.StructField("net_return", T.DoubleType()),
        T.StructField("gross_nav", T.DoubleType()),
        T.StructField("integer_repair_failed", T.BooleanType()),
    ]
)
LEDGER_SQL = oracle(
    "fx_returns", "SELECT * FROM fx_returns", "config strategy return_date integer_repair_failed", "net_return gross_nav"
)


def ledger_csv(t) -> str:
    """Write the ledger as CSV to the shared folder; returns its path."""

    path = scratch_folder(t.spark, "ledger")
    io.write_csv(load(t, "fx_returns").select(*LEDGER.names), path, ["config", "strategy", "return_date"])
    return path


@query("scan_csv", LEDGER_SQL)
def scan_csv(t):
    return io.read_csv(t.spark, ledger_csv(t), LEDGER)


@query(
    "sink_csv",
    oracle("path_table", "SELECT * FROM path_table", "config strategy defaulted",
           "annualized_mean_return annualized_volatility terminal_wealth", "n_obs"),
)
def sink_csv(t):
    table = paths.return_moments(load(t, "fx_returns"), GROUP).select(
        *GROUP, "n_obs", "annualized_mean_return", "annualized_volatility", "terminal_wealth", "defaulted"
    )
    path = scratch_folder(t.spark, "summary")
    io.write_csv(table, path, GROUP)
    return io.read_csv(t.spark, path, table.schema)


@query(
    "sink_json",
    oracle(
        "path_table",
        "SELECT config, strategy, sharpe, n_obs, 'config,n_obs,sharpe,strategy' AS key_order FROM path_table",
        "config strategy key_order", "sharpe", "n_obs",
    ),
)
def sink_json(t):
    table = paths.return_moments(load(t, "fx_returns"), GROUP).select("strategy", "sharpe", "n_obs", "config")
    path = scratch_folder(t.spark, "json")
    io.write_json(table, path)
    lines = t.spark.read.text(path)
    parsed = F.from_json("value", table.schema)
    order = F.array_join(F.json_object_keys("value"), ",")
    return lines.select(parsed.alias("row"), order.alias("key_order")).select("row.*", "key_order")


DOCUMENT = T.StructType(
    [
        T.StructField("symbol", T.LongType()),
        T.StructField(
            "headline",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("event_type", T.StringType()),
                        T.StructField("n", T.LongType()),
                        T.StructField("total", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


@query(
    "scan_json",
    "SELECT user_id AS symbol, event_type, count(*) AS n, round(sum(value) + 1e-11::DOUBLE, 6) + 0.0e0 AS total FROM events GROUP BY 1, 2",
)
def scan_json(t):
    per_type = t.events.groupBy(F.col("user_id").alias("symbol"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    # One record per event type of a symbol: the array has as many entries as there are types.
    documents = per_type.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("event_type", "n", "total"))).alias("headline")
    )
    path = scratch_folder(t.spark, "documents")
    io.write_json(documents, path)
    return io.opened(io.read_json(t.spark, path, DOCUMENT), ["symbol"], "headline")


REQUIRED = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_clerk"],
    "customer": ["c_custkey", "c_mktsegment"],
    "lineitem": ["l_partkey", "l_suppkey", "l_shipdate"],
    "events": ["event_id", "ts", "strike"],
    "part": ["p_partkey", "p_brand"],
}


@query(
    "scan_header",
    """SELECT 'orders' AS table_name, 'o_clerk' AS missing_columns, count(*) AS rows FROM orders
       UNION ALL SELECT 'customer', '', count(*) FROM customer UNION ALL SELECT 'lineitem', '', count(*) FROM lineitem
       UNION ALL SELECT 'events', 'strike', count(*) FROM events UNION ALL SELECT 'part', '', count(*) FROM part""",
)
def scan_header(t):
    parts = []
    for name, required in REQUIRED.items():
        df = getattr(t, name)
        gaps = ",".join(io.header_gaps(df, required))
        parts.append(
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table_name"), F.lit(gaps).alias("missing_columns"), "rows"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


NAMES = {"1-URGENT": "first specification", "5-LOW": "last specification", "BUILDING": "orig", "MACHINERY": "larger+VIX"}


@query(
    "label_map",
    oracle(
        "fx_returns",
        "SELECT "
        + ", ".join(
            f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + f" ELSE {c} END AS {c}"
            for c in ("config", "strategy")
        )
        + ", return_date, net_return FROM fx_returns",
        "config strategy return_date", "net_return",
    ),
)
def label_map(t):
    return ops.label_map(load(t, "fx_returns").select(*GROUP, "return_date", "net_return"), NAMES)


view(
    "fx_files",
    """
SELECT CASE lang WHEN 'en' THEN 'paper/evidence/' WHEN 'fr' THEN 'tests/' WHEN 'de' THEN 'paper/tables/' ELSE 'src/' END
         || source || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.py' WHEN doc_id % 3 = 1 THEN '.csv' ELSE '.tex' END AS path,
       text AS content, doc_id
FROM {documents}
""",
)
MANIFEST_SQL = """
SELECT path, doc_id, CASE WHEN path LIKE 'paper/tables/%' THEN 'frozen-asset' WHEN path LIKE 'paper/evidence/%' THEN 'evidence'
         WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE '%.py' OR path LIKE '%.tex' THEN 'source' ELSE 'documentation' END AS role,
       CASE WHEN path LIKE 'paper/evidence/%' THEN 'analysis.pipeline' WHEN path LIKE 'paper/tables/%' THEN 'historical-derived-asset'
         ELSE 'maintained-source' END AS producer,
       octet_length(encode(content)) AS bytes, sha256(content) AS sha256 FROM fx_files"""
VIEWS.add("manifest", MANIFEST_SQL, "fx_files")


@query("file_manifest", oracle("manifest", "SELECT * FROM manifest", "path role producer sha256", "", "bytes"))
def file_manifest(t):
    return ops.file_manifest(load(t, "fx_files"))


PLANTED = """
SELECT CASE WHEN doc_id % 97 = 0 THEN '../' || path WHEN doc_id % 89 = 0 THEN path || '.gone' ELSE path END AS path,
       CASE WHEN doc_id % 83 = 0 THEN 'other' ELSE role END AS role, producer,
       CASE WHEN doc_id % 79 = 0 THEN bytes + 1 ELSE bytes END AS bytes,
       CASE WHEN doc_id % 73 = 0 THEN 'none' ELSE sha256 END AS sha256 FROM {manifest}
UNION ALL SELECT path, role, producer, bytes, sha256 FROM {manifest} WHERE doc_id % 71 = 0"""
VIEWS.add("planted", PLANTED.replace("{manifest}", "manifest"), "manifest")


def actual_files(t):
    """The recomputed manifest with the document id, written once."""

    files = load(t, "fx_files")
    return written(ops.file_manifest(files).join(files.select("path", "doc_id"), "path"), "manifest")


@query(
    "manifest_check",
    oracle(
        "planted manifest",
        """SELECT DISTINCT path, problem FROM (
             SELECT p.path, unnest([CASE WHEN p.path LIKE '../%' THEN 'unsafe_path' END,
                      CASE WHEN p.path NOT LIKE '../%' AND m.path IS NULL THEN 'missing_file' END,
                      CASE WHEN p.role <> m.role THEN 'role_differs' END, CASE WHEN p.bytes <> m.bytes THEN 'bytes_differs' END,
                      CASE WHEN p.sha256 <> m.sha256 THEN 'sha256_differs' END]) AS problem
             FROM planted p LEFT JOIN manifest m ON m.path = p.path
             UNION ALL SELECT path, 'duplicate_path' FROM planted GROUP BY path HAVING count(*) > 1
             UNION ALL SELECT path, 'unlisted_file' FROM manifest WHERE path NOT IN (SELECT path FROM planted)) s
           WHERE problem IS NOT NULL""",
        "path problem",
    ),
)
def manifest_check(t):
    actual = actual_files(t)
    return ops.manifest_check(t.sql(PLANTED, manifest=actual), actual.drop("doc_id"))


@query(
    "inventory_diff",
    oracle(
        "planted manifest",
        """SELECT path, 'missing' AS problem FROM manifest WHERE path NOT IN (SELECT path FROM planted)
           UNION ALL SELECT DISTINCT path, 'unexpected' FROM planted WHERE path NOT IN (SELECT path FROM manifest)""",
        "path problem",
    ),
)
def inventory_diff(t):
    actual = actual_files(t)
    return ops.inventory_diff(actual, t.sql(PLANTED, manifest=actual))


FROZEN = """
SELECT CASE WHEN doc_id % 40 = 0 THEN path || '.gone' ELSE path END AS path,
       CASE WHEN doc_id % 30 = 0 THEN 'none' ELSE sha256 END AS expected FROM {manifest} WHERE role = 'evidence'"""


@query(
    "hash_membership",
    oracle(
        "manifest",
        f"""SELECT f.path, CASE WHEN m.sha256 IS NULL THEN 'missing' WHEN m.sha256 = f.expected THEN 'same' ELSE 'differs' END AS status,
                   f.expected IN (SELECT sha256 FROM manifest WHERE doc_id % 2 = 0) AS in_provenance
            FROM ({FROZEN.replace('{manifest}', 'manifest')}) f LEFT JOIN manifest m ON m.path = f.path""",
        "path status in_provenance",
    ),
)
def hash_membership(t):
    actual = actual_files(t)
    return ops.hash_membership(t.sql(FROZEN, manifest=actual), actual, actual.where("doc_id % 2 = 0"))


@query(
    "banned_columns",
    """SELECT DISTINCT event_type AS table_name, lower(trim(c)) AS column_name FROM (
         SELECT event_type, unnest(list_concat(json_keys(props), [CASE WHEN event_id % 2 = 0 THEN ' Strike ' ELSE 'Bid' END, 'value'])) AS c FROM events) s
       WHERE lower(trim(c)) IN ('strike', 'bid', 'k')""",
)
def banned_columns(t):
    extra = F.array(F.when(F.col("event_id") % 2 == 0, " Strike ").otherwise("Bid"), F.lit("value"))
    names = t.events.select(
        F.col("event_type").alias("table_name"),
        F.explode(F.concat(F.json_object_keys("props"), extra)).alias("column_name"),
    )
    return ops.banned_columns(names, (*ops.BANNED_COLUMNS, "k"))


@query(
    "domain_closure",
    oracle(
        "fx_returns",
        """SELECT config, count(*) AS rows, 4 - count(DISTINCT strategy) FILTER (WHERE strategy IN ('1-URGENT', '2-HIGH', '5-LOW', '9-NONE')) AS missing_values,
                  count(DISTINCT strategy) FILTER (WHERE strategy NOT IN ('1-URGENT', '2-HIGH', '5-LOW', '9-NONE')) AS unexpected_values,
                  false AS closed FROM fx_returns GROUP BY 1""",
        "config closed", "", "rows missing_values unexpected_values",
    ),
)
def domain_closure(t):
    return ops.domain_closure(
        load(t, "fx_returns"), ["config"], "strategy", ["1-URGENT", "2-HIGH", "5-LOW", "9-NONE"]
    )


@query(
    "required_text",
    "SELECT conv_id, bool_or(contains(text, 'tion de')) AS stated FROM conversations GROUP BY 1",
)
def required_text(t):
    return ops.required_text(t.conversations, ["conv_id"], "text", "tion de")


@query(
    "json_key_audit",
    r"""SELECT event_type, count(*) AS documents, count(*) FILTER (WHERE h > 0) AS documents_with_key, CAST(sum(h) AS BIGINT) AS occurrences
        FROM (SELECT event_type, len(regexp_extract_all(CASE WHEN event_id % 3 = 0 THEN '{"a": [' || props || ']}'
                WHEN event_id % 3 = 1 THEN props ELSE '{"b": 1}' END, '"k"\s*:')) AS h FROM events) s GROUP BY 1""",
)
def json_key_audit(t):
    nested = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": ['), "props", F.lit("]}")))
        .when(F.col("event_id") % 3 == 1, F.col("props"))
        .otherwise('{"b": 1}')
    )
    return ops.json_key_audit(t.events.withColumn("doc", nested), ["event_type"], "doc", "k")


def published_summary(t):
    """A published performance table with planted wrong cells, and the recomputed one."""

    table = written(paths.performance_summary(load(t, "fx_returns"), GROUP), "summary")
    planted = F.when(F.col("config") == "BUILDING", F.col("cagr") + 0.001).otherwise(F.col("cagr"))
    return table.withColumn("cagr", planted), table


@query(
    "summary_reconcile",
    oracle(
        "path_table",
        """SELECT config, strategy, 'cagr' AS column_name, cagr + 0.001e0 AS observed, cagr AS expected FROM path_table
           WHERE config = 'BUILDING'""",
        "config strategy column_name", "observed expected",
    ),
)
def summary_reconcile(t):
    published, table = published_summary(t)
    numbers = [c for c in table.columns if c not in (*GROUP, "defaulted")]
    return ops.summary_differences(published, table, GROUP, numbers)


@query(
    "identity_checks",
    oracle(
        "path_table",
        """SELECT config, strategy, 'cagr_from_wealth' AS failed_check FROM path_table WHERE config = 'BUILDING'
           UNION ALL SELECT DISTINCT event_type, 'all', 'proxy_share_is_part_of_whole' FROM events WHERE event_type = 'view'""",
        "config strategy failed_check",
    ),
)
def identity_checks(t):
    published, _ = published_summary(t)
    sources = t.events.groupBy(F.col("event_type").alias("config"), F.lit("all").alias("strategy")).agg(
        F.count_if(F.col("user_id") % 3 == 0).alias("proxy"), F.count_if(F.col("user_id") % 3 != 0).alias("exact")
    )
    share = F.col("proxy") / (F.col("proxy") + F.col("exact"))
    planted = sources.withColumn("proxy_share", share + F.when(F.col("config") == "view", 0.001).otherwise(0.0))
    shares = ops.share_failures(planted, GROUP, "proxy_share", "proxy", "exact")
    return ops.identity_failures(published, GROUP).unionByName(shares)


@query(
    "report_rows",
    oracle(
        "path_table",
        """SELECT config, strategy, format('{} & {} & {} & {:.3f}', config, strategy, n_obs, annualized_volatility) AS line,
                  config <> 'BUILDING' AS published FROM path_table""",
        "config strategy line published",
    ),
)
def report_rows(t):
    table = paths.return_moments(load(t, "fx_returns"), GROUP)
    lines = written(
        ops.rendered(table, GROUP, "%s & %s & %d & %.3f", [*GROUP, "n_obs", "annualized_volatility"]), "lines"
    )
    path = scratch_folder(t.spark, "report")
    shown = F.when(F.col("config") == "BUILDING", F.concat("line", F.lit(" (old)"))).otherwise(F.col("line"))
    lines.select(F.concat(F.lit("  "), shown).alias("value")).write.text(path)
    return ops.report_rows(lines, t.spark.read.text(path))


@query(
    "immutable_ledger",
    oracle(
        "fx_returns",
        """SELECT config, strategy, return_date, CASE WHEN return_date < DATE '1999-01-01' THEN net_return ELSE 2 * net_return END AS net_return,
                  CASE WHEN return_date < DATE '1999-01-01' THEN 'kept' ELSE 'appended' END AS origin FROM fx_returns""",
        "config strategy return_date origin", "net_return",
    ),
)
def immutable_ledger(t):
    keys = [*GROUP, "return_date"]
    rows = load(t, "fx_returns").select(*keys, "net_return")
    ledger = written(rows.where("return_date < DATE '1999-01-01'").withColumn("origin", F.lit("kept")), "ledger")
    batch = rows.withColumn("net_return", F.col("net_return") * 2.0).withColumn("origin", F.lit("appended"))
    return ledger.unionByName(ops.append_ledger(ledger, batch, keys))
