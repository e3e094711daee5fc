"""The monthly sequence of decisions for every (config, date) in one job, from earlier months only.

Moments are mergeable: each month gives one row of count, sums and product sums a pair of labels, and a running sum over
the months before a date is that date's expanding-window covariance, so the panel is read once however many dates
there are. Positions accumulate the same way. Months x label pairs and months x legs are the size of the results themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import finite
from premia.session import written


@dataclass(frozen=True)
class Rules:
    """Limits of the sequence; volatility is annual, the others are shares of capital."""

    gross: float = 0.5
    least_months: int = 24
    cap: float = 0.045
    net_abs: float = 0.5
    volatility_ceiling: float = 0.047
    cost_rate: float = 0.002
    risk_aversion: float = 2.0
    capital: float = 1e7
    lot: float = 25_000.0
    periods: float = 12.0
    tolerance: float = 1e-9


def _index(date: str) -> Column:
    return F.year(date) * 12 + F.month(date)


def _before(rows: DataFrame, keys: list[str], dates: DataFrame, sums: list[str]) -> DataFrame:
    """For each key and date, the sums over rows with an earlier ``period`` (one row a key and period at most).

    ``dates`` has one row. A window by month number runs over one row a key and date.
    """

    spine = rows.select(*keys).distinct().join(F.broadcast(dates))  # one row: the list of months
    spine = spine.select(*keys, F.explode("dates").alias("period"))
    past = Window.partitionBy(*keys).orderBy("_month").rangeBetween(Window.unboundedPreceding, -1)
    filled = spine.join(rows, [*keys, "period"], "left").withColumn("_month", _index("period"))
    return filled.select(*keys, F.col("period").alias("decision_date"), *[F.coalesce(F.sum(name).over(past), F.lit(0.0)).alias(name) for name in sums])


def months(panel: DataFrame) -> DataFrame:
    """One row with all months that have a return."""

    return panel.where(finite("ret").isNotNull()).agg(F.sort_array(F.collect_set("period")).alias("dates"))


def expanding_moments(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """decision_date, row_label, col_label (row not after column), n, mean_row, mean_col, cov of the months before each date
    in which both labels have a return."""

    clean = panel.select("period", "label", finite("ret").alias("_r")).where("_r IS NOT NULL")
    a = clean.select("period", F.col("label").alias("row_label"), F.col("_r").alias("_x"))
    b = clean.select("period", F.col("label").alias("col_label"), F.col("_r").alias("_y"))
    tile = a.join(b, "period").where("row_label <= col_label").select(
        "row_label", "col_label", "period", F.lit(1.0).alias("n"), F.col("_x").alias("sx"), F.col("_y").alias("sy"), (F.col("_x") * F.col("_y")).alias("sxy")
    )
    done = _before(tile, ["row_label", "col_label"], dates, ["n", "sx", "sy", "sxy"])
    n = F.col("n")
    return done.where("n >= 2").select(
        "decision_date", "row_label", "col_label", n.cast("bigint").alias("n"), (F.col("sx") / n).alias("mean_row"), (F.col("sy") / n).alias("mean_col"),
        ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)).alias("cov"),
    )


def expanding_books(positions: DataFrame, dates: DataFrame, gross: float) -> DataFrame:
    """decision_date, config, book_id, label, weight: positions of the months before a date, scaled to ``gross`` a book."""

    keys = ["config", "book_id", "label"]
    held = _before(positions.groupBy(*keys, "period").agg(F.sum("q").cast("double").alias("q")), keys, dates, ["q"]).where("q <> 0")
    book = held.groupBy("decision_date", "config", "book_id").agg(F.sum(F.abs("q")).alias("_gross"))
    scaled = held.join(book, ["decision_date", "config", "book_id"])
    return scaled.select("decision_date", *keys, (F.lit(gross) * F.col("q") / F.col("_gross")).alias("weight"))


def audit_books(books: DataFrame, moments: DataFrame, rules: Rules) -> DataFrame:
    """One row a (date, config, book): mean, gross, net, cost, volatility, and whether every limit holds.

    A book with a label of fewer than ``least_months`` months, or a pair without a covariance, is never feasible.
    """

    book = ["decision_date", "config", "book_id"]
    own = moments.where("row_label = col_label").select("decision_date", F.col("row_label").alias("label"), "n", F.col("mean_row").alias("mean"))
    legs = books.join(own, ["decision_date", "label"], "left")
    w = F.col("weight")
    sums = legs.groupBy(*book).agg(
        F.sum(w * F.col("mean")).alias("mean"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.max(F.abs(w)).alias("largest"),
        F.min(F.coalesce("n", F.lit(0))).alias("months"), F.count("*").alias("legs"),
    )
    left = books.select(*book, F.col("label").alias("row_label"), F.col("weight").alias("_wr"))
    right = books.select(*book, F.col("label").alias("col_label"), F.col("weight").alias("_wc"))
    pairs = left.join(moments.select("decision_date", "row_label", "col_label", "cov"), ["decision_date", "row_label"]).join(right, [*book, "col_label"])
    twice = F.when(F.col("row_label") == F.col("col_label"), 1.0).otherwise(2.0)
    risk = pairs.groupBy(*book).agg(F.sum(twice * F.col("_wr") * F.col("_wc") * F.col("cov")).alias("variance"), F.count("cov").alias("pairs"))
    table = sums.join(risk, book, "left").select(
        *book, "mean", "gross", "net", "largest", "months", (F.col("gross") * rules.cost_rate).alias("cost"),
        F.when(F.col("pairs") == F.expr("legs * (legs + 1) div 2"), F.sqrt(F.greatest("variance", F.lit(0.0)))).alias("volatility"),
    )
    slack = rules.tolerance
    holds = (
        (F.col("months") >= rules.least_months) & (F.col("gross") <= rules.gross + slack) & (F.col("largest") <= rules.cap + slack)
        & (F.abs("net") <= rules.net_abs + slack) & (F.col("volatility") * rules.periods**0.5 <= rules.volatility_ceiling + slack)
    )
    return table.withColumn("feasible", F.coalesce(holds, F.lit(False)))


def decide(panel: DataFrame, positions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each config and month in which it has a book of earlier positions.

    ``panel`` has (period, label, ret), ``positions`` (config, book_id, label, period, q); periods are first days of months. Books are audited,
    the feasible one with the highest utility (mean less cost less risk aversion times variance; equal: the smaller id) is rounded to whole lots and
    audited again, and held at the month's returns (0 where a label has none) or given up for cash. Status: held, abstained (the rounded book fails) or
    no_feasible_candidate. Everything but ``realized_return`` comes from months before the date. Empty inputs give no rows.
    """

    dates = months(panel)
    moments = written(expanding_moments(panel, dates), "moments")
    books = written(expanding_books(positions, dates, rules.gross), "books")
    pool = audit_books(books, moments, rules)
    key = ["decision_date", "config"]
    utility = F.col("mean") - F.col("cost") - rules.risk_aversion * F.col("volatility") * F.col("volatility")
    best = F.max(F.when(F.col("feasible"), F.struct(utility.alias("utility"), (-F.col("book_id")).alias("_last"))))
    picks = pool.groupBy(*key).agg(F.count("*").alias("candidates"), best.alias("best")).select(*key, "candidates", (-F.col("best._last")).alias("book_id"))
    picks = written(picks, "picks")
    chosen = books.join(picks.select(*key, "book_id"), [*key, "book_id"], "left_semi")
    lots = F.signum("weight") * F.floor(F.abs("weight") * (rules.capital / rules.lot) + rules.tolerance)
    rounded = chosen.withColumn("lots", lots.cast("double")).withColumn("weight", F.col("lots") * (rules.lot / rules.capital)).where("lots <> 0")
    final = audit_books(rounded, moments, rules).select(*key, "gross", "cost", "volatility", "feasible")
    outcome = panel.select(F.col("period").alias("decision_date"), "label", finite("ret").alias("ret"))
    gain = rounded.join(outcome, ["decision_date", "label"], "left").groupBy(*key).agg(F.sum(F.abs("lots")).cast("bigint").alias("lots"), F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("_gain"))
    table = picks.join(final, key, "left").join(gain, key, "left")
    held = F.coalesce(F.col("feasible"), F.lit(False))
    status = F.when(F.col("book_id").isNull(), "no_feasible_candidate").when(held, "held").otherwise("abstained")
    return table.select(
        "config", "decision_date", status.alias("status"), "candidates", "book_id", F.when(held, F.col("lots")).otherwise(0).alias("lots"),
        F.when(held, F.col("gross")).otherwise(0.0).alias("held_gross"), F.when(held, F.col("volatility")).alias("volatility"),
        F.when(held, F.col("_gain") - F.col("cost")).otherwise(0.0).alias("realized_return"),
    )
