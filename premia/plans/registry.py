"""Catalog of queries: a Spark plan and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


from pyspark.sql import DataFrame, SparkSession

from premia.functions.numeric import NUDGE, tidy

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The given tables of one folder, read lazily, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL with ``{name}`` placeholders standing for tables or frames."""

        for name in TABLES:
            if "{" + name + "}" in text and name not in frames:
                frames[name] = getattr(self, name)
        return self.spark.sql(text, **frames)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **digits: int):
    """Register ``plan(tables) -> DataFrame`` under a name; doubles are rounded."""

    def register(plan: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(plan(Tables(spark, folder)), **digits)

        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, run, sql)
        return plan

    return register


class SqlLibrary:
    """Named SQL views; ``build`` prefixes a body with the views it needs."""

    def __init__(self) -> None:
        self._views: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, text: str, *needs: str) -> None:
        self._views[name] = (text, needs)

    def build(self, needs: str, body: str) -> str:
        ordered: list[str] = []

        def visit(name: str) -> None:
            if name in ordered:
                return
            for other in self._views[name][1]:
                visit(other)
            ordered.append(name)

        for name in needs.split():
            visit(name)
        views = ",\n".join(f"{name} AS ({self._views[name][0]})" for name in ordered)
        return f"WITH {views}\n{body}" if ordered else body


VIEWS = SqlLibrary()


def shaped(inner: str, keep: str = "", real: str = "", whole: str = "", digits: int = 6) -> str:
    """Outer SELECT that rounds ``real``, casts ``whole`` and passes ``keep``."""

    parts = [*keep.split()]
    parts += [f"CAST({name} AS BIGINT) AS {name}" for name in whole.split()]
    parts += [
        f"round(CAST({name} AS DOUBLE) + {NUDGE!r}::DOUBLE, {digits}) + 0.0e0 AS {name}" for name in real.split()
    ]
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS shaped"


def oracle(needs: str, inner: str, keep: str = "", real: str = "", whole: str = "", digits: int = 6):
    return VIEWS.build(needs, shaped(inner, keep, real, whole, digits))



