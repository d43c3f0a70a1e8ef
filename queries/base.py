"""How queries are registered: a Spark function and the equivalent SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.views import SPARK_VIEWS, SQL_VIEWS, VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def moment(text: str = "2024-02-01 00:00:00") -> Column:
    """A fixed time without zone; queries never read the clock."""
    return F.expr(f"timestamp_ntz'{text}'")


class Tables:
    """The given tables, and views derived from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        return self.sql(SPARK_VIEWS.get(name) or VIEWS[name])

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """A query over named tables and views; ``given`` frames replace some of them."""
        return self.spark.sql(text, **{name: given.get(name) or self(name) for name in names_in(text)})


def names_in(text: str) -> list[str]:
    """Tables and views a text mentions as ``{name}``."""
    return list(dict.fromkeys(field for _, field, _, _ in Formatter().parse(text) if field))


def expand(text: str) -> str:
    """The text with views written out, for an engine that has only the given tables."""
    parts = {}
    for name in names_in(text):
        parts[name] = name if name in TABLES else "(" + expand(SQL_VIEWS.get(name) or VIEWS[name]) + ")"
    return text.format(**parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable:
    """Register a function of ``Tables`` under a key, with its SQL if it has one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = expand(oracle)
        return fn

    return register
