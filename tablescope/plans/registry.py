"""Registry of the queries served by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Registered] = {}


class Tables:
    """Lazy access to the tables of one scale-factor directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"


@dataclass(frozen=True)
class Registered:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # every time bucket in the library is defined in UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Tables(spark, sf_dir))


def query(name: str, *ids: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` for the operator ids it proves."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Registered(name, ids, build, oracle)
        return build

    return register
