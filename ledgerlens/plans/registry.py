"""The catalogue of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import configure, scratch_path


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(t: Tables, label: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
    """A step table several queries read: written once per application and directory to the shared folder."""
    key = (t.spark.sparkContext.applicationId, t.dir, label)
    if key not in _WRITTEN:
        path = scratch_path(t.spark, label)
        build(t).write.parquet(path)
        _WRITTEN[key] = path
    return t.spark.read.parquet(_WRITTEN[key])


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(t)`` under ``name`` together with its SQL twin."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, build, sql)
        return build

    return keep


def load_all() -> dict[str, Query]:
    """Import every plan module and return the catalogue."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"ledgerlens.plans.{module}")
    return CATALOGUE


MODULES = [
    "sources_plans",
    "governed_plans",
    "profile_plans",
    "relate_plans",
    "graph_plans",
    "warehouse_plans",
    "cohort_plans",
    "feature_plans",
    "screen_plans",
    "score_plans",
    "runlog_plans",
    "evalset_plans",
    "retrieve_plans",
    "diagnose_plans",
    "stream_plans",
]
