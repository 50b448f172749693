"""Registry of named queries: a Spark builder and (where SQL can say it) a DuckDB oracle.

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.model import Model, from_driver_tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str = ""


REGISTRY: dict[str, Query] = {}

_MODELS: dict[tuple[str, str], tuple[tuple, Model]] = {}


def listing(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file of the tables in ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """The model of a folder; a new one, with nothing stored for it, once the folder's files change."""
    key, files = (spark.sparkContext.applicationId, sf_dir), listing(spark, sf_dir)
    if key not in _MODELS or _MODELS[key][0] != files:
        _MODELS[key] = files, from_driver_tables(spark, sf_dir)
    return _MODELS[key][1]


def forget_models() -> None:
    """Drop the cached models with all that hangs on them (closure, stores)."""
    _MODELS.clear()


def register(name: str, oracle: str | None, ids: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(name, fn, oracle, ids)
        return fn
    return deco


def on_model(fn: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(model_for(spark, sf_dir))
    build.__name__ = getattr(fn, "__name__", "build")
    return build


def load_all() -> dict[str, Query]:
    # importing the query modules fills REGISTRY
    from . import queries_cart, queries_changes, queries_metrics, queries_pricing, queries_streaming  # noqa: F401
    return REGISTRY
