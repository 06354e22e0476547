"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Of local sessions without a checkpoint folder the temporary one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session (tests) without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table, read again: computed once, with no lineage, whatever executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What the innermost one_graph() block has written, by label and folder of the tables; None outside of one.
_SCOPE: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def one_graph() -> Iterator[None]:
    """In this block, layers of the graph that several steps need are written once.

    Each query opens one for itself, so queries share nothing; whoever has many
    questions to a graph whose tables and parameters stay as they are opens one
    around them all.
    """
    outer = _SCOPE.get()
    token = _SCOPE.set({} if outer is None else outer)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def kept(label: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """written(build()), once in a one_graph() block."""
    scope = _SCOPE.get()
    if scope is None:
        return written(build(), label)
    if (label, sf_dir) not in scope:
        scope[label, sf_dir] = written(build(), label)
    return scope[label, sf_dir]
