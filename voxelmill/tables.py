"""Intermediate tables in the folder that all executors see, and their removal."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession

#: With this setting Spark removes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests on one machine) a folder below the
    warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_voxelmill"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/voxelmill-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of each write go when it has ended: what comes later reads its table.  The session's
    own choice comes back afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def write(df: DataFrame, path: str) -> DataFrame:
    with without_leftovers(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the plan ends there, and the files
    outlive any executor.  Within ``owned_by`` the table belongs to that scope, else to the caller."""
    scope, path = _scope.get(), new_path(df.sparkSession, name)
    out = write(df, path)
    if scope:
        scope.adopt(out, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation: each can be dropped as soon as what follows is stored, all go at the end.

    A result that outlives the scope must be stored outside of it (``stored``) before the scope ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def adopt(self, table: DataFrame, path: str) -> DataFrame:
        """``table`` at ``path`` goes with this scope."""
        self.paths[id(table)] = (table, path)
        return table

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        return self.adopt(write(df, path), path)

    def counted(self, df: DataFrame, name: str, **figures) -> tuple[DataFrame, dict]:
        """The table, and aggregates of its rows that the same pass has taken."""
        seen = Observation()
        out = self.stored(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
        return out, seen.get

    def renamed(self, table: DataFrame, view: DataFrame) -> DataFrame:
        """``view``, a selection of the columns of ``table``, in its place."""
        self.paths[id(view)] = (view, self.paths.pop(id(table))[1])
        return view

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                remove(self.spark, self.paths.pop(id(t))[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop(*[t for t, _ in self.paths.values()])


_scope: ContextVar[Scratch | None] = ContextVar("voxelmill-scope", default=None)


@contextmanager
def owned_by(scratch: Scratch) -> Iterator[None]:
    """Within, what ``stored`` writes belongs to ``scratch``."""
    token = _scope.set(scratch)
    try:
        yield
    finally:
        _scope.reset(token)


def adopted(table: DataFrame, path: str) -> DataFrame:
    """A table that was written by other means: it belongs to the scope, if there is one."""
    scope = _scope.get()
    return scope.adopt(table, path) if scope else table


def scoped(query: Callable[..., DataFrame], order: tuple[str, ...] = ()) -> Callable[..., DataFrame]:
    """``query`` (its first argument is the session) that leaves its result's table only, and not even that where the
    result reads none of its own tables.  ``order``: columns that sort the result."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        with Scratch(spark) as scratch:
            with owned_by(scratch):
                out = query(spark, *args)
            if id(out) in scratch.paths:
                scratch.paths.pop(id(out))
            elif scratch.paths:
                out = write(out, new_path(spark, "result"))
            return out.orderBy(*order) if order else out

    return run
