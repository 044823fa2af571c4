"""Where derived data is kept when a plan must be cut.

The folder comes from ``spark.checkpoint.dir``. Only where a session on one
machine names none (local tests) is a folder made under the system's temporary
directory. What is cut inside a ``scratch`` block is deleted when the block
ends, so a block must hold the action that reads it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_tables: dict[tuple[str, str], str] = {}
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="fleetpulse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fleetpulse/{uuid.uuid4().hex}"


def folder_for_cut(spark: SparkSession) -> str:
    """A new folder, inside the innermost scratch block if there is one."""
    return f"{_scopes[-1]}/{uuid.uuid4().hex}" if _scopes else _fresh(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything cut inside is deleted at the end."""
    folder = _fresh(spark)
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back."""
    return _written(df, folder_for_cut(df.sparkSession))


def kept(df: DataFrame) -> DataFrame:
    """The same, but what is written outlives any scratch block."""
    return _written(df, _fresh(df.sparkSession))


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose generated method is longer than 8,000 bytes run as expressions split into short ones.

    The JVM never compiles a longer method; wide projections in one would be interpreted row by row.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _written(df: DataFrame, path: str) -> DataFrame:
    with small_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application and read by every later query."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _tables:
        path = _fresh(spark)
        with scratch(spark):
            df = build()
            with small_methods(spark):
                df.write.parquet(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def written_table(spark: SparkSession, name: str, write: Callable[[str], None]) -> DataFrame:
    """The same for a table that ``write`` puts into a folder itself, such as a stream whose files keep their order."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _tables:
        path = _fresh(spark)
        with scratch(spark):
            write(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def table_path(spark: SparkSession, name: str) -> str:
    """Where a table made by :func:`table` or :func:`written_table` in this application lies."""
    return _tables[(spark.sparkContext.applicationId, name)]
