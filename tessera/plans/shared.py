"""Tables and texts that an application writes once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a pass that are sent to all tasks at most, and the passes that this may ask for.
SENT_ROWS, MOST_PASSES = 1_000_000, 256

_made: dict[tuple[str, ...], str] = {}
#: Whether a query's shuffle files go when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder (tests), any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def once(spark: SparkSession, write: Callable[[str], object], *names: str) -> str:
    """The path that ``write`` has filled for these names in this application; it is written at the first call."""
    key = (spark.sparkContext.applicationId, *names)
    if key not in _made:
        path = f"{folder(spark)}/{names[-1]}-{uuid.uuid4().hex}"
        with cleaned(spark):
            write(path)
        _made[key] = path
    return _made[key]


@contextmanager
def set_to(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cleaned(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files; no DataFrame may run twice here."""
    return set_to(spark, _CLEANUP, "true")


def same(spark: SparkSession, names: tuple[str, ...], others: tuple[str, ...]) -> None:
    """What is written for ``names`` is so for ``others`` too."""
    _made[(spark.sparkContext.applicationId, *others)] = _made[(spark.sparkContext.applicationId, *names)]


def written(spark: SparkSession, *names: str) -> bool:
    """Whether ``once`` has filled a path for these names."""
    return (spark.sparkContext.applicationId, *names) in _made


def drop(spark: SparkSession, *names: str) -> None:
    """Deletes what ``once`` has written for these names; the next call writes it again."""
    delete(spark, _made.pop((spark.sparkContext.applicationId, *names)))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob finds, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def share(n: int, i: int) -> Callable[[str], Column]:
    """Whether a key is of the pass ``i`` of ``n``."""
    return lambda key: F.pmod(F.xxhash64(key), F.lit(n)) == i


def put(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def table(spark: SparkSession, make: Callable[[], DataFrame], *names: str) -> DataFrame:
    """A relation that several queries read, as a Parquet table written at its first use."""
    return spark.read.parquet(once(spark, lambda path: put(make(), path), *names))
