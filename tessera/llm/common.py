"""Plumbing shared by the corpus operators: tables in the shared folder, Arrow slices, text guards."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

#: Rows of one Arrow batch handed to Python; documents may hold hundreds of thousands of characters each.
BATCH_ROWS = 512
#: Characters that a Python operator holds at once, besides one document of any length.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session takes a temporary folder of our own (tests); any other session is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


#: The paths given out while a ``released`` runs.
_given: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for given in _given:
        given.append(path)
    return path


def released(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``make()`` as a table in the shared folder; every other table that was written for them is deleted."""
    _given.append(given := [])
    try:
        out = materialise(make(), name)
        kept = given[-1]
    finally:
        _given.remove(given)
    for path in given:
        if path != kept:
            _delete(spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` made and nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application has put into the shared folder. Results that still read them fail afterwards."""
    _delete(spark, shared_dir(spark))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, since texts are long. All operators set the same number, so a lazy plan never runs with another one's."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cuts(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Each batch cut so that the texts of a slice hold about ``most`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The slices of ``cuts`` with their texts as Python strings; a null text comes as None."""
    for batch in cuts(batches, text, most):
        yield batch, batch.column(batch.schema.get_field_index(text)).to_pylist()


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """One output row per row of ``df``: the columns ``keep``, then ``fields`` from ``make()(texts)``.

    ``make`` runs once in each task and returns the function that turns a list of texts into a list of
    Arrow arrays. Only the columns ``keep`` and ``text`` are read; a text that is kept is sent to Python once.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema]
    held = text if text in keep else "__text"
    source = df.select(*keep) if text in keep else df.select(*keep, df[text].alias(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch, texts in slices(batches, held):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + work(texts), names=names)

    return source.mapInArrow(run, schema)
