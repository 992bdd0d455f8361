"""Exact top-k search by inner product, with a uniform threshold in three phases.

A vector's dimensions are cut into ``LISTS`` ranges; the partial inner products over a range are one score
list per query, and a candidate's score is the sum of its partial scores.

1. A task takes its candidates in slices. Of each slice it keeps, per query, the k best entries of every list,
   completes the scores of those few and passes on the k best of them. Per query the k-th best of all that was
   passed on is a cutoff: at least k candidates reach it.
2. The cutoff T goes back with the queries. A candidate that reaches T has a partial score of T / lists or more
   in some list, so the entries at or above that uniform threshold are sufficient. By the Cauchy-Schwarz bound of
   a range, candidates whose part is too short for every query of a block are left out before any product.
3. For those entries alone the partial scores of the other ranges are resolved; the candidates that reach T go on,
   and the best k of them by (score, id) are the result.

Queries lie in the shared folder in blocks of ``BLOCK``; a task reads them one after the other for each slice of
its candidates, so each phase is one scan of the candidates, whatever the number of blocks, and nothing that
grows is broadcast or sent to the driver. Scores are integers: components are floor(256 x).

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no part, nor
does a row with a null id; a candidate with the query's own id, or with another number of dimensions, is no
candidate of it; of query rows with the same id the least vector asks; repeated candidate rows are all
ranked; equal scores rank by id. Components must fit the inner product in 64 bits; larger ones raise
OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

SCALE = 256
LISTS = 2
BLOCK = 2048
#: Bytes of a slice of candidates, and products of a slice with a block's queries that a task holds at a time.
SLICE, CELLS = 16_000_000, 4_000_000
#: What stands for no score.
NONE = np.iinfo(np.int64).min // 4


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part, components scaled and floored."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("double"))
    usable = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    took = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & usable)
    return took.select(F.col(key).cast("long").alias("id"), x.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("an inner product may exceed 64 bits")
    return np.einsum("id,jd->ij", a.astype(np.int64), b.astype(np.int64))


def resolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``a`` with the same row of ``b``, exact."""
    out = np.empty(len(a), np.int64)
    if len(a) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**62:
        raise OverflowError("an inner product may exceed 64 bits")
    for at in range(0, len(a), 65_536):
        of = slice(at, at + 65_536)
        out[of] = np.einsum("ij,ij->i", a[of].astype(np.int64), b[of].astype(np.int64))
    return out


def ranges(width: int) -> list[slice]:
    """The ranges of dimensions, one per list."""
    cuts = np.linspace(0, width, min(LISTS, width) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _largest(k: int, names: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The places of the k best of each row by (score, name), in order."""
    return np.lexsort((names, -scores), axis=1)[:, :k]


def local_best(asks: np.ndarray, queries: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 for a slice: (query, id, score) of the k best among the k best entries of every list."""
    same = asks[:, None] == names[None, :]
    parts, chosen = ranges(matrix.shape[1]), []
    for part in parts:
        seen = products(queries[:, part], matrix[:, part])
        seen[same] = NONE
        n = min(k, seen.shape[1])
        chosen.append(np.argpartition(seen, seen.shape[1] - n, axis=1)[:, -n:])
    at = np.sort(np.concatenate(chosen, axis=1), axis=1)
    row = np.broadcast_to(np.arange(len(asks))[:, None], at.shape)
    whole = resolved(queries[row.ravel()], matrix[at.ravel()]).reshape(at.shape)
    real = ~np.take_along_axis(same, at, 1)
    real[:, 1:] &= at[:, 1:] != at[:, :-1]
    whole[~real] = NONE
    best = _largest(k, names[at], whole)
    kept = np.take_along_axis(real, best, 1)
    return np.broadcast_to(asks[:, None], best.shape)[kept], np.take_along_axis(names[at], best, 1)[kept], np.take_along_axis(whole, best, 1)[kept]


def sufficient(queries: np.ndarray, cutoffs: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2 for a slice: the places (query, candidate) of entries that reach the uniform threshold in some list."""
    parts = ranges(matrix.shape[1])
    least = -(-cutoffs // len(parts))
    entry = np.zeros((len(queries), len(matrix)), bool)
    for part in parts:
        lengths = np.sqrt(np.einsum("ij,ij->i", matrix[:, part], matrix[:, part]))
        asks = np.sqrt(np.einsum("ij,ij->i", queries[:, part], queries[:, part]))
        # |q| |x| >= threshold for some query; a threshold that is not positive excludes nothing
        needed = np.where(least > 0, least / np.maximum(asks, 1e-300), 0).min(initial=np.inf)
        near = np.flatnonzero(lengths * (1 + 1e-9) >= needed)
        if len(near):
            entry[:, near] |= products(queries[:, part], matrix[near][:, part]) >= least[:, None]
    return np.nonzero(entry)


def reaching(asks: np.ndarray, queries: np.ndarray, cutoffs: np.ndarray, names: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for a slice: (query, id, score) of the candidates that reach the cutoff."""
    q, c = sufficient(queries, cutoffs, matrix)
    other = asks[q] != names[c]
    q, c = q[other], c[other]
    whole = resolved(queries[q], matrix[c])
    kept = whole >= cutoffs[q]
    return asks[q[kept]], names[c[kept]], whole[kept]


def _scan(candidates: DataFrame, folder: str, blocks: int, work) -> DataFrame:
    """(query, id, score) that ``work(asks, queries, cutoffs, names, matrix)`` gives for each slice of the candidates with each block."""

    def block(number: int):
        """(id, v, cutoff) arrays of a block by number of dimensions."""
        source, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/block={number}")
        found = pyarrow.parquet.read_table(path, filesystem=source, columns=["id", "v", "cutoff"], partitioning=None).combine_chunks()
        widths = found["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths).tolist():
            own = found.filter(pa.array(widths == width)).combine_chunks()
            yield width, own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), width), own["cutoff"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def through(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            widths = rows["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            slices = {}
            for width in np.unique(widths).tolist():
                own = rows.filter(pa.array(widths == width)).combine_chunks()
                slices[width] = own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), width)
            for number in range(blocks):
                for width, asks, queries, cutoffs in block(number):
                    if width not in slices:
                        continue
                    names, matrix = slices[width]
                    step = max(1, CELLS // len(names))
                    for at in range(0, len(asks), step):
                        of = slice(at, at + step)
                        found = work(asks[of], queries[of], cutoffs[of], names, matrix)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query", "id", "score"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n >= SLICE:
                yield from through(held)
                held, n = [], 0
        if held:
            yield from through(held)

    return candidates.mapInArrow(run, "query long, id long, score long")


def _best(entries: DataFrame, k: int, columns: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*columns.split())


def search(vectors: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row where ``asks`` (over ``id``) holds."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = quantised(vectors, key, vector)
    queries = common.materialise(rows.where(asks).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def placed(df: DataFrame) -> str:
        """The folder of the blocks; every block has a folder of its own."""
        folder = common.new_path(spark, "query-blocks")
        df.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
        return folder

    floor = F.lit(NONE)
    there = sorted(r.block for r in dealt.select("block").distinct().collect())
    if len(there) < blocks:  # a hash without a query, or no query at all
        numbers = {b: i for i, b in enumerate(there)}
        blocks = len(there)
        if not blocks:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        dealt = dealt.withColumn("block", F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("block")))
    lists = _scan(rows, placed(dealt.withColumn("cutoff", floor)), blocks, lambda asks, queries, _, names, matrix: local_best(asks, queries, names, matrix, k))
    reached = _best(lists, k, "query rank score").where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("cutoff"))
    known = placed(dealt.join(reached, "id", "left").withColumn("cutoff", F.coalesce("cutoff", floor)))
    found = _best(_scan(rows, known, blocks, reaching), k, "query rank id score")
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
