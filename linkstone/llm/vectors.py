"""Vectors packed in blocks, and a stated query set held against all of them block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "norm double, low double, ids binary, data binary"


def valid(column: Column) -> Column:
    """Not null, and all components finite numbers."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def matrix(column: pa.ListArray, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def width_of(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column))).first()[0] or 0


def blocks(df: DataFrame, width: int, rows: int) -> DataFrame:
    """Blocks of ``rows`` vectors of each partition as they come: largest and smallest norm, ids, matrix.

    ``df`` has the columns id (long), vector (array<double>) and norm (double).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                norm = part.column("norm").to_numpy(zero_copy_only=False)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([float(norm.max())]), pa.array([float(norm.min())]), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([matrix(part.column("vector"), width).tobytes()], pa.binary())], names=["norm", "low", "ids", "data"])

    return df.select("id", "vector", "norm").mapInArrow(run, BLOCK)


def numbered(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``df`` dealt by id into parts of about ``size`` rows, with the part's number."""
    n = max(1, -(-df.count() // size))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def against(queries: DataFrame, candidates: DataFrame, start: Callable, kernel: Callable, finish: Callable, schema: str, groups: int = 16) -> DataFrame:
    """Every block of queries (columns qpart, qids, last) against the blocks of candidates (column cpart) up to number ``last``.

    Only the pairs that are asked for travel.  Candidates are dealt to ``groups`` groups, and a task's
    work is a query block and a group: ``start`` of the first pair makes a state, ``kernel`` adds a
    pair to it, ``finish`` gives its rows.  So a query has the rows of ``groups`` states at most,
    however many blocks there are, and a task holds one state and some blocks at a time.
    """
    pairs = queries.select("qpart", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("cpart")).distinct()
    dealt = candidates.join(pairs, "cpart").withColumn("group", F.pmod("cpart", F.lit(groups)))
    asked = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.least(F.col("last"), F.lit(groups - 1)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, states = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                pair = batch.slice(k, 1)
                here = pair.column("qpart")[0].as_py(), pair.column("group")[0].as_py()
                if here != place:
                    for state in states.values():
                        yield finish(state)
                    place, states = here, {}
                block = pair.column("qids")[0].as_py()
                if block not in states:
                    states[block] = start(pair)
                kernel(states[block], pair)
        for state in states.values():
            yield finish(state)

    # sorted at every size, or a group's blocks would not meet in one task; the candidates come first,
    # as the other side of a sorted join is held for each key
    return dealt.join(asked.hint("merge"), ["qpart", "group"]).mapInArrow(run, schema)


def best(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
