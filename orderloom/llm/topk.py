"""Exact top-k by inner product: branch and bound over a columnar layout.

Queries and candidates are dealt into blocks of bounded size, and every pair of a query block and a
candidate block is one group. There the candidates lie dimension by dimension, the dimensions with
most mass first. Partial products grow one block of dimensions at a time; what the dimensions to
come can still add or take away is at most the product of the remaining lengths of both vectors. A
candidate whose upper bound is below the k-th best lower bound is dropped, and the survivors are
compacted before the next block. Each group returns k rows per query, and a rank over those gives
the result.

Components are integers held in doubles: partial products are exact while they stay below 2^53;
larger ones are computed with whole numbers of any size and saturate at 64 bits.

Defined results: null vectors and vectors with a null or non-finite component take no part; of
vectors of different lengths the shorter is filled with zeros; empty vectors score 0; ties go to
the smaller id (null ids last); every row is a candidate of its own, so repeated rows both appear,
and only the query's own row is left out. Queries without candidates have no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze
from orderloom.llm.common import width

_CANDIDATES, _QUERIES, _DIMENSIONS = 8_192, 4_096, 8
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows whose vectors take part, with each component as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor of a double that exceeds a bigint would overflow; such doubles are whole already
    whole = F.transform(
        x, lambda v: F.when(F.abs(v * scale) < 2.0**62, F.floor(v * scale).cast("double")).otherwise(v * scale)
    )
    return vectors.where(F.col(vector_col).isNotNull() & finite).withColumn(vector_col, whole)


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """One row per dimension, one column per vector."""
    out = np.zeros((len(column), dimensions))
    at = 0
    for chunk in column.chunks:
        flat, ends = chunk.flatten().to_numpy(zero_copy_only=False), np.diff(chunk.offsets.to_numpy())
        row = np.repeat(np.arange(len(ends)), ends)
        out[at + row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
        at += len(ends)
    return np.ascontiguousarray(out.T)


def _remaining(matrix: np.ndarray, starts: list[int]) -> np.ndarray:
    """Length of each vector from each start dimension on."""
    return np.sqrt(np.array([(matrix[s:] ** 2).sum(0) for s in starts]))


def _best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, missing, -scores))[:k]


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        lengths = [
            max((len(v) for v in t.column("vector").to_pylist()), default=0) for t in (queries, candidates)
        ]
        dimensions = max(*lengths, 1)
        q, c = _matrix(queries.column("vector"), dimensions), _matrix(candidates.column("vector"), dimensions)
        order = np.argsort(-(c**2).sum(1), kind="stable")
        q, c = q[order], c[order]
        rows = candidates.column("row").to_numpy()
        missing = candidates.column("id").is_null().to_numpy()
        ids = candidates.column("id").fill_null(0).to_numpy()
        query_rows = queries.column("row").to_numpy()
        exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dimensions < _EXACT
        starts = list(range(0, dimensions, _DIMENSIONS)) + [dimensions]
        q_rest, c_rest = _remaining(q, starts), _remaining(c, starts)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for i in range(q.shape[1]):
            alive = np.flatnonzero(rows != query_rows[i])
            if not exact:
                whole = [int(v) for v in q[:, i]]
                sums = [sum(a * int(b) for a, b in zip(whole, c[:, j], strict=True)) for j in alive]
                total = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=object)
                top = sorted(range(len(alive)), key=lambda j: (-total[j], missing[alive[j]], ids[alive[j]]))[:k]
                found.append((alive[top], total[top].astype(np.int64), i))
                continue
            part = np.zeros(len(alive))
            for b, (start, stop) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                part += q[start:stop, i] @ c[start:stop, alive]
                if len(alive) > k and stop < dimensions:
                    reach = q_rest[b + 1, i] * c_rest[b + 1, alive]
                    reach += 1e-9 * reach + 0.25  # room for the rounding of the lengths
                    low = part - reach
                    floor = np.partition(low, len(low) - k)[len(low) - k]
                    stay = part + reach >= floor
                    if not stay.all():
                        alive, part = alive[stay], part[stay]
            top = _best(part, ids[alive], missing[alive], k)
            found.append((alive[top], part[top].astype(np.int64), i))
        if not found:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query", "query_id", "id", "score")})
        at = np.concatenate([f[0] for f in found]).astype(np.int64)
        whose = np.concatenate([np.full(len(f[0]), f[2]) for f in found]).astype(np.int64)
        return pa.table(
            {
                "query": queries.column("row").take(pa.array(whose)),
                "query_id": queries.column("id").take(pa.array(whose)),
                "id": candidates.column("id").take(pa.array(at)),
                "score": np.concatenate([f[1] for f in found]).astype(np.int64),
            }
        )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), id and score of the k largest inner products of each query.

    ``vectors`` holds whole numbers as doubles (``integer_vectors``). Runs jobs.
    """
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = freeze(base, "vectors")
    count = base.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    q_blocks = -(-count["asking"] // _QUERIES) or 1
    c_blocks = -(-count["all"] // _CANDIDATES) or 1

    def blocks(of: Column, many: int) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(many)).cast("int")

    def every(many: int) -> Column:
        return F.explode(F.array(*map(F.lit, range(many))) if many < 64 else F.sequence(F.lit(0), F.lit(many - 1)))

    queries = base.where("asks").select(
        "row", "id", "vector", blocks(F.col("row"), q_blocks).alias("q"), every(c_blocks).alias("c")
    )
    candidates = base.select(
        "row", "id", "vector", every(q_blocks).alias("q"), blocks(F.col("row"), c_blocks).alias("c")
    )
    tasks = max(width(base.sparkSession), q_blocks * c_blocks)
    near = (
        queries.repartition(tasks, "q", "c")
        .groupBy("q", "c")
        .cogroup(candidates.repartition(tasks, "q", "c").groupBy("q", "c"))
        .applyInArrow(_cell(k), "query long, query_id long, id long, score long")
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
