"""Operator 2: exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers floor(256 x). Candidates are dealt into blocks; in each, every dimension has
the list of its vectors in order of value. A query reads the lists from the end that its own component
favours, scores each vector when it is first met, and stops when the best score that an unmet vector
could still have is below its k-th score: equal is not enough, since a smaller id would win the tie.
Every (query block, candidate block) is one group of bounded size, and the k best of each block are
merged per query.

A vector that is null, empty or holds a null or non-finite component takes no part; vectors of
different lengths are never compared. A row is not a candidate of queries with its own id; rows that
share an id are each a candidate of other ids, and as queries their results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import pinned, table

K = 5
SCALE = 256.0
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 8192
QUERY_STEP = 50


def usable(embedding: Column) -> Column:
    """True if the vector is present, not empty and all its components are finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def threshold_topk(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best vectors of each query; all values are integers."""
    n, width = vectors.shape
    exact = max(np.abs(vectors).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * width < 2**53
    if not exact:  # beyond what doubles hold: Python's integers
        vectors, queries = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (vectors, queries))
    down = np.argsort(-vectors.astype(np.float64), axis=0, kind="stable").astype(np.int32)
    values = np.take_along_axis(vectors, down, axis=0)
    found = []
    for q, query_id in zip(queries, query_ids.tolist()):
        used = np.flatnonzero(q != 0)
        rising = q[used] < 0
        met = np.zeros(n, bool)
        own = ids == query_id
        at, depth = np.zeros(0, np.int64), 0
        scores = np.zeros(0, vectors.dtype)
        while depth < n:
            to = min(n, max(16, depth * 2))
            if len(used):
                heads = np.where(rising, down[n - to : n - depth, used][::-1], down[depth:to, used])
                now = met.copy()
                now[heads.ravel()] = True
                new = np.flatnonzero(now & ~met & ~own)
                met = now
            else:  # every score is 0: ties go by id
                new, to = np.flatnonzero(~own), n
            depth = to
            at, scores = np.append(at, new), np.append(scores, vectors[new] @ q)
            if len(at) > k:
                best = np.lexsort((ids[at], -scores.astype(np.float64) if exact else [-x for x in scores]))[:k]
                at, scores = at[best], scores[best]
            if len(at) == k and len(used):
                edge = np.where(rising, values[n - depth, used], values[depth - 1, used])
                if min(scores) > edge @ q[used]:
                    break
        found += [(query_id, int(ids[i]), max(-(2**63), min(2**63 - 1, int(s)))) for i, s in zip(at, scores)]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `vectors` (vec_id, embedding) that `is_query` marks."""
    whole = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.size("embedding").alias("width"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    whole = pinned(whole.where("vec_id is not null"))
    counts = whole.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, query_blocks = max(1, -(-counts.n // CANDIDATE_BLOCK)), max(1, -(-counts.q // QUERY_BLOCK))
    spot = lambda n, salt: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = whole.select("vec_id", "embedding", "width", spot(blocks, 1).alias("c"), every(query_blocks).alias("q"))
    queries = whole.where("is_query").select("vec_id", "embedding", "width", spot(query_blocks, 2).alias("q"), every(blocks).alias("c"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            ints = lambda t: np.floor(SCALE * matrix(t.column("embedding"), width))
            rows = threshold_topk(ints(left), left.column("vec_id").to_numpy(), ints(right), right.column("vec_id").to_numpy(), k)
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    keys = ["width", "c", "q"]
    parts = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
