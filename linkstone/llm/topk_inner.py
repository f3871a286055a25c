"""Exact top-k inner products over norm-sorted blocks.

Vectors are sorted by descending length and packed in blocks.  The axes are those of the SVD of all
vectors (of their Gram matrix, summed in the cluster; its size is that of the dimension only), so
the first of them hold most of each product.  Each query first gets a threshold from the longest
vectors.  As blocks are in order of length, the threshold tells up to which block |q| |x| can reach
it for any query of a query block; the blocks after that are never sent to it.  In a block the
partial product on the first axes plus the product of the residual lengths (Cauchy-Schwarz) bounds
every score.  Only vectors whose bound reaches the threshold are multiplied out, in integers, and
the k best so far raise the threshold for the blocks that follow.

Defined results: vectors that are null or have null or non-finite components take no part; shorter
vectors count as filled with zeros; scores that tie go to the smaller id; rows that repeat an id are
never candidates for that id's query, and else count as often as they are there; with fewer candidates than k all are returned; scores beyond
64 bits are not supported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import stash, table
from linkstone.llm.vectors import against, best, blocks, matrix, numbered, valid, width_of

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def gram(df: DataFrame, width: int) -> np.ndarray:
    """Sum of the vectors' outer products, from a partial sum of each task."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for i, j, v in df.select("vector").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of the rows; through doubles where they are exact."""
    limit = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0))
    if limit < 2**52:
        return np.rint(q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(vectors: DataFrame, is_query: Column, k: int, *, head: int | None = None, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer ``vectors`` (id, vector array<double> of whole numbers)."""
    rows = vectors.where(valid(F.col("vector"))).select(F.col("id").cast("long").alias("id"), "vector", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    rows = stash(rows, "topk-vectors")
    width = width_of(rows, "vector")
    if not width:
        width = 1
    first = head or max(1, width // 4)
    values, axes = np.linalg.eigh(gram(rows, width))
    axes = axes[:, np.argsort(-values)]

    spread, n_candidates = numbered(rows, block, "_")
    ordered = spread.drop("_").repartitionByRange(n_candidates, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    candidates = stash(blocks(ordered, width, block).withColumn("cpart", F.spark_partition_id()), "topk-blocks")
    # the longest vectors: one block, so bounded by its size
    lead = candidates.orderBy(F.desc("norm")).limit(1).collect()
    lead_ids, lead_data = (np.frombuffer(lead[0]["ids"], np.int64), np.frombuffer(lead[0]["data"]).reshape(-1, width)) if lead else (np.zeros(0, np.int64), np.zeros((0, width)))

    # a number for each block; the greatest length from each block on
    lengths = dict(candidates.groupBy("cpart").agg(F.max("norm")).collect())
    ahead = np.maximum.accumulate([lengths.get(c, 0.0) for c in range(max(lengths, default=-1), -1, -1)] or [0.0])[::-1]

    asked, n_queries = numbered(rows.where(is_query), query_block, "qpart")
    packed = blocks(asked.repartition(n_queries, "qpart"), width, query_block)

    def thresholds(batches):
        for block in (batch.slice(n, 1) for batch in batches for n in range(batch.num_rows)):
            q = np.frombuffer(block.column("data")[0].as_py()).reshape(-1, width)
            ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
            least = np.full(len(ids), -np.inf)
            for at in range(0, len(ids) if len(lead_ids) > k else 0, 256):
                part = slice(at, at + 256)
                scores = exact(q[part], lead_data).astype(float)
                scores[ids[part, None] == lead_ids[None, :]] = -np.inf
                least[part] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            # the length a vector needs to reach the threshold of any query of the block
            norm = np.sqrt((q * q).sum(1))
            need = np.where(least <= 1e-6, -np.inf, (least - 1e-6) / np.maximum(norm * (1 + 1e-6), 1e-300)).min()
            last = max(0, int(np.searchsorted(-ahead, -need, "right")) - 1)
            yield pa.RecordBatch.from_arrays([*block.columns[1:], pa.array([least.tobytes()], pa.binary()), pa.array([last], pa.int32())], names=["low_q", "qids", "qdata", "least", "last"])

    queries = packed.mapInArrow(thresholds, "low_q double, qids binary, qdata binary, least binary, last int").withColumn("qpart", F.pmod(F.spark_partition_id(), F.lit(n_queries)))
    queries = stash(queries, "topk-queries")

    def start(pair: pa.RecordBatch) -> dict:
        field = lambda name, kind=np.float64: np.frombuffer(pair.column(name)[0].as_py(), kind)
        q, none = field("qdata").reshape(-1, width), np.zeros(0, np.int64)
        return {"q": q, "norm": np.sqrt((q * q).sum(1)), "axes": q @ axes, "ids": field("qids", np.int64), "least": field("least").copy(), "found": (none, none, none)}

    def kernel(state: dict, pair: pa.RecordBatch) -> None:
        field = lambda name, kind=np.float64: np.frombuffer(pair.column(name)[0].as_py(), kind)
        x, ids, longest = field("data").reshape(-1, width), field("ids", np.int64), pair.column("norm")[0].as_py()
        slack = 1e-6 * (1 + state["norm"] * longest)
        live = np.flatnonzero(state["norm"] * longest + slack >= state["least"])
        if not len(live):
            return
        q, least, qids, slack, q_axes = (a[live] for a in (state["q"], state["least"], state["ids"], slack, state["axes"]))
        x_axes = x @ axes
        q_rest, x_rest = np.sqrt((q_axes[:, first:] ** 2).sum(1)), np.sqrt((x_axes[:, first:] ** 2).sum(1))
        out = [state["found"]]
        for at in range(0, len(x), 1024):
            tile = slice(at, at + 1024)
            bound = q_axes[:, :first] @ x_axes[tile, :first].T + q_rest[:, None] * x_rest[None, tile]
            open_ = (bound + slack[:, None] >= least[:, None]) & (qids[:, None] != ids[None, tile])
            rows_, cols = np.nonzero(open_)
            if len(rows_) * 8 > open_.size or state["norm"].max() * longest >= 2**52:
                scores = exact(q, x[tile])[rows_, cols]
            else:
                scores = np.rint((q[rows_] * x[tile][cols]).sum(1)).astype(np.int64)
            kept = scores >= least[rows_]
            out.append((live[rows_[kept]], ids[tile][cols[kept]], scores[kept]))
        rows_, found, scores = (np.concatenate(part) for part in zip(*out, strict=True))
        order = np.lexsort((found, -scores, rows_))
        rows_, found, scores = rows_[order], found[order], scores[order]
        place = np.arange(len(rows_)) - np.searchsorted(rows_, rows_)
        kth = place == k - 1
        state["least"][rows_[kth]] = np.maximum(state["least"][rows_[kth]], scores[kth])
        top = place < k
        state["found"] = rows_[top], found[top], scores[top]

    def finish(state: dict) -> pa.RecordBatch:
        rows_, found, scores = state["found"]
        return pa.RecordBatch.from_arrays([pa.array(state["ids"][rows_]), pa.array(found), pa.array(scores)], schema=_FOUND)

    found = against(queries, candidates, start, kernel, finish, "query_id long, vec_id long, score long")
    return best(found, k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    whole = table(spark, sf_dir, "embeddings").where(valid(F.col("embedding")))
    vectors = whole.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(64) * x.cast("double")).cast("double")).alias("vector"))
    return search(vectors, F.col("id") % 20 == 0, 20)


OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
