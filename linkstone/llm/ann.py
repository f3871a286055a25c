"""Approximate nearest neighbours by score-aware anisotropic quantisation.

A vector is split in pairs of components and each pair coded by one of 16 centres, so a code has four
bits.  Centres and codes are chosen for the products with queries that matter: of the quantisation
error the part parallel to the vector weighs ``eta`` times the part across it.  Scanning is by
tables: a query's products with the centres, two codes to a table of 256 entries, are summed over
the code bytes, and with the vector's exact squared length they give the distance in rank.  The
``rerank`` best of each query are measured exactly on the original vectors first.

No number of reranked vectors is enough for all rows: a group closer together than the codes can
tell has one code and no order.  So every other vector has a bound: it is no nearer than its coded
form, less the distance between the two, which is kept with the code.  Whatever is not beyond the
k nearest measured so far by that bound is measured too, so the codes only save work and never
lose a neighbour.  Vectors without structure are mostly measured; well coded ones hardly.

Equal vectors are indexed once, with the k + 1 smallest of their ids, so copies take one place
however many there are, and all the ids an exact answer can need come with it.

Centres are fitted on a sample of at most ``sample`` vectors (those with the smallest hashes); every
distinct vector is indexed and scanned for every query.

Defined results: vectors that are null, zero or have null or non-finite components take no part;
shorter vectors count as filled with zeros; equal distances go to the smaller id; rows that repeat
an id are never candidates for that id's query, which is asked with the smallest of their vectors,
and count once as candidates, by the nearest of them; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import stash, table
from linkstone.llm.vectors import against, best, blocks, matrix, numbered, valid, width_of

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float64())])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def choose(x: np.ndarray, centres: np.ndarray, eta: float, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """Codes of the vectors (n, parts): coordinate descent on the anisotropic loss."""
    n, parts = len(x), len(centres)
    pairs, along = x.reshape(n, parts, 2), _unit(x).reshape(n, parts, 2)
    if codes is None:
        codes = np.stack([((pairs[:, j, None, :] - centres[j][None]) ** 2).sum(2).argmin(1) for j in range(parts)], 1)
    error = ((pairs - centres[np.arange(parts)[None], codes]) * along).sum(2)
    total = error.sum(1)
    for _ in range(rounds):
        for j in range(parts):
            rest = pairs[:, j, None, :] - centres[j][None]
            parallel = (total - error[:, j])[:, None] + (rest * along[:, j, None, :]).sum(2)
            codes[:, j] = ((eta - 1) * parallel**2 + (rest**2).sum(2)).argmin(1)
            new = parallel[np.arange(n), codes[:, j]]
            error[:, j] += new - total
            total = new
    return codes


def train(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres (parts, 16, 2): coding and weighted least squares by turns."""
    n, parts = len(x), x.shape[1] // 2
    pairs, along = x.reshape(n, parts, 2), _unit(x).reshape(n, parts, 2)
    pick = np.random.default_rng(seed)
    centres = np.stack([pairs[pick.choice(n, 16, replace=n < 16), j] for j in range(parts)])
    codes = None
    for turn in range(rounds):
        weight = 1.0 if turn < rounds // 2 else eta
        codes = choose(x, centres, weight, None if weight == 1.0 else codes, 0 if weight == 1.0 else 1)
        error = ((pairs - centres[np.arange(parts)[None], codes]) * along).sum(2)
        total = error.sum(1)
        for j in range(parts):
            u, goal = along[:, j], (total - error[:, j]) + (pairs[:, j] * along[:, j]).sum(1)
            left, right = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(left, codes[:, j], (weight - 1) * u[:, :, None] * u[:, None, :] + np.eye(2))
            np.add.at(right, codes[:, j], (weight - 1) * u * goal[:, None] + pairs[:, j])
            used = left[:, 0, 0] > 0
            centres[j, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            new = ((pairs[:, j] - centres[j][codes[:, j]]) * u).sum(1)
            total += new - error[:, j]
            error[:, j] = new
    return centres


def tables(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(code bytes, queries, 256): products of the queries with both centres a code byte names."""
    products = np.einsum("qjd,jcd->jqc", q.reshape(len(q), len(centres), 2), centres)
    return (products[0::2, :, None, :] + products[1::2, :, :, None]).reshape(len(centres) // 2, len(q), 256).astype(np.float32)


def distinct(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(id, vector, norm, ids): each vector once, filled to ``width``, with the ``most`` smallest of its ids and the first of them as its own."""
    padded = rows.select("id", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))).alias("vector"))

    def fewer(batches):
        # of each batch only the smallest ids of a vector are sent: a large group is no large group then
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.ascontiguousarray(matrix(batch.column("vector"), width) + 0.0)  # -0.0 is 0.0
            _, kind = np.unique(x.view(np.dtype((np.void, x.itemsize * width))).ravel(), return_inverse=True)
            order = np.lexsort((ids, kind))
            kind, sorted_ids = kind[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])
            order, kind = order[new], kind[new]
            place = np.arange(len(kind)) - np.searchsorted(kind, kind)
            yield batch.take(pa.array(order[place < most]))

    some = padded.mapInArrow(fewer, padded.schema)
    held = some.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids"))
    return stash(held.select(F.col("ids")[0].alias("id"), "vector", F.lit(0.0).alias("norm"), "ids"), "ann-distinct")


def smallest(near: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the places of the n smallest of each row, of equal ones the first."""
    cut = np.partition(near, n - 1, axis=1)[:, n - 1 : n]
    below, level = near < cut, near == cut
    room = n - below.sum(1, keepdims=True)
    return np.nonzero(below | (level & (level.cumsum(1) <= room)))[1].reshape(len(near), n)


def measured(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row of q, at of x), both given by components, summed in their order."""
    total = np.zeros(len(row))
    for j in range(len(q)):
        total += (q[j, row] - x[j, at]) ** 2
    return np.sqrt(total)


def nearest(rows: tuple, k: int) -> tuple:
    """Of (row, near, id) columns the k nearest of each row, ties to the smaller id, and their places from 0."""
    order = np.lexsort((rows[2], rows[1], rows[0]))
    row, near, ids = (c[order] for c in rows)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], near[place < k], ids[place < k], place[place < k]


def search(vectors: DataFrame, is_query: Column, k: int, *, threshold: float = 0.2, rerank: int = 400, sample: int = 16384, block: int = 16384, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest, by Euclidean distance, of ``vectors`` (id, vector array<double>)."""
    some = F.exists("vector", lambda x: x != 0)
    rows = stash(vectors.where(valid(F.col("vector")) & some).select(F.col("id").cast("long").alias("id"), "vector", F.lit(0.0).alias("norm")), "ann-vectors")
    width = -(-max(1, width_of(rows, "vector")) // 4) * 4
    apart = distinct(rows, width, k + 1)
    # vectors that share an id count once: so many nearest vectors have k ids beside the query's own
    repeats = rows.groupBy("id").agg(F.count_distinct(F.xxhash64("vector")).alias("n")).agg(F.max("n")).first()[0] or 1
    keep = (k + 1) * repeats
    # blocks travel with their vectors: at most 32 MB of candidates and 8 MB of queries
    block, query_block = min(block, max(256, (1 << 22) // width)), min(query_block, max(256, (1 << 20) // width))
    # at most ``sample`` vectors, whatever the table's size
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    fitted = matrix(taken, width) if len(taken) else np.zeros((1, width))
    eta = max(1.0, (width - 1) * threshold**2 / (1 - threshold**2))
    centres = train(fitted, eta)

    def code(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= block:
                yield packed(held)
                held, many = [], 0
        if many:
            yield packed(held)

    def packed(held):
        part = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        x = matrix(part.column("vector").combine_chunks(), width)
        codes = choose(x, centres, eta).astype(np.uint8)
        coded = centres[np.arange(len(centres))[None], codes].reshape(len(x), width)
        paired = np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)
        squares, short = np.stack([(x * x).sum(1), (coded * coded).sum(1), np.sqrt(((x - coded) ** 2).sum(1))]), x.astype(np.float32)
        columns = [part.column("id").to_numpy(), paired, squares, part.column("alone").to_numpy(), short if (short == x).all() else x]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "codes", "squares", "alone", "data"])

    spread, n_candidates = numbered(apart, block, "part")
    index = spread.repartition(n_candidates, "part").select("id", "vector", (F.size("ids") == 1).alias("alone")).mapInArrow(code, "ids binary, codes binary, squares binary, alone binary, data binary").withColumn("cpart", F.pmod(F.spark_partition_id(), F.lit(n_candidates)))
    questions = stash(rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"), F.first("norm").alias("norm")), "ann-asked")
    asked, n_queries = numbered(questions, query_block, "part")
    queries = blocks(asked.repartition(n_queries, "part"), width, query_block).select(F.col("ids").alias("qids"), F.col("data").alias("qdata")).withColumn("qpart", F.pmod(F.spark_partition_id(), F.lit(n_queries))).withColumn("last", F.lit(n_candidates - 1))
    queries = stash(queries, "ann-queries")

    def start(pair: pa.RecordBatch) -> dict:
        qids, q = np.frombuffer(pair.column("qids")[0].as_py(), np.int64), np.frombuffer(pair.column("qdata")[0].as_py()).reshape(-1, width)
        return {"ids": qids, "q": q, "best": [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * -(-len(q) // 64)}

    def kernel(state: dict, pair: pa.RecordBatch) -> None:
        """The nearest of each query so far and of this block."""
        field = lambda name, kind=np.float64: np.frombuffer(pair.column(name)[0].as_py(), kind)
        ids, alone = field("ids", np.int64), field("alone", bool)
        codes, (squares, coded, error) = field("codes", np.uint8).reshape(-1, len(ids)), field("squares").reshape(3, -1)
        raw = pair.column("data")[0].as_py()
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * width * len(ids) else np.float64).astype(np.float64).reshape(-1, width)
        across = np.ascontiguousarray(x.T)
        for part in range(len(state["best"])):
            here = slice(64 * part, 64 * part + 64)
            q, lookup = state["q"][here], tables(state["q"][here], centres)
            total = np.zeros((len(q), len(ids)), np.float32)
            for byte in range(len(codes)):
                total += lookup[byte][:, codes[byte]]
            # a vector that only the query's own id has is no candidate
            own = alone[None, :] & (ids[None, :] == state["ids"][here, None])
            near = squares[None, :] - 2.0 * total
            near[own | np.isnan(near)] = np.inf
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, smallest(near, min(max(rerank, keep), len(ids))), True, 1)

            def add(some: np.ndarray, part=part, q=q) -> tuple:
                row, at = np.nonzero(some)
                found = row, measured(np.ascontiguousarray(q.T), across, row, at), ids[at]
                return nearest(tuple(np.concatenate(both) for both in zip(state["best"][part], found, strict=True)), keep)

            row, far, known, place = add(first & ~own)
            state["best"][part] = row, far, known
            reach = np.full((len(q), 1), np.inf)
            reach[row[place == keep - 1], 0] = far[place == keep - 1] * (1 + 1e-9)
            # the table's sums are in single precision; what they may be off by is taken off the bound
            q2 = (q * q).sum(1)[:, None]
            least = q2 + coded[None, :] - 2.0 * total - (len(codes) + 8) * 2.0**-21 * np.sqrt(q2 * coded[None, :])
            rest = ~(np.sqrt(np.maximum(least, 0)) - error[None, :] > reach) & ~first & ~own
            some = np.flatnonzero(rest.any(0))
            if len(some):
                # products of whole matrices leave few of them to be measured in order
                exact = q2 + squares[None, some] - 2.0 * (q @ x[some].T)
                room = (width + 8) * 2.0**-50 * (q2 + squares[None, some])
                rest[:, some] &= ~(exact - room > reach**2)
                state["best"][part] = add(rest)[:3]

    def finish(state: dict) -> pa.RecordBatch:
        query = np.concatenate([state["ids"][64 * part + best[0]] for part, best in enumerate(state["best"])])
        near, found = (np.concatenate([best[c] for best in state["best"]]) for c in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(near)], schema=_FOUND)

    scanned = against(queries, index, start, kernel, finish, "query_id long, vec_id long, near double")
    chosen = best(scanned, keep, F.asc("near"), F.asc("vec_id")).select("query_id", F.col("vec_id").alias("kept"), F.col("near").alias("score"))
    each = chosen.join(apart.select(F.col("id").alias("kept"), "vector", "ids"), "kept").join(questions.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    each = each.select("query_id", F.sqrt(F.aggregate(F.zip_with("q", "vector", lambda a, b: F.pow(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 2)), F.lit(0.0), lambda s, y: s + y)).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # of rows that repeat an id, the nearest
    return best(each, k, F.asc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(vectors, F.col("id") % 100 == 0, 10)
