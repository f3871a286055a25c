"""The candidate pool: query expansion, context on both sides of a pair, and the global budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstone.operators.blocking import best_postings, key_rows, key_weights, postings, ranks, with_keys
from linkstone.sources.stages import staged


def _top(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("_r") <= k).drop("_r")


def expand(pool: DataFrame, rec: DataFrame, lists: DataFrame, n_seed: int = 3, n_exp: int = 5, hits: int = 10) -> DataFrame:
    """Neighbours of each query's best candidates join the pool.

    The first ``n_seed`` candidates are queries in the candidate index (``lists``: its postings); of
    each one's ``hits`` best (itself among them, then left out) a query gets esc, the best score, and
    en, the seeds that found it.  Pairs already in the pool get both; of the others the ``n_exp`` best
    come in with from_exp 1.
    """
    seeds = _top(pool, "s1", "sc", n_seed, "cand").select("country", "s1", F.col("cand").alias("seed"))
    asked = rec.where("src > 1").join(seeds.select("country", F.col("seed").alias("entity_id")).distinct(), ["country", "entity_id"], "left_semi")
    near = best_postings(key_rows(asked), lists, hits, 0, "near").select("country", F.col("s1").alias("seed"), F.col("cand"), F.col("sc").alias("s")).where("seed <> cand")
    found = seeds.join(near, ["country", "seed"]).select("country", "s1", "cand", F.col("s").alias("_s"))
    # dealt by s1 once: what is in the pool and what the neighbours found meet there, and all places of a query are taken there
    own = [c for c in pool.columns if c not in ("country", "s1", "cand")]
    rows = pool.withColumn("_s", F.lit(None).cast("double")).unionByName(found, allowMissingColumns=True).repartition("s1")
    kept = [F.first(c, ignorenulls=True).alias(c) for c in own]
    both = rows.groupBy("country", "s1", "cand").agg(*kept, F.max("_s").alias("esc"), F.count("_s").cast("int").alias("en"), F.max(F.col("_s").isNull()).alias("_in"))
    both = both.withColumn("from_exp", F.when(F.col("_in"), 0).otherwise(1)).drop("_in").fillna(0)
    place = F.row_number().over(Window.partitionBy("s1", "from_exp").orderBy(F.desc("esc"), "cand"))
    return both.withColumn("_r", place).where((F.col("from_exp") == 0) | (F.col("_r") <= n_exp)).drop("_r")


def query_context(pool: DataFrame) -> DataFrame:
    """Adds b_rel, b_gap, n_pool and the places brank, rank_n, rank_a, erank within a query's pool."""
    w = Window.partitionBy("s1")
    most = F.max("sc").over(w)
    out = ranks(pool).withColumn("b_rel", F.round(F.col("sc") / F.greatest(most, F.lit(1e-6)), 6)).withColumn("b_gap", F.round(most - F.col("sc"), 6))
    out = out.withColumn("n_pool", F.count(F.lit(1)).over(w).cast("int"))
    return out.withColumn("erank", (F.row_number().over(w.orderBy(F.desc("esc"), "cand")) - 1).cast("int")) if "esc" in pool.columns else out


def competition(pool: DataFrame) -> DataFrame:
    """Adds c_nq, c_rank, c_gap: how many queries claim a candidate, this one's place, and its lead over the best other."""
    w = Window.partitionBy("cand")
    by = w.orderBy(F.desc("sc"), "s1")
    out = pool.withColumn("c_nq", F.count(F.lit(1)).over(w).cast("int")).withColumn("c_rank", (F.row_number().over(by) - 1).cast("int"))
    first = F.max("sc").over(w)
    second = F.max(F.when(F.col("c_rank") == 1, F.col("sc"))).over(w)
    other = F.when(F.col("sc") == first, F.coalesce(second, F.col("sc"))).otherwise(first)
    return out.withColumn("c_gap", F.round(F.when(F.col("c_nq") == 1, F.lit(0.0)).otherwise(F.col("sc") - other), 6))


def build(rec: DataFrame, max_df: int = 300, top: int = 30, side: int = 3, n_seed: int = 3, n_exp: int = 5) -> DataFrame:
    """The whole pool of all countries.

    The records' keys, the postings and the direct pool are used more than once; they are stage tables,
    as are the seeds' neighbours.
    """
    rec = staged(with_keys(rec).select("country", "entity_id", "src", "keys"), "keys")
    keys = key_rows(rec)
    candidates = keys.where("src > 1")
    weights = key_weights(candidates, rec.where("src > 1"))
    lists = staged(postings(candidates, weights.where(F.col("df") <= max_df)), "postings")
    direct = best_postings(keys.where("src = 1"), lists, top, side, "direct")
    return competition(query_context(expand(direct, rec, lists, n_seed, n_exp)))


def nth_highest(values: DataFrame, n: int, bins: int = 4096) -> float | None:
    """The n-th highest of values (v, many: how often each is there), or None if there are fewer.

    A histogram of ``bins`` equal bins tells the bin it is in, whose range is divided again until the
    bin has one value: some rounds over distributed counts, each of which sends ``bins`` rows.
    """
    ends = values.agg(F.min("v"), F.max("v"), F.sum("many")).first()
    if ends[2] is None or ends[2] < n:
        return None
    low, high = ends[0], ends[1]
    while low < high:
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * bins))
        inside = values.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        for row in sorted(inside.groupBy(place.alias("b")).agg(F.sum("many"), F.min("v"), F.max("v")).collect(), reverse=True):
            if row[1] >= n:
                low, high = row[2], row[3]
                break
            n -= row[1]
    return low


def placed(pairs: DataFrame, score: str) -> DataFrame:
    """Adds _r, a pair's place from 1 among its query's."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc(score), "cand")))


def cut(places: DataFrame, score: str, budget: float, min_keep: int = 1) -> DataFrame:
    """``select`` of pairs that have their places (_r)."""
    ranked = places.where(F.col("_r") <= int(2 * budget + 5))
    queries, forced = ranked.agg(F.sum((F.col("_r") == 1).cast("int")), F.sum((F.col("_r") <= min_keep).cast("int"))).first()
    values = ranked.where(F.col("_r") > min_keep).groupBy(F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("many")).persist()
    least = nth_highest(values, max(1, int(budget * (queries or 0)) - (forced or 0)))
    values.unpersist()
    kept = ranked if least is None else ranked.where((F.col("_r") <= min_keep) | (F.col(score) >= F.lit(least)))
    return kept.withColumn("rrank", (F.col("_r") - 1).cast("int")).drop("_r")


def select(pairs: DataFrame, score: str, budget: float, min_keep: int = 1) -> DataFrame:
    """Pairs within a global budget of ``budget`` candidates a query.

    Each query's ``min_keep`` best are kept; the others compete for what is left of budget times
    queries, one place at least, and ties at the cut all stay.  A query's tail beyond twice the
    budget and five is dropped before.  The cut is one number, found by histograms: nothing is
    sorted over all pairs and no task sees more than its share.  The places are taken once.
    """
    return cut(staged(placed(pairs, score), "places"), score, budget, min_keep)
