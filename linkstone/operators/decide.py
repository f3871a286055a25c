"""Decisions: assignment, threshold and weight grids, blending, cascades, expected F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstone.functions.similarity import f_half


def cut_candidates(pairs: DataFrame, top: int = 12, side: int = 3) -> DataFrame:
    """Pairs in the first places, with brank numbered again by score."""
    kept = pairs.where((F.col("brank") < top) | ((F.col("rank_n") < side) & (F.col("sn") > 0)) | ((F.col("rank_a") < side) & (F.col("sa") > 0)))
    return kept.withColumn("brank", (F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("sc"), "cand")) - 1).cast("int"))


def assign(scored: DataFrame, threshold: float, one_to_one: bool = True) -> DataFrame:
    """Pairs with p at the threshold or above, each candidate only for its best query (ties: smaller s1)."""
    kept = scored.where(F.col("p") >= threshold)
    if not one_to_one:
        return kept
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("cand").orderBy(F.desc("p"), "s1"))).where("_r = 1").drop("_r")


def rescale_unseen(p: Column, threshold: float, unseen: float) -> Column:
    """Probabilities of countries no model was trained on, so that their own threshold falls on the common one."""
    return F.least(p * F.lit(threshold) / F.lit(unseen), F.lit(0.999))


def grid_f_half(scored: DataFrame, gold: DataFrame, queries: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, f): macro F0.5 over all ``queries`` (s1) at each threshold.

    ``scored`` (s1, cand, p), ``gold`` (s1, cand).  A candidate goes to its best query at any threshold,
    so each pair is kept up to a threshold of its own and one pass serves the whole grid.
    """
    best = assign(scored, float("-inf"))
    gold_n = gold.groupBy("s1").agg(F.count(F.lit(1)).alias("gold"))
    hits = best.join(gold.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left")
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    per = hits.select("s1", "hit", F.explode(F.filter(grid, lambda t: t <= F.col("p"))).alias("threshold")).groupBy("s1", "threshold").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("predicted"))
    every = queries.select("s1").withColumn("threshold", F.explode(grid))
    rows = every.join(per, ["s1", "threshold"], "left").join(gold_n, "s1", "left").fillna(0)
    return rows.groupBy("threshold").agg(F.round(F.avg(F.expr(f_half("tp", "predicted", "gold"))), 6).alias("f"))


def best_threshold(grid: DataFrame) -> float:
    """The smallest threshold of the largest F0.5."""
    return grid.orderBy(F.desc("f"), "threshold").first()["threshold"]


def blend(scored: DataFrame, columns: list[str], weight: float, base: str = "p") -> DataFrame:
    """Adds ce, the mean of the scores that are there (the base score if none is), and blend."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).otherwise(F.col(base))
    return scored.withColumn("ce", F.round(mean, 8)).withColumn("blend", F.round(F.lit(weight) * F.col(base) + F.lit(1 - weight) * mean, 8))


def subset_weight_grid(scored: DataFrame, gold: DataFrame, queries: DataFrame, columns: list[str], weights: list[float], thresholds: list[float]) -> DataFrame:
    """(subset, weight, threshold, f) over the subsets of score columns that hold the first one."""
    from itertools import combinations

    rest, out = columns[1:], None
    for n in range(len(rest) + 1):
        for chosen in combinations(rest, n):
            for w in weights:
                tried = blend(scored, [columns[0], *chosen], w).select("s1", "cand", F.col("blend").alias("p"))
                rows = grid_f_half(tried, gold, queries, thresholds).select(F.lit("+".join([columns[0], *chosen])).alias("subset"), F.lit(float(w)).alias("weight"), "threshold", "f")
                out = rows if out is None else out.unionByName(rows)
    return out


def uncertain(scored: DataFrame, band: float = 0.002, limit: int | None = None) -> DataFrame:
    """Pairs a larger model should see: min(p, 1-p) above the band, the ``limit`` least certain if given."""
    out = scored.withColumn("uncertainty", F.round(F.least("p", 1 - F.col("p")), 6)).where(F.col("uncertainty") > band)
    return out if limit is None else out.orderBy(F.desc("uncertainty"), "s1", "cand").limit(limit)


def new_pairs(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    return pairs.join(scored.select("s1", "cand").distinct(), ["s1", "cand"], "left_anti")


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """(s1, cand, split): one list of pairs for an outside model, each named by the part it came from."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [pairs.select("s1", "cand", F.lit(name).alias("split")) for name, pairs in parts.items()])


def expected_f_subset(scored: DataFrame) -> DataFrame:
    """Pairs of each query's best set by expected F0.5; none where no set beats the chance that nothing matches."""
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "cand")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy("s1")
    rows = scored.withColumn("k", F.row_number().over(w)).withColumn("sum_k", F.sum("p").over(run)).withColumn("total", F.sum("p").over(all_)).withColumn("none", F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))).over(all_)))
    rows = rows.withColumn("gain", F.round(1.25 * F.col("sum_k") / (0.25 * F.col("total") + F.col("k")), 9))
    rows = rows.withColumn("best", F.max("gain").over(all_))
    rows = rows.withColumn("cut", F.min(F.when(F.col("gain") == F.col("best"), F.col("k"))).over(all_))
    return rows.where((F.col("k") <= F.col("cut")) & (F.col("best") > F.round("none", 9))).select("s1", "cand", "p", "k")


def odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return F.log(q / (1 - q))
