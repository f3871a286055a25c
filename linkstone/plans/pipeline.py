"""The whole linkage as a batch job over tab-separated files, one stage table at a time.

    spark-submit linkstone/plans/pipeline.py --data DIR --work DIR --out DIR [--budget 10] [--threshold 0.65]

DIR holds {train,test}_source{1,2,3}.tsv and train_ground_truth.tsv.  A stage whose table is there is
read and not made again, so a job that was broken off goes on where it was; so are the fitted models.
Tables that depend on the budget or the threshold are kept apart by their values.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.functions.text import normalise
from linkstone.operators import decide, features, metrics, model, pool, ranker, tables
from linkstone.sources import records as io

MATCHER = ["sc", "sn", "sa", "nkeys", "brank", "rank_n", "rank_a", *features.SET_FEATURES, *features.NUMBER_FEATURES, "len_ratio_nm", "ad_empty2", "lev_nm", "lev_ad", "jw_core", "tsr_nm", "tsr_ad", "pr_nm", "sdx_cov1", "nm_sh_idf", "nm_un2_idf", "ad_sh_idf", "x2_sib_max", "x2_agree_min", "cos_c3_nm", "cos_w_core", "cos_c3_ad", "nmfreq_s1_in_c", "adkey_eq", "name_x_addr", "b_rel", "n_cand_s1", "cand_ns1", "cand_gap"]
GRID = [round(0.2 + 0.025 * k, 3) for k in range(31)]


def read_split(spark: SparkSession, data: str, split: str) -> DataFrame:
    parts = [io.read_records(spark, f"{data}/{split}_source{k}.tsv") for k in (1, 2, 3)]
    return reduce(DataFrame.unionByName, parts)


def candidates(spark: SparkSession, built: DataFrame, fitted: PipelineModel, work: str, name: str, budget: float) -> DataFrame:
    """The pool ranked by the model and cut to the global budget."""
    return io.once(spark, f"{work}/{name}_pairs", lambda: pool.select(ranker.apply(built, fitted), "rp", budget).select("country", "s1", "cand", "sc", "sn", "sa", "nkeys", "esc", "from_exp", "rp", "brank", "rank_n", "rank_a", "rrank"))


def run(spark: SparkSession, data: str, work: str, out: str, budget: float = 10.0, threshold: float | None = None) -> float:
    """Train on the train files, link the test files, write both id lists; returns the threshold."""
    gold, _ = io.read_gold(spark, f"{data}/train_ground_truth.tsv")
    rec = {s: io.once(spark, f"{work}/{s}_records", lambda s=s: normalise(read_split(spark, data, s))) for s in ("train", "test")}
    pools = {s: io.once(spark, f"{work}/{s}_pool", lambda s=s: ranker.text_features(pool.build(rec[s]), rec[s])) for s in rec}
    # fitted on the fold that no later model is trained or judged on
    fitted = io.model_once(spark, f"{work}/ranker", lambda: ranker.fit(model.split(pools["train"]).where("fold = 'table'").drop("fold"), gold))
    work = f"{work}/budget_{budget:g}"  # what follows depends on the budget
    pairs = {s: candidates(spark, pools[s], fitted, work, s, budget) for s in rec}
    labelled = model.label(model.split(features.attach(pairs["train"], rec["train"])), gold)
    extra = io.once(spark, f"{work}/extra_tokens", lambda: tables.extra_tokens(labelled.where("fold = 'table'")))
    frames = {s: io.once(spark, f"{work}/{s}_features", lambda s=s: features.all_features(pairs[s], rec[s], extra, tables.agreement(features.attach(pairs[s], rec[s])))) for s in rec}
    train = model.label(model.split(frames["train"]), gold)
    matcher = io.model_once(spark, f"{work}/matcher", lambda: model.fit_matcher(train.where("fold = 'train'"), MATCHER))
    plain = io.model_once(spark, f"{work}/regularised", lambda: model.fit_regularised(train.where("fold = 'train'"), MATCHER))
    seen = [r["country"] for r in rec["train"].select("country").distinct().collect()]
    queries = model.split(rec["train"].where("src = 1").select("country", F.col("entity_id").alias("s1"))).where("fold = 'validation'")
    if threshold is None:
        scored = model.score(train.where("fold = 'validation'"), matcher).select("s1", "cand", "p")
        threshold = decide.best_threshold(decide.grid_f_half(scored, gold.join(queries, "s1", "left_semi"), queries, GRID))
    held = model.leave_one_country_out(train.where("fold = 'train'"), gold, queries.drop("fold"), MATCHER, seen, GRID) if len(seen) > 1 else {}
    unseen = sum(t for t, _ in held.values()) / len(held) if held else 0.8
    scored = io.once(spark, f"{work}/test_scores_{threshold:g}_{unseen:g}", lambda: model.score_by_country(frames["test"], matcher, plain, seen, threshold, unseen).select("country", "s1", "cand", "p"))
    every = rec["test"].where("src = 1").select(F.col("entity_id").alias("s1"))
    io.write_id_lists(io.id_lists(decide.assign(scored, threshold), every), f"{out}/matching_results", ("source1_entity_id", "matched_entity_ids"))
    io.write_id_lists(io.id_lists(pairs["test"], every), f"{out}/candidate_pairs", ("source1_entity_id", "candidate_entity_ids"))
    return threshold


def report(spark: SparkSession, data: str, work: str, budgets: tuple[float, ...] = (8, 10, 12, 15, 20)) -> DataFrame:
    """Recall and ceiling of the train candidates by budget."""
    gold, _ = io.read_gold(spark, f"{data}/train_ground_truth.tsv")
    rec = spark.read.parquet(f"{work}/train_records")
    ranked = ranker.apply(spark.read.parquet(f"{work}/train_pool"), PipelineModel.load(f"{work}/ranker"))
    return metrics.budget_report(ranked, gold, rec.where("src = 1").select("country", F.col("entity_id").alias("s1")), "rp", list(budgets))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("data", "work", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--budget", type=float, default=10.0)
    parser.add_argument("--threshold", type=float)
    given = parser.parse_args(args)
    print(run(SparkSession.builder.getOrCreate(), given.data, given.work, given.out, given.budget, given.threshold))


if __name__ == "__main__":
    main()
