"""Registered queries of the linkage engine: one for each family of operators, over the whole record view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.functions.text import normalise
from linkstone.operators import blocking, decide, features, metrics, model, pool, ranker, tables, tfidf, validate
from linkstone.plans.oracle import ORACLE_SQL  # noqa: F401
from linkstone.plans.records import native_pairs, noisy_records, records
from linkstone.sources.records import id_lists
from linkstone.sources.stages import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GRID = [round(0.2 + 0.025 * k, 3) for k in range(31)]
SEEN = ["en", "de", "es"]
THRESHOLD = 0.65


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records, kept in memory and on disk: most queries use them several times."""
    return normalise(records(spark, sf_dir)).persist()


def _keys(rec: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = blocking.key_rows(rec)
    return keys, keys.where("src > 1"), blocking.key_weights(keys.where("src > 1"), rec.where("src > 1"))


def _ranked(rec: DataFrame, detail: bool = False) -> DataFrame:
    keys, candidates, weights = _keys(rec)
    return blocking.ranks(blocking.score_pairs(keys.where("src = 1"), candidates, weights, detail=detail))


def _pairs(rec: DataFrame) -> DataFrame:
    return blocking.side_slots(_ranked(rec))


def _scored(rec: DataFrame) -> DataFrame:
    """Pairs with a rule score in place of a model's probability."""
    return _pairs(rec).withColumn("p", F.round(F.col("sc") / (F.col("sc") + 40), 6))


def _gold(rec: DataFrame) -> DataFrame:
    return rec.where("owner IS NOT NULL").select(F.col("owner").alias("s1"), F.col("entity_id").alias("cand"))


def _queries(rec: DataFrame) -> DataFrame:
    return rec.where("src = 1").select("country", F.col("entity_id").alias("s1"))


def _attached(rec: DataFrame) -> DataFrame:
    return features.attach(_pairs(rec).select("country", "s1", "cand"), rec)


def _labelled(rec: DataFrame) -> DataFrame:
    return model.label(_attached(rec), _gold(rec))


@query
def er_records(spark, sf_dir):
    return records(spark, sf_dir)


@query
def er_normalise_name(spark, sf_dir):
    return _rec(spark, sf_dir).select("entity_id", "nm", F.array_join("core", " ").alias("core"), "has_dba")


@query
def er_normalise_address(spark, sf_dir):
    return _rec(spark, sf_dir).select("entity_id", "ad", F.array_join("nums", " ").alias("nums"), F.array_join("alph", " ").alias("alph"))


@query
def er_normalise_noisy(spark, sf_dir):
    """Names and addresses with domains, second names, acronyms, leet, accents, native script, states and ordinals."""
    out = normalise(noisy_records(spark, sf_dir))
    joined = {c: F.array_join(c, " ") for c in ("core", "nums", "alph")}
    return out.withColumns(joined).select("entity_id", "nm", "core", "is_dom", "has_dba", "ad", "nums", "alph")


@query
def er_key_catalogue(spark, sf_dir):
    return blocking.key_rows(_rec(spark, sf_dir)).select("country", "id", "src", "key")


@query
def er_key_df_idf(spark, sf_dir):
    return _keys(_rec(spark, sf_dir))[2].withColumn("idf", F.round("idf", 6))


@query
def er_block_topk(spark, sf_dir):
    return _ranked(_rec(spark, sf_dir)).where("brank < 12").select("country", "s1", "cand", "sc", "sn", "sa", "nkeys", "brank")


@query
def er_block_side_slots(spark, sf_dir):
    return _pairs(_rec(spark, sf_dir)).select("country", "s1", "cand", "sc", "sn", "sa", "nkeys", "brank", "rank_n", "rank_a")


@query
def er_block_detail(spark, sf_dir):
    """What the keys of a pair were: the largest weight and the number of each group."""
    return _ranked(_rec(spark, sf_dir), detail=True).where("brank < 12").select("s1", "cand", "maxidf", *(f"g{g}" for g in range(6)))


@query
def er_noaddr_cap(spark, sf_dir):
    return blocking.block_by_address(_rec(spark, sf_dir), max_df=20, max_df_noaddr=40).select("country", "s1", "cand", "sc", "brank")


@query
def er_query_expansion(spark, sf_dir):
    return pool.build(_rec(spark, sf_dir)).select("country", "s1", "cand", "sc", "esc", "en", "from_exp")


@query
def er_s1_context(spark, sf_dir):
    return pool.build(_rec(spark, sf_dir)).select("s1", "cand", "brank", "rank_n", "rank_a", "erank", "n_pool", "b_rel", "b_gap")


@query
def er_cand_competition(spark, sf_dir):
    return pool.build(_rec(spark, sf_dir)).select("s1", "cand", "c_nq", "c_rank", "c_gap")


@query
def er_ranker_features(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    rows = features.context(_pairs(rec)).select("country", "s1", "cand", "b_rel")
    return ranker.text_features(rows, rec).drop("country", "b_rel", "tset_core")


@query
def er_closure(spark, sf_dir):
    rows = _pairs(_rec(spark, sf_dir))
    return ranker.closure(rows, rows.where("right(s1, 1) = '5'")).select("s1", "cand")


@query
def er_pair_context(spark, sf_dir):
    return features.context(_pairs(_rec(spark, sf_dir))).select("s1", "cand", "b_rel", "n_cand_s1", "cand_ns1", "cand_rank", "cand_gap")


@query
def er_budget_select(spark, sf_dir):
    return pool.select(_pairs(_rec(spark, sf_dir)), "sc", 8.0).select("s1", "cand", "sc", "rrank")


@query
def er_budget_recall(spark, sf_dir):
    """Recall and ceiling of what each budget keeps."""
    rec = _rec(spark, sf_dir)
    return metrics.budget_report(_pairs(rec), _gold(rec), _queries(rec), "sc", [2.0, 5.0, 8.0])


@query
def er_ranker(spark, sf_dir):
    """The pool ranked by a model fitted on other queries, cut to four candidates a query."""
    rec = _rec(spark, sf_dir)
    rows = staged(model.split(ranker.text_features(pool.build(rec), rec)), "ranker-rows")
    fitted = ranker.fit(rows.where("fold = 'train'").drop("fold"), _gold(rec), trees=10, depth=4)
    held = ranker.apply(rows.where("fold <> 'train'").drop("fold"), fitted)
    return pool.select(held, "rp", 4.0).select("s1", "cand", F.round("rp", 4).alias("rp"), "rrank")


@query
def er_set_features(spark, sf_dir):
    return features.set_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "core_jac", "core_ovl_min", "concat_eq", "concat_sub", "first_tok_eq", "legal_common", "legal_conflict", "n_core1", "n_core2", "name_in_other", "core_cov1", "core_cov2", "nm_digit_tok2")


@query
def er_number_features(spark, sf_dir):
    return features.number_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "num_common", "num_jac", "first_num_eq", "num_conflict_first", "zip_eq", "zip_conflict", "n_nums1", "n_nums2", "alph_jac", "addr_len1", "addr_len2", "ad_cov2", "num_cov2")


@query
def er_fuzzy_cover(spark, sf_dir):
    out = features.number_features(features.set_features(_attached(_rec(spark, sf_dir))))
    return out.select("s1", "cand", "tok_fuzzy_cov1", "tok_fuzzy_cov2", "alph_fuzzy_cov1", "first_num_sim", "best_num_sim", "last_alph_eq")


@query
def er_idf_mass(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return features.idf_mass(_attached(rec), tables.token_df(rec), float(rec.count())).drop("country")


@query
def er_edit_features(spark, sf_dir):
    return features.edit_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "lev_nm", "lev_ad", "jw_core", "jw_first")


@query
def er_token_set_ratio(spark, sf_dir):
    return features.edit_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "tsr_nm", "tsr_ad")


@query
def er_partial_ratio(spark, sf_dir):
    return features.edit_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "pr_nm", "lev_street")


@query
def er_street(spark, sf_dir):
    """Similarity of the streets, and features of single records."""
    attached = features.edit_features(features.record_features(_attached(_rec(spark, sf_dir))))
    return attached.select("s1", "cand", "lev_street", "ad_empty2", "is_dom_2", "has_dba_2", "src", "len_ratio_nm")


@query
def er_soundex_cov(spark, sf_dir):
    return features.edit_features(_attached(_rec(spark, sf_dir))).select("s1", "cand", "sdx_cov1", "sdx_cov2")


@query
def er_tfidf_cosine_word(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return tfidf.cosine(_pairs(rec), tfidf.vectors(rec.withColumn("core", F.array_join("core", " ")), "core", "w"), "cos_w_core").select("s1", "cand", "cos_w_core")


@query
def er_tfidf_cosine_char3(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return tfidf.cosine(_pairs(rec), tfidf.vectors(rec, "nm", "c3"), "cos_c3_nm").select("s1", "cand", "cos_c3_nm")


def _cosine(column: str, kind: str) -> Query:
    def run(spark, sf_dir):
        rec = _rec(spark, sf_dir)
        text = rec.withColumns({c: F.array_join(c, " ") for c in ("core", "alph")})
        return tfidf.cosine(_pairs(rec), tfidf.vectors(text, column, kind), f"cos_{kind}_{column}").select("s1", "cand", f"cos_{kind}_{column}")

    return run


for _column, _kind in features.VECTORS:
    if (_column, _kind) not in (("core", "w"), ("nm", "c3")):
        QUERIES[f"er_tfidf_{_kind}_{_column}"] = _cosine(_column, _kind)


@query
def er_relative_context(spark, sf_dir):
    """A cosine against the best of its query's and its candidate's pairs, and the product of name and address."""
    rec = _rec(spark, sf_dir)
    rows = features.attach(_pairs(rec), rec).select("country", "s1", "cand", "sc", "ad2")
    for column in ("nm", "ad"):
        rows = tfidf.cosine(rows, tfidf.vectors(rec, column, "c3"), f"cos_c3_{column}")
    out = features.context(rows.withColumn("name_x_addr", features.name_x_addr()))
    return out.select("s1", "cand", "name_x_addr", *(f"{c}_{k}" for c in ("cos_c3_nm", "name_x_addr") for k in ("rel1", "relc", "rk1")))


@query
def er_token_df(spark, sf_dir):
    return tables.token_df(_rec(spark, sf_dir))


@query
def er_rarity(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return features.rarity_features(_pairs(rec).select("country", "s1", "cand"), rec).drop("country")


@query
def er_extra_token_table(spark, sf_dir):
    return tables.extra_tokens(_labelled(_rec(spark, sf_dir)), min_support=5)


@query
def er_agree_table(spark, sf_dir):
    return tables.agreement(_attached(_rec(spark, sf_dir)), min_support=5)


@query
def er_sibling_stats(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    attached = staged(_attached(rec).select("country", "s1", "cand", "core1", "core2", "nums1", "nums2"), "attached")
    extra = staged(tables.extra_tokens(model.label(attached, _gold(rec)), min_support=5), "extra-tokens")
    agree = staged(tables.agreement(attached, min_support=5), "agreement")
    out = features.sibling_stats(attached, extra, agree)
    return out.select("s1", "cand", "x2_sib_max", "x2_sib_mean", "x2_n_sib", "x2_n_noise", "x2_n_unk", "x2_agree_min", "x2_n_lowagree", "x1_sib_max", "x1_n_sib", "x1_n_noise", "x1_agree_min", "x1_n_lowagree")


@query
def er_token_map(spark, sf_dir):
    """Latin words for the native-script words of all owned records."""
    return tables.token_map(native_pairs(spark, sf_dir))


@query
def er_pair_features(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    rows = staged(_pairs(rec), "pairs")
    attached = staged(features.attach(rows.select("country", "s1", "cand"), rec), "attached")
    extra = staged(tables.extra_tokens(model.label(attached, _gold(rec)), min_support=5), "extra-tokens")
    return features.all_features(rows, rec, extra, staged(tables.agreement(attached, min_support=5), "agreement"), attached)


@query
def er_candidate_cut(spark, sf_dir):
    return decide.cut_candidates(_ranked(_rec(spark, sf_dir)), 6, 2).select("s1", "cand", "sc", "brank")


@query
def er_matcher(spark, sf_dir):
    """Models trained on three countries' folds, scores of all pairs, the unseen country's rescaled."""
    rec = _rec(spark, sf_dir)
    columns = ["sc", "sn", "sa", "nkeys", "core_jac", "num_jac", "zip_eq", "alph_jac", "len_ratio_nm"]
    rows = features.record_features(features.number_features(features.set_features(features.attach(_pairs(rec), rec)))).select("country", "s1", "cand", *columns)
    rows = model.label(model.split(rows), _gold(rec)).persist()
    train = rows.where(F.col("country").isin(SEEN) & (F.col("fold") == "train"))
    scored = model.score_by_country(rows, model.fit_matcher(train, columns, trees=10, depth=4), model.fit_regularised(train, columns), SEEN, THRESHOLD, 0.7875)
    return scored.select("country", "s1", "cand", "label", F.round("p", 4).alias("p"))


@query
def er_assign_one_to_one(spark, sf_dir):
    return decide.assign(_scored(_rec(spark, sf_dir)), THRESHOLD).select("s1", "cand", "p")


@query
def er_threshold_grid(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return decide.grid_f_half(_scored(rec), _gold(rec), _queries(rec), GRID)


@query
def er_blend_nan_mean(spark, sf_dir):
    rows = _scored(_rec(spark, sf_dir)).withColumn("ce1", F.when(F.col("nkeys") % 3 != 0, F.round(F.col("sn") / (F.col("sn") + 10), 6))).withColumn("ce2", F.when(F.col("nkeys") % 2 != 0, F.round(F.col("sa") / (F.col("sa") + 10), 6)))
    return decide.blend(rows, ["ce1", "ce2"], 0.5).select("s1", "cand", "ce", "blend")


@query
def er_expected_f_decision(spark, sf_dir):
    return decide.expected_f_subset(_scored(_rec(spark, sf_dir)))


@query
def er_macro_f05(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return metrics.macro_f_half(decide.assign(_scored(rec), THRESHOLD).select("s1", "cand"), _gold(rec), _queries(rec))


@query
def er_recall_ceiling(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return metrics.recall_ceiling(_pairs(rec), _gold(rec), _queries(rec))


@query
def er_miss_taxonomy(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    keys, _, weights = _keys(rec)
    gold = _gold(rec).join(_queries(rec), "s1")
    return metrics.miss_table(metrics.misses(gold, _ranked(rec), rec, keys, weights, top=2))


@query
def er_k_sweep(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return metrics.k_sweep(_ranked(rec), _gold(rec), _queries(rec), [1, 2, 3, 5, 8, 12, 20, 45])


@query
def er_expansion_sweep(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return metrics.expansion_sweep(pool.build(rec), _gold(rec), [0, 1, 2, 3, 5])


@query
def er_new_pairs_anti(spark, sf_dir):
    rows = _pairs(_rec(spark, sf_dir))
    return decide.new_pairs(rows.select("s1", "cand"), rows.where("brank < 4"))


@query
def er_uncertain_cascade(spark, sf_dir):
    return decide.uncertain(_scored(_rec(spark, sf_dir)), 0.2, 500).select("s1", "cand", "p", "uncertainty")


@query
def er_uncertain_pairs(spark, sf_dir):
    """All pairs for a larger model: the reference's band and no limit."""
    return decide.uncertain(_scored(_rec(spark, sf_dir))).select("s1", "cand", "p", "uncertainty")


@query
def er_unseen_rescale(spark, sf_dir):
    rows = _scored(_rec(spark, sf_dir))
    p = F.when(F.col("country").isin(SEEN), F.col("p")).otherwise(decide.rescale_unseen(F.col("p"), THRESHOLD, 0.7875))
    return rows.select("s1", "cand", F.round(p, 6).alias("p"))


@query
def er_output_lists(spark, sf_dir):
    rec = _rec(spark, sf_dir)
    return id_lists(decide.assign(_scored(rec), THRESHOLD), _queries(rec))


@query
def er_validate_output(spark, sf_dir):
    """Findings in lists with planted faults: rows left out, rows twice, ids twice, wrong ids."""
    rec = _rec(spark, sf_dir)
    rows = staged(_pairs(rec).select("s1", "cand", "brank"), "pairs")
    good = rows.where("brank < 3 AND right(s1, 1) <> '7'").groupBy("s1").agg(F.array_sort(F.collect_list("cand")).alias("ids"))
    bad = rows.where("right(s1, 1) = '3'").groupBy("s1").agg(F.min("cand").alias("c")).select("s1", F.array("s1", F.lit("X9"), "c", "c").alias("ids"))
    return validate.report(validate.validate(staged(good.unionByName(bad), "lists"), _queries(rec)))


@query
def er_link(spark, sf_dir):
    """Blocking, scoring and one-to-one linkage."""
    return decide.assign(_scored(_rec(spark, sf_dir)), THRESHOLD).select("country", "s1", "cand", "p")
