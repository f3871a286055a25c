import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkstone.functions import similarity
from linkstone.functions.text import normalise
from linkstone.operators import blocking, features, metrics, pool, tfidf
from linkstone.plans.queries import QUERIES
from linkstone.plans.records import records
from linkstone.sources.stages import staged

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def _bounded(spark, name, most):
    """What is returned stands on stage tables: few exchanges are left above them."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("stage tables are kept in memory without spark.checkpoint.dir")
    df = QUERIES[name](spark, SF)
    assert _exchanges(df) <= most
    spark.catalog.clearCache()


def test_pairs_are_summed_where_a_query_lies(spark):
    rec = normalise(records(spark, SF))
    keys = blocking.key_rows(rec)
    candidates = keys.where("src > 1")
    pairs = blocking.score_pairs(keys.where("src = 1"), candidates, blocking.key_weights(candidates, rec.where("src > 1")))
    plan = blocking.ranks(pairs)._jdf.queryExecution().executedPlan().toString()
    # the last exchange is below the explosion into pairs, and none deals single pairs
    assert plan.index("Generate explode(split(cands") < plan.index("Exchange ")
    assert not re.search(r"hashpartitioning\(country#\d+, s1#\d+, cand#\d+", plan)


def test_query_expansion_stages(spark):
    _bounded(spark, "er_query_expansion", 3)


def test_s1_context_stages(spark):
    _bounded(spark, "er_s1_context", 3)


def test_cand_competition_stages(spark):
    _bounded(spark, "er_cand_competition", 4)


def test_budget_recall_stages(spark):
    _bounded(spark, "er_budget_recall", 12)


def test_budget_report_counts_each_budget(spark):
    pairs = spark.createDataFrame([("A", "a", 5.0), ("A", "b", 1.0), ("B", "c", 4.0), ("B", "d", 3.0)], "s1 string, cand string, sc double")
    gold = spark.createDataFrame([("A", "a"), ("B", "d"), ("B", "z")], "s1 string, cand string")
    queries = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "C")], "country string, s1 string")
    got = {r["budget"]: (r["n_gold"], r["found"], r["per_query"]) for r in metrics.budget_report(pairs, gold, queries, "sc", [1.0, 1.5]).collect()}
    for budget in got:
        plain = metrics.recall_ceiling(pool.select(pairs, "sc", budget), gold, queries).first()
        assert got[budget] == (plain["n_gold"], plain["found"], plain["per_query"])
    assert got[1.5][:2] == (3, 2)


def test_sibling_stats_stages(spark):
    _bounded(spark, "er_sibling_stats", 6)


def test_ranker_stages(spark):
    _bounded(spark, "er_ranker", 0)


def test_validate_output_stages(spark):
    _bounded(spark, "er_validate_output", 12)


def test_miss_taxonomy_stages(spark):
    _bounded(spark, "er_miss_taxonomy", 15)


def test_pair_features_stages(spark):
    _bounded(spark, "er_pair_features", 15)


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_with_their_stage_table(spark, tmp_path):
    core = "spark.sql.legacy.setCommandRejectsSparkCoreConfs"
    spark.conf.set(core, "false")
    spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    before = _shuffled(spark)
    try:
        table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    finally:
        spark.conf.unset("spark.checkpoint.dir")
        spark.conf.unset(core)
    for _ in range(20):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    assert table.count() == 7


def test_best_postings_are_the_side_slots_of_all_pairs(spark, monkeypatch):
    rec = normalise(records(spark, SF)).persist()
    keys = blocking.key_rows(rec)
    candidates = keys.where("src > 1")
    lists = blocking.postings(candidates, blocking.key_weights(candidates, rec.where("src > 1")).where("df <= 300")).persist()
    plain = blocking.ranks(blocking.score_postings(keys.where("src = 1"), lists, detail=True))
    names = [c.split()[0] for c in blocking.BEST.split(", ")]
    for top, side, rounds in ((30, 3, 3), (2, 1, 1), (10, 0, 2)):
        want = blocking.side_slots(plain, top, side).select(*names)
        got = blocking.best_postings(keys.where("src = 1"), lists, top, side, "best", rounds)
        assert got.schema.simpleString() == want.schema.simpleString()
        rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert rounded(got) == rounded(want)
    spark.catalog.clearCache()


def test_best_postings_across_batches():
    rows = [("x", q, k, w, c) for q, k, w, c in (("A", "c", 2.0, "b\ta"), ("A", "a", 1.0, "c"), ("A", "u", 0.5, "c\ta\tb"), ("B", "x", 3.0, "c"), ("C", "c", 1.0, "é\tz\td"))]
    for size in (1, 2, 5):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["country", "s1", "key", "idf", "cands"]) for part in parts]
        got = [tuple(r[c] for c in ("s1", "cand", "sc", "nkeys", "maxidf", "g0", "g1")) for b in blocking._kept(iter(batches), 1, 1) for r in b.to_pylist()]
        # a and b tie by total and name, c is best by address alone
        assert sorted(got) == [("A", "a", 2.5, 2, 2.0, 1, 1), ("A", "c", 1.5, 2, 1.0, 0, 1), ("B", "c", 3.0, 1, 3.0, 0, 0), ("C", "d", 1.0, 1, 1.0, 1, 0)]
    assert list(blocking._kept(iter([]), 1, 1)) == []


def test_pool_takes_keys_once(spark, monkeypatch):
    calls = []
    made = blocking.with_keys
    for module in (blocking, pool):
        monkeypatch.setattr(module, "with_keys", lambda rec: calls.append(1) or made(rec))
    pool.build(normalise(records(spark, SF)))
    spark.catalog.clearCache()
    assert len(calls) == 1


def test_pair_features_take_cosines_where_the_pairs_lie(spark, monkeypatch):
    """No vector travels: the pairs' texts and the terms' frequencies give all cosines at once, equal to those by joins."""
    rec = normalise(records(spark, SF)).persist()
    pairs = blocking.block(rec).select("country", "s1", "cand").persist()
    text = rec.withColumn("core", F.array_join("core", " ")).withColumn("alph", F.array_join("alph", " "))
    made = []
    plain = features.staged
    monkeypatch.setattr(features, "staged", lambda df, what: made.append(what) or plain(df, what))
    out = QUERIES["er_pair_features"](spark, SF).persist()
    assert len([what for what in made if what.startswith("cos")]) == 1
    for column, kind in (("nm", "c3"), ("core", "w"), ("alph", "c4")):
        name = f"cos_{kind}_{column}"
        want = tfidf.cosine(pairs, tfidf.vectors(text, column, kind), name)
        assert out.select("s1", "cand", name).exceptAll(want.select("s1", "cand", name)).count() == 0
    few = out.select("s1", "cand", "cos_c4_alph")
    monkeypatch.setattr(tfidf, "TERMS", 0)
    many = QUERIES["er_pair_features"](spark, SF)
    assert many.columns == out.columns and many.select("s1", "cand", "cos_c4_alph").exceptAll(few).count() == 0
    spark.catalog.clearCache()


def test_partial_ratio_is_that_of_all_pieces():
    pick = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(pick.choice("abcdef") for _ in range(pick.randint(0, 12))) for _ in "ab")
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        want = max(similarity.indel_ratio(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))) if short else float(not long)
        assert similarity.partial_of(a, b) == want
