from pyspark.sql import functions as F

from linkstone.operators import decide, model
from linkstone.plans import check, pipeline
from linkstone.plans.records import records
from linkstone.sources import records as io


def test_split_is_stable_and_disjoint(spark):
    q = spark.range(2000).select(F.concat(F.lit("S1-"), "id").alias("s1"))
    a, b = (model.split(q).orderBy("s1").collect() for _ in range(2))
    assert a == b and {r["fold"] for r in a} == {"table", "train", "validation"}
    sample = io.corpus_sample(q.withColumnRenamed("s1", "entity_id"), 0.2).count()
    assert 300 < sample < 500


def test_nth_highest(spark):
    import random

    from linkstone.operators import pool

    pick = random.Random(2)
    for values in ([1.0] * 5, [pick.random() for _ in range(500)], [pick.choice([0.1, 0.2, 0.30000000001, 0.3]) for _ in range(60)], [1e9, *(pick.random() for _ in range(50))], [-3.5, 2.0]):
        table = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("many"))
        for n in {1, 2, len(values) // 2 or 1, len(values)}:
            assert pool.nth_highest(table, n, bins=16) == sorted(values, reverse=True)[n - 1]
        assert pool.nth_highest(table, len(values) + 1) is None


def test_tables_and_ids(spark, tmp_path):
    rows = spark.createDataFrame([("S2-17", "a b"), ("S1-9000000001", "")], "entity_id string, note string")
    io.write_table(rows, str(tmp_path / "t"))
    assert sorted(r[0] for r in io.read_first_column(spark, str(tmp_path / "t")).collect()) == ["S1-9000000001", "S2-17"]
    numbers = rows.select("entity_id", io.id_number("entity_id").alias("n"))
    assert all(r[0] == r[1] for r in numbers.select("entity_id", io.id_text("n")).collect())


def test_tagged_pairs(spark):
    a, b = (spark.createDataFrame([(x, "S2-1")], "s1 string, cand string") for x in ("S1-1", "S1-2"))
    assert sorted(tuple(r) for r in decide.tagged({"val": a, "test": b}).collect()) == [("S1-1", "S2-1", "val"), ("S1-2", "S2-1", "test")]


def test_plug_in(spark):
    pairs = spark.createDataFrame([("a b", "a"), ("x", "y")], "text1 string, text2 string")
    got = model.plug_in(pairs, lambda a, b: (a.str[0] == b.str[0]).astype(float)).collect()
    assert [r["ce"] for r in got] == [1.0, 0.0]


def test_whole_job(spark, tmp_path):
    """Files in, id lists out: France is unseen, most of the output is right."""
    rows = records(spark, "/root/testdata/sf0.001").persist()
    data = tmp_path / "data"
    data.mkdir()
    for split, part in (("train", rows.where("country <> 'fr'")), ("test", rows)):
        for k in (1, 2, 3):
            lines = part.where(F.col("src") == k).select(F.concat_ws("\t", "entity_id", "business_name", "business_address", "country").alias("v")).collect()
            (data / f"{split}_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(r["v"] + "\n" for r in lines), encoding="utf-8")
    gold = {}
    for r in rows.where("owner IS NOT NULL").collect():
        gold.setdefault(r["owner"], []).append(r["entity_id"])
    train = [r["entity_id"] for r in rows.where("src = 1 AND country <> 'fr'").collect()]
    (data / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{k}\t{','.join(gold.get(k, []))}\n" for k in train), encoding="utf-8")
    matcher = pipeline.MATCHER
    pipeline.MATCHER = ["sc", "sn", "sa", "core_jac", "num_jac", "zip_eq", "lev_nm", "cos_c3_nm", "b_rel"]
    try:
        threshold = pipeline.run(spark, str(data), str(tmp_path / "work"), str(tmp_path / "out"))
    finally:
        pipeline.MATCHER = matcher
    assert 0.2 <= threshold <= 0.95
    got, every = io.read_gold(spark, str(tmp_path / "out" / "matching_results"))
    assert every.count() == rows.where("src = 1").count()
    pairs = {(r["s1"], r["cand"]) for r in got.collect()}
    right = {(s, c) for s, cs in gold.items() for c in cs}
    assert len(pairs & right) > 0.7 * len(pairs) and len(pairs & right) > 0.5 * len(right)
    report = pipeline.report(spark, str(data), str(tmp_path / "work"), (2, 8)).collect()
    recall = {(r["country"], r["budget"]): r["recall"] for r in report}
    assert len(recall) == 6 and all(recall[c, 2.0] <= recall[c, 8.0] and recall[c, 8.0] > 0.8 for c in ("en", "de", "es"))
    assert check.main(["--data", str(data), "--out", str(tmp_path / "out"), "--candidates"]) == 0
    (tmp_path / "bad" / "matching_results").mkdir(parents=True)
    (tmp_path / "bad" / "matching_results" / "part").write_text("source1_entity_id\tmatched\nS1-1\tS2-999999999,S1-2\nno tab\n")
    faults = {r["check"]: r["n"] for r in check.check(spark, str(data), str(tmp_path / "bad")).collect()}
    assert faults["header"] == faults["malformed"] == faults["unknown_id"] == faults["self_match"] == 1 and faults["missing_row"] > 50
    assert check.main(["--data", str(data), "--out", str(tmp_path / "bad")]) == 1
    again = pipeline.io.model_once(spark, str(tmp_path / "work" / "ranker"), lambda: 1 / 0)
    assert len(again.stages) == 2
    spark.catalog.clearCache()
