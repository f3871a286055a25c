import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from linkstone.operators import decide, metrics, pool, tables, validate
from linkstone.operators.blocking import key_rows, key_weights
from linkstone.plans.queries import ORACLE_SQL, QUERIES
from linkstone.sources import records as io
from linkstone.functions.text import normalise
from linkstone.plans.records import records

SF = "/root/testdata/sf0.001"


def _rounded(value):
    return round(value, 7) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) & set(QUERIES)))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(map(_rounded, r)) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(map(_rounded, r)) for r in df.select(*columns).collect()), key=repr)
    spark.catalog.clearCache()
    assert got == want


def test_every_query_with_sql_is_registered():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pair_features_have_all_families(spark):
    df = QUERIES["er_pair_features"](spark, SF)
    for name in ("core_jac", "first_num_sim", "nm_sh_idf", "x2_sib_max", "lev_nm", "cos_c4_alph", "nmfreq_s1_in_c", "cand_gap", "cos_w_core_rk1"):
        assert name in df.columns
    assert len(df.columns) >= 105
    spark.catalog.clearCache()


def test_matcher_scores(spark):
    rows = QUERIES["er_matcher"](spark, SF)
    low, high, good, bad = rows.agg(F.min("p"), F.max("p"), F.avg(F.when(F.col("label") == 1, F.col("p"))), F.avg(F.when(F.col("label") == 0, F.col("p")))).first()
    spark.catalog.clearCache()
    assert 0 <= low <= high <= 1 and good > bad + 0.2


def test_budget(spark):
    pairs = spark.createDataFrame([("A", "a", 5.0), ("A", "b", 1.0), ("B", "c", 4.0), ("B", "d", 3.0)], "s1 string, cand string, sc double")
    assert {r["cand"] for r in pool.select(pairs, "sc", 1.5).collect()} == {"a", "c", "d"}
    assert pool.select(pairs.where("false"), "sc", 1.5).count() == 0


def test_decisions(spark):
    scored = spark.createDataFrame([("A", "c", 0.9), ("B", "c", 0.8)], "s1 string, cand string, p double")
    assert [r["s1"] for r in decide.assign(scored, 0.65).collect()] == ["A"]
    assert decide.assign(scored, 0.65, one_to_one=False).count() == 2
    assert scored.select(F.round(decide.rescale_unseen(F.col("p") - 0.1, 0.65, 0.7875), 4).alias("r")).first()["r"] == 0.6603
    means = spark.createDataFrame([(0.9, 0.2, None, 0.4), (0.9, None, float("nan"), None)], "p double, a double, b double, c double")
    assert [round(r["ce"], 6) for r in decide.blend(means, ["a", "b", "c"], 0.5).collect()] == [0.3, 0.9]


def test_uncertain(spark):
    """Band 0.002 and no limit unless asked for; the query has pairs beyond a band of 0.2 and more than 500."""
    scored = spark.createDataFrame([("A", f"c{k}", p) for k, p in enumerate([0.001, 0.003, 0.1, 0.5, 0.6, 0.9, 0.997, 0.999])], "s1 string, cand string, p double")
    assert sorted(r["p"] for r in decide.uncertain(scored).collect()) == [0.003, 0.1, 0.5, 0.6, 0.9, 0.997]
    assert [r["p"] for r in decide.uncertain(scored, limit=2).orderBy("p").collect()] == [0.5, 0.6]
    n, wide = QUERIES["er_uncertain_pairs"](spark, "/root/testdata/sf0.01").agg(F.count(F.lit(1)), F.count(F.when(F.col("uncertainty") <= 0.2, 1))).first()
    spark.catalog.clearCache()
    print("pairs", n, "of them at most 0.2", wide)
    assert n > 500 and wide > 0


def test_f_half(spark):
    pred = spark.createDataFrame([("A", "a"), ("A", "b"), ("A", "c"), ("C", "x")], "s1 string, cand string")
    gold = spark.createDataFrame([("A", "a"), ("A", "c"), ("D", "y")], "s1 string, cand string")
    queries = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "C"), ("D", "D")], "country string, s1 string")
    got = {r["country"]: round(r["f"], 3) for r in metrics.macro_f_half(pred, gold, queries).collect()}
    assert got == {"A": 0.714, "B": 1.0, "C": 0.0, "D": 0.0}


def test_token_map(spark):
    native = {"टाटा": "tata", "शर्मा": "sharma", "दिल्ली": "delhi"}
    rows = [(f"{b} works {k}", f"{a} {k}") for a, b in native.items() for k in range(5)]
    got = {r["native"]: r["latin"] for r in tables.token_map(spark.createDataFrame(rows, "latin_text string, native_text string")).collect()}
    assert got == native


def test_validation(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-1", []), ("S1-2", ["S1-3", "Q7"]), ("S1-9", ["S3-4"])], "s1 string, ids array<string>")
    queries = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1 string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    got = {r["check"]: r["n"] for r in validate.report(validate.validate(lists, queries, known)).collect()}
    assert got == {"duplicate_row": 1, "duplicate_id": 1, "self_match": 1, "wrong_prefix": 1, "missing_row": 1, "extra_row": 1, "unknown_id": 1}
    assert validate.header_problem("a,b", ("a", "b")) == "comma_separated"
    assert validate.header_problem("A\tB ", ("a", "b")) is None
    assert validate.parse_lines(spark.createDataFrame([("S1-1 no tab",)], "value string")).first()["bad"]


def test_files(spark, tmp_path):
    path = tmp_path / "source1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted \\ NA\t\tfr\n', encoding="utf-8")
    row = io.read_records(spark, str(path)).first()
    assert (row["business_name"], row["business_address"], row["src"]) == ('"Quoted \\ NA', "", 1)
    pairs = spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-1")], "s1 string, cand string")
    lists = io.id_lists(pairs, spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string"))
    out = str(tmp_path / "out")
    io.write_id_lists(lists.coalesce(1), out, ("source1_entity_id", "matched_entity_ids"))
    text = "".join((tmp_path / "out" / f).read_text() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert "S1-1\tS2-1,S2-9\n" in text and "S1-2\t\n" in text
    made = []
    for _ in range(2):
        df = io.once(spark, str(tmp_path / "stage"), lambda: made.append(1) or pairs)
    assert len(made) == 1 and df.count() == 2


def test_streaming_links(spark, tmp_path):
    from linkstone.streaming.linking import run

    raw = records(spark, SF).drop("owner").persist()
    rec = normalise(raw).persist()
    keys = key_rows(rec).persist()
    raw.where("src > 1").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    job = run(stream, keys, key_weights(keys.where("src > 1"), rec.where("src > 1")).persist(), str(tmp_path / "links"), str(tmp_path / "ck"))
    job.awaitTermination(120)
    links = spark.read.parquet(str(tmp_path / "links"))
    assert links.count() > 100 and links.groupBy("cand").count().agg(F.max("count")).first()[0] <= 3
    spark.catalog.clearCache()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    json.dumps(sorted(entry.queries()))
    spark.catalog.clearCache()
