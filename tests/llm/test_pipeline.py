"""The pipeline's stages against brute-force versions, on documents with planted cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name, sql in ORACLE_SQL.items():
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(result.fetchall()) == sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents and labels with a passage in many, near copies, and toxic words."""
    pick = random.Random(11)
    words = [f"word{n}" for n in range(3000)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passage, base, rows, labels = prose(90), prose(200), [], []
    for k in range(120):
        text = "\n".join(prose(12) for _ in range(12))
        kind = "plain"
        if k % 6 == 1:
            text, kind = f"{prose(60)} {passage} {prose(60)}", "passage"
        elif k % 6 == 2:
            new = base.split(" ")
            new[k] = "changed"
            text, kind = " ".join(new), "near"
        elif k % 6 == 3:
            text, kind = f"{prose(30)} vilescum {prose(20)} vilescums {prose(10)} vilescum", "toxic"
        rows.append((k, text, "en", "s", len(text), kind))
        labels.append((k, 1, int(kind == "toxic")))
    rows += [(200, None, None, None, None, "null"), (201, "", "en", "s", 0, "empty")]
    place = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string").drop("kind").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place), {r[0]: r[5] for r in rows}, passage


def test_stages(spark, planted):
    place, kind, passage = planted
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dup", "suffix_dedup", "packing"]

    clean = stages["toxicity"](spark, docs, place).persist()
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {k for k, v in kind.items() if v != "toxic"}

    lines = stages["line_dedup"](spark, clean, place).persist()
    assert lines.columns == columns and lines.count() == clean.count()
    assert lines.where(F.coalesce(F.length("text"), F.lit(-1)) != F.coalesce(F.col("n_chars"), F.lit(-1))).count() == 0

    apart = stages["near_dup"](spark, lines, place).persist()
    near = [k for k, v in kind.items() if v == "near"]
    assert {r["doc_id"] for r in apart.collect()} == {k for k, v in kind.items() if v not in ("toxic", "near")} | {min(near)}

    left = stages["suffix_dedup"](spark, apart, place).persist()
    assert left.columns == columns and left.count() == apart.count()
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    before = {r["doc_id"]: r["text"] for r in apart.collect()}
    for k, v in kind.items():
        if v == "passage":
            assert passage not in texts[k] and len(texts[k]) <= len(before[k]) - len(passage)
        elif k in texts:
            assert texts[k] == before[k]

    pieces = stages["packing"](spark, left, place)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_near_copies_keep_rows_without_id(spark):
    text = " ".join(f"word{n}" for n in range(60))
    rows = [(1, text), (2, text), (None, text), (None, "another clean text of some words"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dup"](spark, docs, "").collect()]
    assert sorted(left, key=repr) == sorted([rows[0], *rows[2:]], key=repr)


def test_run(spark, planted):
    assert corpus_pipeline.run(spark, planted[0]).count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_goes_by_chunks_first(spark, monkeypatch):
    """The chunks of the rolling hash are grouped first; the lines that go are those of all windows."""
    import random

    import corpus_pipeline
    from linkstone.llm import line_dedup

    dice = random.Random(5)
    rows = [(k if k else None, "\n".join(dice.choice(["a", "b", "c", f"w{dice.randrange(40)}"]) for _ in range(dice.randrange(0, 40)))) for k in range(120)]
    passage = "\n".join(f"line {k}" for k in range(30))
    rows += [(200 + k, f"{k}\n{passage}\n{k + 1}") for k in range(8)] + [(300, None), (301, "a\na\na\na\na\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    inner = line_dedup.removals
    monkeypatch.setattr(line_dedup, "removals", lambda *a, **b: seen.append(a[3:]) or inner(*a, **b))
    got = sorted(corpus_pipeline.drop_repeated_lines(spark, docs, "").collect(), key=repr)
    assert len(seen) == 2  # all windows, and before them the chunks
    want = sorted(line_dedup.dedup(docs, runs=True).select("doc_id", "text").collect(), key=repr)
    assert got == want and sum(r["text"] is not None and "line 5" in r["text"] for r in got) == 1
