import pytest

from linkstone.functions import similarity as S
from linkstone.functions.text import normalise_address, normalise_name, romanise, street
from linkstone.operators.blocking import with_keys
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("raw", "nm", "core", "dom"),
    [
        ("M/s Shree Laxmi Traders Private Limited", "shree laxmi traders pvt ltd", "shree laxmi traders", 0),
        ("capitalholding.com", "capitalholding", "capitalholding", 1),
        ("S.A.R.L. Dupont", "sarl dupont", "dupont", 0),
        ("The Ltd", "the ltd", "ltd", 0),
        ("m.g road", "m g road", "g road", 0),
        ("0bsidian a1ltime 1234 a1b2c3d", "obsidian alltime 1234 a1b2c3d", "obsidian alltime a1b2c3d", 0),
        ("Café Éclair", "cafe eclair", "cafe eclair", 0),
        ("", "", "", 0),
        (None, "", "", 0),
    ],
)
def test_names(spark, raw, nm, core, dom):
    row = normalise_name(spark.createDataFrame([(raw,)], "n string"), "n").first()
    assert (row["nm"], " ".join(row["core"]), row["is_dom"]) == (nm, core, dom)


@pytest.mark.parametrize(
    ("raw", "nums", "some"),
    [
        ("921, M.G. Road, Bangalore 560 001", ["921", "560001"], {"rd", "bengaluru", "m", "g"}),
        ("0921 MG Road", ["921"], {"mg", "rd"}),
        ("12th Street, New York", ["12"], {"st", "ny"}),
        ("", [], set()),
        (None, [], set()),
    ],
)
def test_addresses(spark, raw, nums, some):
    row = normalise_address(spark.createDataFrame([(raw,)], "a string"), "a").first()
    assert row["nums"] == nums and some <= set(row["alph"])


def test_romanise():
    assert romanise("राम") == "ram"
    assert romanise("शर्मा") == "sharma"
    assert romanise("१२") == "12"
    assert romanise("क्ष") == "ksh"


def test_key_set(spark):
    rows = spark.createDataFrame([(["acme", "tools"], ["12", "560001"], ["rd", "main", "bengaluru"]), ([], [], [])], "core array<string>, nums array<string>, alph array<string>")
    got = [set(r["keys"]) for r in with_keys(rows).collect()]
    want = "c:acmetools,s:acme tools,u:acme,u:tool,p:acme|tool,x:acme|12,x:tool|12,x:acme|560001,x:tool|560001,a:12|beng,a:560001|beng,n:acmetools|beng,m:acme|beng,m:tool|beng,z:560001|acme,z:560001|tool"
    assert got == [set(want.split(",")), set()]


def test_similarities(spark):
    df = spark.createDataFrame([("921", "924", 0.8), ("921", "921", 1.0), ("12", "123", 0.7), ("1", "12", 0.0), ("1234", "1256", 0.4)], "a string, b string, want double")
    assert df.where(F.expr(S.number_similarity("a", "b")) != F.col("want")).count() == 0
    close = spark.createDataFrame([("traders", ["trader"], 0.7), ("abc", ["abd"], 0.0), ("x", ["x"], 1.0)], "t string, o array<string>, want double")
    assert close.where(F.expr(S.token_close("t", "o")) != F.col("want")).count() == 0
    assert [S.sound_of(t) for t in ("laxmi", "lakshmi", "tymczak", "12b", "pfister", "ashcraft", "a5bc")] == ["l250", "l250", "t522", "12b", "p236", "a261", "a512"]
    words = spark.createDataFrame([(["laxmi", "tymczak", "pfister", "ashcraft"],)], "w array<string>")
    assert words.select(S.sounds("w").alias("s")).first()["s"] == ["l250", "t522", "p236", "a261"]
    assert S.token_set_of("a b c", "c b a d") == 1.0 and S.partial_of("abc", "xxabcxx") == 1.0
    assert S.jaro_winkler_of(["abcd"], ["abzzzzzz"])[0] == pytest.approx(0.583333, abs=1e-6)


def _words(pick, n):
    return [" ".join("".join(pick.choice("abcé漢") for _ in range(pick.randrange(0, 6))) for _ in range(pick.randrange(0, 4))).strip() for _ in range(n)]


def test_jaro_winkler_against_sql():
    """All pairs at once, against DuckDB's function."""
    import random

    import duckdb

    pick = random.Random(6)
    left = ["", "", "a", "martha", "dixon", "dwayne", *("".join(pick.choice("abcd") for _ in range(pick.randrange(0, 14))) for _ in range(600))]
    right = ["", "b", "a", "marhta", "dicksonx", "duane", *("".join(pick.choice("abcd") for _ in range(pick.randrange(0, 14))) for _ in range(600))]
    con = duckdb.connect()
    want = [con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0] if a or b else 1.0 for a, b in zip(left, right)]
    assert S.jaro_winkler_of(left, right).tolist() == pytest.approx(want, abs=1e-9)


def test_ratios_against_brute_force(spark):
    """Indel, partial and token-set ratios against a table of longest common subsequences."""
    import random
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def shared(a, b):
        if not a or not b:
            return 0
        return shared(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(shared(a[:-1], b), shared(a, b[:-1]))

    def ratio(a, b):
        return 1.0 if not a and not b else 2 * shared(a, b) / (len(a) + len(b))

    def partial(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return 1.0 if not b else 0.0
        # windows as long as the shorter text, and shorter ones at both ends
        windows = {b[i : i + len(a)] for i in range(len(b) - len(a) + 1)} | {b[:k] for k in range(1, len(a))} | {b[-k:] for k in range(1, len(a))}
        return max(ratio(a, w) for w in windows)

    def token_set(a, b):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0.0
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
        return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0,)))

    pick = random.Random(5)
    left, right = _words(pick, 150), _words(pick, 150)
    for a, b in zip(left, right):
        assert S.common_subsequence(a, b) == shared(a, b) and S.indel_ratio(a, b) == pytest.approx(ratio(a, b))
        assert S.partial_of(a, b) == pytest.approx(partial(a, b)), (a, b)
        assert S.token_set_of(a, b) == pytest.approx(token_set(a, b))
    rows = [(a, b) for a, b in zip(left, right)] + [(None, "x"), ("x", None), (left[0], right[0])]
    df = spark.createDataFrame(rows, "a string, b string").repartition(2)
    got = df.select("a", "b", S.partial_ratio("a", "b").alias("p"), S.token_set_ratio("a", "b").alias("t"), S.jaro_winkler("a", "b").alias("j")).collect()
    for r in got:
        if r["a"] is None or r["b"] is None:
            assert r["p"] is r["t"] is r["j"] is None
        else:
            assert (r["p"], r["t"], r["j"]) == pytest.approx((partial(r["a"], r["b"]), token_set(r["a"], r["b"]), S.jaro_winkler_of([r["a"]], [r["b"]])[0]))
    assert spark.createDataFrame([(["mg", "rd", "bengaluru"],), (["one", "two", "three"],)], "a array<string>").select(F.expr(street("a")).alias("s")).collect() == [("mg rd",), ("one two",)]
