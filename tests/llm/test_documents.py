"""Operators over documents against brute-force versions, with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkstone.llm import bpe, line_dedup, ngram_join, packing, suffix_dedup, suffix_sort, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, gone_ string, spans_ string, key_ long"


def _documents():
    pick = random.Random(3)
    words = [f"w{n}é" if n % 7 == 0 else f"w{n}" for n in range(400)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passage = prose(120)
    texts = [None, "", " ", "\n\n", "one", "One", "a b c", "x" * 900, "x" * 1500, "ab" * 700, "<|endoftext|> it's    1234 ½ été\x1c\x85 <|endoftext|>", prose(15000)]
    base = prose(300)
    texts += [base, base, base.upper()]
    for k in range(12):
        new = base.split(" ")
        for _ in range(3 + k):
            new[pick.randrange(len(new))] = f"new{pick.randrange(10**6)}"
        texts.append(" ".join(new))
    texts += [prose(40) + "\n" + passage + "\n" + prose(30), prose(10) + passage, passage + prose(5), prose(200)]
    lines = [prose(8) for _ in range(30)]
    texts += ["\n".join(lines), "\n".join(["new first line", *lines]), "\n".join(lines[5:25]), "\n".join([prose(6) for _ in range(20)]), "ä" * 450, "zz" + "ä" * 450]
    return [(k, t, "en", "s", None, k % 3, "d", "g", "x", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return _documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(docs, none, rows):
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    got = {r["doc_id"]: r for r in coded.collect()}
    table = bpe.load(RANKS)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.rank, special_tokens={})
    for key, text, *_ in rows:
        assert got[key]["ids"] == library.encode_ordinary(text or "")
        assert bytes(got[key]["decoded"]) == (text or "").encode()
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_small_memory(spark, rows):
    """The same ids when the words are forgotten all the time."""
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    small = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, max_words=50).collect()}
    large = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert small == large


def test_bpe_random_words():
    pick, table = random.Random(5), bpe.load(RANKS)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.rank, special_tokens={})
    words = ["".join(pick.choice("aabehnorst  -é¼漢") for _ in range(pick.randrange(0, 40))) for _ in range(500)]
    ids, sizes = bpe.replay([w.encode() for w in words], table)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == library._encode_single_piece(w.encode()) if w else at[k] == at[k + 1]


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 3, "max_loss": 64}, {"max_tokens": 128, "max_segments": 50, "max_loss": 40, "unscored": 4, "window": 4}])
def test_packing(docs, none, rows, limits):
    pieces = packing.pack(docs, RANKS, public_tokenizers.PATTERN, **limits).collect()
    most = {"max_tokens": 2048, "max_segments": 64, "max_loss": 2048, "unscored": 1} | limits
    library = Tokenizer.from_file(PATH)
    want = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and bytes(p["ids"]) == ids[p["start"] : p["start"] + p["length"]].tobytes()
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], max(0, p["length"] - max(0, most["unscored"] - p["start"]))))
    assert set(by_doc) == set(want)
    for key, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(want[key])
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= most["max_tokens"] and len(parts) <= most["max_segments"] and sum(p[2] for p in parts) <= most["max_loss"]
    if not limits:
        lengths = [sum(p[1] for p in parts) for parts in by_sequence.values()]
        assert sum(2048 - n for n in lengths if n & (n - 1)) == 0
    assert packing.pack(none, RANKS, public_tokenizers.PATTERN).count() == 0


def _sets(rows):
    out = {}
    for key, text, *_ in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        out[key] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    return out


def _components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("rounds", [1, 3])
def test_ngram_join(docs, none, rows, rounds):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(docs, rounds=rounds).collect()}
    sets = _sets(rows)
    want = _components(sets)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}
    assert len(set(want.values())) < len(want) - 6
    assert ngram_join.similar(none).count() == 0


def test_ngram_join_words_of_one_polynomial(spark):
    """Two long words that polynomial hashes modulo 2^64 cannot tell apart."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{thue} b c d e"), (2, f"{thue.translate(str.maketrans('ab', 'ba'))} b c d e"), (3, thue)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(docs).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 3)}


def test_ngram_join_shared_fingerprints(docs, rows, monkeypatch):
    """Different sets with one first fingerprint stay different classes."""
    plain, mixed = ngram_join._prints, ngram_join._mixed

    def few(key, size):
        fp, other = plain(key, size)
        return fp % 5, other

    def classes(key, size, clash):
        fp, other = few(key, size)
        return np.where(np.isin(fp, clash), mixed(fp, other), fp)

    monkeypatch.setattr(ngram_join, "_prints", few)
    monkeypatch.setattr(ngram_join, "_classes", classes)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(docs).collect()}
    sets = _sets(rows)
    want = _components(sets)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_tree_chunks(spark):
    """Pairs of a group that is dealt in chunks are the pairs of the whole group."""
    pick = np.random.default_rng(2)
    base = pick.integers(0, 2**52, 60, dtype=np.uint64)
    sets = []
    for k in range(40):
        own = np.unique(np.concatenate([base[pick.permutation(60)[: 54 + k % 6]], pick.integers(0, 2**52, 1 + k % 3, dtype=np.uint64)]))
        point = np.bincount((ngram_join.mix(own) >> np.uint64(57)).astype(int), minlength=ngram_join._GROUPS)
        sets.append((k, len(own), bytearray(ngram_join._packed(point)), bytearray(own.tobytes())))
    table = spark.createDataFrame(sets, "fp long, n int, point binary, hashes binary").persist()
    apart = table.select(F.lit(7).cast("long").alias("token"), "fp", "n", F.lit(0).alias("rank"), F.col("fp").alias("root")).persist()
    pairs = lambda chunk: {(r["a"], r["b"]) for r in ngram_join.tree_pairs(apart, table, 80, False, chunk).collect()}
    assert pairs(4096) == pairs(7) and len(pairs(7)) > 20


def _repeats(rows, length):
    raw = {k: (t or "").encode() for k, t, *_ in rows}
    count = {}
    for data in raw.values():
        for s in range(len(data) - length + 1):
            count[data[s : s + length]] = count.get(data[s : s + length], 0) + 1
    out = {}
    for key, data in raw.items():
        gone = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            if count[data[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        out[key] = np.cumsum(gone)[: len(data)] > 0
    return raw, out


@pytest.mark.parametrize(("length", "gram", "most"), [(400, 256, 2048), (60, 16, 2048), (60, 16, 2)])
def test_suffix_dedup(docs, none, rows, length, gram, most):
    done = suffix_dedup.remove(docs, length=length, gram=gram, most=most).collect()
    raw, gone = _repeats(rows, length)
    assert len(done) == len(rows)
    for r in done:
        data, marked = np.frombuffer(raw[r["doc_id"]], np.uint8), gone[r["doc_id"]]
        runs = int((np.diff(np.concatenate([[0], marked.astype(int)])) == 1).sum())
        assert (bytes(r["kept_"]), r["n_bytes_"], r["n_removed_"], r["n_spans_"]) == (data[~marked].tobytes(), len(data), int(marked.sum()), runs)
    assert suffix_dedup.remove(none).count() == 0


def test_suffix_dedup_places_do_not_collide(spark):
    """Strings much longer than their anchors: places and lengths of a context stay apart."""
    pick = random.Random(8)
    shared = "".join(chr(pick.randrange(97, 123)) for _ in range(6100))
    rows = [(1, "x" + shared + "yy"), (2, "zzz" + shared), (3, shared[:5999] + "!"), (4, shared[100:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw, gone = _repeats(rows, 6000)
    for r in suffix_dedup.remove(docs, length=6000, gram=64).collect():
        assert bytes(r["kept_"]) == np.frombuffer(raw[r["doc_id"]], np.uint8)[~gone[r["doc_id"]]].tobytes()


def test_suffix_dedup_of_table(spark):
    """The query against all 400-byte strings of the table."""
    place = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{place}/documents.parquet").collect()}
    once, again = set(), set()
    for data in texts.values():
        for s in range(len(data) - 399):
            h = hash(data[s : s + 400])
            (again if h in once else once).add(h)
    touched = 0
    for r in suffix_dedup.op7_suffix_dedup(spark, place).collect():
        data = texts[r["doc_id"]]
        edge = np.zeros(len(data) + 1, int)
        for s in range(len(data) - 399):
            if hash(data[s : s + 400]) in again:
                edge[s] += 1
                edge[s + 400] -= 1
        gone = np.cumsum(edge)[: len(data)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        touched += bool(gone.any())
    assert touched > 100


def test_suffix_dedup_least_words(spark):
    """Runs of fewer words stay; runs long enough for a script without spaces go."""
    pick = random.Random(4)
    words = [f"w{n}" for n in range(5000)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    few, many, solid = " ".join("longword%d" % pick.randrange(10**6) for _ in range(40)), prose(60), "".join(chr(0x4E00 + pick.randrange(9000)) for _ in range(400))
    rows = [(k, f"{prose(30)} {x} {prose(30)}") for k, x in enumerate([few, few, many, many, solid, solid])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_"] for r in suffix_dedup.remove(docs, length=200, gram=96, as_text=True, least_words=50).collect()}
    assert all(got[k] == rows[k][1] for k in (0, 1))
    assert all(many not in got[k] and len(got[k]) < len(rows[k][1]) for k in (2, 3)) and all(solid not in got[k] for k in (4, 5))


@pytest.mark.parametrize("data", [b"", b"a", b"banana", b"aaaaaaaa", b"mississippi" * 3, bytes(range(256)) * 2, "éàé".encode() * 9])
def test_suffix_sort(data):
    order = suffix_sort.two_stage(data, len(data) + 1)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = suffix_sort.adjacent_prefixes(data, order, 400)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[k] == min(n, 400)
    wanted = np.arange(len(data)) % 3 == 0
    some = suffix_sort.two_stage(data, len(data) + 1, wanted)
    assert [i for i in some.tolist() if wanted[i]] == [i for i in order.tolist() if wanted[i]]


def test_line_dedup(docs, none, rows):
    done = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    seen, removed = set(), 0
    for key, text, *_ in rows:
        if text is None:
            assert done[key]["text"] is None
            continue
        stay, parts = [], 0
        for chunk in line_dedup.chunks(text):
            whole = "\n".join(chunk)
            if len(chunk) > 1 and whole in seen:
                parts += 1
            else:
                stay += chunk
                if len(chunk) > 1:
                    seen.add(whole)
        removed += parts
        assert (done[key]["text"], done[key]["chunks_gone_"], done[key]["gone_"]) == ("\n".join(stay), parts, "g")
    assert removed >= 4 and len(done) == len(rows)
    assert line_dedup.dedup(none).count() == 0


def test_line_runs(spark):
    """Every line of a repeated run of two or more goes, short runs and lone edges too; a single repeated line stays."""
    texts = {1: "p\nq\nr\ns", 2: "x1\np\nq\nx2", 3: "y1\nr\ns", 4: "q\nr", 5: "z1\nq\nz2", 6: "a\na\na", 7: "a\na", 8: "b\nb\nb\nb", 9: None, 10: "", 11: "x2\nw1\np\nq\nr\ns"}
    docs = spark.createDataFrame([*texts.items(), (None, "p\nq\nown")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["lines_gone_"], r["chunks_gone_"]) for r in line_dedup.dedup(docs, runs=True).collect()}
    # the row without an id comes first and keeps its lines
    assert got == {None: ("p\nq\nown", 0, 0), 1: ("r\ns", 2, 1), 2: ("x1\nx2", 2, 1), 3: ("y1", 2, 1), 4: ("", 2, 1), 5: ("z1\nq\nz2", 0, 0), 6: ("a\na\na", 0, 0), 7: ("", 2, 1), 8: ("b\nb", 2, 1), 9: (None, 0, 0), 10: ("", 0, 0), 11: ("x2\nw1", 4, 1)}


def test_line_runs_of_table(spark):
    """The query against all pairs of lines of the table, in order."""
    place = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    first, want = {}, {}
    for key, text in sorted(rows):
        lines, out = (text or "").split("\n"), set()
        for k in range(len(lines) - 1):
            d, p = first.setdefault((lines[k], lines[k + 1]), (key, k))
            if d != key or k > p + 1:
                out |= {k, k + 1}
        want[key] = (len(out), hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in out).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_removed_lines"], r["kept_sha256"]) for r in line_dedup.op1_line_dedup(spark, place).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 0


def test_line_chunks_are_shift_resistant():
    pick = random.Random(1)
    lines = [f"line {pick.random()}" for _ in range(200)]
    a = {"\n".join(c) for c in line_dedup.chunks("\n".join(lines))}
    b = {"\n".join(c) for c in line_dedup.chunks("\n".join(["another", "start", *lines]))}
    assert len(a & b) > 0.9 * len(a)
    assert all(len(c) > 1 for c in line_dedup.chunks("\n".join(lines))[:-1])
    assert "\n".join(x for c in line_dedup.chunks("a\n\nb\n") for x in c) == "a\n\nb\n"


def test_copies_of_rows(spark, rows):
    """Rows twice: copies, not crashes."""
    docs = spark.createDataFrame(rows[4:9] + rows[4:9], SCHEMA)
    assert suffix_dedup.remove(docs).count() == line_dedup.dedup(docs).count() == ngram_join.similar(docs).count() == 10
    kept = {r["doc_id"]: len(r["kept_"]) for r in suffix_dedup.remove(docs).collect()}
    assert kept[7] == 0 and kept[4] == 3


def _held(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


def test_toxicity(spark):
    path = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == _held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    test = [r for r in got if r["held_out"]]
    hit = [r["predicted"] for r in test if r["toxic"] == 1]
    false = [r["predicted"] for r in test if r["toxic"] == 0]
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.01 * len(false) and len(hit) > 30


def test_toxicity_ratios(spark):
    """The model's log ratios against Kneser-Ney probabilities counted one by one."""
    texts = ["bad awful cat", "awful badly", "bad bad", "good cat sat", "goodly cats", "a sad cat", "sat", "und\u00e9 bad cab", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)], "doc_id long, label int")
    order, model = 3, toxicity.fit(docs, labels, order=3, margin=0.0)
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    cut = lambda w: [(b"\x02" * (order - 1) + w.encode() + b"\x03")[k : k + order] for k in range(len(w.encode()) + 1)]
    types = {order: {g for t in texts for w in words(t) for g in cut(w)}}
    for n in range(order - 1, 0, -1):
        types[n] = {g[1:] for g in types[n + 1]}

    def shared(g):
        if not g:
            return 1 / 256
        cont = {x: sum(y[1:] == x for y in types[len(g) + 1]) for x in types[len(g)] if x[:-1] == g[:-1]}
        return (max(cont.get(g, 0) - 0.75, 0) + 0.75 * len(cont) * shared(g[1:])) / sum(cont.values())

    def likelihood(g, kind):
        count = [x for k, t in enumerate(texts[:6]) if (k < 3) == kind for w in words(t) for x in cut(w) if x[:-1] == g[:-1]]
        if not count:
            return shared(g[1:])
        off = {x: min(count.count(x), {1: 1.0, 2: 1.5}.get(count.count(x), 2.0)) for x in set(count)}
        left = max(sum(off.values()) / len(count), 1e-3)
        return (count.count(g) - off.get(g, 0)) / len(count) + left * shared(g[1:])

    for word in ("bad", "awful", "cat", "good", "sat", "cab", "badly"):
        want = sum(np.log(likelihood(g, True) / likelihood(g, False)) for g in cut(word))
        assert model.words([word])[0] == pytest.approx(want, abs=1e-9), word
    shrunk = toxicity.fit(docs, labels, order=3, margin=0.5)
    raw = model.words(["bad", "good", "zzz"])
    assert shrunk.words(["bad", "good", "zzz"]) == pytest.approx(np.sign(raw) * np.maximum(np.abs(raw) - 0.5, 0))
    assert raw[0] > 0 > raw[1]


def test_toxicity_edges(spark, none):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([None, "", "!!", "bad awful word", "nice day"] + ["nice calm day"] * 30 + ["bad awful thing"] * 30)], "doc_id long, text string, score string")
    labels = docs.select("doc_id", F.when(F.col("text").contains("bad"), 1).when(F.col("text").contains("nice"), 0).alias("label"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[0] == got[1] == got[2] < 0.5 and got[3] > 0.5 > got[4]
    assert toxicity.score(none, model).count() == 0
    assert "bad awful word" not in {r["text"] for r in toxicity.tolerable(docs, model).collect()}
    long = spark.createDataFrame([(1, "bad awful thing " * 200_000, "x"), (1, "nice day", "y"), (1, "nice day", "y")], "doc_id long, text string, evidence string")
    again = sorted((r["doc_id"], r["score"]) for r in toxicity.score(long, model).collect())
    assert len(again) == 3 and again[0] == again[1] and again[2][1] > 0.5
    unlabelled = toxicity.fit(docs, labels.where("label = 0"))
    assert {r["score"] for r in toxicity.score(docs, unlabelled).collect()} == {0.0}


def test_digests(spark):
    """The thin queries derive what they return from the operators' outputs."""
    got = bpe.op6_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()["text"]
    ids = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(RANKS).rank, special_tokens={}).encode_ordinary(text)
    assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
