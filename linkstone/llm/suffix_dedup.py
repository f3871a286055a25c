"""Removal of long byte strings that occur again, by suffix arrays.

A string of ``length`` bytes that occurs twice has the same smallest-hash grams of ``gram`` bytes at the
same places in both occurrences.  Those grams are the anchors; they are few, and where an anchor's
hash occurs once in the corpus nothing around it repeats.  The strings that hold an anchor lie in its
context, ``length - gram`` bytes to either side.  Contexts that are equal as a whole are repeated as
a whole and only one of them goes on.  What goes on meets by the anchor's hash, and a suffix array
of these contexts (two-stage sorting, then adjacent common prefixes) tells which of their strings
occur again.  A string matches only at the same distance from its anchor, so overlapping contexts of
one text are never taken for two occurrences.

Anchors with more than ``most`` contexts are split before sorting: the strings of a context are
halved by their place, each half is dealt by the bytes all its strings share, halves whose strings
are all repeated or all single are settled by counting, and only the rest goes on, down to single
strings if need be.  So no suffix array grows with the corpus, and nothing is dropped.

Defined results: null or empty texts, and texts shorter than ``length`` bytes, stay as they are; texts
that occur twice and have ``length`` bytes go whole; rows that repeat an id are texts of their own
when their bytes differ and copies otherwise; other columns are passed over.  Anchors and contexts
are compared by 64-bit hashes, whole texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import empty, fresh, slices, stash, table, text_of
from linkstone.llm.shingles import _tables, mix
from linkstone.llm.suffix_sort import adjacent_prefixes, two_stage

_ROW = "gid long, h long, ctx long, single boolean, left int, a int, b int, data binary"
_SPAN = "h long, ctx long, low int, high int"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of x over the ``width`` places from each on; the last ones see less."""
    x, size = x.copy(), 1
    while size * 2 <= width:
        pick(x[:-size], x[size:], out=x[:-size])
        size *= 2
    rest = width - size
    if rest:
        pick(x[:-rest], x[rest:], out=x[:-rest])
    return x


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all texts of ``length`` bytes or more: number of the text, place, gram hash, context hash, bytes to the left and right."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    n, wide = len(flat), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length or sizes.max() < length:
        return (none,) * 6
    ends = np.cumsum(sizes)
    power, inverse = _tables(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:n], out=upto[1:])
    grams = mix((upto[gram:] - upto[:-gram]) * inverse[: n - gram + 1])
    short = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(short, wide, np.minimum)[: n - length + 1]
    # strings that would run on into the next text do not count
    for end in ends[:-1].tolist():
        least[max(0, end - length + 1) : end] = 0
    # the strings that hold gram i start in i - wide + 1 .. i
    padded = np.concatenate([np.zeros(wide - 1, np.uint32), least, np.zeros(wide - 1, np.uint32)])
    reach = _slide(padded, wide, np.maximum)[: n - gram + 1]
    at = np.flatnonzero(short == reach)
    text = np.searchsorted(ends, at, "right")
    start = ends[text] - sizes[text]
    left, right = np.minimum(at - start, wide - 1), np.minimum(ends[text] - at - gram, wide - 1)
    low, high = at - left, at + gram + right
    context = mix((upto[high] - upto[low]) * inverse[low] + (left * wide + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, at - start, grams[at].view(np.int64), context.view(np.int64), left, right


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row of each text (digest, size) and a row of each anchor (h, ctx, id, at)."""
    names = ["id", "digest", "size", "h", "ctx", "at", "left", "right"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text", 2 << 20):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()).to_pylist()
            digests = [xxhash.xxh3_128_digest(t) for t in texts]
            rows = len(texts)
            nulls = [pa.nulls(rows, pa.int64())] * 2 + [pa.nulls(rows, pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *nulls], names=names)
            new = []
            for k, digest in enumerate(digests):  # a copy of a text of this task adds no string to the corpus
                if len(texts[k]) >= length and digest not in seen:
                    seen.add(digest)
                    new.append(k)
            if new:
                text, at, h, ctx, left, right = anchors([texts[k] for k in new], length, gram)
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[new][text]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(h), pa.array(ctx), *(pa.array(x.astype(np.int32)) for x in (at, left, right))], names=names)

    return docs.mapInArrow(run, "id long, digest binary, size long, h long, ctx long, at int, left int, right int")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the wanted contexts (h, ctx, copies, id, at, left, right)."""
    per_text = wanted.groupBy("id").agg(F.collect_list(F.struct("h", "ctx", "single", "at", "left", "right")).alias("cuts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                for c in cuts:
                    out.append((c["h"], c["h"], c["ctx"], c["single"], c["left"], 0, length - gram + 1, text[c["at"] - c["left"] : c["at"] + gram + c["right"]]))
            if out:
                yield _rows(out)

    return docs.join(per_text.hint("merge"), "id").select("text", "cuts").mapInArrow(run, _ROW)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gid", "h", "ctx", "single", "left", "a", "b", "data"])


def _halves(big: DataFrame, length: int, gram: int) -> DataFrame:
    """Both halves of the strings of each context, keyed by the bytes all strings of the half share."""
    side = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 1 << 20):
            out, hulls = [], []
            for row in batch.to_pylist():
                base = row["left"] - side
                middle = (row["a"] + row["b"]) // 2
                for a, b in ((row["a"], middle), (middle, row["b"])):
                    low, high = max(a, -base), min(b, len(row["data"]) - length - base + 1)
                    if low < high:
                        core = row["data"][base + b - 1 : base + a + length]
                        key = xxhash.xxh64_intdigest(core, seed=a) ^ (row["h"] & (2**64 - 1))
                        out.append((key - (1 << 64) if key >> 63 else key, row["h"], row["ctx"], row["single"], row["left"], a, b, row["data"]))
                        hulls.append(xxhash.xxh64_intdigest(row["data"][base + low : base + high - 1 + length], seed=low) >> 1)
            if out:
                rows = _rows(out)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hulls, pa.int64())], names=[*rows.schema.names, "hull"])

    return big.mapInArrow(run, f"{_ROW}, hull long")


def _clip(side: int, length: int) -> tuple:
    low = F.greatest(F.col("a"), F.lit(side) - F.col("left"))
    high = F.least(F.col("b"), F.octet_length("data") - length - F.col("left") + side + 1)
    return (low - side).alias("low"), (high - 1 + length - side).alias("high")


def repeated_strings(rows: DataFrame, length: int, gram: int, batch_bytes: int = 1 << 18) -> DataFrame:
    """Spans (h, ctx, low, high; from the anchor's start) that the suffix arrays of the groups find repeated."""
    side = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for piece in slices([batch], "data", 1 << 20):
                for row in piece.to_pylist():
                    if size > batch_bytes and row["gid"] != held[-1]["gid"]:
                        yield from sort(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["data"])
        if held:
            yield from sort(held)

    def sort(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        data = b"".join(r["data"] for r in rows)
        sizes = np.array([len(r["data"]) for r in rows])
        start = np.cumsum(sizes) - sizes
        base = np.array([r["left"] for r in rows]) - side
        low, high = (np.array([r[c] for r in rows]) for c in "ab")
        # places whose string of ``length`` bytes holds the anchor and lies in the context
        place = np.arange(len(data)) - np.repeat(start + base, sizes)
        wanted = (np.arange(len(data)) + length <= np.repeat(start + sizes, sizes)) & (place >= np.repeat(low, sizes)) & (place < np.repeat(high, sizes))
        order = two_stage(data, length, wanted)
        prefix = adjacent_prefixes(data, order, length)
        row = np.repeat(np.arange(len(rows)), sizes)[order]
        place, whole = place[order], wanted[order]
        key = np.cumsum(prefix < length)[whole] * (side + 1) + place[whole]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[which] > 1
        row, place = row[whole][again], place[whole][again]
        mine = np.array([r["single"] for r in rows])[row]
        row, place = row[mine], place[mine]
        if not len(row):
            return
        by = np.lexsort((place, row))
        row, place = row[by], place[by]
        # strings that overlap or touch are one span
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)])
        last = np.concatenate([first[1:], [True]])
        owner = row[first]
        yield pa.RecordBatch.from_arrays([pa.array([rows[k]["h"] for k in owner]), pa.array([rows[k]["ctx"] for k in owner]), pa.array((place[first] - side).astype(np.int32)), pa.array((place[last] - side + length).astype(np.int32))], names=["h", "ctx", "low", "high"])

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, _SPAN)


def _settle(rows: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Spans of all contexts in ``rows``; large groups are halved until they are small."""
    found = None
    todo = stash(rows, "contexts")
    while True:
        groups = stash(todo.groupBy("gid").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("gid"), "large")
        large = not empty(groups)
        small = todo.join(groups, "gid", "left_anti") if large else todo
        spans = repeated_strings(small, length, gram)
        found = spans if found is None else found.unionByName(spans)
        if not large:
            return found
        halves = stash(_halves(todo.join(groups, "gid", "left_semi"), length, gram), "halves")
        hulls = halves.groupBy("gid", "hull").agg(F.count(F.lit(1)).alias("same"), F.min("ctx").alias("chosen"))
        kinds = hulls.groupBy("gid").agg(F.count(F.lit(1)).alias("kinds"))
        hulls = stash(hulls.join(kinds, "gid").where("same > 1 OR kinds > 1"), "hulls")
        halves = stash(halves.join(hulls, ["gid", "hull"]), "settled")
        covered = halves.where("same > 1 AND single").select("h", "ctx", *_clip(length - gram, length))
        found = found.unionByName(covered.select("h", "ctx", F.col("low").cast("int"), F.col("high").cast("int")))
        goes_on = halves.where("kinds > 1 AND b - a > 1 AND (same = 1 OR ctx = chosen)")
        todo = goes_on.select("gid", "h", "ctx", (F.col("single") & (F.col("same") == 1)).alias("single"), "left", "a", "b", "data")


def repeats(docs: DataFrame, length: int = 400, gram: int = 256, most: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of texts that go whole, and (id, spans array<struct<low int, high int>>) of repeated bytes."""
    scan = stash(_scan(docs, length, gram), "anchors")
    texts = scan.where("digest IS NOT NULL AND size >= %d" % length)
    copies = stash(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest"), "copied")
    whole = stash(texts.select("id", "digest").join(copies, "digest").select("id", "digest").distinct(), "whole")
    found = scan.where("h IS NOT NULL").select("h", "ctx", "id", "at", "left", "right")
    groups = found.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("ctx").alias("lowest"), F.max("ctx").alias("highest"))
    groups = stash(groups.where("rows > 1").select("h", (F.col("lowest") != F.col("highest")).alias("mixed")), "anchors-again")
    live = stash(found.join(groups, "h"), "live")
    contexts = stash(live.groupBy("h", "ctx", "mixed", "left", "right").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "at")).alias("one")), "kinds")
    settled = contexts.where("rows > 1").select("h", "ctx", (-F.col("left")).cast("int").alias("low"), (F.col("right") + gram).cast("int").alias("high"))
    wanted = contexts.where("mixed").select("h", "ctx", (F.col("rows") == 1).alias("single"), F.col("one.id").alias("id"), F.col("one.at").alias("at"), "left", "right")
    # a group whose contexts all repeat has nothing left to find
    open_ = wanted.groupBy("h").agg(F.max("single").alias("open")).where("open").select("h")
    wanted = stash(wanted.join(stash(open_, "open"), "h"), "wanted")
    spans = stash(settled.unionByName(_settle(_contexts(docs, wanted, length, gram), length, gram, most)), "spans")
    placed = live.select("h", "ctx", "id", "at").join(spans, ["h", "ctx"]).select("id", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
    return whole, stash(placed.groupBy("id").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "by-text")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, gram: int = 256, most: int = 2048, as_text: bool = False, least_words: int = 0) -> DataFrame:
    """``df`` with kept_ (binary, the bytes that stay), n_bytes_, n_removed_, n_spans_ (long).

    Columns of these names are replaced.  ``as_text``: kept_ is a string; of a character of which only some bytes stay, none do.
    ``least_words``: a run of repeated bytes with fewer words (at ASCII white space) stays, unless it
    has 20 bytes for each of the words asked for, as in scripts without spaces.
    """
    docs = text_of(df, F.col(id_col).cast("long").alias("id"), text=text_col)
    whole, spans = repeats(docs, length, gram, most)
    df = df.drop("kept_", "n_bytes_", "n_removed_", "n_spans_")
    key, copied, marked = fresh(df, "key_", "digests_", "spans_")
    marks = whole.groupBy("id").agg(F.collect_set("digest").alias("digests")).join(spans, "id", "full")
    marks = marks.select(F.col("id").alias(key), F.col("digests").alias(copied), F.col("spans").alias(marked)).hint("merge")
    own = list(df.columns)
    rows = df.select("*", F.col(id_col).cast("long").alias(key)).join(marks, key, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            kept, sizes, removed, counts = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in (text_col, copied, marked))
            for text, digests, strings in zip(*columns, strict=True):
                raw = (text or "").encode()
                if digests and xxhash.xxh3_128_digest(raw) in digests:
                    runs = [(0, len(raw))]
                else:
                    runs = []
                    for low, high in sorted((s["low"], s["high"]) for s in strings or ()):
                        if runs and low <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
                        else:
                            runs.append((low, high))
                if least_words:
                    runs = [(low, high) for low, high in runs if high - low >= 20 * least_words or len(raw[low:high].split()) >= least_words]
                parts, at = [], 0
                for low, high in runs:
                    parts.append(raw[at:low])
                    at = high
                left = b"".join([*parts, raw[at:]])
                kept.append(left.decode(errors="ignore") if as_text else left)
                sizes.append(len(raw))
                removed.append(sum(high - low for low, high in runs))
                counts.append(len(runs))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())], names=[*own, "kept_", "n_bytes_", "n_removed_", "n_spans_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.select(*own, copied, marked).mapInArrow(run, f"{fields}, kept_ {'string' if as_text else 'binary'}, n_bytes_ long, n_removed_ long, n_spans_ long")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that also start elsewhere."""
    done = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_bytes_").alias("n_bytes"), F.col("n_removed_").alias("n_removed"), F.col("n_spans_").alias("n_spans"), F.sha2("kept_", 256).alias("kept_sha256"))
