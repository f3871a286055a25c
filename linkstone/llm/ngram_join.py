"""N-gram Jaccard join with a count-vector R-tree.

Texts are sets of word shingles.  Texts with equal sets are one class from the start.  Classes meet
where they share a shingle of their prefix: in an order of all shingles that two similar sets agree
on, each must have a common one among its first n - ceil(t n) + 1.  The order is by how many texts
hold a shingle (a fixed-size sketch over all texts), rarest first, so a passage that many texts
share lies outside the prefixes of all but near copies.

Where classes meet, links are sought in steps, and each step leaves out what the ones before have
put into one component, so a group of copies is never spread into its pairs.  The first is a star
(each class against one class of its groups).  Then comes the R-tree: count vectors of a group's
classes are its points, and node bounds by summed coordinate minima leave the pairs that can still
be links.  In all but the last of ``rounds`` such steps each class takes its nearest by that bound
only, in the last all that is left; pairs are verified on the whole sets.  Every link is thus either verified or inside a component found by verified links.

Defined results: null or empty texts, and texts without words, have 0 shingles and are linked with
nothing; with fewer words than a shingle has, the whole sequence is the one shingle; repeated rows
and ties make no difference; other columns are passed over.  Words are hashed by XXH3 and shingles
compared by 52 bits of the mixed hashes; sets are equal by two fingerprints of 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm import count_tree
from linkstone.llm.common import empty, slices, stash, table, text_of
from linkstone.llm.components import components
from linkstone.llm.shingles import HASH_BITS, MAX_TEXTS, mix, shingle_sets

#: The sketch of text frequencies: counters, and counters in a row of its table.
_SKETCH_BITS, _CHUNK = 18, 4096
#: Groups of a count vector: in the tree, and where a single pair is looked at again.
_GROUPS, _FINE = 128, 1024
#: First fingerprints that different sets may share; at 10^11 sets some hundreds are to be expected.
_MOST_CLASHES = 10_000
_BITS = np.uint64(HASH_BITS)
_LOW = np.uint64((1 << HASH_BITS) - 1)


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in slices(batches, "text"):
        for k in range(0, piece.num_rows, MAX_TEXTS):
            batch = piece.slice(k, MAX_TEXTS)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch, *shingle_sets(texts, width)


def _prints(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-independent fingerprints of each set."""
    start = np.cumsum(size) - size
    has = size > 0
    out = []
    for salt in (1, 0x9E3779B97F4A7C15):
        sums = np.zeros(len(size), np.uint64)
        if has.any():
            sums[has] = np.add.reduceat(mix((key & _LOW) + np.uint64(salt)), start[has])
        out.append(mix(sums ^ size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _classes(key: np.ndarray, size: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The class of each set: its first fingerprint, or a mix of both where different sets share the first."""
    fp, other = _prints(key, size)
    return np.where(np.isin(fp, clash), _mixed(fp, other), fp)


def _mixed(fp: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix(fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + other.view(np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, n, fp) of each text, the sketch (texts per shingle hash, by the hash's low bits), and the first fingerprints that different sets share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "fp", "other", "mixed", "chunk", "counts"]
        sketch = np.zeros(1 << _SKETCH_BITS, np.int64)
        for batch, key, size in _sets(batches, width):
            sketch += np.bincount((key & np.uint64((1 << _SKETCH_BITS) - 1)).astype(np.int64), minlength=len(sketch))
            rows = batch.num_rows
            fp, other = _prints(key, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array(fp), pa.array(other), pa.array(_mixed(fp, other)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        chunks = len(sketch) // _CHUNK
        parts = [sketch[k * _CHUNK : (k + 1) * _CHUNK].astype(np.int32).tobytes() for k in range(chunks)]
        longs = [pa.nulls(chunks, pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([pa.nulls(chunks, pa.int64()), pa.nulls(chunks, pa.int32()), *longs, pa.array(range(chunks), pa.int32()), pa.array(parts, pa.binary())], names=names)

    both = stash(docs.mapInArrow(run, "id long, n int, fp long, other long, mixed long, chunk int, counts binary"), "fingerprints")

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    # the sums have a fixed size, whatever the table's
    total = np.zeros(1 << _SKETCH_BITS, np.int64)
    for chunk, counts in both.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(added, "chunk int, counts binary").collect():
        total[chunk * _CHUNK : (chunk + 1) * _CHUNK] += np.frombuffer(counts, np.int64)
    prints = both.where("chunk IS NULL")
    # about n * n / 2^65 of n different sets
    shared = prints.groupBy("fp").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("fp")
    clash = np.array([r[0] for r in shared.limit(_MOST_CLASHES + 1).collect()], np.int64)
    if len(clash) > _MOST_CLASHES:
        raise ValueError("too many different sets share a fingerprint")
    if len(clash):
        prints = prints.withColumn("fp", F.when(F.col("fp").isin(clash.tolist()), F.col("mixed")).otherwise(F.col("fp")))
    return prints.select("id", "n", "fp"), total, clash


def prefixes(docs: DataFrame, sketch: np.ndarray, clash: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, fp, n, rank): the prefix of each set in the common order; equal sets of a task once."""
    place = np.empty(len(sketch), np.uint64)
    place[np.argsort(sketch, kind="stable")] = np.arange(len(sketch), dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = shared.value, set()
        for _, key, size in _sets(batches, width):
            prints = _classes(key, size, clash)
            new = np.zeros(len(size), bool)
            for k, fp in enumerate(prints.tolist()):
                if size[k] and fp not in seen:
                    seen.add(fp)
                    new[k] = True
            owner = (key >> _BITS).astype(np.int64)
            key = key[new[owner]]
            value = key & _LOW
            token = place[value & np.uint64((1 << _SKETCH_BITS) - 1)] << np.uint64(HASH_BITS - _SKETCH_BITS) | value >> np.uint64(_SKETCH_BITS)
            key = np.sort(key & ~_LOW | token)
            owner = (key >> _BITS).astype(np.int64)
            kept = np.where(new, size, 0)
            rank = np.arange(len(key)) - (np.cumsum(kept) - kept)[owner]
            first = rank < (size - -(-percent * size // 100) + 1)[owner]
            owner = owner[first]
            yield pa.RecordBatch.from_arrays([pa.array((key[first] & _LOW).view(np.int64)), pa.array(prints[owner]), pa.array(size[owner].astype(np.int32)), pa.array(rank[first].astype(np.int32))], names=["token", "fp", "n", "rank"])

    return docs.mapInArrow(run, "token long, fp long, n int, rank int")


def small_groups(start: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i before j, of the pairs in all groups of 2 to ``most`` rows, some groups at a time."""
    for s in np.unique(size[(size > 1) & (size <= most)]).tolist():
        i, j = np.triu_indices(s, 1)
        base = start[size == s]
        for k in range(0, len(base), max(1, 100_000 // len(i))):
            part = base[k : k + max(1, 100_000 // len(i)), None]
            yield (part + i).ravel(), (part + j).ravel()


def meetings(rows: DataFrame, percent: int, most: int = 64) -> DataFrame:
    """The rows of tokens that more than one class has, once each.

    In a small group a row also needs a partner: of a size that allows a link, and such that from the
    token on both sets have enough left (the pair's first common token is such a one).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, True  # the last row so far, and whether it has been given out
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "fp", "rank")]
            if last is not None:
                columns = [np.concatenate([[x], column]) for x, column in zip(last, columns, strict=True)]
            token, n, fp, rank = columns
            if not len(token):
                continue
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])])
            token, n, fp, rank = token[first], n[first], fp[first], rank[first]
            same = token[1:] == token[:-1]
            live = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            alone = not live[-1]
            if last is not None and given:
                alone, live[0] = alone and len(token) > 1, False
            last, given = (token[-1], n[-1], fp[-1], rank[-1]), not alone
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(start, len(token)))
            inner = np.ones(len(size), bool)
            inner[[0, -1]] = False  # groups that may go on outside this batch are kept
            judged = np.repeat(inner & (size <= most), size)
            partner = np.zeros(len(token), bool)
            for i, j in small_groups(start[inner], size[inner], most):
                least = count_tree.needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)
                fits = (percent * n[j].astype(np.int64) <= 100 * n[i].astype(np.int64)) & (n[i] - rank[i] >= least) & (n[j] - rank[j] >= least)
                partner[i[fits]] = True
                partner[j[fits]] = True
            live &= partner | ~judged
            if live.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[live]), pa.array(fp[live]), pa.array(n[live].astype(np.int32)), pa.array(rank[live].astype(np.int32))], names=["token", "fp", "n", "rank"])

    return rows.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(run, "token long, fp long, n int, rank int")


def set_table(docs: DataFrame, clash: np.ndarray, width: int) -> DataFrame:
    """(fp, n, point, fine, hashes) of texts: count vectors of few and of many groups, sorted hashes, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key, size in _sets(batches, width):
            value, owner = key & _LOW, (key >> _BITS).astype(np.int64)
            group = (mix(value) >> np.uint64(54)).astype(np.int64)
            fine = np.bincount(owner * _FINE + group, minlength=len(size) * _FINE).reshape(len(size), _FINE)
            points = fine.reshape(len(size), _GROUPS, _FINE // _GROUPS).sum(2)
            start = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([pa.array(_classes(key, size, clash)), pa.array(size.astype(np.int32)), pa.array([_packed(p) for p in points], pa.binary()), pa.array([_packed(p) for p in fine], pa.binary()), pa.array([value[s : s + n].tobytes() for s, n in zip(start, size, strict=True)], pa.binary())], names=["fp", "n", "point", "fine", "hashes"])

    return docs.mapInArrow(run, "fp long, n int, point binary, fine binary, hashes binary")


def _packed(point: np.ndarray) -> bytes:
    """A point's counts in as few bytes each as the largest needs."""
    most = int(point.max())
    return point.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _points(column, groups: int = _GROUPS) -> np.ndarray:
    kinds = {groups: np.uint8, 2 * groups: np.uint16, 4 * groups: np.uint32}
    return np.stack([np.frombuffer(p, kinds[len(p)]) for p in column.to_pylist()]).astype(np.int32)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose count vectors allow a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                left, right = _points(batch.column("left"), _FINE), _points(batch.column("right"), _FINE)
                fits = np.minimum(left, right).sum(1) >= count_tree.needed(left.sum(1), right.sum(1), percent)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    side = lambda key, name: sets.select(F.col("fp").alias(key), F.col("fine").alias(name)).hint("merge")
    return pairs.select("a", "b").join(side("a", "left"), "a").join(side("b", "right"), "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links, by the overlap of the whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int((b[at] == a).sum())
                linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    # only the sets of pairs that their finer count vectors still allow travel; whether their ids do is for Spark to decide by the size of their table
    pairs = stash(bounded(pairs, sets, percent), "asked")
    asked = stash(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "asked-sets")
    needed = sets.select("fp", "hashes").join(asked, "fp", "left_semi")
    side = lambda key, name: needed.select(F.col("fp").alias(key), F.col("hashes").alias(name)).hint("merge")
    return pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").mapInArrow(run, "a long, b long")


def _stars(live: DataFrame, seed: int, percent: int) -> DataFrame:
    """One pair for each class: with the class that is first, by a seeded order, in most of its groups."""
    rank = F.xxhash64("fp", F.lit(seed))
    first = stash(live.groupBy("token").agg(F.min(F.struct(rank.alias("r"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))).alias("hub")), "hubs")
    near = (percent * F.col("n") <= 100 * F.col("hub.m")) & (percent * F.col("hub.m") <= 100 * F.col("n")) & (F.col("root") != F.col("hub.other"))
    found = live.join(first.hint("merge"), "token").where(near).groupBy(F.col("fp").alias("a"), F.col("hub.b").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    return found.groupBy("a").agg(F.max(F.struct("met", "b")).alias("h")).select("a", F.col("h.b").alias("b"))


def _apart(live: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows with their component as root, of tokens where more than one component meets."""
    live = live.drop("root")
    if label is None:
        return live.withColumn("root", F.col("fp"))
    rooted = stash(live.join(label.withColumnRenamed("x", "fp").withColumnRenamed("root", "to").hint("merge"), "fp", "left").select("token", "fp", "n", "rank", F.coalesce("to", "fp").alias("root")), "rooted")
    open_ = stash(rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token"), "open")
    return stash(rooted.join(open_.hint("merge"), "token"), "apart")


def tree_pairs(apart: DataFrame, sets: DataFrame, percent: int, nearest: bool, chunk: int = 4096) -> DataFrame:
    """Distinct pairs (a, b) of classes of different components that meet in a token and that the tree leaves.

    ``nearest``: of a class's pairs in a group only the one with the largest bound.  A large group is dealt into chunks, and each pair of chunks is a task's work of its own.
    """
    parts = stash(apart.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts")).where("parts > 1"), "parts")
    dealt = apart.join(sets.select("fp", "point").hint("merge"), "fp")
    dealt = (dealt.withColumn("parts", F.lit(1)) if empty(parts) else dealt.join(parts.hint("merge"), "token", "left").fillna({"parts": 1})).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([held.column(c).to_numpy() for c in ("token", "i", "j")], 1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            cut = int(change[-1]) if len(change) else 0
            rest = held.slice(cut)
            if cut:
                yield from search(held.slice(0, cut), np.concatenate([[0], change[:-1]]))
        if rest is not None and rest.num_rows:
            yield from search(rest, np.zeros(1, np.int64))

    def search(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, n, left, root, own = (rows.column(c).to_numpy() for c in ("fp", "n", "rank", "root", "own"))
        n = n.astype(np.int64)
        left, points = n - left, _points(rows.column("point"))
        size = np.diff(np.append(start, len(fp)))
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in small_groups(start, size, count_tree.FANOUT):  # one leaf
            fits = np.minimum(points[i], points[j]).sum(1) >= count_tree.needed(n[i], n[j], percent)
            found.append((i[fits], j[fits]))
        for at, many in zip(start[size > count_tree.FANOUT].tolist(), size[size > count_tree.FANOUT].tolist(), strict=True):
            tree = count_tree.build(points[at : at + many], n[at : at + many])
            for k in range(many):
                near = count_tree.search(tree, points[at + k], int(n[at + k]), percent)
                found.append((np.full(len(near), at + k), near + at))
            found = [tuple(np.concatenate(side) for side in zip(*found, strict=True))]
        i, j = (np.concatenate(side) for side in zip(*found, strict=True))
        i, j = np.where(fp[i] < fp[j], i, j), np.where(fp[i] < fp[j], j, i)
        least = count_tree.needed(n[i], n[j], percent)
        group = np.repeat(np.arange(len(size)), size)
        cross = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start))[group[i]]
        kept = (fp[i] != fp[j]) & (root[i] != root[j]) & (left[i] >= least) & (left[j] >= least) & (~cross | (own[i] != own[j]))
        if nearest and kept.any():
            at = np.flatnonzero(kept)
            bound = np.concatenate([np.minimum(points[i[c]], points[j[c]]).sum(1) / least[c] for c in np.array_split(at, len(at) // 50_000 + 1)])
            ends, pair = np.concatenate([i[at], j[at]]), np.concatenate([at, at])
            order = np.lexsort((-np.concatenate([bound, bound]), ends))
            first = np.concatenate([[True], ends[order][1:] != ends[order][:-1]])
            kept = np.zeros(len(kept), bool)
            kept[pair[order][first]] = True
        if kept.any():
            pairs = np.unique(np.stack([fp[i[kept]], fp[j[kept]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = dealt.select("token", "i", "j", "fp", "n", "rank", "root", "own", "point")
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """(id, n_shingles, component_id): set size of each text and the smallest id its links reach."""
    docs = text_of(df, F.col(id_col).cast("long").alias("id"), text=text_col)
    prints, sketch, clash = fingerprints(docs, width)
    filled = prints.where("n > 0")
    classes = filled.groupBy("fp").agg(F.min("id").alias("first"))
    live = stash(meetings(prefixes(docs, sketch, clash, width, percent), percent), "meetings")
    label = None
    if not empty(live):
        wanted = stash(classes.join(live.select("fp").distinct(), "fp").select(F.col("first").alias("id")), "wanted")
        sets = stash(set_table(docs.join(wanted.hint("merge"), "id", "left_semi"), clash, width), "sets")
        links = None
        apart = _apart(live, None)
        for step in range(rounds + 1):
            if step == 0:
                pairs = _stars(apart, 1, percent)
            else:
                pairs = stash(tree_pairs(apart, sets, percent, nearest=step < rounds), "pairs")
            found = stash(verified(pairs, sets, percent), "links")
            links = found if links is None else links.unionByName(found)
            label = components(links)
            if step < rounds:
                apart = _apart(apart, label)
                if empty(apart):
                    break
    if label is None:
        rooted = classes.select("fp", "first", F.col("fp").alias("root"))
    else:
        rooted = classes.join(label, classes["fp"] == label["x"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    smallest = stash(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = stash(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    with_words = filled.join(named, "fp").select("id", "n", "component_id")
    without = prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return with_words.unionByName(without).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents at 0.8 over five words, as components."""
    return similar(table(spark, sf_dir, "documents"))
