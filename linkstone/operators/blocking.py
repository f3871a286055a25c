"""Blocking: typed keys of each record, their weights, the scoring join and top-k with side places."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstone.functions.dictionaries import ADDRESS_STOP
from linkstone.functions.text import words_sql
from linkstone.sources.stages import staged

#: Channel of each key type: 0 name, 1 address, 2 mixed; and its group in the candidate pool.
CHANNEL = {"c": 0, "s": 0, "p": 0, "u": 0, "a": 1, "x": 2, "n": 2, "m": 2, "z": 2}
GROUP = {"c": 0, "s": 0, "p": 1, "u": 1, "n": 2, "m": 2, "a": 3, "x": 4, "z": 5}

#: What ``best_postings`` returns, and the rows of keys that are made into pairs at once.
BEST = "country string, s1 string, cand string, sc double, sn double, sa double, nkeys int, maxidf double, g0 int, g1 int, g2 int, g3 int, g4 int, g5 int"
SLICE = 2000


def with_keys(rec: DataFrame) -> DataFrame:
    """Adds keys array<string>, a set: all blocking keys of the record."""
    out = rec.withColumn("_al", F.expr(f"slice(filter(alph, t -> length(t) >= 3 AND t NOT IN ({words_sql(ADDRESS_STOP)}) AND NOT t RLIKE '^[0-9]+$'), 1, 8)"))
    out = out.withColumn("_a4", F.expr("transform(_al, t -> substring(t, 1, 4))")).withColumn("_cc", F.array_join("core", ""))
    out = out.withColumn("_pre", F.expr("array_sort(array_distinct(transform(filter(slice(array_distinct(core), 1, 6), t -> length(t) >= 2), t -> substring(t, 1, 4))))"))
    out = out.withColumn("_cp", F.expr("slice(array_distinct(transform(filter(core, t -> length(t) >= 2), t -> substring(t, 1, 4))), 1, 3)"))
    parts = [
        "CASE WHEN size(core) > 0 THEN array(concat('c:', _cc), concat('s:', array_join(array_sort(array_distinct(core)), ' '))) ELSE array() END",
        "transform(_pre, p -> concat('u:', p))",
        "flatten(transform(_pre, (p, i) -> transform(slice(_pre, i + 2, size(_pre)), q -> concat('p:', p, '|', q))))",
        "flatten(transform(slice(nums, 1, 2), n -> transform(slice(_pre, 1, 4), t -> concat('x:', t, '|', n))))",
        "flatten(transform(filter(slice(nums, 1, 3), n -> length(n) <= 7), n -> transform(_a4, t -> concat('a:', n, '|', t))))",
        "CASE WHEN size(core) > 0 THEN transform(_a4, t -> concat('n:', _cc, '|', t)) ELSE array() END",
        "flatten(transform(_cp, t -> transform(slice(_a4, 1, 6), u -> concat('m:', t, '|', u))))",
        "flatten(transform(filter(slice(nums, 1, 4), n -> length(n) IN (5, 6)), n -> transform(slice(core, 1, 3), t -> concat('z:', n, '|', substring(t, 1, 4)))))",
    ]
    return out.withColumn("keys", F.expr(f"array_distinct(concat({', '.join(parts)}))")).drop("_al", "_a4", "_cc", "_pre", "_cp")


def key_rows(rec: DataFrame) -> DataFrame:
    """(country, id, src, key): the inverted relation; ``rec`` may have its keys already."""
    return (rec if "keys" in rec.columns else with_keys(rec)).select("country", F.col("entity_id").alias("id"), "src", F.explode("keys").alias("key"))


def key_weights(candidate_keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """(country, key, df, idf): documents a key occurs in among a country's candidates, ln(1 + N / df)."""
    # one row for each country; joined after the keys have been counted
    sizes = candidates.groupBy("country").agg(F.count(F.lit(1)).alias("n_c"))
    return candidate_keys.groupBy("country", "key").agg(F.count(F.lit(1)).alias("df")).join(sizes, "country").select("country", "key", "df", F.log1p(F.col("n_c") / F.col("df")).alias("idf"))


def _in(kinds: dict[str, int], value: int) -> Column:
    return F.substring("key", 1, 1).isin([k for k, v in kinds.items() if v == value])


def postings(candidate_keys: DataFrame, usable: DataFrame) -> DataFrame:
    """(country, key, df, idf, cands): the ids of each usable key's candidates in order, joined by tabs, which no id of a tab-separated file has."""
    return candidate_keys.join(usable, ["country", "key"]).groupBy("country", "key").agg(F.first("df").alias("df"), F.first("idf").alias("idf"), F.array_join(F.array_sort(F.collect_list("id")), "\t").alias("cands"))


def score_pairs(query_keys: DataFrame, candidate_keys: DataFrame, weights: DataFrame, max_df: int = 300, detail: bool = False, cap: Column | None = None) -> DataFrame:
    """(country, s1, cand, sc, sn, sa, nkeys[, maxidf, g0..g5]) of all pairs that share a key of at most ``max_df`` candidates.

    The cap comes before the join: a key gives each query at most ``max_df`` rows, whatever its
    frequency.  ``cap`` is a condition on query and weight columns in place of it.  A key's candidates
    travel as one text to each of its queries, dealt by s1; pairs are made and summed there, and what
    works on the pairs of a query next needs no other exchange.
    """
    usable = weights.where(F.col("df") <= max_df) if cap is None else weights
    return score_postings(query_keys, postings(candidate_keys, usable), detail, cap)


def _sent(query_keys: DataFrame, lists: DataFrame, cap: Column | None = None) -> DataFrame:
    """The candidates of each of a query's keys, dealt by s1."""
    q = query_keys.withColumnRenamed("id", "s1").drop("src").join(lists, ["country", "key"])
    if cap is not None:
        q = q.where(cap)
    return q.select("country", "s1", F.substring("key", 1, 1).alias("key"), "idf", "cands").repartition("s1")


def score_postings(query_keys: DataFrame, lists: DataFrame, detail: bool = False, cap: Column | None = None) -> DataFrame:
    """The pairs of ``score_pairs`` by the candidates of each key (``postings``)."""
    sent = _sent(query_keys, lists, cap)
    part = lambda kinds, v: F.sum(F.when(_in(kinds, v), F.col("idf")).otherwise(0.0))
    aggs = [F.round(F.sum("idf"), 6).alias("sc"), F.round(part(CHANNEL, 0), 6).alias("sn"), F.round(part(CHANNEL, 1), 6).alias("sa"), F.count(F.lit(1)).cast("int").alias("nkeys")]
    if detail:
        aggs += [F.round(F.max("idf"), 6).alias("maxidf"), *(F.sum(_in(GROUP, g).cast("int")).cast("int").alias(f"g{g}") for g in range(6))]
    return sent.select("country", "s1", "key", "idf", F.explode(F.split("cands", "\t")).alias("cand")).groupBy("country", "s1", "cand").agg(*aggs)


def ranks(pairs: DataFrame, group: str = "s1") -> DataFrame:
    """Adds brank, rank_n, rank_a: places from 0 by total, name and address score, ties by candidate."""
    place = lambda score: (F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "cand")) - 1).cast("int")
    return pairs.withColumn("brank", place("sc")).withColumn("rank_n", place("sn")).withColumn("rank_a", place("sa"))


def side_slots(ranked: DataFrame, top: int = 12, side: int = 3) -> DataFrame:
    """Pairs in the first ``top`` places, or in the first ``side`` by name or by address alone."""
    return ranked.where((F.col("brank") < top) | ((F.col("rank_n") < side) & (F.col("sn") > 0)) | ((F.col("rank_a") < side) & (F.col("sa") > 0)))


def best_postings(query_keys: DataFrame, lists: DataFrame, top: int, side: int, what: str, rounds: int = 2) -> DataFrame:
    """``side_slots`` of the ranked pairs of ``score_postings`` with detail, without their places: stage tables of ``what``.

    The queries are dealt into ``rounds`` parts by their ids, one after the other, so no more than
    a part's lists lie in shuffle files at once.  Pairs are summed and placed by Arrow batches, and only
    those that stay are rows.
    """
    keep = lambda batches: _kept(batches, top, side)
    part = lambda r: query_keys.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
    return reduce(DataFrame.unionByName, [staged(_sent(part(r), lists).sortWithinPartitions("s1", "country").mapInArrow(keep, BEST), what) for r in range(rounds)])


def _kept(batches: Iterable[pa.RecordBatch], top: int, side: int) -> Iterator[pa.RecordBatch]:
    """The pairs that stay of rows (country, s1, key, idf, cands) in order of s1; a query's rows are taken together."""
    held = None
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            rows = pa.Table.from_batches([batch.slice(start, SLICE)])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = pc.index(rows["s1"], rows["s1"][-1]).as_py()
            if last:
                yield _summed(rows.slice(0, last), top, side)
            held = rows.slice(last)
    if held is not None:
        yield _summed(held, top, side)


def _summed(rows: pa.Table, top: int, side: int) -> pa.RecordBatch:
    """The pairs that stay of whole queries."""
    country, s1, key, idf, cands = (rows[c].combine_chunks() for c in ("country", "s1", "key", "idf", "cands"))
    lists = pc.split_pattern(cands, "\t")
    sizes = lists.value_lengths().to_numpy()
    coded, query, place, kind = lists.flatten().dictionary_encode(), s1.dictionary_encode(), country.dictionary_encode(), key.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # a pair is one number: its query, its country and its candidate's place among the ids, so pairs come out in the order of ties
    group = query.indices.to_numpy().astype(np.int64) * len(place.dictionary) + place.indices.to_numpy()
    pair, of = np.unique(np.repeat(group, sizes) * len(order) + rank[coded.indices.to_numpy()], return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    group, cand = np.divmod(pair, len(order))
    mine, channel, family = group // len(place.dictionary), _codes(CHANNEL, kind), _codes(GROUP, kind)
    weight = idf.to_numpy()
    total = lambda w: np.round(np.bincount(of, w[row], len(pair)), 6)
    sc, sn, sa = total(weight), total(np.where(channel == 0, weight, 0.0)), total(np.where(channel == 1, weight, 0.0))
    stay = _place(mine, sc, cand) < top
    if side:
        stay |= ((_place(mine, sn, cand) < side) & (sn > 0)) | ((_place(mine, sa, cand) < side) & (sa > 0))
    # the detail is of pairs that stay only
    new = np.cumsum(stay) - 1
    row, of = row[stay[of]], new[of[stay[of]]]
    n = int(stay.sum())
    most = np.zeros(n)
    np.maximum.at(most, of, weight[row])
    count = lambda some: pa.array(np.bincount(of[some], minlength=n).astype(np.int32))
    ids = [place.dictionary.take(pa.array(group[stay] % len(place.dictionary))), query.dictionary.take(pa.array(mine[stay])), coded.dictionary.take(pa.array(order[cand[stay]]))]
    sums = [pa.array(x[stay]) for x in (sc, sn, sa)]
    detail = [count(slice(None)), pa.array(np.round(most, 6)), *(count(family[row] == g) for g in range(6))]
    return pa.RecordBatch.from_arrays([*ids, *sums, *detail], names=[c.split()[0] for c in BEST.split(", ")])


def _codes(kinds: dict[str, int], key: pa.DictionaryArray) -> np.ndarray:
    return np.array([kinds.get(k, -1) for k in key.dictionary.to_pylist()])[key.indices.to_numpy()]


def _place(query: np.ndarray, score: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Places from 0 within each query by score, ties by candidate."""
    order = np.lexsort((cand, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    out = np.empty(len(query), np.int64)
    out[order] = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
    return out


def block(rec: DataFrame, max_df: int = 300, top: int = 12, side: int = 3) -> DataFrame:
    """Candidate pairs of all countries at once; the country is part of every key."""
    keys = key_rows(rec)
    queries, candidates = keys.where("src = 1"), keys.where("src > 1")
    weights = key_weights(candidates, rec.where("src > 1"))
    return side_slots(ranks(score_pairs(queries, candidates, weights, max_df)), top, side)


def address_free(query_keys: DataFrame) -> DataFrame:
    """(country, s1, no_address): whether a query has no key that an address is part of."""
    return query_keys.groupBy("country", F.col("id").alias("s1")).agg((F.max(F.substring("key", 1, 1).isin("n", "m", "a").cast("int")) == 0).alias("no_address"))


def block_by_address(rec: DataFrame, max_df: int = 300, max_df_noaddr: int = 600, top: int = 12, side: int = 3) -> DataFrame:
    """Blocking where queries without address keys may use more frequent keys."""
    keys = key_rows(rec)
    queries, candidates = keys.where("src = 1"), keys.where("src > 1")
    weights = key_weights(candidates, rec.where("src > 1")).where(F.col("df") <= max(max_df, max_df_noaddr))
    flagged = queries.join(address_free(queries).withColumnRenamed("s1", "id"), ["country", "id"])
    cap = F.col("df") <= F.when(F.col("no_address"), F.lit(max_df_noaddr)).otherwise(F.lit(max_df))
    return side_slots(ranks(score_pairs(flagged, candidates, weights, cap=cap)), top, side)
