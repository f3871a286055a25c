"""TF-IDF of words or of character grams inside words, and cosines of record pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The most terms of all countries and kinds that are sent to the workers, and the texts a task keeps the vectors of.
TERMS, TEXTS = 400_000, 20_000


def grams(column: str, kind: str) -> str:
    """SQL array of terms: ``w`` words, ``c<n>`` grams of each word with one space on either side."""
    words = f"filter(split({column}, ' '), t -> t <> '')"
    if kind == "w":
        return words
    n = int(kind[1:])
    return f"flatten(transform({words}, t -> CASE WHEN length(t) + 2 <= {n} THEN array(concat(' ', t, ' ')) ELSE transform(sequence(1, length(t) + 3 - {n}), i -> substring(concat(' ', t, ' '), i, {n})) END))"


def vectors(rec: DataFrame, column: str, kind: str) -> DataFrame:
    """(country, id, v map<term, weight>): counts clipped at 2, times ln((1+n)/(1+df)) + 1, of length 1.  Terms are exact."""
    counted = rec.select("country", F.col("entity_id").alias("id"), F.explode(F.expr(grams(column, kind))).alias("term")).groupBy("country", "id", "term").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("tf"))
    df = counted.groupBy("country", "term").agg(F.count(F.lit(1)).alias("df"))
    n = rec.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    idf = df.join(n, "country").select("country", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighted = counted.join(idf, ["country", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    per = weighted.groupBy("country", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.collect_list(F.struct("term", "w")).alias("e"))
    return per.select("country", "id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["term"], x["w"] / F.col("len")))).alias("v"))


def cosine(pairs: DataFrame, vecs: DataFrame, name: str) -> DataFrame:
    """Adds the cosine of each pair (s1, cand); 0 where a record has no term."""
    side = lambda key, v: vecs.select("country", F.col("id").alias(key), F.col("v").alias(v))
    both = pairs.join(side("s1", "_u"), ["country", "s1"], "left").join(side("cand", "_v"), ["country", "cand"], "left")
    dot = F.aggregate(F.map_entries("_u"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("_v", e["key"]), F.lit(0.0)))
    return both.withColumn(name, F.round(F.coalesce(dot, F.lit(0.0)), 6)).drop("_u", "_v")


def terms_of(text: str | None, kind: str) -> list[str]:
    """The terms of ``grams``."""
    words = [w for w in (text or "").split(" ") if w]
    if kind == "w":
        return words
    n = int(kind[1:])
    padded = [f" {w} " for w in words]
    return [w[i : i + n] for w in padded for i in range(max(1, len(w) - n + 1))]


def frequencies(rec: DataFrame, kinds: tuple[tuple[str, str], ...]) -> DataFrame:
    """(country, place, term, df): records of a country with a term of the ``place``-th of the (column, kind) pairs."""
    columns = sorted({c for c, _ in kinds})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            countries, texts = batch.column("country").to_pylist(), {c: batch.column(c).to_pylist() for c in columns}
            seen: Counter = Counter()
            for place, (column, kind) in enumerate(kinds):
                for country, text in zip(countries, texts[column], strict=True):
                    seen.update((country, place, t) for t in set(terms_of(text, kind)))
            rows = [*zip(*seen)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["country", "place", "term", "df"])

    counted = rec.where("country IS NOT NULL").select("country", *columns).mapInArrow(run, "country string, place int, term string, df long")
    return counted.groupBy("country", "place", "term").agg(F.sum("df").alias("df"))


def with_cosines(attached: DataFrame, counted: DataFrame, sizes: dict[str, int], kinds: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds cos_<kind>_<column> of all ``kinds`` to pairs that have the texts _<column>1 and _<column>2, which go.

    ``counted`` is ``frequencies``, ``sizes`` the records of each country.  The vectors are made where
    the pairs lie, so none travels.
    """
    found = counted.toArrow()
    idf: dict = {}
    for country, place, term, df in zip(*(found.column(c).to_pylist() for c in ("country", "place", "term", "df")), strict=True):
        idf.setdefault((country, place), {})[term] = math.log((1.0 + sizes[country]) / (1.0 + df)) + 1.0
    shared = attached.sparkSession.sparkContext.broadcast(idf)
    texts = [f"_{c}{n}" for c in dict.fromkeys(c for c, _ in kinds) for n in (1, 2)]
    keep = [f for f in attached.schema.fields if f.name not in texts]
    names = [f"cos_{kind}_{column}" for column, kind in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def vector(country: str, place: int, text: str | None) -> dict[str, float]:
            if (country, place, text) not in known:
                if len(known) >= TEXTS * len(kinds):
                    known.clear()
                weigh = shared.value.get((country, place), {})
                w = {t: min(n, 2) * weigh[t] for t, n in Counter(terms_of(text, kinds[place][1])).items()}
                length = math.sqrt(sum(x * x for x in w.values()))
                known[country, place, text] = {t: x / length for t, x in w.items()}
            return known[country, place, text]

        for batch in batches:
            countries, sides = batch.column("country").to_pylist(), {c: batch.column(c).to_pylist() for c in texts}
            out = []
            for place, (column, _) in enumerate(kinds):
                values = []
                for country, a, b in zip(countries, sides[f"_{column}1"], sides[f"_{column}2"], strict=True):
                    u, v = vector(country, place, a), vector(country, place, b)
                    values.append(sum(x * v[t] for t, x in u.items() if t in v))
                out.append(pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *out], names=[*(f.name for f in keep), *names])

    made = attached.mapInArrow(run, StructType([*keep, *(StructField(n, DoubleType()) for n in names)]))
    return made.withColumns({n: F.round(n, 6) for n in names})
