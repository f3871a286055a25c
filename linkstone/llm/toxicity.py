"""Toxicity by two class-conditional Kneser-Ney models.

The models are over the bytes of words (``order`` bytes; words are padded at the front, and their
end is a symbol too), so a rare form of a toxic expression is known by its stem.  Each class has its
own counts at the highest order; below it both share the backoff distributions, recursively from
``order`` - 1 bytes down to none: at each order the continuation counts of all documents (how many
different bytes come before a shorter byte sequence), which grow with the corpus and smooth what the
labelled rows show too seldom.

A text's score compares its two log-likelihoods, normalised by its length in words: the mean over
its words of log toxic - log ordinary likelihood, each word's difference shrunk towards 0 by
``margin`` (words that speak for either class count for it, the noise of all others does not add
up over a long text), through a logistic curve fitted on labelled rows.

The class counts are of documents (a word counts once in each) and discounted by 1, 1.5 and 2 where
they are 1, 2 and more, so what one document holds is no evidence.  They come from a bounded sample:
at most ``sample`` labelled rows of each class, those with the smallest hashes; the model that is sent
to the executors has the byte sequences of these rows, all of them.  The curve is fitted by
cross-validation: the evidence of each of ``folds`` parts of the sample comes from the counts of the
others.

Defined results: a null or empty text, or one without words, has no evidence and gets the curve's
value at 0; labels other than 0 and 1 are not used, a row labelled both ways counts for both;
without labels of both classes every score is 0.  Repeated rows are each scored; other columns are
passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import slices, stash, table, text_of

_WORD = re.compile(r"\w+")
_START, _END = b"\x02", b"\x03"


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte sequences of ``order`` bytes of all words, packed into integers, and the word of each."""
    padded = [_START * (order - 1) + w.encode() + _END for w in words]
    flat = np.frombuffer(b"".join(padded), np.uint8)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    packed = np.zeros(len(flat), np.int64)
    for j in range(order):
        packed[order - 1 :] |= flat[order - 1 - j : len(flat) - j].astype(np.int64) << (8 * j)
    whole = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    for j in range(order - 1):
        whole[starts + j] = False
    return packed[whole], np.repeat(np.arange(len(words)), sizes)[whole]


def spread(evidence: np.ndarray) -> np.ndarray:
    """The logarithm of the evidence, to either side of 0."""
    return np.sign(evidence) * np.log1p(1000 * np.abs(evidence))


@dataclass
class Model:
    order: int
    margin: float
    gram: np.ndarray  # sorted, with the log ratio of each
    ratio: np.ndarray
    history: np.ndarray  # sorted; the log ratio of a gram not seen after a history that is
    backoff: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        """The curve, over the logarithm of the evidence."""
        return 1 / (1 + np.exp(-np.clip(self.slope * spread(evidence) + self.offset, -800, 700)))

    def words(self, words: list[str]) -> np.ndarray:
        """Evidence of each word: the difference of its log-likelihoods, shrunk by the margin."""
        if not len(self.gram) or not words:
            return np.zeros(len(words))
        packed, word = grams(words, self.order)
        at = np.minimum(np.searchsorted(self.gram, packed), len(self.gram) - 1)
        past = packed >> 8
        back = np.minimum(np.searchsorted(self.history, past), len(self.history) - 1)
        part = np.where(self.gram[at] == packed, self.ratio[at], np.where(self.history[back] == past, self.backoff[back], 0.0))
        ratio = np.bincount(word, part, len(words))
        return np.sign(ratio) * np.maximum(np.abs(ratio) - self.margin, 0.0)


class Scorer:
    """Evidence per word of texts; remembers the words it has met, ``max_words`` at most."""

    def __init__(self, model: Model, max_words: int = 400_000):
        self.model, self.max_words, self.known = model, max_words, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [_WORD.findall(t.lower()) for t in texts]
        new = list(set().union(*found).difference(self.known))
        if len(self.known) + len(new) > self.max_words:
            self.known = {}
            new = list(set().union(*found))
        self.known.update(zip(new, self.model.words(new).tolist(), strict=True))
        return np.array([sum(map(self.known.__getitem__, words)) / len(words) if words else 0.0 for words in found])


def backoff(types: DataFrame, order: int, discount: float = 0.75) -> DataFrame:
    """(back, shared): the shared distribution of ``order`` - 1 bytes, for every sequence that ``types`` (gram, distinct) ends in.

    At each order the continuation counts, discounted and interpolated with the next lower order;
    below one byte all 256 are alike.
    """
    levels = [types]
    for width in range(order - 1, 0, -1):
        column = "gram" if width == order - 1 else "back"
        levels.append(levels[-1].groupBy(F.expr(f"{column} & {(1 << 8 * width) - 1}").alias("back")).agg(F.count(F.lit(1)).alias("cont")))
        if width == order - 1:  # the lower orders follow from this table, not from the texts
            levels[-1] = stash(levels[-1], "toxic-types")
    lower = None
    for width in range(1, order):
        sums = levels[order - width].groupBy(F.shiftright("back", 8).alias("past")).agg(F.sum("cont").alias("total"), F.count(F.lit(1)).alias("kinds"), F.collect_list(F.struct("back", "cont")).alias("of"))
        rows = sums.select(F.inline("of"), "total", "kinds")  # 256 of a kind at most
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("end", F.expr(f"back & {(1 << 8 * (width - 1)) - 1}")).join(lower.withColumnsRenamed({"back": "end", "shared": "below"}), "end")
        lower = rows.select("back", ((F.greatest(F.col("cont") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("below")) / F.col("total")).alias("shared"))
    return lower


def fit_ratios(rows: dict[str, np.ndarray], order: int, margin: float, discounts: tuple[float, float, float] = (1.0, 1.5, 2.0)) -> Model:
    """Log ratios from columns gram, toxic, plain (the class counts) and shared (probability of the gram's last byte after the others but the first)."""
    order_by = np.argsort(rows["gram"])
    gram, toxic, plain, shared = (np.asarray(rows[k])[order_by].astype(np.int64 if k == "gram" else float) for k in ("gram", "toxic", "plain", "shared"))
    history, of = np.unique(gram >> 8, return_inverse=True)

    def smoothed(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = np.minimum(count, np.select([count >= 3, count == 2, count == 1], discounts[::-1], 0.0))
        seen = np.bincount(of, count)
        left = np.where(seen > 0, np.maximum(np.bincount(of, off) / np.maximum(seen, 1), 1e-3), 1.0)
        return np.where(seen[of] > 0, (count - off) / np.maximum(seen[of], 1), 0.0) + left[of] * shared, left

    (p, p_left), (q, q_left) = smoothed(toxic), smoothed(plain)
    return Model(order, margin, gram, np.log(p / q), history, np.log(p_left / q_left))


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, both classes weighing the same; Newton's method with a weak prior."""
    scale = float(np.abs(evidence).max()) or 1.0
    x = np.column_stack([evidence / scale, np.ones(len(evidence))])
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _class_sample(labels: DataFrame, sample: int) -> DataFrame:
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id", "label").count().drop("count")
    first = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return first(0).unionByName(first(1))


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = 4000, order: int = 5, margin: float = 3.0, folds: int = 4) -> Model:
    """Fit on ``labels`` (doc_id, label) of ``documents`` (doc_id, text); the backoff counts are of all documents."""
    # at most 2 * sample ids, so the broadcast is bounded
    rows = text_of(documents, "doc_id").join(F.broadcast(_class_sample(labels, sample)), "doc_id")
    rows = stash(rows.select("text", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds)).cast("int").alias("fold")), "toxic-sample")
    sides = [f"{kind}{f}" for f in range(folds) for kind in ("plain", "toxic")]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words: list[Counter] = [Counter() for _ in sides]
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[2 * fold + label].update(set(_WORD.findall(text.lower())))
            every = list(set().union(*words))
            packed, word = grams(every, order)
            gram, of = np.unique(packed, return_inverse=True)
            sums = [np.bincount(of, np.array([c[w] for w in every], float)[word], len(gram)).astype(np.int64) for c in words]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, sums)], names=["gram", *sides])

    found = rows.mapInArrow(counted, "gram long, " + ", ".join(f"{s} long" for s in sides)).groupBy("gram").agg(*(F.sum(s).alias(s) for s in sides))
    found = stash(found, "toxic-grams")

    def types(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            words = list(set().union(*(_WORD.findall(t.lower()) for t in batch.column(0).to_pylist())))
            kept = np.union1d(kept, grams(words, order)[0])
            if len(kept) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(kept)], names=["gram"])
                kept = kept[:0]
        yield pa.RecordBatch.from_arrays([pa.array(kept)], names=["gram"])

    low = (1 << (8 * (order - 1))) - 1
    every = text_of(documents).mapInArrow(types, "gram long").distinct()
    # a row for each byte sequence of the sample's words
    joined = found.withColumn("back", F.expr(f"gram & {low}")).join(backoff(every, order), "back").select("gram", *sides, "shared").toPandas()
    columns = {c: joined[c].to_numpy() for c in joined.columns}

    def ratios(left_out: int | None) -> Model:
        both = {kind: sum((columns[f"{kind}{f}"] for f in range(folds) if f != left_out), np.zeros(len(joined), np.int64)) for kind in ("toxic", "plain")}
        return fit_ratios(columns | both, order, margin)

    if not len(joined) or not all(any(columns[f"{kind}{f}"].any() for f in range(folds)) for kind in ("toxic", "plain")):
        none = np.zeros(0)
        return Model(order, margin, none.astype(np.int64), none, none.astype(np.int64), none, 0.0, -800.0)
    model = ratios(None)
    others = documents.sparkSession.sparkContext.broadcast([ratios(f) for f in range(folds)])

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m, 50_000) for m in others.value]
        for batch in slices(batches, "text"):
            texts, folds_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([float(scorers[f]([t])[0]) for t, f in zip(texts, folds_, strict=True)])], names=["label", "evidence"])

    # at most 2 * sample rows
    check = rows.mapInArrow(evidence, "label int, evidence double").toPandas()
    model.slope, model.offset = fit_curve(spread(check["evidence"].to_numpy()), check["label"].to_numpy())
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, evidence, score) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            x = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(model.scores(x))], names=[id_col, "evidence", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return text_of(documents, id_col, text=text_col).mapInArrow(run, f"{id_col} {kind}, evidence double, score double")


def tolerable(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores below the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in slices(batches, text_col):
            x = scorer([t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) < threshold))

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column | str) -> Column:
    """Rows no label may be learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def model_for(documents: DataFrame, spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))
    return fit(documents, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, model_for(documents, spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
