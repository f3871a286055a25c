"""Removal of repeated multi-line chunks.

Lines are hashed, and a rolling hash over the hashes of ``window`` lines chooses the boundaries: a
line ends a chunk where that hash is 0 modulo ``every`` and it was not so at the line before.  A
boundary depends on the lines just before it only, so text put in ahead of a passage shifts no
boundary inside it.  Chunks of two lines or more (all but, at most, a text's last one) are grouped
over the whole corpus by a digest and by their bytes; of each group the occurrence with the
smallest id and place stays and the others are removed.

Each task sends each different chunk once, with its first place, so a chunk that a third of all
texts hold is no larger a group than any other.  Should two chunks with one digest differ in
their bytes, all chunks of that digest stay.

Boundaries are sparse, so chunks miss repeats that are short or lie across an edge.  With ``runs``
(as the query has it) every window of two lines is compared instead, and a line
goes when a window it is in has an earlier place, so every repeated run of two lines or more goes
whole.  Windows that overlap the first place of their own lines do not count (of "a a a" nothing
goes, of "a a a a" two lines).  Every line that goes stays at an earlier place; the first place of a
run may itself lose lines to a still earlier run.  ``chunks_gone_`` counts the stretches removed.
With ``chunked`` as well (the pipeline's way) the chunks find most of these lines, and only the
windows outside repeated chunks are compared.

Defined results: rows with a null id are left as they are; a null text stays null; an empty text is one empty line; a text of one line is
never changed; rows that repeat an id and text are all treated as that one; a text that is removed
whole becomes empty, and its row stays; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import fresh, slices, stash, table

_MASK = (1 << 64) - 1


def chunks(text: str, window: int = 2, every: int = 3) -> list[list[str]]:
    """The lines of a text, in content-defined chunks."""
    lines = text.split("\n")
    if len(lines) < 3:
        return [lines]
    hashes = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    # the rolling hash: a sum of the window's hashes, each turned by its distance
    factor = [pow(0x9E3779B97F4A7C15, d, 1 << 64) for d in range(window + 1)]
    out, start, rolled, before = [], 0, 0, False
    for k, h in enumerate(hashes):
        rolled = rolled * factor[1] + h
        if k >= window:
            rolled -= hashes[k - window] * factor[window]
        rolled &= _MASK
        ends = k >= window - 1 and (rolled >> 32) % every == 0
        if ends and not before and k - start >= 1:
            out.append(lines[start : k + 1])
            start = k + 1
        before = ends
    if start < len(lines):
        out.append(lines[start:])
    return out


def pairs(text: str) -> list[str]:
    """Every two consecutive lines of a text."""
    lines = text.split("\n")
    return [f"{a}\n{b}" for a, b in zip(lines, lines[1:])]


def digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode())


def _inside(text: str, gone: list[dict] | None, window: int, every: int) -> set[int]:
    """The places of a text's pairs of lines that lie within one of its chunks marked as gone."""
    known, out, line = {p["place"]: p["digest"] for p in gone or ()}, set(), 0
    if known:
        for place, chunk in enumerate(chunks(text, window, every)):
            if place in known and digest("\n".join(chunk)) == known[place]:
                out |= set(range(line, line + len(chunk) - 1))
            line += len(chunk)
    return out


def removals(docs: DataFrame, window: int, every: int, runs: bool = False, chunked: bool = False) -> DataFrame:
    """(id, gone array<struct<place int, digest binary>>): the chunks (with ``runs``: pairs of lines) to remove from each text.

    With ``chunked`` the repeated chunks come first: pairs of lines within them are gone by that, and
    only the others, of the lines that chunks leave or cut, are compared.  The lines that go are the same:
    a pair in a repeated chunk has an earlier place, that of the chunk's first occurrence.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, places, texts, digests, done = [], [], [], [], []
            for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = pairs(text) if runs else ["\n".join(c) if len(c) > 1 else None for c in chunks(text, window, every)]
                known = _inside(text, marks, window, every)
                for place, chunk in enumerate(whole):
                    if chunk is not None:
                        ids.append(key)
                        places.append(place)
                        digests.append(digest(chunk))
                        done.append(place in known)
                        texts.append(None if done[-1] else chunk)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string()), pa.array(done, pa.bool_())], names=["digest", "id", "place", "chunk", "done"])

    docs = docs.where("text IS NOT NULL")
    no_marks = F.lit(None).cast("array<struct<place int, digest binary>>").alias("marks")
    if runs and chunked:
        marks = removals(docs, window, every).withColumnRenamed("gone", "marks")
        marked = stash(docs.join(marks.hint("merge"), "id", "left").select("id", "text", "marks"), "marked")
    else:
        marked = docs.select("id", "text", no_marks)
    found = marked.mapInArrow(cut, "digest binary, id long, place int, chunk string, done boolean")
    # grouping by the bytes is the comparison
    by_bytes = found.where("NOT done").groupBy("digest", "chunk").agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("copies").alias("copies"))
    groups = stash(groups.where("texts = 1 AND copies > 1").select("digest", "first"), "repeated")
    places = stash(found.select("digest", "id", "place", "done"), "chunks")
    # a pair one line after the first shares a line with it
    own = F.col("first.place") + 1 if runs else F.col("first.place")
    gone = places.where("NOT done").join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("place") < F.col("first.place")) | (F.col("place") > own))
    gone = gone.select("id", "place", "digest").unionByName(places.where("done").select("id", "place", "digest"))
    return stash(gone.groupBy("id").agg(F.collect_set(F.struct("place", "digest")).alias("gone")), "removals")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 2, every: int = 3, runs: bool = False, chunked: bool = False) -> DataFrame:
    """``df`` with the repeated chunks (with ``runs``: all repeated runs of lines, with ``chunked`` by chunks first) out of its texts, and lines_before_, lines_gone_, chunks_gone_ (long) in place of columns of these names."""
    gone = removals(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), window, every, runs, chunked)
    df = df.drop("lines_before_", "lines_gone_", "chunks_gone_")
    key, marked = fresh(df, "key_", "gone_")
    # a sorted join at every size: the list of removals grows with the texts
    gone = gone.select(F.col("id").alias(key), F.col("gone").alias(marked)).hint("merge")
    joined = df.select("*", F.col(id_col).cast("long").alias(key)).join(gone, key, "left")
    own = [c for c in df.columns if c != text_col]
    order = [*own, text_col, marked]

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, before, lines, parts = [], [], [], []
            for text, places in zip(batch.column(text_col).to_pylist(), batch.column(marked).to_pylist(), strict=True):
                n_lines = n_parts = 0
                before.append(0 if text is None else text.count("\n") + 1)
                if places and runs:
                    known = {p["place"]: p["digest"] for p in places}
                    all_lines, out = (text or "").split("\n"), set()
                    for place, pair in enumerate(pairs(text or "")):
                        if place in known and digest(pair) == known[place]:
                            out |= {place, place + 1}
                    n_lines, n_parts = len(out), sum(k - 1 not in out for k in out)
                    text = "\n".join(line for k, line in enumerate(all_lines) if k not in out)
                elif places:
                    known = {p["place"]: p["digest"] for p in places}
                    stay = []
                    for place, chunk in enumerate(chunks(text or "", window, every)):
                        if place in known and digest("\n".join(chunk)) == known[place]:
                            n_lines += len(chunk)
                            n_parts += 1
                        else:
                            stay += chunk
                    text = "\n".join(stay)
                texts.append(text)
                lines.append(n_lines)
                parts.append(n_parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(lines, pa.int64()), pa.array(parts, pa.int64())], names=[*own, text_col, "lines_before_", "lines_gone_", "chunks_gone_"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own)
    out = joined.select(*order).mapInArrow(take, f"{fields}{', ' if own else ''}`{text_col}` string, lines_before_ long, lines_gone_ long, chunks_gone_ long")
    return out.select(*df.columns, "lines_before_", "lines_gone_", "chunks_gone_")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines another document, or an earlier place, has."""
    done = dedup(table(spark, sf_dir, "documents"), runs=True)
    return done.select("doc_id", F.col("lines_before_").alias("n_lines"), F.col("lines_gone_").alias("n_removed_lines"), F.col("chunks_gone_").alias("n_removed_chunks"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
