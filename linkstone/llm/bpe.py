"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a slice of the corpus are laid out in one array of byte tokens.  An inverted
index maps every adjacent token pair that some rule merges (keyed by the merged token, whose id is
the rule's rank) to the positions where it starts.  The rules are replayed once, in rank order;
a merge looks only at its two neighbours and files the pairs that appear there.  So the work is
proportional to the merges that happen and not to words times rules.  Each task replays the words
of its own rows and keeps their ids (a bounded memory of ``max_words`` words), so nothing is
shuffled and every task can be run again alone.

Defined results: a null text is the empty text and gives no ids; repeated rows, ties and very long
texts need no special case; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import slices, table, text_of


class Ranks:
    """The ranks file: bytes of every token, and the merged token of every pair that has one."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, n in self.rank.items():
            self.token[n] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.merged: dict[int, int] = {}
        for token, n in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left << 20 | right] = n
        # the merges of two single bytes as a table, for the first filling of the index
        self.first = np.full((256, 256), -1, np.int64)
        for token, n in self.rank.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = n
        sizes = np.array([len(t) for t in self.token], np.int64)
        self.token_size, self.token_at = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    ends = np.cumsum(sizes) - 1
    last = np.zeros(len(flat), bool)
    last[ends[sizes > 0]] = True
    first = np.full(len(flat), -1, np.int64)
    first[:-1] = ranks.first[flat[:-1], flat[1:]]
    first[last] = -1
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    rule, cut = np.unique(first[at], return_index=True)
    index = {int(r): part.tolist() for r, part in zip(rule, np.split(at, cut[1:]), strict=True)} if len(at) else {}

    token = ranks.byte[flat].tolist()
    follow = np.arange(1, len(flat) + 1)
    follow[last] = -1
    before = np.arange(-1, len(flat) - 1)
    before[1:][last[:-1]] = -1
    follow, before = follow.tolist(), before.tolist()
    merged, heap = ranks.merged, list(index)
    heapq.heapify(heap)
    while heap:
        rule = heapq.heappop(heap)
        places = index.pop(rule)
        places.sort()
        for p in places:
            n = follow[p]
            if n < 0 or token[p] < 0 or merged.get(token[p] << 20 | token[n]) != rule:
                continue  # a merge before this one has taken a side of the pair
            after, prior = follow[n], before[p]
            token[p], token[n], follow[p] = rule, -1, after
            if after >= 0:
                before[after] = p
                made = merged.get(rule << 20 | token[after])
                if made is not None:
                    if made in index:
                        index[made].append(p)
                    else:
                        index[made] = [p]
                        heapq.heappush(heap, made)
            if prior >= 0:
                made = merged.get(token[prior] << 20 | rule)
                if made is not None:
                    if made in index:
                        index[made].append(prior)
                    else:
                        index[made] = [prior]
                        heapq.heappush(heap, made)
    ids = np.array(token, np.int32)
    live = ids >= 0
    counts = np.concatenate([[0], np.cumsum(live)])
    stops = np.cumsum(sizes)
    return ids[live], counts[stops] - counts[stops - sizes]


class Vocabulary:
    """Ids of the words met so far, as flat arrays; begun anew when it holds ``max_words``."""

    def __init__(self, ranks: Ranks, max_words: int):
        self.ranks, self.max_words = ranks, max_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in their order, and the number of ids up to each word."""
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > self.max_words and self.place:
            self.clear()
            new = list(set(words))
        if new:
            ids, size = replay([w.encode() for w in new], self.ranks)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
        which = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        size = self.size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = np.arange(upto[-1]) + np.repeat(self.start[which] - upto[:-1], size)
        return self.ids[out], upto


@lru_cache(maxsize=1)
def vocabulary_of(path: str, max_words: int) -> Vocabulary:
    """The vocabulary of this Python worker, which later tasks in it go on using."""
    return Vocabulary(load(path), max_words)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 700_000) -> DataFrame:
    """(id, ids array<int>): the BPE ids of each whole text; every match of ``pattern`` is a word of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = vocabulary_of(ranks_path, max_words), regex.compile(pattern)
        for batch in slices(batches, "text", 2 << 20):
            words: list[str] = []
            upto = [0]
            for text in batch.column(1).to_pylist():
                words += split.findall(text)
                upto.append(len(words))
            ids, ends = vocabulary.encode(words)
            offsets = pa.array(ends[upto].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return text_of(df, id_col, text=text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(ranks_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                column = batch.column(1)
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = ranks.token_size[ids]
                upto = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(upto[-1]) + np.repeat(ranks.token_at[ids] - upto[:-1], size)
                starts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                offsets = upto[starts].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ranks.token_bytes[place].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), column, decoded], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
