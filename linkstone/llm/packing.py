"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens.  The packer
keeps a window of open documents.  It gives each next place in the sequence to the document whose
demand vector has the largest dot product with what is left of the three limits; when no whole
document fits, the one with the largest product is cut at the room that is left.  What remains at
the end of a partition goes to sequences whose lengths are powers of two, which need no padding.
Every partition is packed by itself from its own rows, so there is no shuffle, a task that is run
again gives the same pieces, and the window bounds the memory.

Defined results: a null text is an empty one and gives the end id alone; rows with the same id or
text are packed each for itself; other columns are passed over; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm.common import slices, table, text_of

#: Sequence ids: the partition above this many bits, the sequence's number in it below.
_ID_BITS = 36


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str, end_of_text: str, end_id: int):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(n) for token, n in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end_of_text: end_id})


class Packer:
    """Gives (document key, start, length, sequence, offset) for documents put in one after another."""

    def __init__(self, limits: tuple[int, int, int], window: int):
        self.tokens, self.segments, self.loss = limits
        self.scale = 1.0 / np.array(limits, float)
        self.window = window
        self.key: list = [None] * window
        self.start = np.zeros(window, np.int64)
        self.left = np.zeros(window, np.int64)  # 0: a free slot
        self.free = np.zeros(window, np.int64)  # of the tokens left, how many at the front bear no loss
        self.slots = list(range(window))
        self.sequence = 0

    def put(self, key, size: int, unscored: int) -> Iterator[tuple]:
        """``unscored``: ids at the document's front that bear no loss."""
        start, most = 0, min(self.tokens, self.loss)
        while size - start >= self.tokens and most == self.tokens:
            yield key, start, self.tokens, self.sequence, 0
            self.sequence += 1
            start += self.tokens
        if size > start:
            slot = self.slots.pop()
            self.key[slot], self.start[slot], self.left[slot], self.free[slot] = key, start, size - start, max(0, unscored - start)
        while not self.slots:
            yield from self.fill(self.tokens)

    def fill(self, room: int) -> Iterator[tuple]:
        """One sequence of ``room`` tokens, or as many as the limits allow."""
        offset, segments, loss = 0, self.segments, self.loss
        while room > offset and segments > 0:
            scored = np.maximum(self.left - self.free, 0)
            remain = np.array([room - offset, segments, loss], float) * self.scale
            value = self.left * (self.scale[0] * remain[0]) + scored * (self.scale[2] * remain[2]) + self.scale[1] * remain[1]
            open_ = self.left > 0
            fits = open_ & (self.left <= room - offset) & (scored <= loss)
            if segments == 1:  # the last place: take what fills the room, if there is such a document
                fits &= self.left == room - offset
            if fits.any():
                slot = int(np.argmax(np.where(fits, value, -1.0)))
                take = int(self.left[slot])
            elif open_.any():
                slot = int(np.argmax(np.where(open_, value, -1.0)))
                take = int(min(self.left[slot], room - offset, self.free[slot] + loss))
                if take <= 0:
                    break
            else:
                break
            yield self.key[slot], int(self.start[slot]), take, self.sequence, offset
            loss -= max(0, take - int(min(self.free[slot], take)))
            self.start[slot] += take
            self.left[slot] -= take
            self.free[slot] = max(0, self.free[slot] - take)
            if not self.left[slot]:
                self.key[slot] = None
                self.slots.append(slot)
            offset += take
            segments -= 1
        self.sequence += 1

    def close(self) -> Iterator[tuple]:
        while (rest := int(self.left.sum())) > 0:
            yield from self.fill(self.tokens if rest >= self.tokens else 1 << (rest.bit_length() - 1))


def pack(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 2048, unscored: int = 1, end_id: int = 1, end_of_text: str = "<|endoftext|>", end_of_text_id: int = 50256, window: int = 256) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit) and places in the sequences.

    A document's ids are those of its whole text and then ``end_id``; its first ``unscored`` ids bear
    no loss.  The text of the special token stands for that token, as in the vocabulary's own library.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(ranks_path, pattern, end_of_text, end_of_text_id)
        packer = Packer((max_tokens, max_segments, max_loss), window)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << _ID_BITS
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys, starts, sizes, sequences, offsets = zip(*rows, strict=True)
            ids = [key[1][s : s + n].tobytes() for key, s, n in zip(keys, starts, sizes, strict=True)]
            columns = [pa.array([k[0] for k in keys]), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([len(k[1]) for k in keys], pa.int64()), pa.array([base + q for q in sequences], pa.int64()), pa.array(offsets, pa.int64())]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, "text", 2 << 20):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoding.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id)).astype("<u4")
                rows.extend(packer.put((key, ids), len(ids), unscored))
            if rows:
                yield out()
        rows.extend(packer.close())
        if rows:
            yield out()

    kind = df.schema[id_col].dataType.simpleString()
    packed = text_of(df, F.col(id_col).alias("doc_id"), text=text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of sequences of at most 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
