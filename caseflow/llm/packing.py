"""Packing of tokenized documents into fixed windows by best-fit decreasing.

A document that is longer than a window is first cut into full windows. The pieces that are left go, longest first, into the
open window with the least room that holds them; a segment tree over remaining capacity finds it. Only lengths
and checksums move: pieces are dealt into groups of bounded size at random, and a group of thousands of pieces packs as tightly as the whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices_of, table, tidy
from .encoding import SLICE, PieceEncoder

WINDOW = 2048
#: Pieces that are packed together, about.
GROUP = 16384


class CapacityTree:
    """Open windows by remaining capacity; the tree counts those below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least ``need``; the window opened last among equals."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            # up to the first right sibling with a window, then down its left side
            while i > 1 and (i & 1 or not count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.open[room].pop()
        self._change(room, -1)
        return room, window


def best_fit_decreasing(lengths, capacity: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; ``lengths`` must be in descending order, each from 1 to ``capacity``."""
    tree, windows, offsets, used = CapacityTree(capacity), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, window = found if found else (capacity, used)
        used += not found
        windows.append(window)
        offsets.append(capacity - room)
        if room > n:
            tree.add(room - n, window)
    return windows, offsets


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, spaces: bool = False) -> DataFrame:
    """Pieces of every document's ids: full windows, then what is left."""

    def run(batches):
        encoder = PieceEncoder.of(tokenizer, spaces)
        for b in tidy(batches):
            for a, z in slices_of(b.column(1), SLICE):
                ids, bounds = encoder.encode(b.column(1)[a:z], end_id)
                tokens = np.diff(bounds)
                pieces = -(-tokens // window)
                of = np.repeat(np.arange(z - a), pieces)
                start = window * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(window, tokens[of] - start)
                raw, at = memoryview(ids).cast("B"), 4 * (bounds[of] + start)
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.record_batch([b.column(0)[a:z].take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens[of]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, group: int = GROUP, spaces: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length) of every piece.

    padded_length is the length of the piece's sequence after padding: the window, or its tokens where these are a power of two. A null text is empty
    and has the end id alone. Every row is a document of its own, also where ids repeat or are null. Empty tables give no rows; other columns are not read.
    """
    ws = Workspace(spark, "packing")
    pieces = ws.save(cut_documents(docs, tokenizer, end_id, window, spaces).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def run(key, t):
        g = key[0].as_py()
        cols = {n: t.column(n).to_pylist() for n in ("doc_id", "start", "length")}
        order = sorted(range(t.num_rows), key=lambda i: (-cols["length"][i], cols["doc_id"][i] is not None, cols["doc_id"][i] or 0, cols["start"][i]))
        windows, offsets = best_fit_decreasing([cols["length"][i] for i in order], window)
        seq, off = np.empty(t.num_rows, np.int64), np.empty(t.num_rows, np.int64)
        seq[order], off[order] = windows, offsets
        lengths = np.array(cols["length"], np.int64)
        used = np.bincount(seq, lengths).astype(np.int64)
        padded = np.where((used & (used - 1)) == 0, used, window)
        out = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        for name, values in (("sequence_id", (g << 32) + seq), ("offset", off), ("padded_length", padded[seq])):
            out = out.append_column(name, pa.array(values))
        return out

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, _PIECE + ", sequence_id long, offset long, padded_length long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
