"""Token ids in binary shards with a minimal perfect hash index.

A shard has a payload file (the ids of its documents, one after the other, as unsigned 16-bit little-endian integers, 32-bit for vocabularies
beyond 65,536 ids) and an index file. The index maps a document's key to its place: level by level, keys
that fall alone on a bit of the level's bit array take the bit, the others go on to the next level; the rank of a key's bit is its slot, and a
fingerprint in the slot tells foreign keys apart. A lookup reads a few bits, one slot and the ids themselves.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, slices_of, table, tidy
from .encoding import SLICE, PieceEncoder
from .sharding import Cuts, SharedFile, by_shard, open_shared, range_cuts, with_place, with_shard

#: Characters of text in a shard, about.
SHARD_CHARS = 1 << 24
MAGIC = b"CFTOK001"
_LEVELS = 24
_GAMMA = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, null: np.ndarray, level: int) -> np.ndarray:
    """Level hash of 64-bit keys; the null key has a hash of its own."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return np.where(null, _mix(np.full(len(keys), seed ^ np.uint64(0x5851F42D4C957F2D))), _mix(_mix(keys.view(np.uint64)) + seed))


class PerfectHash:
    """Slots 0..n-1 of n distinct keys (signed 64-bit, or null). ``slots`` gives -1 for keys that fall on no bit."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: list[list]):
        self.sizes, self.words, self.rest = sizes, words, rest
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(ones)))
        self.rest_slot = {(bool(n), int(k)): int(self.rank[-1]) + i for i, (n, k) in enumerate(rest)}

    @classmethod
    def build(cls, keys: np.ndarray, null: np.ndarray) -> "PerfectHash":
        sizes, words = [], []
        for level in range(_LEVELS):
            if not len(keys):
                break
            size = -(-_GAMMA * len(keys) // 64) * 64
            at = (_hash(keys, null, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            sizes.append(size)
            words.append(bits)
            left = ~alone[at]
            keys, null = keys[left], null[left]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), [[bool(n), int(k)] for n, k in zip(null, keys, strict=True)])

    def slots(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_hash(keys[todo], null[todo], level) % np.uint64(size)).astype(np.int64) + base * 64
            word = self.words[at >> 6]
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            below = np.bitwise_count(word & (bit - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.rank[at >> 6] + below)[hit]
            todo = todo[~hit]
            base += size // 64
        for i in todo:
            out[i] = self.rest_slot.get((bool(null[i]), int(keys[i])), -1)
        return out


def index_bytes(keys: np.ndarray, null: np.ndarray, first: np.ndarray, count: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """The index file: a line of JSON, then bit words, and by slot fingerprint, first document and number of documents, then documents' offsets."""
    mph = PerfectHash.build(keys, null)
    slot = mph.slots(keys, null)
    arrays = [mph.words]
    for values, kind in ((_hash(keys, null, 99) >> np.uint64(32), np.uint32), (first, np.uint64), (count, np.uint32)):
        by_slot = np.zeros(len(keys), kind)
        by_slot[slot] = values
        arrays.append(by_slot)
    arrays.append(offsets.astype(np.uint64))
    head = {"width": width, "sizes": mph.sizes, "rest": mph.rest, "lengths": [len(a) for a in arrays]}
    return b"".join([MAGIC, json.dumps(head).encode() + b"\n", *(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays)])


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int):
        with open_shared(folder, f"shard-{shard:06d}.idx") as f:
            raw = f.read()
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError(f"shard {shard}: not an index file")
        end = raw.index(b"\n")
        head = json.loads(raw[len(MAGIC) : end])
        at, arrays = end + 1, []
        for n, kind in zip(head["lengths"], ("<u8", "<u4", "<u8", "<u4", "<u8"), strict=True):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += arrays[-1].nbytes
        words, self.finger, self.first, self.count, self.offsets = arrays
        self.width = head["width"]
        self.mph = PerfectHash(head["sizes"], words, head["rest"])
        self.payload = open_shared(folder, f"shard-{shard:06d}.bin")

    def places(self, keys: np.ndarray, null: np.ndarray):
        """For each key (first document, number of documents) in the shard; number 0 for unknown keys."""
        slot = self.mph.slots(keys, null)
        known = slot >= 0
        at = np.where(known, slot, 0)
        if len(self.finger):
            known &= self.finger[at] == (_hash(keys, null, 99) >> np.uint64(32)).astype(np.uint32)
            return self.first[at].astype(np.int64), np.where(known, self.count[at], 0).astype(np.int64)
        return at, np.zeros(len(at), np.int64)

    def ids(self, document: int) -> np.ndarray:
        a, z = int(self.offsets[document]), int(self.offsets[document + 1])
        self.payload.seek(a * self.width)
        return np.frombuffer(self.payload.read((z - a) * self.width), "<u2" if self.width == 2 else "<u4")


_MANIFEST = "shard int, n_docs long, n_tokens long, payload_bytes long"


def write_tokens(ws: Workspace, docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaces: bool = True, width: int | None = None, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, Cuts]:
    """Write shards of ascending doc_id ranges; returns (manifest: one row a shard, cuts). A shard counts once its manifest row is there.

    ``width`` is the number of bytes of an id: 2, or 4 where an id passes 65,535; a width that is too small raises an error.
    """
    from tokenizers import Tokenizer

    largest = max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1)
    width = width or (2 if largest < 1 << 16 else 4)
    if largest >= 1 << (8 * width):
        raise ValueError(f"ids up to {largest} don't fit {width} bytes")
    sizes = ws.save(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")), "sizes")
    cuts = range_cuts(sizes, "doc_id", "size", shard_chars)
    rows = with_shard(docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")), "doc_id", "th", cuts).select("shard", "doc_id", "th", "text")

    def run(batches):
        encoder = PieceEncoder.of(tokenizer, spaces)
        shard, out, keys, lens = None, None, [], []

        def close():
            ids = pa.chunked_array(keys, pa.int64())
            null = ids.is_null().to_numpy()
            values = ids.fill_null(0).to_numpy()
            new = np.concatenate(([True], (np.diff(values) != 0) | (np.diff(null.astype(np.int8)) != 0)))
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate((first, [len(values)])))
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
            n = out.commit()
            idx = SharedFile(folder, f"shard-{shard:06d}.idx")
            idx.write(index_bytes(values[first], null[first], first, count, offsets, width))
            idx.commit()
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(values)]), pa.array([int(offsets[-1])]), pa.array([n])], names=["shard", "n_docs", "n_tokens", "payload_bytes"])

        for b in tidy(batches):
            shards = b.column(0).to_numpy()
            for lo, hi in slices_of(b.column(3), SLICE):
                edges = np.flatnonzero(np.diff(shards[lo:hi])) + 1 + lo
                for a, z in zip([lo, *edges.tolist()], [*edges.tolist(), hi], strict=True):
                    if shards[a] != shard:
                        if out:
                            yield close()
                        shard, keys, lens = int(shards[a]), [], []
                        out = SharedFile(folder, f"shard-{shard:06d}.bin")
                    ids, bounds = encoder.encode(b.column(3)[a:z], end_id)
                    out.write((ids.astype("<u2") if width == 2 else ids).tobytes())
                    keys.append(b.column(1)[a:z])
                    lens.append(np.diff(bounds))
        if out:
            yield close()

    manifest = ws.save(by_shard(rows, cuts.shards, "doc_id", "th").mapInArrow(run, _MANIFEST), "manifest")
    return manifest.dropDuplicates(["shard"]), cuts


def read_tokens(keys: DataFrame, folder: str, manifest: DataFrame, cuts: Cuts) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document with a key of ``keys`` (doc_id long), from the files alone.

    Each distinct key is looked up once in each shard of its range; unknown keys give no row.
    """
    # one row a shard, and shards are bounded (MAX_SHARDS)
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    bases = F.broadcast(manifest.select("shard", base))

    def run(batches):
        shard, reader = None, None
        for b in tidy(batches):
            out = [[], [], [], []]
            shards, base = b.column(0).to_numpy(), b.column(2).to_numpy()
            ids = b.column(1)
            null, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for s in np.unique(shards):
                if s != shard:
                    shard, reader = s, ShardReader(folder, int(s))
                rows = np.flatnonzero(shards == s)
                for i, first, count in zip(rows.tolist(), *(c.tolist() for c in reader.places(values[rows], null[rows])), strict=True):
                    for d in range(first, first + count):
                        found = reader.ids(d)
                        for c, v in zip(out, (None if null[i] else int(values[i]), int(base[i]) + int(reader.offsets[d]), len(found), zlib.crc32(found.astype("<u4").tobytes())), strict=True):
                            c.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_place(keys.select("doc_id").distinct(), "doc_id", cuts)
    routed = placed.select("doc_id", F.explode(F.sequence(F.col("place.first"), F.col("place.first") + F.col("place.parts") - 1)).alias("shard"))
    known = routed.join(bases, "shard").select("shard", "doc_id", "base")
    return by_shard(known, cuts.shards, "doc_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, spaces: bool = True, width: int | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, write the shards and read every document back by its key.

    start counts the ids of all documents before it in ascending doc_id order. A null doc_id comes first and is a key of its own; rows that
    share a doc_id follow one another by a hash of their text and are all returned. Empty tables give no rows; other columns are not read.
    """
    ws = Workspace(spark, "tokens")
    folder = f"{ws.root}/shards"
    manifest, cuts = write_tokens(ws, docs, folder, tokenizer, end_id, spaces, width, shard_chars)
    return read_tokens(docs, folder, manifest, cuts)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_token_binary": op7_token_binary}
ORACLE_SQL: dict[str, str] = {}
