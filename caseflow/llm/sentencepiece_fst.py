"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file: the normaliser (dummy prefix, escaped and squeezed spaces), the pieces, and
byte fallback for characters without a piece. An input is composed with the normaliser, and what comes out with the union of the other two; the composition
is a lattice of (position, last piece), made as far as the search goes. Its shortest path in the tropical semiring (least sum of weights) is the encoding.

A piece weighs its negated score in unigram models (of paths of equal weight the library's single precision may take another one). In merge models a piece weighs by the piece before it: nothing if the model's merges over both leave
just these two, and BREAK if they don't (how each piece is merged is compiled once, and two of them are compared step by step). A sequence of pieces is the model's own segmentation if and only if all its neighbours are such
pairs, so that one path, and no other, weighs nothing but its fallbacks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import keep_one, slices_of, table, tidy
from .encoding import SLICE, Recent, gather, joined_lists

SPACE = "▁"
#: Weights in merge models: of neighbours that the model would not leave so, above any number of fallbacks; of a fallback character.
BREAK, FALLBACK = 1e9, 1.0
#: In unigram models a fallback character weighs so much more than the lightest score (a fixed value of the library).
UNKNOWN = 10.0
#: Bytes of words and ids that each of a table's two generations keeps, about; weights and parts of words that are kept.
KNOWN_BYTES = 64 << 20
ARCS = 600_000
PARTS = 300_000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(b: bytes):
    """(number, value) of a serialized protocol buffer message."""

    def varint(i):
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            n = {5: 4, 1: 8}[kind]
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Normaliser:
    """A sequential transducer over characters: arcs[state][space?] is (output, next state), None as output is the character itself; ends[state] is written at the end.

    States: 0 nothing written yet, 1 inside, 2 a space is held back (only where spaces are squeezed).
    """

    def __init__(self, prefix: bool, squeeze: bool):
        lead = SPACE if prefix else ""
        if squeeze:
            self.arcs = (((lead, None, 1), ("", "", 0)), (("", None, 1), ("", "", 2)), ((SPACE, None, 1), ("", "", 2)))
        else:
            self.arcs = (((lead, None, 1), (lead, SPACE, 1)), (("", None, 1), ("", SPACE, 1)))

    def compose(self, text: str, state: int = 0) -> str:
        """The output side of the composition with an input; a mark for a space in the text counts as a space where spaces are squeezed."""
        out, arcs = [], self.arcs
        if text and " " not in text and SPACE not in text:
            return arcs[state][0][0] + text  # every arc but the first writes its character alone
        held = len(arcs) == 3
        for c in text:
            before, own, state = arcs[state][c == " " or (held and c == SPACE)]
            out.append(before)
            out.append(c if own is None else own)
        return "".join(out)


class Transducer:
    """The compiled model: merge (BPE) or unigram, with an identity character map and byte fallback."""

    # fixed values of the model format: piece types, model types
    NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2
    _PLAIN = (1, 2, 3, 6)

    def __init__(self, file: str):
        with open(file, "rb") as f:
            raw = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for n, v in _fields(raw):
            if n == 1:
                p = dict(_fields(v))
                pieces.append((p[1].decode("utf-8"), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, 1)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normalizer = dict(_fields(v))
        kind = trainer.get(3, self.UNIGRAM)
        if kind not in (self.BPE, self.UNIGRAM) or not trainer.get(35, 0) or normalizer.get(2, b"") or not normalizer.get(5, 1) or any(p[2] not in self._PLAIN for p in pieces):
            raise ValueError("a merge or unigram model with byte fallback, escaped spaces, an identity character map and no pieces of a user's is needed")
        self.merges = kind == self.BPE
        self.prefix = bool(normalizer.get(3, 1))
        self.normaliser = Normaliser(self.prefix, bool(normalizer.get(4, 1)))
        self.text = [p[0] for p in pieces]
        self.types = [p[2] for p in pieces]
        self.score = {p[0]: p[1] for p in pieces if p[2] == self.NORMAL}
        self.byte = [0] * 256
        for i, (p, _, t) in enumerate(pieces):
            if t == self.BYTE:
                self.byte[int(p[3:5], 16)] = i
        #: pieces that can come out; beginnings of pieces: states before a piece is complete
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == self.NORMAL and (not self.merges or self.merge(p) == [p])}
        self.heads = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.fallback = FALLBACK if self.merges else UNKNOWN - min(self.score.values(), default=0.0)
        self.arcs: dict[tuple[str, str], float] = {}
        #: neighbours that stand together in some piece (any piece: those that merges pass through as well); ids of parts
        self.inside = {p[i : i + 2] for p in (*self.score, *self.id) for i in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.lines: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.known = Recent(KNOWN_BYTES)

    def merge(self, s: str) -> list[str]:
        """The model's merges over a short string, best score first, leftmost among equals."""
        parts, score = list(s), self.score
        while True:
            found = [(-score[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _line(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How the model's merges make a piece: the score of each merge in order (and -BIG for the end), and its last and first part before each."""
        line = self.lines.get(piece)
        if line is None:
            parts, score = list(piece), self.score
            scores, last, first = [], [parts[-1]], [parts[0]]
            while True:
                found = [(-score[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in score]
                if not found:
                    break
                best, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(-best)
                last.append(parts[-1])
                first.append(parts[0])
            line = self.lines[piece] = ([*scores, -BIG], last, first)
        return line

    def breaks(self, before: str, piece: str) -> bool:
        """Whether the model's merges over two neighbours join parts of both.

        Until they do, the merges inside each go on as if it stood alone, the better one next; so their compiled orders are run side by side.
        """
        a, last, _ = self._line(before)
        b, _, first = self._line(piece)
        get, i, j = self.score.get, 0, 0
        across = get(last[0] + first[0], -BIG)
        while True:
            x, y = a[i], b[j]
            # of equal scores the leftmost is merged
            if across > x and across >= y and across > -BIG:
                return True
            if x == y == -BIG:
                return False
            if x >= y:
                i += 1
            else:
                j += 1
            across = get(last[i] + first[j], -BIG)

    def weight(self, before: str | None, piece: str) -> float:
        """The tropical weight of the arc that writes ``piece`` (a piece, or a character without one) after ``before``."""
        known = self.arcs.get((before, piece))
        if known is None:
            if len(self.arcs) > ARCS:
                self.arcs.clear()
            known = 0.0 if piece in self.id else self.fallback
            if not self.merges:
                known -= self.score.get(piece, 0.0) if piece in self.id else 0.0
            elif before is not None and self.breaks(before, piece):
                known += BREAK
            self.arcs[before, piece] = known
        return known

    def shortest_path(self, s: str) -> list[str]:
        """Pieces (and characters without one) on the path of the least weight through the lattice of a normalised string; the lattice grows by its lightest state, the farthest among equals."""
        n, ids, heads, arcs, merges = len(s), self.id, self.heads, self.arcs, self.merges
        best: dict[tuple[int, str | None], float] = {(0, None): 0.0}
        back: dict[tuple[int, str | None], tuple[int, str | None]] = {}
        heap: list[tuple[float, int, str | None]] = [(0.0, 0, None)]
        while True:
            d, left, last = heapq.heappop(heap)
            i = -left
            state = (i, last)
            if d > best[state]:
                continue
            if i == n:
                break
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in heads:
                    if j > i + 1:
                        break
                elif p not in ids and j > i + 1:
                    continue
                # a single character without a piece is written as bytes
                w = arcs.get((last, p))
                w = d + (self.weight(last, p) if w is None else w)
                # the model's own segmentation has no break, so arcs with one lie on no shortest path
                if merges and w >= BREAK:
                    continue
                to = (j, p if merges else "")
                if w < best.get(to, BIG):
                    best[to] = w
                    back[to] = (*state, p)
                    heapq.heappush(heap, (w, -j, to[1]))
        out = []
        while state[0]:
            *state, p = back[tuple(state)]
            out.append(p)
        return out[::-1]

    def _starts(self, s: str, i: int) -> list[str]:
        """The pieces (or the character without one) that begin at position i, shortest first."""
        heads, ids, out = self.heads, self.id, [s[i]]
        for j in range(i + 2, len(s) + 1):
            p = s[i:j]
            if p not in heads:
                break
            if p in ids:
                out.append(p)
        return out

    def whole_path(self, s: str) -> list[str]:
        """``shortest_path`` of a merge model: one path has no break, so the first that is found without one is it. Arcs are made as the search goes, the farthest first; no state is entered twice."""
        if not s:
            return []
        n, arcs, path, entered = len(s), self.arcs, [], set()
        frames = [self._starts(s, 0)]
        ends = [0]
        while frames:
            if not frames[-1]:
                frames.pop()
                ends.pop()
                if path:
                    path.pop()
                continue
            p = frames[-1].pop()
            last = path[-1] if path else None
            w = arcs.get((last, p))
            if (self.weight(last, p) if w is None else w) >= BREAK:
                continue
            j = ends[-1] + len(p)
            if (j, p) in entered:
                continue
            path.append(p)
            if j == n:
                return path
            entered.add((j, p))
            frames.append(self._starts(s, j))
            ends.append(j)
        raise ValueError("the lattice of a merge model has no path without a break")

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            out = array("I")
            for p in self.whole_path(part) if self.merges else self.shortest_path(part):
                if p in self.id:
                    out.append(self.id[p])
                else:
                    out.extend(self.byte[c] for c in p.encode("utf-8", "surrogatepass"))
            found = out.tobytes()
            if len(self.parts) >= PARTS:
                self.parts.clear()
            if len(part) <= 64:
                self.parts[part] = found
        return found

    def _ids(self, run: str) -> bytes:
        """The ids of a normalised string. Where two neighbouring characters stand together in no piece, no arc crosses, and the parts have paths of their own."""
        inside = self.inside
        cuts = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in inside]
        if not cuts:
            return self._part(run) if run else b""
        return b"".join([self._part(run[a:z]) for a, z in zip([0, *cuts], [*cuts, len(run)], strict=True)])

    def _runs(self, text: str) -> list[str]:
        """The normalised text in parts that no piece crosses."""
        s = self.normaliser.compose(text)
        return _RUNS.findall(s) if self.cuts else [s] if s else []

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit bytes."""
        return b"".join(map(self._ids, self._runs(text or "")))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of text i are ids[bounds[i]:bounds[i + 1]]. Parts between spaces are encoded once each."""
        texts = pc.fill_null(texts, "")
        plain = pc.split_pattern(texts, " ")
        # where single spaces part words, a part follows a space, and so does the first by the dummy prefix
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.or_(pc.equal(texts, ""), pc.match_substring(texts, _WHOLE)))))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if self.prefix and self.cuts else np.arange(len(texts))
        cut = joined_lists(texts, plain, odd, lambda t: [_WHOLE + r for r in self._runs(t)])
        bounds = cut.offsets.to_numpy().astype(np.int64)
        known = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        compose = self.normaliser.compose
        make = lambda new: [self._ids(p[1:] if p[:1] == _WHOLE else compose(" " + p if len(self.normaliser.arcs) == 2 else p, int(len(self.normaliser.arcs) == 2))) for p in new]
        ids, ends = gather(self.known.fill(known.dictionary.to_pylist(), make), known.indices.to_numpy())
        return ids, ends[bounds - bounds[0]]

    def decode(self, ids) -> str:
        """The inverse: pieces and bytes back to text, without the dummy prefix."""
        out = bytearray()
        for i in ids:
            if self.types[i] == self.BYTE:
                out.append(int(self.text[i][3:5], 16))
            elif self.types[i] == self.NORMAL:
                out += self.text[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


BIG = float("inf")
#: Begins a part that is normalised already.
_WHOLE = "\x01"


def compiled(file: str) -> Transducer:
    return keep_one(("transducer", file), lambda: Transducer(file))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip) of every row.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the text decoded from
    the ids, and round_trip tells whether that equals the text (white space marks in a text decode to spaces). Null texts are empty and have no ids.
    Ids may be null or repeat; empty tables give no rows; other columns are not read.
    """

    def run(batches):
        t = compiled(model)
        pieces = pa.array([p.replace(SPACE, " ").encode() if k == t.NORMAL else bytes([int(p[3:5], 16)]) if k == t.BYTE else b"" for p, k in zip(t.text, t.types, strict=True)], pa.large_binary())
        sizes = pc.binary_length(pieces).to_numpy()
        for b in tidy(batches):
            for a, z in slices_of(b.column(1), SLICE):
                texts = b.column(1)[a:z]
                ids, bounds = t.encode_texts(texts)
                _, _, written = pieces.take(pa.array(ids)).buffers() if len(ids) else (None, None, None)
                written, ends = memoryview(written or b""), np.concatenate(([0], np.cumsum(sizes[ids])))[bounds]
                raw, n, crc, sha, same = memoryview(ids).cast("B"), np.diff(bounds), [], [], []
                for text, i, j, x, y in zip(texts.to_pylist(), (4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    back = bytes(written[x + (t.prefix and written[x : x + 1] == b" ") : y])
                    crc.append(zlib.crc32(raw[i:j]))
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == (text or "").encode("utf-8", "surrogatepass"))
                cols = [b.column(0)[a:z], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.record_batch(cols, names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
