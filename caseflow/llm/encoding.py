"""Encoding of whole texts by a public tokenizer: each distinct piece of text between spaces once, the rest in arrays."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keep_one

#: Bytes of pieces and ids that each of a table's two generations keeps, about.
KEEP_BYTES = 24 << 20
#: What an entry costs besides its text and its ids, about.
_ENTRY = 200
#: Entries that are kept at a time.
_SOME = 4096
#: Characters of text that are encoded at a time, about.
SLICE = 1 << 20
#: Begins a piece that no space comes before. Texts that hold it are cut at spaces only.
GLUE = "\x01"
# a Latin letter (but the one whose lower case has a mark of its own), then ASCII punctuation without apostrophes
_LETTER_MARK = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-&(-/:-@[-`{-~])"
# a single line end between characters that are neither white space nor compose with others
_LINE_END = "([!-~À-ɏ])(\n)([!-~À-ɏ])"
_ONE_SPACE = re.compile(r"(?<! ) (?! )")
_WORD = {s: re.compile(f"{lead}[A-Za-zÀ-ÖØ-öø-įı-ɏ]+") for s, lead in ((False, ""), (True, " "))}
#: Words in a line for the library.
_LINE = 128


class Recent(dict):
    """A table of bytes by text in two generations: when the younger one is full it becomes the older, so what is used often stays."""

    def __init__(self, limit: int = KEEP_BYTES):
        super().__init__()
        self.limit, self.size, self.older = limit, 0, {}

    def keep(self, keys: list[str], values: list[bytes]) -> None:
        for a in range(0, len(keys), _SOME):
            some, own = keys[a : a + _SOME], values[a : a + _SOME]
            if self.size > self.limit:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self.update(zip(some, own, strict=True))
            self.size += sum(map(len, some)) + sum(map(len, own)) + _ENTRY * len(some)

    def fill(self, keys: list[str], make) -> list[bytes]:
        """The values of all ``keys``; ``make`` gives those of a list of unknown ones."""
        out = list(map(self.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        names = [keys[i] for i in missing]
        found = list(map(self.older.get, names))
        new = [k for k, v in zip(names, found, strict=True) if v is None]
        made = iter(make(new) if new else ())
        found = [next(made) if v is None else v for v in found]
        for i, v in zip(missing, found, strict=True):
            out[i] = v
        self.keep(names, found)
        return out


def gather(pool: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the pool's entries in the order of ``codes``, one after the other; entry i lies between bounds[i] and bounds[i + 1]."""
    taken = pa.array(pool, pa.large_binary()).take(pa.array(codes))
    _, offsets, data = taken.buffers()
    bounds = np.frombuffer(offsets, np.int64)[: len(codes) + 1] // 4
    return np.frombuffer(data, "<u4") if data else np.zeros(0, "<u4"), bounds


def joined_lists(texts: pa.Array, split: pa.Array, odd: np.ndarray, cut) -> pa.Array:
    """``split`` with the rows numbered ``odd`` cut by the Python function instead."""
    if not len(odd):
        return split
    own = pa.array([cut(texts[int(i)].as_py()) for i in odd], split.type)
    place = np.arange(len(split))
    place[odd] = len(split) + np.arange(len(odd))
    return pa.concat_arrays([split, own]).take(pa.array(place))


class PieceEncoder:
    """ids of whole texts, equal to the library's (add_special_tokens=False).

    Texts are cut where a vocabulary's own rules always cut: before punctuation that follows a letter, and ``spaces`` tells how at
    white space. True is for byte-level vocabularies that keep it: a single space between two other characters begins a
    new piece and stays with what follows, and line ends are pieces of their own. False is for vocabularies that drop white space.
    The strings of special tokens become their ids, as in the library.
    """

    def __init__(self, file: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.spaces = spaces
        #: strings of special tokens; texts that hold one are cut at spaces only
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] or [GLUE]
        plain = not any(m.isalpha() for m in self.marks)
        self.lower = plain and self.tokenizer.normalizer is not None and "Lowercase()" in str(self.tokenizer.normalizer)
        # ids at the edge of a word: with the mark for a space before it, or for its end
        size, end = self.tokenizer.get_vocab_size(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        marks = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        edge = np.array([m.startswith("Ġ") if spaces else bool(end) and m.endswith(end) for m in marks])
        self.edge = edge if plain and edge.any() else None
        self.first, self.after = Recent(), Recent()

    @staticmethod
    def of(file: str, spaces: bool) -> "PieceEncoder":
        return keep_one(("pieces", file, spaces), lambda: PieceEncoder(file, spaces))

    @property
    def largest_id(self) -> int:
        """The largest id, those of special tokens among them."""
        return self.tokenizer.get_vocab_size() - 1

    def _each(self, pieces: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(pieces), 8192):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces[a : a + 8192], add_special_tokens=False)]
        return out

    def _library(self, pieces: list[str]) -> list[bytes]:
        """ids of every piece. Latin words go to the library many in a line, and the marks of word starts or ends in the vocabulary part them again."""
        if self.edge is None:
            return self._each(pieces)
        words = [i for i, p in enumerate(pieces) if _WORD[self.spaces].fullmatch(p)]
        out: list = [None] * len(pieces)
        lines = [("" if self.spaces else " ").join([pieces[i] for i in words[a : a + _LINE]]) for a in range(0, len(words), _LINE)]
        for a in range(0, len(lines), 64):
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines[a : a + 64], add_special_tokens=False)])
            part = words[a * _LINE : (a + 64) * _LINE]
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                raise ValueError("the vocabulary has no mark at one end of a word")
            ends = (np.append(edges[1:], len(ids)) if self.spaces else edges + 1) * 4
            raw = ids.tobytes()
            at = 0
            for i, z in zip(part, ends.tolist(), strict=True):
                out[i] = raw[at:z]
                at = z
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self._each([pieces[i] for i in rest]), strict=True):
            out[i] = v
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        odd = functools.reduce(pc.or_, [pc.match_substring(texts, m) for m in self.marks])
        if self.spaces:
            odd = pc.or_(odd, pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, GLUE)))
            marked = pc.replace_substring_regex(texts, _LETTER_MARK, rf"\1 {GLUE}\2")
            marked = pc.replace_substring_regex(marked, _LINE_END, rf"\1 {GLUE}\2 {GLUE}\3")
        else:
            marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _LETTER_MARK, r"\1 \2")
        return joined_lists(texts, pc.split_pattern(marked, " "), np.flatnonzero(odd.to_numpy(zero_copy_only=False)), self._spaces if self.spaces else lambda t: t.split(" "))

    @staticmethod
    def _spaces(text: str) -> list[str]:
        """The text cut at its single spaces; a piece that begins with the glue itself is left on the one before it."""
        out = []
        for p in _ONE_SPACE.split(text):
            if out and p[:1] == GLUE:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of text i, with the end id if one is given, are ids[offsets[i]:offsets[i + 1]]; null texts are empty."""
        texts = pc.fill_null(texts, "")
        cut = self._cut(texts)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        known = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        codes, pieces = known.indices.to_numpy().copy(), known.dictionary.to_pylist()
        if self.spaces:
            pool = self.after.fill(pieces, lambda new: self._library([p[1:] if p[:1] == GLUE else " " + p for p in new]))
            # the first piece of a text has no space before it
            starts, which = np.unique(codes[bounds[:-1]], return_inverse=True)
            codes[bounds[:-1]] = len(pool) + which
            pool += self.first.fill([pieces[i] for i in starts], self._library)
        else:
            pool = self.after.fill([p.lower() if p.isascii() and p.isalpha() else p for p in pieces] if self.lower else pieces, self._library)
        if end_id is not None:
            codes = np.insert(codes, bounds[1:], len(pool))
            pool.append(array("I", [end_id]).tobytes())
            bounds = bounds + np.arange(len(bounds))
        ids, ends = gather(pool, codes)
        return ids, ends[bounds]


assert array("I").itemsize == 4
