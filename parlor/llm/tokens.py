"""Token ids of many texts by a word tokenizer (lower case, byte-level pairs with word ends): each distinct piece of a task is encoded once."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .words import LOWER, Words, words_of

_LOT = 2048
#: Fixed value: the pattern that cuts lower-cased words of tokenizers of this kind.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters that normalisation leaves alone but for lower case, letter by letter.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: Kinds of bytes. What the pattern treats in its own way (apostrophes) or the library (marks of special tokens, most of Unicode) is _OTHER.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[ord("'"), ord("<")]] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE


def cut(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Pieces of all texts, A-Z lower-cased, and which of them are plain. A run without ASCII white space that holds letters of Latin-1, digits and
    signs alone is cut where the kind changes and at each digit; any other run is one piece that is not plain."""
    runs = words_of(texts)
    buf, n = runs.buf, len(runs.buf)
    if not len(runs.starts):
        return runs, np.zeros(0, bool)
    kind = _KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # letters but for two signs
    kind[lead] = kind[lead + 1] = _LETTER
    others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    plain = others[runs.ends] == others[runs.starts]
    begin = np.zeros(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin &= kind != _SPACE
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, runs.starts[~plain], 1)
    np.add.at(step, runs.ends[~plain], -1)
    whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    begin &= ~whole
    begin[runs.starts] = True
    starts = np.flatnonzero(begin)
    of = np.searchsorted(starts, runs.starts)  # first piece of each run
    ends = np.append(starts[1:], n)
    ends[np.append(of[1:], len(starts)) - 1] = runs.ends
    each = np.diff(np.append(of, len(starts)))
    return Words(np.where(whole, buf, LOWER[buf]), starts, ends, np.append(of, len(starts))[runs.first]), np.repeat(plain, each)


class ChunkEncoder:
    """Pieces are found by a 64-bit hash. The cache is emptied when it holds ``most`` pieces."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        self._empty()

    def _empty(self) -> None:
        self.known, self.lengths, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _one(self, piece: str) -> list[int]:
        """Ids of a lower-cased piece that the pattern does not cut."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _encode(self, pieces: list[str], plain: list[bool]) -> list[list[int]]:
        """Ids of each piece. What is not plain is cut by the pattern if normalisation leaves it alone; the rest goes through all of the library."""
        out: list[list[int] | None] = []
        for text, one in zip(pieces, plain):
            if one:
                out.append(self._one(text.lower()))
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                out.append([i for p in _CUT.findall(text.lower()) for i in self._one(p)])
            else:
                out.append(None)
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text in it."""
        words, plain = cut(texts)
        found = pa.array(words.hashes()).dictionary_encode()
        which, distinct = np.asarray(found.indices), np.asarray(found.dictionary)
        if len(self.known) + len(distinct) > self.most:
            self._empty()
        rows = np.array(list(map(self.known.get, distinct.tolist(), itertools.repeat(-1))), np.int64)
        at = np.zeros(len(distinct), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]
        new = np.flatnonzero(rows < 0)
        data, some = words.buf.tobytes(), at[new]
        rows[new] = np.arange(len(new)) + len(self.lengths)
        self.known.update(zip(distinct[new].tolist(), rows[new].tolist()))
        sizes, more = [self.lengths], [self.flat]
        for k in range(0, len(some), _LOT):
            part = some[k : k + _LOT]
            ids = self._encode([data[a:b].decode() for a, b in zip(words.starts[part].tolist(), words.ends[part].tolist())], plain[part].tolist())
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            more.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
        self.lengths = lengths = np.concatenate(sizes)
        self.flat = np.concatenate(more)
        first = np.concatenate([[0], np.cumsum(lengths)])
        row = rows[which]
        n = lengths[row]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[row], n)]
        return flat, ends[words.first]
