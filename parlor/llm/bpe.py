"""Byte-level BPE over an index of pair occurrences.

Texts of a task are split by the pre-tokenizer's pattern; each distinct piece of a stretch of text is encoded once, all of them together: the index maps
the rank of a pair to all its positions. Ranks are taken in ascending order; all positions of the pair are merged at once, and the lists of the
pairs to the left and right are updated. A merge makes only pairs of higher rank, so no rank comes twice. Decoding joins the bytes of the ids.

Null text: empty, no ids. Special tokens in a text are taken as such, as the tokenizers library does unless told otherwise. Null ids and repeated
rows are passed through. Extra columns are passed on by ``encode`` unless they have the names it adds.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .words import slices

#: Fixed value: the pattern of byte-level pre-tokenizers of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose distinct pieces are encoded together, and pieces remembered from earlier stretches of a task.
STRETCH, REMEMBER = 8 << 20, 300_000
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairMerger:
    """Vocabulary and merges of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.equal = np.array([a == b for a, b in merges])
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        piece = np.repeat(np.arange(len(pieces)), lengths)
        if n < 2:
            return token, lengths
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        same = piece[1:] == piece[:-1]
        following[:-1][~same], before[1:][~same], following[-1] = n, -1, n
        alive = np.ones(n, bool)
        rank = np.full(n + 1, _NONE)
        rank[:-1][:-1][same] = self._rank(token[:-1][same], token[1:][same])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                key = int(r[x])
                if key not in index:
                    index[key] = []
                    heapq.heappush(heap, key)
                index[key].append(at[x:y])

        note(np.flatnonzero(rank[:-1] < _NONE))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (rank[at] == r)]
            if self.equal[r] and len(at) > 1:
                at = _alternate(np.sort(at), following)
            if not len(at):
                continue
            gone = following[at]
            token[at], alive[gone], rank[gone] = self.made[r], False, _NONE
            after = following[gone]
            following[at] = after
            inner = after < n
            before[after[inner]] = at[inner]
            left = before[at]
            left = left[left >= 0]
            rank[at] = _NONE
            rank[at[inner]] = self._rank(token[at[inner]], token[after[inner]])
            rank[left] = self._rank(token[left], token[following[left]])
            note(np.unique(np.concatenate([at[inner], left])))
        return token[alive], np.bincount(piece[alive], minlength=len(pieces))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; a special token is a piece of its own."""
        if self.split is None or not any(t in text for t in self.special):
            return self.pattern.findall(text)
        return [p for i, part in enumerate(self.split.split(text)) for p in ([part] if i % 2 else self.pattern.findall(part))]


def _alternate(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions whose pairs overlap (a run of one symbol), every second from the left."""
    chained = np.concatenate([[False], following[at[:-1]] == at[1:]])
    start = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


class _Pieces(dict):
    """Numbers of pieces in the order in which they come; ``new`` holds those without ids yet."""

    def __init__(self, special: dict[str, int]):
        super().__init__((t, i) for i, t in enumerate(special))
        self.new: list[str] = []
        self.flat, self.counts = np.array([*special.values()], np.uint32), np.ones(len(special), np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at

    def finish(self, merger: PairMerger) -> None:
        if self.new:
            flat, counts = merger.encode([p.encode() for p in self.new])
            self.flat, self.counts, self.new = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.counts, counts]), []


def _encode(path: str):
    def run(batches):
        merger = PairMerger(path)
        pieces, held, size = _Pieces(merger.special), [], 0

        def flush():
            nonlocal pieces, held, size
            pieces.finish(merger)
            first = np.concatenate([[0], np.cumsum(pieces.counts)])
            for rest, numbers, rows in held:
                n = pieces.counts[numbers]
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pieces.flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[numbers], n)].astype("<u4")
                bounds = ends[np.concatenate([[0], np.cumsum(rows)])]
                out = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch([rest, pa.array(np.diff(bounds)), out], names=["rest", "n_tokens", "ids"])
            held, size = [], 0
            if len(pieces) > REMEMBER:
                pieces = _Pieces(merger.special)

        for batch in slices(batches, "text"):
            numbers, rows = [], []
            for text in batch["text"].to_pylist():
                own = np.fromiter(map(pieces.__getitem__, merger.cut(text or "")), np.int32)
                numbers.append(own)
                rows.append(len(own))
                size += len(text or "")
            held.append((batch["rest"], np.concatenate(numbers), rows))
            if size >= STRETCH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _decode(path: str):
    def run(batches):
        table = PairMerger(path).bytes
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["rest"], pa.array(texts, pa.string())], names=["rest", "decoded"])

    return run


def _through(df: DataFrame, run, column: str, added: str, names: list[str]) -> DataFrame:
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in names]  # what is read is among them unless it is replaced
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema if f.name in rest)
    out = df.select(F.struct(*rest).alias("rest"), F.col(column).alias("ids" if "ids" in column else "text")).mapInArrow(run, f"rest struct<{kinds}>, {added}")
    return out.select(*[F.col("rest")[c].alias(c) for c in rest], *names)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids (binary, unsigned 32-bit little-endian)."""
    return _through(docs, _encode(tokenizer), text, "n_tokens long, ids binary", ["n_tokens", "ids"])


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
    return _through(encoded, _decode(tokenizer), ids, "decoded string", ["decoded"])
