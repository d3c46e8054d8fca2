"""Document fingerprints by consistent weighted sampling.

Terms are word shingles, weighted by their count. Sample k of a weighted term comes from two gamma variates and a uniform one that depend on the term and
k alone; the term with the least sample is kept, with its level. Two documents agree in a sample with probability equal to the generalised Jaccard
similarity of their weights, so the share of equal samples estimates it. Variates are read from quantile tables by 16 bits of a hash each.

Null or blank text: no terms; such fingerprints are equal among themselves and differ from all others. The next document is the next row by ``doc_id`` and
text; null ids come first; after the last comes the first. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .words import mix, run_hashes, run_sums, slices, words_of

SAMPLES, WIDTH = 64, 5
_DIGITS = 4  # hexadecimal digits of a sample
_ODD = np.random.Generator(np.random.PCG64(21)).integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 15


def gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 0.5) / n: its distribution function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p)
    for _ in range(60):
        x = np.maximum(x - ((1 - (1 + x) * np.exp(-x)) - p) / np.maximum(x * np.exp(-x), 1e-300).clip(1e-12), x / 4)
    return x


class Sampler:
    def __init__(self, samples: int = SAMPLES, width: int = WIDTH):
        self.samples, self.width = samples, width
        g = gamma_table()
        self.r, self.log_c, self.beta = g, np.log(g), (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.r32, self.log_c32, self.rest32 = g.astype(np.float32), self.log_c.astype(np.float32), (1 - self.beta).astype(np.float32)

    def terms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct terms of each text after each other, their counts, and the number of terms of each text."""
        words = words_of(texts)
        sums = run_sums(words.hashes())
        terms, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            w = min(self.width, b - a)
            t, c = np.unique(run_hashes(sums, np.arange(a, b - w + 1), w), return_counts=True) if w else (terms[0], counts[0])
            terms.append(t)
            counts.append(c)
        return np.concatenate(terms), np.concatenate(counts), np.array([len(t) for t in terms[1:]], np.int64)

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """One row of 16-bit samples per text; zero where there is no term."""
        terms, counts, sizes = self.terms(texts)
        out = np.zeros((len(sizes), self.samples), np.uint16)
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            a = int(ends[row] - sizes[row])
            to = max(row + 1, int(np.searchsorted(ends, a + _CHUNK, "right")))
            some = np.flatnonzero(sizes[row:to]) + row
            if len(some):
                b = int(ends[to - 1])
                out[some] = self._block(terms[a:b], counts[a:b], (ends[some] - sizes[some]) - a)
            row = to
        return out

    def _block(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own = (terms >> np.uint64(32)).astype(np.uint64)
        many = np.flatnonzero(counts > 1)
        log_w = np.log(counts[many])
        out = np.empty((len(starts), self.samples), np.uint16)
        for k in range(self.samples):
            h = terms * _ODD[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            i, j, u = (h >> np.uint64(48)).astype(np.uint16), (h >> np.uint64(32)).astype(np.uint16), (h >> np.uint64(16)).astype(np.uint16)
            sample = self.log_c32[i] - self.r32[j] * self.rest32[u]  # weight 1: level 0
            name = own
            if len(many):
                r, beta = self.r[j[many]], self.beta[u[many]]
                level = np.floor(log_w / r + beta)
                sample[many] = self.log_c[i[many]] - r * (level - beta) - r
                name = own.copy()
                name[many] ^= (mix(level.astype(np.int64).astype(np.uint64)) * (level > 0)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            order = (sample + np.float32(4096)).view(np.uint32).astype(np.uint64)  # positive floats are ordered as their bits
            least = np.minimum.reduceat((order << np.uint64(32)) | name, starts)
            out[:, k] = (mix(least & np.uint64(0xFFFFFFFF)) >> np.uint64(48)).astype(np.uint16)
        return out


def as_text(signatures: np.ndarray, filled: np.ndarray) -> list[str]:
    hexes = [s.astype(">u2").tobytes().hex() for s in signatures]
    return [h if f else "-" for h, f in zip(hexes, filled.tolist())]


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    if len(a) != len(b):
        return 0.0
    return 1.0 if a == b else float((np.frombuffer(bytes.fromhex(a), np.uint16) == np.frombuffer(bytes.fromhex(b), np.uint16)).mean()) if len(a) > 1 else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id and fingerprint."""

    def run(batches):
        sampler = Sampler(samples, width)
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch["doc_id"], pa.array(_prints(sampler, batch["text"]))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _prints(sampler: Sampler, texts: pa.Array) -> list[str]:
    signatures = sampler.signatures(texts)
    return as_text(signatures, words_of(texts).counts > 0)


def _edited(samples: int, width: int):
    """Rows in order; a block ends with copies of the next block's first rows (guard)."""

    def run(batches):
        sampler = Sampler(samples, width)
        last = None  # of the rows so far: block, guard, id, text, print
        for batch in slices(batches, "text"):
            rows = [(b, g, i, t or "") for b, g, i, t in zip(*(batch[c].to_pylist() for c in ("block", "guard", "doc_id", "text")))]
            rows = [(*r, p) for r, p in zip(rows, _prints(sampler, batch["text"]))]
            chain = rows if last is None else [last, *rows]
            pairs = [(x, y) for x, y in zip(chain, chain[1:]) if x[0] == y[0] and not x[1]]
            last = chain[-1]
            if not pairs:
                continue
            edited = [x[3][: len(x[3]) - len(x[3]) // 4] + y[3][: len(x[3]) // 4] for x, y in pairs]
            prints = _prints(sampler, pa.array(edited, pa.string()))
            yield pa.record_batch(
                [pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()), pa.array(edited, pa.string()), pa.array([x[4] for x, _ in pairs]), pa.array(prints),
                 pa.array([likeness(x[4], e) for (x, _), e in zip(pairs, prints)]), pa.array([likeness(x[4], y[4]) for x, y in pairs])],
                names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_chars, edited (the last quarter of its characters replaced by the first ones of the next document), both fingerprints and their
    likeness, and the likeness to the next document's. The text is shuffled once, into blocks of neighbouring ids; of each block the first rows are copied
    to the end of the block before, so no row waits for another task."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ident = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(ident, [i / n for i in range(1, n)], 100 * n).alias("c")).collect()[0]["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= ident))
    first = {r["block"]: r["x"] for r in docs.select(block.alias("block"), ident.alias("i")).groupBy("block").agg(F.min("i").alias("x")).collect()}  # one row per block
    ids = sorted(first)
    before = {ids[k]: ids[k - 1] for k in range(len(ids))}
    target = F.lit(None).cast("int")
    if ids:
        least = F.create_map(*[F.lit(x) for b in ids for x in (first[b], before[b])])
        target = F.element_at(least, ident)
    copies = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(False).alias("guard")), F.when(target.isNotNull(), F.struct(target.alias("block"), F.lit(True).alias("guard")))))
    dealt = docs.select("doc_id", "text", F.explode(copies).alias("to")).select("to.block", "to.guard", "doc_id", "text")
    rows = dealt.repartition(n, "block").sortWithinPartitions("block", "guard", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(_edited(samples, width), "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
