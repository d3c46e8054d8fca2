"""Removal of long passages that an earlier document has too, by suffix automata of reference documents.

1. Anchors: of every 25 neighbouring 26-word grams the one with the least hash. A window of 50 words holds such a set whole, so equal windows have
   equal anchors; about one gram in 13 is an anchor. Anchors of one document only end here.
2. Routing: around the other anchors, the hash of every window; its first holder is the reference of all later documents with it. This sends a
   document to the few references it shares a passage with. (Broadcasting the automata of all shards to all documents would cost documents times
   shards, and Python automata of a whole corpus do not fit an executor.)
3. Automata: each reference becomes a suffix automaton over its words; the documents sent to it are streamed through it. Where the matching
   statistic (length of the longest match that ends at a word) is 50 or more, the words of the match go: the maximal spans above the threshold.

The automata compare words, so that no hash decides what goes. The text is shuffled once, into a table bucketed by document; all later joins use its
buckets. Null text: no words. Null ``doc_id`` sorts below all ids. Rows of one ``doc_id`` don't count against each other. Untouched texts stay as
they are. Extra columns are passed on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import new_path, small_batches, stored
from .words import Words, run_hashes, run_sums, slices, words_of

LENGTH = 50
#: Documents that one copy of a reference is streamed with.
LOT = 256


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each ``width`` neighbours, in two passes over blocks."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, values[-1])]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_positions(sums: np.ndarray, a: int, b: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from a) and hashes of the anchors of the words a ... b - 1."""
    gram = length // 2 + 1
    near = length - gram + 1
    if b - a < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = run_hashes(sums, np.arange(a, b - gram + 1), gram)
    least = _sliding(h, near, np.minimum)
    edge = np.zeros(near - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), near, np.maximum) == h)
    return at, h[at]


def _anchors(length: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words = words_of(batch["text"])
            sums = run_sums(words.hashes())
            found = [np.unique(anchor_positions(sums, a, b, length)[1]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            ids = np.repeat(np.asarray(batch["_id"]), [len(x) for x in found])
            yield pa.record_batch([np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), ids], names=["anchor", "doc"])

    return run


def _windows(length: int):
    """(window hash, doc) of every window that holds one of the document's shared anchors."""

    def run(batches):
        for batch in slices(batches, "text"):
            words = words_of(batch["text"])
            sums = run_sums(words.hashes())
            shared = batch["anchors"]
            found = []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                at, h = anchor_positions(sums, a, b, length)
                at = at[np.isin(h.view(np.int64), np.asarray(shared[i].values))]
                mark = np.zeros(max(b - a, 0) + 2, np.int64)
                np.add.at(mark, np.maximum(at - (length - length // 2 - 1), 0), 1)
                np.add.at(mark, np.minimum(at, b - a - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark) > 0)
                found.append(np.unique(run_hashes(sums, a + starts, length)))
            ids = np.repeat(np.asarray(batch["_id"]), [len(x) for x in found])
            yield pa.record_batch([np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), ids], names=["window", "doc"])

    return run


class Automaton:
    """Suffix automaton of a sequence: states with a link, the length of their longest string, and transitions by symbol."""

    def __init__(self, symbols: list):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][c]] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(dict(self.next[q]), self.length[p] + 1)
                self.link[copy], self.link[q], self.link[new] = self.link[q], copy, copy
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
            last = new

    def _state(self, transitions: dict, length: int) -> int:
        self.next.append(transitions)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def spans(self, symbols: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) of symbols covered by matches of ``least`` or more."""
        state, size, out = 0, 0, []
        step, link, length = self.next, self.link, self.length
        for i, c in enumerate(symbols):
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(c)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= least:
                if out and out[-1][1] >= i + 1 - size:
                    out[-1] = (min(out[-1][0], i + 1 - size), i + 1)
                else:
                    out.append((i + 1 - size, i + 1))
        return out


def _match(length: int):
    """Rows (reference text, document and its text), those of one reference following each other, to spans of word positions."""

    def run(batches):
        last, automaton = None, None
        for batch in slices(batches, "text"):
            refs, keep, spans = batch["ref"].to_pylist(), [], []
            for i, ref in enumerate(refs):
                if last is None or ref != last[0] or batch["ref_same"][i] != last[1]:
                    automaton, last = Automaton((batch["ref_text"][i].as_py() or "").encode().split()), (ref, batch["ref_same"][i])
                found = automaton.spans((batch["text"][i].as_py() or "").encode().split(), length)
                if found:
                    keep.append(i)
                    spans.append([x for pair in found for x in pair])
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows["doc"], rows["same"], pa.array(spans, pa.list_(pa.int64()))], names=["doc", "same", "spans"])

    return run


def _cut(words: Words, i: int, spans: list[list[int]]) -> tuple[bytes | None, int]:
    """The text less the words in the spans, and how many they are; from a removed word to the next word that stays, the bytes go."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    gone = np.zeros(b - a + 1, np.int64)
    for s in spans:
        np.add.at(gone, np.asarray(s[0::2]), 1)
        np.add.at(gone, np.asarray(s[1::2]), -1)
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return None, 0
    kept = np.flatnonzero(~gone)
    runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
    return b"\n".join(words.buf[words.starts[a + r[0]] : words.ends[a + r[-1]]].tobytes() for r in runs), int(gone.sum())


def _remove(text: str):
    def run(batches):
        for batch in slices(batches, "text"):
            words = words_of(batch["text"])
            texts, removed = batch["text"].to_pylist(), [0] * batch.num_rows
            found, same = batch["found"].to_pylist(), batch["_same"].to_pylist()
            for i, rows in enumerate(found):
                own = [r["spans"] for r in rows or () if r["same"] == same[i]]
                if own:
                    left, removed[i] = _cut(words, i, own)
                    texts[i] = texts[i] if left is None else left.decode()
            yield pa.record_batch([batch["rest"], pa.array(texts, pa.string()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())], names=["rest", "text", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents, ``text`` less the repeated passages, with ``n_words`` (before) and ``n_removed``."""
    spark = docs.sparkSession
    small_batches(spark)
    ident = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    plain = docs.select(ident.alias("_id"), F.col(text).alias("text"))
    anchors = plain.mapInArrow(_anchors(length), "anchor long, doc long")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("anchor")
    per_doc = anchors.join(shared, "anchor").groupBy("doc").agg(F.collect_list("anchor").alias("anchors"))
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(ident.alias("_id"), F.xxhash64(text).alias("_same"), F.struct(*rest).alias("rest"), F.col(text).alias("text"))
    table = f"passages_{uuid.uuid4().hex}"
    (rows.join(per_doc, F.col("_id") == F.col("doc"), "left").drop("doc").write.format("parquet").option("compression", "zstd")
     .option("path", new_path(spark, table)).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id").sortBy("_id").saveAsTable(table))
    base = spark.table(table)
    windows = base.where("anchors IS NOT NULL").select("_id", "text", "anchors").mapInArrow(_windows(length), "window long, doc long")
    first = windows.groupBy("window").agg(F.min("doc").alias("ref"), F.max("doc").alias("z")).where("ref < z").select("window", "ref")
    pairs = stored(windows.join(first, "window").where("ref < doc").select("ref", "doc").distinct(), "pairs")
    texts = base.where("anchors IS NOT NULL")
    # a reference of many documents goes to several tasks, each with some LOT of them
    lots = pairs.groupBy("ref").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, "ref").select("ref", "doc", F.pmod(F.xxhash64("doc"), F.col("lots")).cast("int").alias("lot"))
    later = dealt.join(texts.select(F.col("_id").alias("doc"), F.col("_same").alias("same"), "text"), "doc")
    refs = lots.join(texts.select(F.col("_id").alias("ref"), F.col("_same").alias("ref_same"), F.col("text").alias("ref_text")), "ref")
    refs = refs.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    both = later.join(refs, ["ref", "lot"]).select("ref", "ref_same", "ref_text", "doc", "same", "text")
    spans = stored(both.mapInArrow(_match(length), "doc long, same long, spans array<long>"), "spans")
    found = spans.groupBy("doc").agg(F.collect_list(F.struct("same", "spans")).alias("found"))
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    joined = base.join(found, F.col("_id") == F.col("doc"), "left").select("rest", "text", "_same", "found")
    out = joined.mapInArrow(_remove(text), f"rest struct<{kinds}>, text string, n_words long, n_removed long")
    own = {c: F.col("rest")[c] for c in rest} | {text: F.col("text")} | {"n_words": F.col("n_words"), "n_removed": F.col("n_removed")}
    return out.select(*[own[c].alias(c) for c in dict.fromkeys((*docs.columns, "n_words", "n_removed"))])
