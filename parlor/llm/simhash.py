"""Near-duplicate groups by SimHash and a self-join of binary tries.

A fingerprint bit is set if more than half of a document's shingle hashes have it, repeats counted. Two fingerprints are linked if at most
``budget`` of their 64 bits differ. Cut into budget + spare parts, two linked fingerprints agree on ``spare`` parts, so there is a trie for each
choice of that many parts: its fingerprints have the chosen parts in front, and its roots are the nodes that agree on all of them. From each root the
trie is joined with itself: two nodes are followed together, the bits that differ on the way are added up, and a pair of nodes that has used up the
budget is dropped with all below it. Chains of single children are walked in one step, as in a Patricia trie.

A node with more than ``most`` fingerprints is not joined in one task: it is replaced by its nodes some levels below, and its pairs by the pairs of
those that keep the budget, until all are small. A task then joins two small nodes and returns a forest that spans the links within them, fewer edges
than fingerprints, so a dense group never makes all its pairs. Documents with equal fingerprints are one entry from the start. No link is lost.
At 10**9 fingerprints take spare = 2 (15 tries whose roots agree on 21 bits), at 10**10 spare = 3 (35 tries, 27 bits).

Null, blank and empty text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is the one shingle. Very long
texts: one at a time, hashed in slices. Null key: ignored where the least key of a group is taken, so a group without keys has none. Repeated rows and
rows of one key with different texts: rows of their own. Empty table: no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .groups import components
from .store import is_empty, small_batches, stored
from .words import LOWER, SPACE, slices, words_of

BITS, BUDGET, SEED = 64, 4, 42
#: Fingerprints of a node that one task joins, and levels that a larger node is replaced by.
MOST, STEP = 1024, 6
_LOT = 1 << 16
_ONES = np.uint64(0x0101010101010101)


def _plain(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space between, their spans, and each text's first word."""
    words = words_of(texts)
    buf = words.buf
    if not len(words.starts):
        return b"", words.starts, words.ends, words.first
    solid = ~SPACE[buf]
    kept = solid.copy()
    kept[words.ends[words.ends < len(buf)]] = True  # one separator after each word
    to = np.cumsum(kept) - kept
    out = np.where(solid, LOWER[buf], np.uint8(32))[kept]
    return out.tobytes(), to[words.starts], to[words.ends - 1] + 1, words.first


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes. Eight sums of bytes hold the counts of all 64 bits, emptied before a byte overflows."""
    counts = np.zeros((8, 8), np.int64)  # [bit of a byte, byte]
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255]
        for bit in range(8):
            counts[bit] += ((part >> np.uint64(bit)) & _ONES).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    at = np.argwhere(2 * counts > len(hashes))
    return sum(1 << int(8 * byte + bit) for bit, byte in at)


def _fingerprints(width: int):
    def run(batches):
        hashed = xxhash.xxh64_intdigest
        for batch in slices(batches, "text"):
            data, starts, ends, first = _plain(batch["text"])
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                w = min(width, b - a)
                parts = []
                for at in range(a, b - w + 1 if w else a, _LOT):
                    to = min(at + _LOT, b - w + 1)
                    parts.append(np.array([hashed(data[x:y], SEED) for x, y in zip(starts[at:to].tolist(), ends[at + w - 1 : to + w - 1].tolist())], np.uint64))
                out.append(fingerprint(np.concatenate(parts)) if parts else 0)
            yield pa.record_batch([batch["key"], pa.array(np.array(out, np.uint64).view(np.int64))], names=["key", "fp"])

    return run


def layouts(budget: int, spare: int) -> list[list[tuple[int, int]]]:
    """For each trie its parts as (first bit, bits), the chosen ones in front. Bits are counted from the lowest."""
    cuts = [BITS * i // (budget + spare) for i in range(budget + spare + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [[parts[i] for i in chosen] + [p for i, p in enumerate(parts) if i not in chosen] for chosen in combinations(range(len(parts)), spare)]


def _key(layout: list[tuple[int, int]]) -> Column:
    """The fingerprint with its parts in the order of the layout, the first one highest."""
    out, left = F.lit(0).cast("long"), BITS
    for first, bits in layout:
        left -= bits
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)), left))
    return out


def _original(keys: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    out, left = np.zeros(len(keys), np.uint64), BITS
    for first, bits in layout:
        left -= bits
        out |= ((keys >> np.uint64(left)) & np.uint64((1 << bits) - 1)) << np.uint64(first)
    return out


def _below(x: np.ndarray) -> np.ndarray:
    """All bits up to the highest set one."""
    for n in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(n))
    return x


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First place in lo ... hi whose key has the bit; the keys there ascend and agree on all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        has = (keys[np.minimum(mid, len(keys) - 1)] & bit) > 0
        hi, lo = np.where((lo < hi) & has, mid, hi), np.where((lo < hi) & ~has, mid + 1, lo)
    return lo


def join_tries(keys: np.ndarray, pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places. pairs: (lo, hi, lo, hi) of two nodes, each a run of ascending keys that agree on its upper bits; the same node twice is a self-join."""
    while len(pairs):
        a, b, c, d = pairs.T
        top = _below((keys[a] ^ keys[b - 1]) | (keys[c] ^ keys[d - 1]))  # the highest level at which a node branches, and all below
        same = a == c
        alive = np.bitwise_count((keys[a] ^ keys[c]) & ~top) <= budget
        single = (top == 0) & ~same
        yield a[alive & single], c[alive & single]
        keep = alive & (top > 0)
        pairs, top, same = pairs[keep], top[keep], same[keep]
        a, b, c, d = pairs.T
        bit = top ^ (top >> np.uint64(1))
        left = np.where((keys[a] ^ keys[b - 1]) & bit, _middle(keys, a, b, bit), b)
        right = np.where((keys[c] ^ keys[d - 1]) & bit, _middle(keys, c, d, bit), d)
        new = [np.stack(x, 1) for x in ((a, left, c, right), (a, left, right, d), (left, b, right, d))]
        new.append(np.stack((left, b, c, right), 1)[~same])
        pairs = np.concatenate(new)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least place of each place's component."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            a, b = a[x != y], b[x != y]
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _edges(tries: list[list[tuple[int, int]]], budget: int, most: int):
    """Edges that span the links of each pair of nodes; ``y`` is null for a node with itself."""

    def run(batches):
        for batch in batches:
            trie, xs, ys = np.asarray(batch["trie"]), batch["x"], batch["y"]
            at = 0
            while at < len(trie):
                flat, pairs, of, n, work = [], [], [], 0, 0
                while at < len(trie) and work < most * most:
                    spans = []
                    for nodes in (xs, ys):
                        if nodes[at].is_valid:
                            keys = np.sort(np.asarray(nodes[at].values, np.int64).view(np.uint64))
                            flat.append(keys)
                            of.append(np.full(len(keys), trie[at]))
                            spans.append((n, n + len(keys)))
                            n += len(keys)
                    pairs.append(spans[0] + spans[-1])
                    work += (spans[0][1] - spans[0][0]) * (spans[-1][1] - spans[-1][0])
                    at += 1
                keys, of = np.concatenate(flat), np.concatenate(of)
                label = _forest(n, join_tries(keys, np.array(pairs, np.int64), budget))
                linked = np.flatnonzero(label != np.arange(n))
                for t in np.unique(of[linked]).tolist():
                    own = linked[of[linked] == t]
                    yield pa.record_batch([pa.array(_original(keys[x], tries[t]).view(np.int64)) for x in (own, label[own])], names=["a", "b"])

    return run


def _node(level: Column) -> Column:
    """The upper bits of a key down to a level: the node of the trie that it lies in."""
    return F.call_function("shiftrightunsigned", "key", F.lit(BITS) - level)


def _differing(a: str, b: str, level_a: str = "l1", level_b: str = "l2") -> Column:
    """Bits that differ on the way to two nodes, as far as both ways go."""
    level = F.least(level_a, level_b)
    upper = lambda node, own: F.call_function("shiftrightunsigned", node, F.col(own) - level)
    return F.bit_count(upper(a, level_a).bitwiseXOR(upper(b, level_b)))


def _deeper(pairs: DataFrame, kids: DataFrame, budget: int) -> DataFrame:
    """Pairs of nodes with each large node replaced by its nodes below, as far as the budget lasts."""
    for i in "12":
        below = kids.select("trie", F.col("up").alias(f"l{i}"), F.col("above").alias(f"k{i}"), F.col("level").alias("l"), F.col("node").alias("k"), F.col("n").alias("m"))
        own = [F.coalesce(new, F.col(old)).alias(old) for new, old in (("l", f"l{i}"), ("k", f"k{i}"), ("m", f"n{i}"))]
        rest = [c for c in pairs.columns if c not in (f"l{i}", f"k{i}", f"n{i}")]
        pairs = pairs.join(below, ["trie", f"l{i}", f"k{i}"], "left").select(*rest, *own)
    return pairs.where(_differing("k1", "k2") <= budget)


def links(fps: DataFrame, budget: int = BUDGET, spare: int = 1, most: int = MOST) -> DataFrame:
    """Edges (a, b) that span the groups of distinct fingerprints ``fp`` (long) with at most ``budget`` differing bits."""
    tries = layouts(budget, spare)
    roots = F.array(*[F.lit(sum(bits for _, bits in layout[:spare])) for layout in tries])
    keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), _key(layout).alias("key")) for t, layout in enumerate(tries)])).alias("k")
    at = ["trie", "level", "node"]
    level = F.element_at(roots, F.col("trie") + 1)
    open_ = stored(fps.select(keyed).select("k.trie", "k.key").withColumn("level", level).withColumn("node", _node(F.col("level"))), "keys")
    sizes = stored(open_.groupBy(*at).agg(F.count("*").alias("n")), "nodes")
    members, kids = None, None
    while not is_empty(large := sizes.where(F.col("n") > most).select(*at)):  # ends: keys are distinct, so a node at the last level has one
        kept = open_.join(large, at, "left_anti")
        members = kept if members is None else members.unionByName(kept)
        below = open_.join(large, at, "left_semi").select("trie", "key", F.col("level").alias("up"), F.col("node").alias("above"), F.least(F.col("level") + STEP, F.lit(BITS)).alias("level"))
        below = stored(below.withColumn("node", _node(F.col("level"))), "keys")
        sizes = stored(below.groupBy("trie", "up", "above", "level", "node").agg(F.count("*").alias("n")), "nodes")
        kids = sizes if kids is None else kids.unionByName(sizes)
        open_ = below.select("trie", "key", "level", "node")
    members = open_ if members is None else members.unionByName(open_)
    small = stored(members.groupBy(*at).agg(F.collect_list("key").alias("x")), "small")  # lists of at most ``most``
    units = small.where(F.size("x") > 1).select("trie", "x", F.lit(None).cast("array<long>").alias("y"))
    if kids is not None:
        one, two = (kids.select("trie", "up", "above", F.col("level").alias(f"l{i}"), F.col("node").alias(f"k{i}"), F.col("n").alias(f"n{i}")) for i in "12")
        pairs = one.join(two, ["trie", "up", "above"]).where((F.col("k1") < F.col("k2")) & (_differing("k1", "k2") <= budget)).drop("up", "above")
        while True:
            pairs = stored(pairs, "node_pairs")
            done = F.greatest("n1", "n2") <= most
            ready = pairs.where(done).select("trie", "l1", "k1", "l2", "k2")
            for i, x in ("1", "x"), ("2", "y"):
                ready = ready.join(small.select("trie", F.col("level").alias(f"l{i}"), F.col("node").alias(f"k{i}"), F.col("x").alias(x)), ["trie", f"l{i}", f"k{i}"])
            units = units.unionByName(ready.select("trie", "x", "y"))
            if is_empty(rest := pairs.where(~done)):
                break
            pairs = _deeper(rest, kids, budget)
    return units.mapInArrow(_edges(tries, budget, most), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, budget: int = BUDGET, spare: int = 1, most: int = MOST) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits) and component_id, the least key of its group."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_fingerprints(width), "key long, fp long"), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    labels = components(links(classes.select("fp"), budget, spare, most).distinct())
    grouped = stored(classes.join(labels, classes["fp"] == labels["id"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "grouped")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of = grouped.join(least, "label").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
