"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Each document becomes ids and an end id, cut into full sequences and a rest. The plan needs the histogram of lengths alone, which has at most
``size`` entries: lengths are placed longest first, each time into the open pack with the most room; packs with the same content are one pattern with a
count, so that placing a length changes counts, not packs. The plan is a list of segments: ranks r ... r + n - 1 of a length go to sequences from b on.
Documents meet it by their rank within their length: a number within a task's share, plus the count of earlier shares.

The tokenized pieces are a stored table, so ranks and ids come from the same attempt of a task. Null or blank text: the end id alone. Null
``doc_id`` and repeated rows are pieces of their own. Extra columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import small_batches, stored
from .tokens import ChunkEncoder
from .words import slices

SIZE, END = 4096, 2
_SLICE_BYTES = 1 << 20


def pack(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Segments (length, first rank, count, first sequence, copies per sequence, offset), ordered by length and rank."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    heap: list[int] = []
    out, following = [], 0

    def put(room: int, base: int, count: int) -> None:
        if room > 0 and count > 0:
            if not rooms.get(room):
                heapq.heappush(heap, -room)
            rooms.setdefault(room, []).append((base, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while heap and not rooms.get(-heap[0]):
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room >= length:
                base, count = rooms[room].pop()
                n = min(left, count)
                out.append((length, rank, n, base, 1, size - room))
                put(room - length, base, n)
                put(room, base + n, count - n)
                left, rank = left - n, rank + n
                continue
            each = size // length
            for copies, packs in ((each, left // each), (left % each, 1)):
                if copies and packs:
                    out.append((length, rank, copies * packs, following, copies, 0))
                    put(size - copies * length, following, packs)
                    rank, following = rank + copies * packs, following + packs
            left = 0
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _pieces(path: str, size: int, end: int):
    def run(batches):
        encoder, counts, part = ChunkEncoder(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in slices(batches, "text", _SLICE_BYTES):
            ids, bounds = encoder.encode(batch["text"])
            own = np.diff(bounds) + 1  # with the end id
            own_ids = np.insert(ids, bounds[1:], np.uint32(end)).astype("<u4", copy=False)
            pieces = -(-own // size)
            of = np.repeat(np.arange(len(own)), pieces)
            place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = place * size
            length = np.minimum(own[of] - start, size)
            # pieces of one length are numbered in order, on from those before
            order = np.argsort(length, kind="stable")
            some, first, n = np.unique(length[order], return_index=True, return_counts=True)
            number = np.empty(len(of), np.int64)
            number[order] = np.arange(len(of)) - np.repeat(first, n) + counts[length[order]]
            counts[some] += n
            offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(own_ids.tobytes())])
            columns = [batch["doc_id"].take(pa.array(of)), pa.array(start), pa.array(length), packed, pa.array(own[of]), pa.array(number), pa.array(np.full(len(of), part))]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "number", "part"])

    return run


def _placed(plan: np.ndarray):
    """Adds sequence and offset by a search for (length, rank) among the segments; rows stream through, so that a task holds a batch of ids and no more."""
    keys = (plan[:, 0] << 44) + plan[:, 1]
    passed = ("doc_id", "start", "length", "ids", "doc_tokens")

    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            seg = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            k = rank - seg[:, 1]
            sequence, offset = seg[:, 3] + k // seg[:, 4], seg[:, 5] + k % seg[:, 4] * length
            yield pa.record_batch([*[batch[c] for c in passed], pa.array(sequence), pa.array(offset)], names=[*passed, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.
    ``tokenizer``: path of a tokenizers file that every executor has; it must not join what white space separates."""
    small_batches(docs.sparkSession)
    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, number long, part long"
    pieces = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, size, end), shape), "pieces")
    shares = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "shares")
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def by_length(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size + 1, np.int64)
        counts[rows["length"]] = rows["before"]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "before": [counts]})

    # one row a task: for each length the pieces of earlier tasks
    starts = stored(shares.select("length", "part", before.alias("before")).groupBy("part").applyInPandas(by_length, "part long, before array<long>"), "starts")
    ranked = pieces.join(starts, "part").select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("number") + F.get("before", F.col("length").cast("int"))).alias("rank"))
    return ranked.mapInArrow(_placed(pack(histogram, size)), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids; a sequence has at most ``size`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
