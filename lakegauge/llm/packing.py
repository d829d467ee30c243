"""Best-fit packing: token pieces into fixed-length sequences, after a dominance reduction on the counts by length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.session import materialize

from .common import whole_texts
from .tokens import encoder

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one ranking group holds on average; more pieces make more groups.
RANKED = 100_000

#: (how many sequences, the lengths in each as (length, copies))
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def piece_batches(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for first, ids, at in enc.batch(batch.column(1), end):
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), first):
                    start, piece = 0, 0
                    while start < b - a:
                        length = (b - a - start) % capacity or capacity
                        rows.append((i, piece, start, length, zlib.crc32(ids[a + start : a + start + length])))
                        start, piece = start + length, piece + 1
            cols = [np.array(c, dtype=np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids, each closed by ``end``; only longer documents are cut, the first piece takes the remainder."""
    texts = whole_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return texts.mapInArrow(piece_batches(path or public_tokenizers.path(VOCABULARY), capacity, end), schema)


def dominant(w: int, count: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """The other lengths of a set that holds ``w`` and dominates every set that could hold it; None if no small set does.

    A set dominates another if each group of the other's items can be given an own item at least as large. So a set is
    fixed for good if nothing fits beside w; if one item fills the rest exactly; if only single items fit, by the largest;
    and if at most two fit, by the largest one and the largest beside it, when no other pair escapes them.
    """
    rest = capacity - w
    own = count.copy()
    own[w] -= 1
    fits = np.flatnonzero(own[: rest + 1])
    if not len(fits):
        return ()
    largest = int(fits[-1])
    if largest == rest:
        return (largest,)
    smallest = np.repeat(fits[:3], np.minimum(own[fits[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[:2].sum() > rest:
        return (largest,)
    if len(smallest) == 3 and smallest.sum() <= rest:
        return None
    own[largest] -= 1
    beside = np.flatnonzero(own[: rest - largest + 1])
    own[largest] += 1
    if not len(beside):
        return None
    second = int(beside[-1])
    for y in fits[(fits > second) & (2 * fits <= rest)]:
        xs = fits[(fits >= y) & (fits <= rest - y) & (fits + y > largest)]
        if len(xs) > 1 or len(xs) == 1 and (xs[0] != y or own[y] > 1):
            return None
    return (largest, second)


def reduce_counts(count: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Sets fixed by dominance, each for as many sequences as its rarest length allows, and the counts that are left."""
    count, fixed, changed = count.copy(), [], True
    while changed:
        changed = False
        for w in np.flatnonzero(count)[::-1]:
            while count[w] and (others := dominant(int(w), count, capacity)) is not None:
                lengths, copies = np.unique([int(w), *others], return_counts=True)
                times = int((count[lengths] // copies).min())
                count[lengths] -= times * copies
                fixed.append((times, tuple(zip(map(int, lengths[::-1]), map(int, copies[::-1])))))
                changed = True
    return fixed, count


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the counts: equal sequences are filled together, so work follows the number of lengths, not of pieces."""
    room: dict[int, list[Pattern]] = {}

    def put(times: int, content: tuple[tuple[int, int], ...], left: int) -> None:
        if times:
            room.setdefault(left, []).append((times, content))

    for w in map(int, np.flatnonzero(count)[::-1]):
        n = int(count[w])
        while n:
            left = min((r for r in room if r >= w), default=None)
            if left is None:
                times, content, left = -(-n // (capacity // w)), (), capacity
            else:
                times, content = room[left].pop()
                if not room[left]:
                    del room[left]
            most = left // w
            full = min(times, n // most)
            put(full, (*content, (w, most)), left - most * w)
            n, times = n - full * most, times - full
            if n and times:  # fewer than ``most`` are left
                put(1, (*content, (w, n)), left - n * w)
                n, times = 0, times - 1
            if content:
                put(times, content, left)
    return [p for several in room.values() for p in several]


def pack_counts(count: np.ndarray, capacity: int) -> list[Pattern]:
    """``count[w]`` pieces of each length w -> patterns that use every piece once."""
    fixed, rest = reduce_counts(count, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), by length and rank: where the pieces of a length go."""
    rows, sequence, used = [], 0, {}
    for times, content in patterns:
        offset = 0
        for length, copies in content:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(table: np.ndarray, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(2**62 // (capacity + 1))
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(length) else table[:0]
            turn = rank - row[:, 1]
            sequence, offset = row[:, 3] + turn // np.maximum(row[:, 2], 1), row[:, 4] + turn % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are filled gaplessly from 0.

    The driver sees at most ``capacity`` counts and the patterns made of them; pieces get their place by their rank within
    their length. Ranks come from hash groups of about ``RANKED`` pieces plus the bounded totals of the groups before, so a
    length that a third of all pieces share is no one task's work. Repeated rows are pieces of their own; null ids too.
    An empty table gives an empty result.
    """
    pieces = materialize(pieces, "pieces")
    found = pieces.groupBy("length").count().collect()
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in found:
        count[r["length"]] = r["count"]
    table = slots(pack_counts(count, capacity))
    groups = int(count.sum() // RANKED) + 1
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    ranked = dealt.withColumn("local", local).join(sizes, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place(table, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
