"""SimHash near-duplicates: fingerprints, pivot distance tables, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.session import materialize

from .common import components, id_key, key_runs, lean, whole_texts

BITS, SEED, WORDS = 64, 42, 3
#: Differing bits up to which two fingerprints link.
DISTANCE = 3
#: Reference fingerprints whose distances are kept with every fingerprint.
PIVOTS = 24
#: Fingerprints of a key that one task compares; larger keys are split by more equal bits.
LARGE = 4096


def fingerprint(text: bytes) -> int:
    """Bits set in more than half of the shingle hashes; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: -WORDS]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :])]
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for a in range(0, n, 1 << 14):
        part = np.array(hashes[a : a + (1 << 14)], dtype=np.uint64).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        marks = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), batch.column(2)], names=["doc_id", "mark", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text_hash) of every row, over whole texts."""
    texts = whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lean(fingerprint_batches), f"doc_id {kind}, mark long, text_hash long")


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed and spread at random."""
    return np.frombuffer(np.random.default_rng(20).bytes(8 * PIVOTS), dtype=np.uint64)


def pivot_distances(marks: np.ndarray) -> np.ndarray:
    """One row of Hamming distances for each fingerprint."""
    return np.bitwise_count(marks.view(np.uint64)[:, None] ^ pivots()[None, :]).astype(np.int8)


def equal_bits(level: int) -> list[int]:
    """Masks of the bits that the keys of a level take: at most three bits differ, so one of four blocks is equal.

    Level 0 cuts all 64 bits into four blocks. Each further level cuts the bits that are left again, for large keys only.
    """
    masks = [0]
    for _ in range(level + 1):
        finer = []
        for m in masks:
            left = [b for b in range(BITS) if not m >> b & 1]
            finer += [m | sum(1 << b for b in left[i * len(left) // (DISTANCE + 1) : (i + 1) * len(left) // (DISTANCE + 1)]) for i in range(DISTANCE + 1)]
        masks = finer
    return masks


def keyed(level: int):
    """Rows (path, mark, rep, table) -> one row for each block of a path, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(equal_bits(level), dtype=np.uint64)
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            mark = batch.column(1).to_numpy(zero_copy_only=False)
            table = batch.column(3)
            if table.null_count:  # first level: the distances are computed once, here
                d = pivot_distances(mark)
                table = pa.array([r.tobytes() for r in d], pa.binary())
            for i in range(DISTANCE + 1):
                own = path * (DISTANCE + 1) + i
                value = mark.view(np.uint64) & masks[own]
                with np.errstate(over="ignore"):
                    key = (value ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + own.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), batch.column(1), batch.column(2), table], names=["key", "path", "mark", "rep", "distances"])

    return run


def spanning(marks: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that hold each component of the rows together: pivots discard, the bits decide.

    A row is compared with the rows that no component has taken yet, so dense groups cost little more than their size.
    """
    order = np.argsort(table[:, 0], kind="stable")
    marks, table = marks[order], table[order].astype(np.int16)
    free = np.ones(len(marks), bool)
    for first in range(len(marks)):
        if not free[first]:
            continue
        free[first], front = False, [first]
        while front:
            at = front.pop()
            lo, hi = np.searchsorted(table[:, 0], (table[at, 0] - DISTANCE, table[at, 0] + DISTANCE + 1))
            left = lo + np.flatnonzero(free[lo:hi])
            for p in range(1, table.shape[1]):
                if not len(left):
                    break
                left = left[np.abs(table[left, p] - table[at, p]) <= DISTANCE]
            left = left[np.bitwise_count(marks[left] ^ marks[at]) <= DISTANCE]
            free[left] = False
            front.extend(left.tolist())
            for x in left:
                yield int(order[first]), int(order[x])


def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for run in key_runs(batches, "key"):
        marks = run["mark"].to_numpy().view(np.uint64)
        table = np.frombuffer(b"".join(run["distances"].to_pylist()), dtype=np.int8).reshape(len(marks), -1)
        reps = run["rep"].to_numpy()
        for i, j in spanning(marks, table):
            a.append(int(reps[i]))
            b.append(int(reps[j]))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def close_marks(marks: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) between the ids of distinct ``marks`` (mark, rep) that keep every component of close marks together.

    Two marks that differ in at most three bits agree in one of four blocks, which deals the rows out; keys with more than
    ``large`` rows are dealt again by a further equal block of their remaining bits, until no key is large or 16 bits are
    left (65 536 possible rows). No pair is lost on the way.
    """
    kind = "key long, path long, mark long, rep long, distances binary"
    rows, level, edges = marks.select(F.lit(0).cast("long").alias("path"), "mark", "rep", F.lit(None).cast("binary").alias("distances")), 0, None
    while True:
        dealt = rows.mapInArrow(lean(keyed(level)), kind)
        last = BITS - max(m.bit_count() for m in equal_bits(level)) <= 16
        hot = None if last else materialize(dealt.groupBy("key").count().where(F.col("count") > large).select("key"), "simhash-hot")
        crowded = hot is not None and not hot.isEmpty()
        calm = dealt.join(hot, "key", "left_anti") if crowded else dealt
        found = calm.repartition("key").sortWithinPartitions("key").mapInArrow(lean(link_runs), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if not crowded:
            return edges
        rows, level = materialize(dealt.join(hot, "key", "left_semi").select("path", "mark", "rep", "distances"), "simhash-large"), level + 1


def simhash_classes(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, text_hash, mark, component, component_id): the smallest doc_id reachable over fingerprints with at most 3 differing bits.

    Equal fingerprints are one row before anything is compared, so copies cost nothing. Texts without words share the
    fingerprint 0. A null doc_id takes part and comes last as a component's name: a component of null ids only has no
    ``component_id``; ``component``, its smallest fingerprint, still tells it from others.
    """
    rows = materialize(fingerprints(docs), "simhash-rows")
    key = F.when(F.col("doc_id").isNull(), F.lit(2**63 - 1)).otherwise(F.col("doc_id").cast("long"))
    marks = materialize(rows.groupBy("mark").agg(F.min(key).alias("rep")), "simhash-marks")
    linked = components(close_marks(marks.select("mark", F.col("mark").alias("rep")), large), "simhash-components")
    named = marks.join(linked.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "rep", F.coalesce("component", "mark").alias("component"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named.select("mark", "component").join(names, "component").select("mark", "component", "component_id")
    last = F.col("component_id") == 2**63 - 1
    return rows.join(final, "mark").select("doc_id", "text_hash", "mark", "component", F.when(~last, F.col("component_id")).alias("component_id"))


def simhash_report(docs: DataFrame) -> DataFrame:
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (ties: smallest text hash); repeated rows once."""
    rows = simhash_classes(docs)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), id_key(F.col("doc_id")).alias("id"), "text_hash")).alias("first")).select("first.id", "first.text_hash")
    keep = first.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = docs.withColumns({"__id": id_key(F.col("doc_id")), "__hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    rank = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(1)))
    return own.join(keep, ["__id", "__hash"]).withColumn("__rank", rank).where("__rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
