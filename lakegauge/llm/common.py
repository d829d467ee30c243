"""Pieces shared by the corpus operators: worker-wide caches, key runs, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.session import materialize

#: Stands for a null id inside keys; results carry null again.
NO_ID = -(2**63)


def worker_cache(name: str, make: Callable[[], object]):
    """One object for each Python worker, kept over its tasks (shipped functions lose their own globals)."""
    home = sys.modules.setdefault("lakegauge_worker_cache", types.ModuleType("lakegauge_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def drop_worker_cache() -> None:
    """Lets go of what earlier operators kept in a reused worker; for tasks that keep nothing and need the memory.

    Memory that Arrow and the C library hold for later goes back too, as a worker shares an executor's memory with the JVM.
    """
    home = sys.modules.get("lakegauge_worker_cache")
    if home is not None and len(vars(home)) > len(vars(types.ModuleType("empty"))):
        sys.modules.pop("lakegauge_worker_cache")
        del home
        gc.collect()
    release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A task's function after which the worker, idle or not, holds no memory that it no longer uses."""

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return light


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, so that no other column can clash; a null text is an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_key(col: Column) -> Column:
    """A joinable key of an id: null becomes a value of its own."""
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def null_again(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and its ``n + 1`` offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(values) else whole[:0], offsets - offsets[0] if len(values) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def key_runs(batches: Iterable[pa.RecordBatch], key: str, least: int = 2) -> Iterator[pa.Table]:
    """Tables of whole runs of an equal, sorted ``key``; runs below ``least`` rows are skipped, small ones come many at once.

    Only the last run of a batch waits for the next batch, so memory is bounded by a batch and the largest run.
    """

    def ripe(table: pa.Table) -> Iterator[pa.Table]:
        keys = table[key].combine_chunks().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(keys)]
        for a, b in zip(starts[ends - starts >= least], ends[ends - starts >= least]):
            yield table.slice(a, b - a)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and (cut or keys[0] != last):
            # a change of key: what is held is whole up to here
            yield from ripe(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
            held = []
        elif cut:
            yield from ripe(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield from ripe(pa.Table.from_batches(held))


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Every node of the pairs -> the smallest node it is joined to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := above.setdefault(root, root)) != root:
            root = up
        while above[x] != root:
            above[x], x = root, above[x]
        return root

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(above)}


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of each batch as edges to the smallest node that they join."""
    for batch in batches:
        found = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        rows = [(x, r) for x, r in found.items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a, b); nodes without an edge do not appear.

    Large-star and small-star rounds, each a few joins and aggregates that combine before they shuffle. Every round is
    written to the shared folder, so that a lost executor costs one round and the plan stays short.
    """
    ends = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    now = materialize(ends.mapInArrow(contract, "u long, v long").distinct(), label)
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(nxt, label)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            break
        state = tuple(total)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bits of a membership filter: its size never grows, a fuller one only lets more rows through to the exact join.
FILTER_BITS = 1 << 24


def filter_bits(df: DataFrame, column: str) -> np.ndarray:
    """A fixed-size set of two bits for each hash in ``column`` (64-bit, well mixed), or-ed together before it leaves the tasks."""
    places = F.explode(F.array(F.col(column).bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(column, 36).bitwiseAND(FILTER_BITS - 1)))
    bits = df.select(places.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only where a hash is surely not in the set."""
    h = hashes.view(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    first, second = h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(36)) & np.uint64(FILTER_BITS - 1)
    hit = (bits[(first >> np.uint64(6)).astype(np.int64)] >> (first & low)) & (bits[(second >> np.uint64(6)).astype(np.int64)] >> (second & low)) & one
    return hit.astype(bool)
