"""Embedding near-duplicates by lattice hashing: random projections decoded to points of E8, neighbouring cells probed, cosines verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakegauge.session import materialize

from .common import components, id_key, key_runs, null_again

COSINE = 0.93
#: Hash tables; neighbouring cells that each vector asks besides its own; size of a cell for unit vectors. For two unit
#: vectors at cosine 0.93 one table finds about 0.51 of the pairs, all tables 0.986; more at larger cosines.
TABLES, PROBES, CELL = 6, 2, 0.6
#: Vectors of a cell that one task compares; larger cells are cut into parts and the pairs of parts dealt out.
LARGE = 2048

#: Roles of a vector in a run: member of a cell; asks the cell; left and right part of a cut cell; member that is only asked.
MEMBER, ASKS, LEFT, RIGHT, ASKED = range(5)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    out = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    out += [list(h) for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.array(out)


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: round, and where the sum is odd turn the worst coordinate the other way."""
    point = np.rint(y)
    gap = y - point
    worst = np.abs(gap).argmax(axis=1)
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    point[odd, worst[odd]] += np.where(gap[odd, worst[odd]] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even whole points and their shift by a half."""
    whole, half = nearest_even(y), nearest_even(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1))[:, None], whole, half)


def cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points; ``salt`` tells table, label and dimension apart."""
    key = salt.astype(np.uint64)
    for c in (2 * points).astype(np.int64).T:
        key = (key ^ (c.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, label, vector) -> a row for each table and cell: the own one, and the probed ones."""
    neighbours = roots()
    for batch in batches:
        label = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        column = batch.column(3)
        lengths = np.diff(np.asarray(column.offsets))
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            for a in range(0, len(rows), 4096):
                own = rows[a : a + 4096]
                x = np.asarray(column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(own), d)
                raw = pa.array([v.tobytes() for v in x.astype(np.float32 if column.type.value_type == pa.float32() else np.float64)], pa.binary())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = []
                for t in range(TABLES):
                    y = x @ (np.random.default_rng([t, d]).normal(size=(d, 8)) / (np.sqrt(8) * CELL))
                    point = decode(y)
                    salt = label[own] * np.uint64(1_000_003) + np.uint64(t * 7919 + d * 104_729)
                    near = np.argpartition(-(y - point) @ neighbours.T, PROBES, axis=1)[:, :PROBES]
                    keys.append([cell_keys(point, salt), *[cell_keys(point + neighbours[near[:, p]], salt) for p in range(PROBES)]])
                codes = pa.array([c.tobytes() for c in np.stack([k[0] for k in keys], axis=1)], pa.binary())
                for t in range(TABLES):
                    for p, key in enumerate(keys[t]):
                        n = len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, ASKS if p else MEMBER, np.int32)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), codes, raw],
                            names=["key", "t", "role", "rep", "n", "codes", "vector"],
                        )


CELLS = "key long, t int, role int, rep long, n long, codes binary, vector binary"
FOUND = "kind int, a long, b long, n_a long, n_b long"


class Side:
    """Vectors of one role in a run."""

    def __init__(self, table: pa.Table):
        self.rep, self.n = table["rep"].to_numpy(), table["n"].to_numpy()
        self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=np.int64).reshape(-1, TABLES)
        raw = table["vector"].to_pylist()
        x = np.frombuffer(b"".join(raw), dtype=np.float32 if table["single"][0].as_py() else np.float64).reshape(len(raw), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)

    def __len__(self) -> int:
        return len(self.rep)


def close(a: Side, b: Side) -> np.ndarray:
    return a.x @ b.x.T >= COSINE


def first_met(a: Side, b: Side, near: np.ndarray, t: int) -> np.ndarray:
    """Of the close pairs those that share no cell of an earlier table, where they are counted already."""
    i, j = np.nonzero(near)
    for earlier in range(t):
        keep = a.codes[i, earlier] != b.codes[j, earlier]
        i, j = i[keep], j[keep]
    out = np.zeros_like(near)
    out[i, j] = True
    return out


def stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what ``near`` joins: smallest ids travel to and fro over the links until nothing changes."""
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0, initial=top))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return [(int(x), int(y)) for ids, labels in ((a, la), (b, lb)) for x, y in zip(ids, labels) if x != y]


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a cell -> kind 0: links of ``a`` found here (n_a); 1: an edge (a, b); 2: a link (a, b) found by probing only."""
    rows: list[tuple[int, int, int, int, int]] = []
    for run in key_runs(batches, "key"):
        role, t = run["role"].to_numpy(), run["t"][0].as_py()
        side = {r: Side(run.filter(pa.array(role == r))) for r in np.unique(role).tolist()}

        def counted(a: Side, b: Side, near: np.ndarray, both: bool) -> None:
            own = first_met(a, b, near, t)
            for s, k in ((a, own @ b.n), *([(b, a.n @ own)] if both else [])):
                rows.extend((0, int(s.rep[i]), 0, int(k[i]), 0) for i in np.flatnonzero(k))
            rows.extend((1, x, y, 0, 0) for x, y in stars(near, a.rep, b.rep))

        if (m := side.get(MEMBER)) and len(m) > 1:
            near = close(m, m)
            np.fill_diagonal(near, False)
            counted(m, m, near, False)
        if LEFT in side and RIGHT in side:
            counted(side[LEFT], side[RIGHT], close(side[LEFT], side[RIGHT]), True)
        asked = side.get(MEMBER) or side.get(ASKED)
        if ASKS in side and asked:
            q = side[ASKS]
            i, j = np.nonzero(close(q, asked))
            apart = (q.codes[i] != asked.codes[j]).all(axis=1) & (q.rep[i] != asked.rep[j])
            for x, y in zip(i[apart], j[apart]):
                p, r = (q, int(x)), (asked, int(y))
                if p[0].rep[p[1]] > r[0].rep[r[1]]:
                    p, r = r, p
                rows.append((2, int(p[0].rep[p[1]]), int(r[0].rep[r[1]]), int(p[0].n[p[1]]), int(r[0].n[r[1]])))
        if len(rows) > 50_000:
            yield found_rows(rows)
            rows = []
    yield found_rows(rows)


def found_rows(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names=["kind", "a", "b", "n_a", "n_b"])


def dealt(cells: DataFrame, large: int) -> DataFrame:
    """Cells beyond ``large`` vectors are cut by a hash of the vector, and every pair of parts becomes a run of its own."""
    sizes = cells.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > large)
    crowded = materialize(sizes.select("key", F.ceil(2 * F.col("size") / large).cast("int").alias("parts")), "lattice-crowded")
    if crowded.isEmpty():
        return cells
    rows = cells.join(crowded, "key", "left")
    calm = rows.where("parts is null").drop("parts")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    rows = rows.where("parts is not null").withColumn("part", part)
    step = lambda kind, i, j, role: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.col("part")
    member = F.concat(
        F.array(step(0, own, own, MEMBER)),
        F.transform(F.filter(every, lambda x: x > own), lambda x: step(0, own, x, LEFT)),
        F.transform(F.filter(every, lambda x: x < own), lambda x: step(0, x, own, RIGHT)),
        F.transform(every, lambda x: step(1, x, own, ASKED)),
    )
    asks = F.transform(every, lambda x: step(1, own, x, ASKS))
    rows = rows.withColumn("to", F.explode(F.when(F.col("role") == MEMBER, member).otherwise(asks)))
    cut = rows.select(F.xxhash64("key", "to.kind", "to.i", "to.j").alias("key"), "t", F.col("to.role").alias("role"), "rep", "n", "codes", "vector", "single")
    return calm.union(cut)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", large: int = LARGE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links at a cosine of 0.93 or more between rows of an equal label.

    Labels are compared as they are, of whatever type. Rows that repeat an id with another vector are rows of their own.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing
    and stay. Equal vectors of a label are one row with a count before anything is compared. Links inside a cell are
    counted where they are found, without listing them; only links that no table has in one cell are listed. Cells of any
    size are compared whole.
    """
    rows = vectors.select(id_key(F.col(id_col)).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))).withColumn("class", F.when(F.col("sound"), F.struct("label", "embedding")))
    classes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    # ids may repeat with other vectors: classes go by numbers of their own
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "lattice-classes")
    cells = classes.select("rep", "n", F.xxhash64("label").alias("label"), "embedding").mapInArrow(cell_batches, CELLS).withColumn("single", F.lit(single))
    found = materialize(dealt(cells, large).repartition("key").sortWithinPartitions("key").mapInArrow(link_batches, FOUND), "lattice-links")
    probed = found.where("kind = 2").select("a", "b", "n_a", "n_b").distinct()
    ends = probed.select(F.col("a").alias("rep"), F.col("n_b").alias("k")).union(probed.select("b", "n_a"))
    links = found.where("kind = 0").select(F.col("a").alias("rep"), F.col("n_a").alias("k")).union(ends).groupBy("rep").agg(F.sum("k").alias("links"))
    joined = components(found.where("kind > 0").select("a", "b"), "lattice-components").withColumnRenamed("node", "rep")
    named = classes.join(links, "rep", "left").join(joined, "rep", "left")
    named = named.select(F.struct("label", "embedding").alias("class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("component").alias("joined"), "first_id")
    smallest = named.where("joined is not null").groupBy("joined").agg(F.min("first_id").alias("least"))
    named = named.join(smallest, "joined", "left").select("class", "links", F.coalesce("least", "first_id").alias("component"))
    out = rows.select("vec_id", "class").join(named, "class", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    return out.select(null_again(F.col("vec_id")).alias("vec_id"), "n_links", null_again(F.col("component")).alias("component_id"), (F.col("component") == F.col("vec_id")).alias("kept"))
