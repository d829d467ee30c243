"""Vector codes by product quantisation: the nearest entry of each part's codebook, found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.session import materialize

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and steps of a whole number in one unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest whole component and longest part; with them squares of sum gaps and distances times dimensions fit into 64 bits.
LARGEST, LONGEST = 1 << 22, 256
#: Labels beyond this number are joined without a broadcast.
LABEL_LIMIT = 1_000_000
#: Vectors searched at a time.
BLOCK = 4096


class Codebook:
    """The entries of one part, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row and its squared distance; of equally near ones the lowest index.

        From the place of a row's own sum the entry with the closer sum is looked at next, above or below. By Cauchy and
        Schwarz (sum gap)^2 / dimension is at most the squared distance, so a row is done once that bound of the next entry is
        strictly beyond its best distance. Bounds are compared as whole numbers: gap^2 > best * dimension.
        """
        n, d, k = len(x), x.shape[1], len(self.sums)
        best, index = np.full(n, np.iinfo(np.int64).max // max(d, 1), dtype=np.int64), np.full(n, k, dtype=np.int64)
        total = x.sum(axis=1)
        above = np.searchsorted(self.sums, total)
        below = above - 1
        open_rows = np.arange(n)
        far = np.int64(4 * LARGEST * LONGEST)
        while len(open_rows):
            up, down, own = above[open_rows], below[open_rows], total[open_rows]
            gap_up = np.where(up < k, self.sums[np.minimum(up, k - 1)] - own, far)
            gap_down = np.where(down >= 0, own - self.sums[np.maximum(down, 0)], far)
            gap = np.minimum(gap_up, gap_down)
            go = (gap < far) & (gap * gap <= best[open_rows] * d)
            open_rows, rise, up, down = open_rows[go], (gap_up <= gap_down)[go], up[go], down[go]
            place = np.where(rise, up, down)
            above[open_rows] += rise
            below[open_rows] -= ~rise
            diff = x[open_rows] - self.entries[place]
            distance, entry = np.einsum("ij,ij->i", diff, diff), self.order[place]
            better = (distance < best[open_rows]) | ((distance == best[open_rows]) & (entry < index[open_rows]))
            rows = open_rows[better]
            best[rows], index[rows] = distance[better], entry[better]
        return index, best


def whole_numbers(column: pa.Array, dimension: int) -> np.ndarray:
    """(rows, dimension) of floor(256 * x)."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) != len(column) * dimension or len(column) and (np.diff(np.asarray(column.offsets)) != dimension).any():
        raise ValueError(f"vectors must have {dimension} components")
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return x.astype(np.int64).reshape(len(column), dimension)


def blocks(batches: Iterator[pa.RecordBatch], column: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(a, BLOCK)
            yield piece, whole_numbers(piece.column(column), dimension)


def sums_by_entry(books: np.ndarray):
    """Task function: vectors -> one row a used entry with the number and the sums of the parts assigned to it."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        n, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for _, x in blocks(batches, 0, PARTS * width):
            for p in range(PARTS):
                part = x[:, p * width : (p + 1) * width]
                index, _ = search[p].nearest(part)
                n[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(sums[p], index, part)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def codes(books: np.ndarray):
    """Task function: (id, label, vector) -> (id, label, code, error)."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch, x in blocks(batches, 2, PARTS * width):
            index, error = np.zeros((len(x), PARTS), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            for p in range(PARTS):
                index[:, p], distance = search[p].nearest(x[:, p * width : (p + 1) * width])
                error += distance
            code = ["".join(row) for row in digits[index]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every used entry moved to the floor of the mean of its parts; only sums by entry and component reach the driver."""
    sums = vectors.select("embedding").mapInArrow(sums_by_entry(books), "part int, entry int, n long, sums array<long>")
    cells = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "total"))
    found = cells.groupBy("part", "entry", "pos").agg((F.sum("n").cast("long")).alias("n"), F.sum("total").alias("total")).toArrow()
    out = books.copy()
    n, total = found["n"].to_numpy(), found["total"].to_numpy()
    out[found["part"].to_numpy(), found["entry"].to_numpy(), found["pos"].to_numpy()] = total // n
    return out


def sound(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def product_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    Vectors that are null, empty or hold null or non-finite components are dropped. The first codebooks are the parts of the 64
    rows smallest by id (null ids last, equal ids by their vector), fewer where there are fewer rows. Equal rows are coded each.
    Labels are compared as they are, nulls and NaNs together. All vectors must have one dimension, a multiple of 16 up to 4096; a component
    beyond 16384 stops the query. Without a sound vector the result is empty.
    """
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")).where(sound(F.col("embedding")))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).toArrow()
    dimension = len(first["embedding"][0]) if first.num_rows else PARTS
    if dimension % PARTS or dimension > PARTS * LONGEST:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {PARTS} equal parts of at most {LONGEST}")
    start = whole_numbers(first["embedding"].combine_chunks(), dimension) if first.num_rows else np.zeros((1, dimension), dtype=np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = refined(kept, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    coded = materialize(kept.mapInArrow(codes(books), kinds), "product-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    by_label = F.broadcast(by_label) if coded.select("label").distinct().limit(LABEL_LIMIT + 1).count() <= LABEL_LIMIT else by_label
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL by comparing every part with every entry of its codebook."""

    def assigned(name: str, book: str) -> str:
        return f"""{name} AS (SELECT row, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
  SELECT x.row, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts x JOIN {book} b USING (part)) GROUP BY ALL)"""

    def moved(name: str, old: str, nearest: str) -> str:
        return f"""{name} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {old} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
  SELECT part, entry, pos, floor(sum(c)::DOUBLE / count(*))::BIGINT AS mean FROM (SELECT part, a.entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM parts JOIN {nearest} a USING (row, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""

    steps = ["book0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {})".format(ENTRIES)]
    for k in range(ROUNDS):
        steps += [assigned(f"near{k}", f"book{k}"), moved(f"book{k + 1}", f"book{k}", f"near{k}")]
    steps.append(assigned("last", f"book{ROUNDS}"))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (SELECT row, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
{', '.join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM last GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM kept JOIN coded USING (row)
"""
