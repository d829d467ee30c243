"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and limits by language on its perplexity.

The model's symbols are the bytes of the text, its order is five, so an n-gram is a number below 2**40. Counts and
probabilities are tables sharded by n-gram; a document meets them through joins on n-grams:

* Documents fall into blocks of about 24 MB that follow the input files. A block asks once for each distinct n-gram in it.
* The distinct n-grams asked for are joined with the tables of all orders, from the highest down, and get one number each.
* A block receives the numbers that it asked for and adds them up for its documents. Texts and numbers travel once, compressed.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions.frames import local_frame
from lakegauge.session import materialize

from .common import column_bytes, drop_worker_cache, id_key, lean, release_memory, slices

ORDER = 5
#: Trusted ids up to this number go to every task; more of them meet the texts in a join by shuffle. All are used.
SMALL_IDS = 5_000_000
#: Documents to drop up to this number go to every task, so that no text travels; more of them meet the texts in a join by shuffle.
SMALL_POOR = 1_000_000
#: One in so many trusted documents is kept out of the model; the limits come from these.
HELD_OUT = 5
#: Texts are judged by their mean with so many bytes of usual text added, as short ones say little.
PRIOR = 150
#: The share of held-out trusted documents of a language that lies within its limit, and the slack beyond it, in bits a byte.
QUANTILE, SLACK = 0.995, 0.05
#: Languages with fewer held-out documents take the limit of all languages.
ENOUGH = 30
BLOCK = 24 << 20
#: Answers of all blocks that a task holds to pack them by block.
HELD = 1 << 19
#: Bytes worked on at a time; a block's questions are collected, and its texts packed, over some pieces.
PIECE, PIECES = 1 << 19, 8


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the number of the n-gram that ends in it; in front of a text stand line ends."""
    out = data.astype(np.int64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        before = np.full(len(data), 10, dtype=np.int64)
        before[back:] = data[:-back]
        before[at < back] = 10
        out |= before << np.int64(8 * back)
    return out


def model_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (k, c) of the trusted documents."""
    drop_worker_cache()
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        for a, b in slices(offsets, PIECE):
            k, c = np.unique(grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["k", "c"])


def request_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) -> (block, k), distinct within a piece."""
    drop_worker_cache()
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks):
            data, offsets = column_bytes(batch.column(1).filter(pa.array(blocks == block)))
            held: list[np.ndarray] = []
            ranges = list(slices(offsets, PIECE))
            for i, (a, b) in enumerate(ranges):
                held.append(np.unique(grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
                if len(held) == PIECES or i == len(ranges) - 1:
                    k = np.unique(np.concatenate(held))
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k)], names=["block", "k"])


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text_hash, lang, text) -> (block, texts): the rows of a block, sorted by language, as compressed pieces.

    bz2 takes a fifth less of natural text than zstd does; texts are most of what the operator writes to disk.
    """
    drop_worker_cache()
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks):
            rows = batch.filter(pa.array(blocks == block)).select([1, 2, 3, 4])
            rows = rows.take(pc.sort_indices(rows.column(2)))
            _, offsets = column_bytes(rows.column(3))
            for a, b in slices(offsets, PIECE * PIECES):
                sink, some = pa.BufferOutputStream(), rows.slice(a, b - a)
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    for c, d in slices(offsets[a : b + 1], PIECE):
                        out.write_batch(some.slice(c, d - c))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bz2.compress(sink.getvalue())], pa.binary())], names=["block", "texts"])


def answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, k, bits) -> (block, answers): numbers in ascending order as steps, byte by byte, compressed."""
    import zstandard

    drop_worker_cache()
    squeeze = zstandard.ZstdCompressor(3)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, k, bits = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.lexsort((k, block))
        block, k, bits = block[order], k[order], bits[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        rows = [squeeze.compress(planes(np.diff(k[a:b], prepend=0)) + planes(bits[a:b])) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(rows, pa.binary())], names=["block", "answers"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= HELD:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as their first bytes, then their second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(answers: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(k, bits) of the answers of a block, in ascending order of k."""
    import zstandard

    expand, ks, bits = zstandard.ZstdDecompressor(), [np.zeros(0, np.int64)], [np.zeros(0)]
    for row in answers:
        both = np.frombuffer(expand.decompress(row.as_py()), dtype=np.uint8).reshape(2, 8, -1)
        steps, own = (np.ascontiguousarray(half.T).reshape(-1) for half in both)
        ks.append(np.cumsum(steps.view(np.int64)))
        bits.append(own.view(np.float64))
    k, bits = np.concatenate(ks), np.concatenate(bits)
    order = np.argsort(k)
    return k[order], bits[order]


def score_block(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The bits of every document of a block, by its bytes' n-grams."""
    drop_worker_cache()
    out = block_bits(texts, answers)
    release_memory()
    return out


def block_bits(texts: pa.Table, answers: pa.Table) -> pa.Table:
    k, bits = unpacked(answers["answers"])
    out = []
    for piece in texts["texts"]:
        for rows in pa.ipc.open_stream(bz2.decompress(piece.as_py())):
            data, offsets = column_bytes(rows.column(3))
            own = grams(data, offsets)
            sums = np.concatenate([[0.0], np.cumsum(bits[np.searchsorted(k, own)])]) if len(own) else np.zeros(1)
            out.append(pa.Table.from_arrays([*rows.columns[:3], pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets]))], names=["doc_id", "text_hash", "lang", "n_bytes", "bits"]))
    return pa.concat_tables(out)


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from how many n-grams have counts of 1 to 4."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    one, two = n.get(1, 0), n.get(2, 0)
    y = one / (one + 2 * two) if one + two else 0.5
    out = []
    for c in (1, 2, 3):
        d = c - (c + 1) * y * n.get(c + 1, 0) / n[c] if n.get(c) else 0.75
        out.append(min(max(d, 0.05), c - 0.05))
    return tuple(out)


def below(col: str, order: int) -> Column:
    """The last ``order`` symbols of an n-gram."""
    return F.col(col).bitwiseAND(F.lit((1 << (8 * order)) - 1))


def model_tables(top: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (k, p) of seen n-grams, interpolated, and (h, gamma): what a history leaves to the order below.

    The highest order counts occurrences, lower ones the distinct symbols in front.
    """
    counts = {ORDER: materialize(top, "kn-counts", "zstd")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = materialize(counts[n + 1].groupBy(below("k", n).alias("k")).agg(F.count("*").alias("c")), "kn-counts", "zstd")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[n])
        held = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = counts[n].withColumn("h", F.shiftright("k", 8))
        history = own.groupBy("h").agg(F.sum("c").alias("total"), (F.sum(held) / F.sum("c")).alias("gamma"))
        seen = own.join(history, "h")
        if n == 1:
            seen = seen.withColumn("lower", F.lit(1 / 256))
        else:
            seen = seen.withColumn("s", below("k", n - 1)).join(tables[-1][0].select(F.col("k").alias("s"), F.col("p").alias("lower")), "s")
        p = (F.col("c") - held) / F.col("total") + F.col("gamma") * F.col("lower")
        tables.append((materialize(seen.select("k", p.alias("p")), "kn-p", "zstd"), materialize(history.select("h", "gamma"), "kn-gamma", "zstd")))
    return tables


def answers(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(k, bits) of every n-gram asked for: the highest order that knows it, times what the histories above leave."""
    rows = asked.select("k", F.col("k").alias("s"), F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("p"))
    for n in range(ORDER, 0, -1):
        seen, history = tables[n - 1]
        rows = rows.join(seen.select(F.col("k").alias("s"), F.col("p").alias("own")), "s", "left").withColumn("h", F.shiftright("s", 8)).join(history, "h", "left")
        known = F.coalesce("p", F.col("w") * F.col("own"))
        rows = rows.select("k", below("s", n - 1).alias("s"), (F.col("w") * F.coalesce("gamma", F.lit(1.0))).alias("w"), known.alias("p"))
    return rows.select("k", (-F.log2(F.coalesce("p", F.col("w") / 256))).alias("bits"))


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of all documents of good quality that are not toxic: held-out ones set the limits, the others make the model."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)


def trusted_ids(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``trusted`` as arrays, for small tables: those of the model and the held-out ones."""
    rows = trusted(labels).collect()
    return tuple(np.array(sorted(r["doc_id"] for r in rows if r["held"] == held), dtype=np.int64) for held in (False, True))


def blocked(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text_hash, lang, text): blocks are parts of an input file, so a task that reads a file meets few of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.input_file_name().alias("file"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), lang.alias("lang"), text.alias("text"))
    largest = rows.groupBy("file").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = largest // BLOCK + 1
    return rows.select(F.xxhash64("file", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts))).alias("block"), "doc_id", "text_hash", "lang", "text")


def scores(docs: DataFrame, model_ids: DataFrame | np.ndarray) -> DataFrame:
    """(doc_id, text_hash, lang, n_bytes, bits) of every row under a model of the texts of ``model_ids``: a table of ``doc_id`` or an array."""
    if not isinstance(model_ids, DataFrame):
        model_ids = local_frame(docs.sparkSession, [(int(i),) for i in model_ids], "doc_id long")
    rows = blocked(docs)
    own = F.broadcast(model_ids) if model_ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS else model_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.join(own, "doc_id", "left_semi").select("text").mapInArrow(lean(model_batches), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    tables = model_tables(counted)
    asked = materialize(rows.select("block", "text").mapInArrow(lean(request_batches), "block long, k long").distinct().sortWithinPartitions("block", "k"), "kn-asked", "zstd")  # sorted numbers take less disk
    found = materialize(answers(asked.select("k").distinct(), tables), "kn-answers", "zstd")
    texts = rows.mapInArrow(lean(pack_batches), "block long, texts binary")
    told = asked.join(found, "k").select("block", "k", "bits").mapInArrow(lean(answer_batches), "block long, answers binary")
    result = "doc_id long, text_hash long, lang string, n_bytes long, bits double"
    return materialize(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score_block, result), "kn-scores")


def limits(scored: DataFrame, held_ids: DataFrame) -> DataFrame:
    """(lang, usual, limit) for each language: the usual bits a byte, and the quantile of the held-out trusted documents."""
    own = scored.join(held_ids, "doc_id", "left_semi")
    everyone = own.withColumn("lang", F.lit(None).cast("string"))
    sums = lambda rows: rows.groupBy("lang").agg((F.sum("bits") / F.greatest(F.sum("n_bytes"), F.lit(1))).alias("usual"), F.count("*").alias("n"))
    known = own.where("lang is not null")
    usual = sums(known).where(F.col("n") >= ENOUGH).union(sums(everyone)).select("lang", "usual")
    columns = ["lang", "usual", "n_bytes", "bits"]
    general = usual.where("lang is null").select("usual")  # one row
    judged = known.join(usual, "lang").select(*columns).union(everyone.join(F.broadcast(general), F.lit(True)).select(*columns))
    return judged.groupBy("lang").agg(F.first("usual").alias("usual"), (F.percentile_approx(shrunk(), QUANTILE, 10_000) + SLACK).alias("limit"))


def shrunk() -> Column:
    return (F.col("bits") + PRIOR * F.col("usual")) / (F.col("n_bytes") + PRIOR)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lang, n_bytes, perplexity, score, limit, kept) of every row.

    ``perplexity`` is that of a byte; ``score`` the bits a byte with PRIOR usual bytes added. Documents of a language that
    has few trusted ones, or of none, are held against the limit of all languages. Empty and null texts have perplexity 1
    and stay. Without any trusted text all documents stay.
    """
    ids = materialize(trusted(labels), "kn-trusted")
    scored = scores(docs, ids.where("not held").select("doc_id"))
    own = limits(scored, ids.where("held").select("doc_id"))
    general = own.where("lang is null").select(F.col("usual").alias("any_usual"), F.col("limit").alias("any_limit"))
    # one row, or none without trusted text
    rows = scored.join(F.broadcast(own.where("lang is not null")), "lang", "left").join(F.broadcast(general), F.lit(True), "left")
    rows = rows.withColumns({"usual": F.coalesce("usual", "any_usual"), "limit": F.coalesce("limit", "any_limit")})
    mean = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "text_hash", "lang", "n_bytes", F.pow(F.lit(2.0), mean).alias("perplexity"), shrunk().alias("score"), "limit", F.coalesce(shrunk() <= F.col("limit"), F.lit(True)).alias("kept"))


def classifier_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select("doc_id", "lang", "n_bytes", "perplexity", "score", "limit", "kept")


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that the classifier keeps, repeated rows included."""
    poor = classify(docs, labels).where(~F.col("kept")).select(id_key(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    poor = materialize(poor, "kn-poor")
    if poor.count() <= SMALL_POOR:
        poor = F.broadcast(poor)
    own = docs.withColumns({"__id": id_key(F.col("doc_id")), "__hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return own.join(poor, ["__id", "__hash"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
