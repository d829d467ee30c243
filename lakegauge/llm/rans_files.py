"""Token files: interleaved static range coding (rANS) of ids, with a shared frequency table, checkpoints and checksums.

A file set is a Parquet folder of blocks (columns part, block, n_docs, n_tokens, payload) and a folder with the one
frequency table. A block holds whole documents in ascending id order and decodes without any other block:

    header    magic "RNS1", lanes, steps between checkpoints, tokens, documents, words, checkpoints, crc of the ids
    documents id, is-null flag and number of tokens of each
    restarts  for each checkpoint: the word position and the state of every lane, so that segments decode side by side
    words     the 32-bit words of all lanes in reading order
    crc       CRC-32 of everything before it
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakegauge.functions.frames import local_frame
from lakegauge.session import materialize, scratch_path

from .common import whole_texts
from .tokens import encoder

VOCABULARY, END = "byte_bpe_50k.json", 0
#: Bits of a frequency table's total; lower bound of a lane's state; bits moved at a time.
SCALE, LOW, WORD = 18, 1 << 31, 32
#: A block closes at the first document end at or after this many tokens.
BLOCK = 1 << 18
LANES, EVERY = 512, 128
#: Tokens that one partition of the files holds on average.
PART = 1 << 22

HEADER = "<4sHHQIQHI"


class BadBlock(ValueError):
    """A block whose checksum, table or ids do not agree."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts -> whole frequencies that sum to 2**SCALE; every symbol keeps at least 1, so unseen ids stay encodable."""
    total, n = 1 << SCALE, len(counts)
    if n > total:
        raise ValueError("more symbols than the table has places")
    share = counts / max(1, counts.sum()) * (total - n)
    freq = np.floor(share).astype(np.int64)
    short = total - n - int(freq.sum())
    freq[np.argsort(freq - share, kind="stable")[:short]] += 1
    if (short := total - n - int(freq.sum())) > 0:
        freq[int(np.argmax(counts))] += short
    return freq + 1


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.below = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.limit = self.freq << np.uint64(31 - SCALE + WORD)


def encode_ids(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Restarts (word position, states) for every ``every`` steps and the words; lane k takes ids k, k + lanes, ..."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    low, shift, scale = np.uint64(0xFFFFFFFF), np.uint64(WORD), np.uint64(SCALE)
    total = 0
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], table.freq[s]
        over = x >= table.limit[s]
        out = (x[over] & low).astype(np.uint32)
        words.append(out)
        total += len(out)
        x = np.where(over, x >> shift, x)
        q = x // f
        state[: len(s)] = (q << scale) + (x - q * f) + table.below[s]
        if t % every == 0:
            marks.append((total, state.copy()))
    return [(total - at, x) for at, x in reversed(marks)], np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_segment(n: int, lanes: int, words: np.ndarray, at: int, state: np.ndarray, table: Table) -> np.ndarray:
    """``n`` ids from one restart on; nothing outside the segment's words is read."""
    state, out = state.copy(), np.empty(n, dtype=np.uint32)
    mask, shift, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(WORD), np.uint64(SCALE), np.uint64(LOW)
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        place = x & mask
        s = table.symbol[place]
        out[a:b] = s
        x = table.freq[s] * (x >> scale) + place - table.below[s]
        need = x < low
        k = int(need.sum())
        if k:
            x[need] = (x[need] << shift) | words[at : at + k]
            at += k
        state[: b - a] = x
    return out


def decode_segments(steps: int, words: np.ndarray, at: np.ndarray, state: np.ndarray, table: Table) -> np.ndarray:
    """The ids of whole segments side by side, each from its own restart: rows of ``state`` are segments of ``steps`` times its
    lanes. The same ids as segment by segment, in fewer and larger steps."""
    at, x = at.copy(), state.copy()
    out = np.empty((len(x), steps, x.shape[1]), dtype=np.uint32)
    mask, shift, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(WORD), np.uint64(SCALE), np.uint64(LOW)
    for t in range(steps):
        place = x & mask
        s = table.symbol[place]
        out[:, t] = s
        x = table.freq[s] * (x >> scale) + place - table.below[s]
        need = x < low
        k = np.count_nonzero(need, axis=1)
        taken = np.arange(k.sum()) + np.repeat(at - (np.cumsum(k) - k), k)
        x[need] = (x[need] << shift) | words[taken]
        at += k
    return out.reshape(-1)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    lanes = max(1, min(lanes, len(flat) // every))
    marks, words = encode_ids(flat, table, lanes, every)
    body = [struct.pack(HEADER, b"RNS1", lanes, every, len(flat), len(ids), len(words), len(marks), zlib.crc32(flat.astype("<u4").tobytes()))]
    body.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    body.append(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes())
    body.append(np.array([len(i) for i in ids], dtype="<u8").tobytes())
    body += [struct.pack("<Q", at) + state.astype("<u8").tobytes() for at, state in marks]
    body.append(words.astype("<u4").tobytes())
    whole = b"".join(body)
    return whole + struct.pack("<I", zlib.crc32(whole))


class Block:
    """A parsed block: its directory, and segments that decode independently."""

    def __init__(self, payload: bytes, table: Table):
        if len(payload) < struct.calcsize(HEADER) + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise BadBlock("checksum of the block")
        magic, self.lanes, self.every, self.n, docs, n_words, n_marks, self.crc = struct.unpack_from(HEADER, payload)
        if magic != b"RNS1":
            raise BadBlock("not a token block")
        at = struct.calcsize(HEADER)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(payload, dtype=dtype, count=n, offset=at)
            at += part.nbytes
            return part

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.marks = [(int(take("<u8", 1)[0]), take("<u8", self.lanes).astype(np.uint64)) for _ in range(n_marks)]
        self.words = take("<u4", n_words).astype(np.uint64)
        self.table = table

    def segment(self, k: int) -> np.ndarray:
        size = self.lanes * self.every
        at, state = self.marks[k]
        return decode_segment(min(size, self.n - k * size), self.lanes, self.words, at, state, self.table)

    def ids(self) -> np.ndarray:
        whole = self.n // (self.lanes * self.every)
        parts = [np.zeros(0, np.uint32), *[self.segment(k) for k in range(whole, len(self.marks))]]
        if whole:
            at, state = (np.array([m[i] for m in self.marks[:whole]]) for i in (0, 1))
            parts[0] = decode_segments(self.every, self.words, at, state, self.table)
        out = np.concatenate(parts)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise BadBlock("checksum of the ids")
        return out


def id_batches(path: str, end: int):
    """Documents -> (doc_id, text_hash, n, ids as 16- or 32-bit integers); then one row of counts by id for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, squeeze, counts = encoder(path), zstandard.ZstdCompressor(1), np.zeros(0, np.int64)
        for batch in batches:
            for first, ids, at in enc.batch(batch.column(1), end):
                found = np.bincount(ids, minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
                narrow = ids.max() < 65536
                ids = ids.astype("<u2" if narrow else "<u4")
                mark, n = b"\x02" if narrow else b"\x04", len(at) - 1
                packed = [mark + squeeze.compress(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                rows = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(at)), pa.array(packed, pa.binary()), pa.nulls(n, pa.binary())], names=["doc_id", "text_hash", "n", "ids", "counts"])
        kind = pa.int64()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, kind), pa.array([0], kind), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["doc_id", "text_hash", "n", "ids", "counts"])

    return run


def unpacked(packed: bytes, expand) -> np.ndarray:
    return np.frombuffer(expand.decompress(packed[1:]), dtype="<u2" if packed[:1] == b"\x02" else "<u4").astype(np.uint32)


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count vectors -> (id, n) rows that are not 0."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            own = np.frombuffer(packed, dtype="<i8").copy()
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "n"])


def block_batches(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, part, expand = Table(np.frombuffer(freq, dtype="<i8")), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            row = [[part], [number], [len(ids)], [size], [write_block(names, ids, table)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(unpacked(packed.as_py(), expand))
                size += len(ids[-1])
                if size >= BLOCK:
                    yield close()
                    names, ids, size, number = [], [], 0, number + 1
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Whole texts as ids plus ``end``, in ascending doc_id order (null first, ties by text hash), below ``folder``.

    Ids are made once and kept in the shared folder while the frequency table is counted over all of them. The table has a
    bounded size, the vocabulary's, and goes to every task. Rows are dealt by ranges of (id, text hash), so an id that
    many rows share is cut too. An empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(VOCABULARY)
    texts = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    held = scratch_path(spark, "token-ids")
    kind = "doc_id long, text_hash long, n long, ids binary, counts binary"
    texts.mapInArrow(id_batches(path, end), kind).write.option("compression", "zstd").parquet(held)
    held = spark.read.schema(kind).parquet(held)
    counts = np.zeros(Tokenizer.from_file(path).get_vocab_size(), dtype=np.int64)
    total = 0
    for r in held.where("counts is not null").select("counts").mapInArrow(sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
        total += r["n"]
    freq = frequencies(counts).astype("<i8").tobytes()
    local_frame(spark, [(SCALE, freq)], "scale int, frequencies binary").coalesce(1).write.parquet(f"{folder}/table")
    dealt = held.where("ids is not null").select("doc_id", "ids", "text_hash").repartitionByRange(total // PART + 1, "doc_id", "text_hash")
    ordered = dealt.sortWithinPartitions("doc_id", "text_hash").select("doc_id", "ids")
    ordered.mapInArrow(block_batches(freq), "part int, block long, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def decode_batches(freq: bytes, digest: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(freq, dtype="<i8"))
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(payload, table)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.lengths)
                n = len(ends)
                own = [ids[b - k : b] for b, k in zip(ends.tolist(), block.lengths.tolist())]
                last = pa.array([zlib.crc32(i) for i in own], pa.int64()) if digest else pa.array([i.tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(ends - block.lengths), pa.array(block.lengths),
                        last,
                    ],
                    names=["doc_id", "part", "block", "within", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, part, block, within, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit integers.

    Every block is checked against its checksums and decodes on its own. With ``digest`` the decoded ids stay in their task and
    their CRC-32, ``ids_crc32``, takes their place.
    """
    freq = bytes(spark.read.parquet(f"{folder}/table").first()["frequencies"])
    blocks = spark.read.schema("part int, block long, n_docs long, n_tokens long, payload binary").parquet(f"{folder}/blocks")
    return blocks.select("part", "block", "payload").mapInArrow(decode_batches(freq, digest), f"doc_id long, part int, block long, within long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, before): the ids of all blocks before each block; the driver sees one total for each partition."""
    blocks = spark.read.schema("part int, block long, n_docs long, n_tokens long, payload binary").parquet(f"{folder}/blocks").select("part", "block", "n_tokens")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    at, rows = 0, []
    for part, n in totals:
        rows.append((part, at))
        at += n
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = blocks.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
    return inside.join(local_frame(spark, rows, "part int, at long"), "part").select("part", "block", (F.col("at") + F.col("inside")).alias("before"))


def token_file_report(docs: DataFrame) -> DataFrame:
    """Writes the files, reads them back, and reports (doc_id, start, n_tokens, ids_crc32) from what was read."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder)
    rows = read_token_files(spark, folder, digest=True)
    return rows.join(block_starts(spark, folder), ["part", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
