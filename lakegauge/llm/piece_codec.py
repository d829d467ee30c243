"""SentencePiece ids: an Aho-Corasick automaton over the pieces drives one Viterbi pass over each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import whole_texts, worker_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A literal space mark of the text: no piece holds a lone surrogate, so it takes the way of unknown characters.
LITERAL = "\udfff"
#: An unknown character costs this much more than the worst piece.
PENALTY = 10.0
#: Cached segments of a worker, beyond which the cache starts anew: it bounds memory and changes no result.
CACHED = 500_000


class PieceCodec(dict):
    """Segment -> ids, as bytes. A segment is a run of spaces and the text up to the next one; no piece crosses its end."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.machine = ahocorasick.Automaton()
        self.raw: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype="<u4")
        worst, self.crossing = 0.0, False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                score = model.get_score(i)
                worst = min(worst, score)
                self.machine.add_word(piece, (i, len(piece), score))
                self.raw.append(piece.replace(SPACE, " ").encode())
                self.crossing |= SPACE in piece.lstrip(SPACE)
        self.machine.make_automaton()
        self.unknown = worst - PENALTY
        self.cut = re.compile("(?<=[^ ]) ")

    def __missing__(self, segment: str) -> bytes:
        ids = self.best(segment)
        if len(segment) <= 64:
            self[segment] = ids
        return ids

    def best(self, segment: str) -> bytes:
        """The best-scored ids of ``segment``: at each end the automaton's output links list the pieces that stop there.

        Longer pieces come first, and only a better score replaces one, so ties go to the longer last piece.
        """
        text = segment.replace(SPACE, LITERAL).replace(" ", SPACE)
        n = len(text)
        score, back = [0.0] + [-np.inf] * n, [(-1, 0)] * (n + 1)
        done = 0  # ends up to here are final
        single = False

        def unknown_until(end: int) -> None:
            nonlocal done, single
            while done < end:
                if not single and score[done] + self.unknown > score[done + 1]:
                    score[done + 1], back[done + 1] = score[done] + self.unknown, (-1, 1)
                done, single = done + 1, False

        for end, (i, size, gain) in self.machine.iter(text):
            unknown_until(end)
            single |= size == 1
            if (total := score[end + 1 - size] + gain) > score[end + 1]:
                score[end + 1], back[end + 1] = total, (i, size)
        unknown_until(n)
        out: list[np.ndarray | int] = []
        at = n
        while at:
            i, size = back[at]
            if i < 0:
                out.extend(self.byte_ids[list(segment[at - 1].encode())][::-1])
            else:
                out.append(i)
            at -= size
        return np.array(out[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text behind one leading space; an empty text has none."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if len(self) > CACHED:
            self.clear()
        if self.crossing:
            return np.frombuffer(self.best(" " + text), dtype="<u4")
        parts = self.cut.split(text) if text[0] == " " or "  " in text else text.split(" ")
        return np.frombuffer(b"".join([self[" " + p] for p in parts]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; wrong byte runs become replacement characters, control ids nothing."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> PieceCodec:
    return worker_cache(f"pieces_{path}", lambda: PieceCodec(path))


def int_lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


def encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), int_lists([own.encode(t.as_py()) for t in part.column(1)])], names=["doc_id", "ids"])

    return run


def decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.asarray(i.as_py() or [], dtype=np.int64)) for i in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return run


def round_trip_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        low, high = int(own.byte_ids.min()), int(own.byte_ids.max())
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                texts = part.column(1).to_pylist()
                ids = [own.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([int(((i >= low) & (i <= high)).sum()) for i in ids], pa.int64()),
                        pa.array([own.decode(i) == t for i, t in zip(ids, texts)]), int_lists(ids),
                    ],
                    names=["doc_id", "n_tokens", "n_bytes", "round_trip", "ids"],
                )

    return run


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of whole texts: the segmentation with the largest sum of piece scores, unknown characters as bytes.

    One pass over the texts without a shuffle. Null and empty texts give an empty list, repeated rows each their own.
    A literal space mark in a text is spelled in bytes, so that decoding always returns the text.
    """
    texts = whole_texts(docs)
    return texts.mapInArrow(encode_batches(path or public_tokenizers.path(MODEL)), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids; a null or empty list gives an empty text."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode_batches(path or public_tokenizers.path(MODEL)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def piece_report(docs: DataFrame) -> DataFrame:
    """Ids of every whole text, how many are bytes, and whether decoding them gives the text again."""
    texts = whole_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(round_trip_batches(public_tokenizers.path(MODEL)), f"doc_id {kind}, n_tokens long, n_bytes long, round_trip boolean, ids array<int>")
