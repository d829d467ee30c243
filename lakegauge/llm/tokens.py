"""Byte-level BPE ids of whole texts, with the public tokenizer's own model behind a bounded cache of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import column_bytes, slices, worker_cache

#: The white space of the pre-tokenizer's pattern, and the pattern with it spelled out.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Cached units of a worker, beyond which the cache starts anew, and the longest unit worth a place: they bound memory and
#: change no result.
CACHED, LONGEST = 800_000, 12
#: Bytes of text whose units are numbered at a time, and units whose ids are put together at a time; a longer text stands alone.
PIECE, AT_ONCE = 1 << 22, 1 << 20


class Units(dict):
    """Text between two single spaces -> the ids, as bytes, of a space and that text."""

    def __init__(self, words: "Words"):
        self.words = words

    def __missing__(self, unit: str) -> bytes:
        if unit[:-1].isalpha() and unit[-1] in ".,!?;:":  # composed each time: the word alone is kept
            return self[unit[:-1]] + self.words[unit[-1]]
        ids = self.words.tokenize(" " + unit) if unit.isalpha() else self.words.several(" " + unit)
        if len(unit) <= LONGEST:
            self[unit] = ids
        return ids


class Words(dict):
    """A pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = whole.model
        self.added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in whole.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens that take in the text around them")
        self.find = regex.compile(PATTERN).findall
        # the visible character that stands for each byte
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def tokenize(self, word: str) -> bytes:
        shown = word.replace(" ", self.shown[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.tokenize(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def several(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


class Encoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)``: the file's added tokens have ids of their own wherever
    their text stands, and the text between them is taken by itself.

    A pre-token never starts before a space that follows a non-space character and ends after it. So a text falls into
    units at such spaces, and a unit's ids depend on the unit alone.
    """

    def __init__(self, path: str):
        self.words = Words(path)
        self.units = Units(self.words)
        self.odd = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S) ")
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in self.words.added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.apart = rf"[{SPACE}\x1c-\x1f] " + "".join(f"|{re.escape(t)}" for t in self.added)
        self.spaces = tuple(f"{c} " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.at_added.split(text))
        return self.plain(text)

    def forget(self) -> None:
        if len(self.units) > CACHED:
            self.units.clear()
        if len(self.words) > CACHED // 2:  # outlive units, which are put together from them
            self.words.clear()

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        self.forget()
        odd = any(s in text for s in self.spaces) if text.isascii() else self.odd.search(text)
        parts = self.cut.split(text) if odd else text.split(" ")
        if parts[0] == "" and len(parts) > 1:  # the text starts with a space: it belongs to the next unit
            return b"".join(map(self.units.__getitem__, parts[1:]))
        return self.words.several(parts[0]) + b"".join(map(self.units.__getitem__, parts[1:]))

    def batch(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids end to end, offsets of the rows into them) of pieces of a column of texts; ``end`` closes each row."""
        _, offsets = column_bytes(texts)
        for a, b in slices(offsets, PIECE):
            self.forget()
            ids, at = self.piece(texts.slice(a, b - a))
            yield a, np.insert(ids, at[1:], end), at + np.arange(len(at))

    def piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and their offsets: every distinct unit is looked up once, its ids are taken by its number.

        Texts with several spaces in a row or added tokens are taken one by one.
        """
        apart = pc.match_substring_regex(texts, self.apart)
        lists = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        first = np.zeros(len(flat), bool)
        first[ends[:-1]] = True  # nothing stands in front of a text's first unit
        later, start = flat.filter(pa.array(~first)).dictionary_encode(), flat.filter(pa.array(first)).dictionary_encode()
        own = list(map(self.units.__getitem__, later.dictionary.to_numpy(zero_copy_only=False)))
        code = np.empty(len(flat), dtype=np.int64)
        code[~first] = later.indices.to_numpy()
        code[first] = start.indices.to_numpy() + len(own)
        own += map(self.words.several, start.dictionary.to_numpy(zero_copy_only=False))
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        code[ends[alone]] = np.arange(len(alone)) + len(own)
        own += (self.ids(texts[int(i)].as_py()) for i in alone)
        known, parts, total = pa.array(own, pa.large_binary()), [], np.zeros(len(code) + 1, dtype=np.int64)
        for a in range(0, len(code), AT_ONCE):
            data, offsets = column_bytes(known.take(pa.array(code[a : a + AT_ONCE])))
            parts.append(data.view("<u4"))
            total[a + 1 : a + len(offsets)] = total[a] + offsets[1:] // 4
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4"), total[ends]


def encoder(path: str) -> Encoder:
    return worker_cache(f"encoder_{path}", lambda: Encoder(path))
