"""Secret scan: an Aho-Corasick keyword pass, anchored expressions at its hits, checksums inside the tokens."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_texts, worker_cache

#: Kinds in the order in which spans of an equal start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "slack", "google", "stripe", "jwt", "pem")

SPANS = "array<struct<kind:string,start:int,end:int>>"

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(token: str) -> bool:
    """Tokens that end in six base-62 digits of the CRC-32 of the part between prefix and digits."""
    body = token.split("_", 1)[1]
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == body[-6:]


def jwt_header(token: str) -> bool:
    """The first part of a signed web token decodes to an object that names its algorithm."""
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


class Scanner:
    """Keywords -> kinds, and for each kind the expression that must match at the keyword's place, and its check."""

    def __init__(self) -> None:
        import ahocorasick

        anything = lambda m: True
        self.rules = {
            "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 12),
            "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
            "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_suffix(m[0])),
            "npm": (re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_suffix(m[0])),
            "slack": (re.compile(r"xox[abprs]-[0-9A-Za-z-]{20,}"), anything),
            "google": (re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), anything),
            "stripe": (re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), anything),
            "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: jwt_header(m[0])),
            "pem": (re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), anything),
        }
        words = {
            "assign": "password passwd secret token apikey api_key",
            "access": "akia",
            "github": "ghp_ gho_ ghu_ ghs_ ghr_",
            "npm": "npm_",
            "slack": "xoxa- xoxb- xoxp- xoxr- xoxs-",
            "google": "aiza",
            "stripe": "sk_live_ rk_live_",
            "jwt": "eyj",
        }
        self.machine = ahocorasick.Automaton()
        for kind, several in words.items():
            for word in several.split():
                self.machine.add_word(word, (len(word), kind))
        self.machine.add_word("-----begin ", (11, "pem"))
        self.machine.make_automaton()
        # Runs of hex digits have no keyword: their own class, scanned once, is the prefilter.
        self.hex = re.compile(r"[0-9a-f]{16,}")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        low = text if text.islower() else text.lower()
        if len(low) != len(text):  # a few letters become two; positions must stay
            low = "".join(c.lower() if c < "\x80" else c for c in text)
        hits = sorted((end - n + 1, kind) for end, (n, kind) in self.machine.iter(low))
        found, after = [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)], dict.fromkeys(KINDS, 0)
        for start, kind in hits:
            if start < after[kind]:
                continue
            rule, right = self.rules[kind]
            if m := rule.match(text, start):
                after[kind] = m.end()
                if right(m):
                    found.append((start, m.end(), kind))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scanner = worker_cache("secret_scanner", Scanner)
    for series in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scanner.spans(t or "")] for t in series])


def redact_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scanner = worker_cache("secret_scanner", Scanner)
    for series in texts:
        yield pd.Series([redacted(t, scanner.spans(t)) if t else t for t in series])


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans count as one, under the name of the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def secret_spans(text: Column) -> Column:
    """All secrets of a text as an array of (kind, start, end), by start, then kind; offsets in code points, end exclusive.

    Null and empty texts have none. Kinds overlap each other freely; within one kind the leftmost match wins and a match
    that fails its check still covers its place. Repeated rows each get their own result.
    """
    return F.pandas_udf(scan_batches, SPANS)(text)


def redact(text: Column) -> Column:
    """The text with every secret replaced by its kind in brackets; a null text stays null."""
    return F.pandas_udf(redact_batches, "string")(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` for every row: one pass over the texts, no shuffle; an empty table gives an empty result."""
    return whole_texts(docs, id_col, text_col).select("doc_id", secret_spans(F.col("text")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns; changed texts get their new length, other rows stay as they are."""
    clean = docs.withColumn("__clean", redact(F.col(text_col)))
    out = {text_col: F.col("__clean")}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out[length_col] = F.when(F.col("__clean") == F.col(text_col), F.col(length_col)).otherwise(F.coalesce(F.length("__clean").cast(kind), F.col(length_col)))
    return clean.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
