"""Quality rules on whole texts: word and line counts, and how a public vocabulary takes the text apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.session import materialize

from .common import worker_cache

MODEL = "piece_bpe_32k.model"
MIN_WORDS, WINDOW = 50, 3
#: A measure is out of its band this many half spreads between quartiles below or above the group's centre.
BELOW, ABOVE = 6.5, 12.0
#: Half spreads are at least this large, so that a group of equal texts has a band too.
LEAST = {"fertility": 0.4, "entropy_gap": 0.05, "byte_share": 0.02}

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Upper ends of the code point ranges that tell scripts apart coarsely.
SCRIPTS = ((0x250, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "other"), (0x600, "hebrew"), (0x780, "arabic"), (0x900, "other"), (0xE00, "indic"), (0xE80, "thai"), (0x3040, "other"), (0x3100, "kana"), (0x3400, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"), (0x110000, "other"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_tokens", "n_bytes")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", token_entropy double, script string"


def repeated(words: list[str]) -> int:
    """Words that lie in a window of three which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    k = len(numbers)
    _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
    _, at, times = np.unique(pair * k + ids[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= hit
    return int(covered.sum())


def counted(text: str) -> tuple[int, ...]:
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated(words), len(text)


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.array([e for e, _ in SCRIPTS], dtype=np.uint32)
    letters = points[(points >= 0xC0) | ((points | 32) - 97 < 26)]
    if not len(letters):
        return "none"
    return SCRIPTS[int(np.bincount(np.searchsorted(ends, letters, side="right")).argmax())][1]


def measure_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = worker_cache(f"sentencepiece_{path}", lambda: sentencepiece.SentencePieceProcessor(model_file=path))
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                rows = []
                for text in part.column(2).to_pylist():
                    ids = np.array(model.encode(text), dtype=np.int64)
                    times = np.bincount(ids)
                    share = times[times > 0] / max(1, len(ids))
                    rows.append((*counted(text), len(ids), int(is_byte[ids].sum()), float(-(share * np.log2(share)).sum()) + 0.0, script_of(text)))
                cols = list(zip(*rows))
                kinds = [*[pa.int64()] * len(COUNTS), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "lang", *COUNTS, "token_entropy", "script"])

    return run


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", path: str | None = None) -> DataFrame:
    """Counts and token measures of every whole text, one pass without a shuffle.

    ``chars_per_token``: code points for each token; ``byte_share``: tokens that are bytes of unknown characters;
    ``token_entropy``: bits of the text's own token distribution. ``band`` names the group that a text is held against: its
    language, or its main script where the language is null or missing.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(measure_batches(path or public_tokenizers.path(MODEL)), f"doc_id {kind}, lang string, {SCHEMA}")
    tokens = F.greatest("n_tokens", F.lit(1))
    return rows.withColumns(
        {
            "chars_per_token": F.col("n_chars") / tokens,
            "byte_share": F.col("n_bytes") / tokens,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "band": F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script")),
        }
    )


def centred(rows: DataFrame) -> DataFrame:
    """Adds ``fertility`` and ``entropy_gap``, both comparable between short and long texts of a group.

    The spread of characters per token shrinks with the root of the length, and entropy grows with its logarithm: so the
    first is the scaled distance from the group's median, the second the distance from the group's line over log length.
    """
    size = F.log2(F.col("n_tokens").cast("double"))
    line = rows.where(~F.col("base_failed")).groupBy("band").agg(
        F.percentile_approx("chars_per_token", 0.5, 2000).alias("usual"),
        F.coalesce(F.regr_slope("token_entropy", size), F.lit(0.0)).alias("slope"),
        F.avg("token_entropy").alias("mean_entropy"),
        F.avg(size).alias("mean_size"),
    )
    out = rows.join(line, "band", "left")
    fertility = (F.col("chars_per_token") - F.col("usual")) * F.sqrt("n_tokens")
    gap = F.col("token_entropy") - F.col("mean_entropy") - F.col("slope") * (size - F.col("mean_size"))
    return out.withColumns({"fertility": fertility, "entropy_gap": gap}).drop("usual", "slope", "mean_entropy", "mean_size")


def bands(rows: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(band, low and high of each measure) from the quartiles of the group's documents that pass the base rules.

    Percentile sketches are merged map-side, so a group may hold any share of the rows.
    """
    found = rows.where(~F.col("base_failed")).groupBy("band").agg(*[F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in LEAST])
    out: list[Column] = [F.col("band")]
    for m, least in LEAST.items():
        q = F.col(m)
        half = F.greatest((q[2] - q[0]) / 2, F.lit(least))
        out += [(q[1] - below * half).alias(f"{m}_low"), (q[1] + above * half).alias(f"{m}_high")]
    return found.select(*out)


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``kept``: false if the base rules fail or a measure is out of its group's band."""
    inside = None
    for m in LEAST:
        one = F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
        inside = one if inside is None else inside & one
    # groups without any passing document have no band, and no document that could need one
    return rows.join(limits, "band", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def fertility_report(docs: DataFrame) -> DataFrame:
    """One row for each document, repeated rows included. Null texts count as empty and fail the base rules."""
    rows = centred(materialize(measures(docs), "fertility"))
    judged = judge(rows, bands(rows))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "band", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "fertility", "entropy_gap")
