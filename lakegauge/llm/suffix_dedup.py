"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else in the corpus.

Every 200-byte window holds an anchor: the place of the smallest hash among its 50-byte grams. Equal windows have the same
anchor at the same distance, so only suffixes at anchors (about one byte in 76) need sorting, and only where grams repeat:

1. Grams that occur once are left out (exact counts by gram).
2. An anchor's context reaches as far as its windows do. A context that occurs twice is covered as a whole, and one
   occurrence stands for all from here on.
3. Distinct contexts of one gram go through a merge sort: tasks sort the suffixes at their anchors, front-code them into
   runs, the runs are exchanged by ranges of the gram, and a loser tree merges the runs of a range with the lengths of
   common prefixes it already knows. Common prefixes to the right and to the left of the anchors say which windows agree.
4. Windows become byte ranges of every text that holds the context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lakegauge.session import materialize

from .common import column_bytes, filter_bits, id_key, key_runs, lean, may_hold, null_again, slices, whole_texts, worker_cache
from .suffix_runs import Entry, common_suffix, front_coded, merged

#: Length of a repeated string, of a gram, and places of a gram inside such a string.
LENGTH, GRAM = 200, 50
PLACES = LENGTH - GRAM + 1
#: Bytes hashed at a time; arrays of eight times this size stay near the processor.
CHUNK = 1 << 19
#: Distinct contexts of one gram that one task compares, in about 6 kB each; larger groups are dealt out by their windows.
LARGE = 32_768
#: Distances that are compared at a time, so that the rest of a group's memory does not follow their number.
AT_ONCE = 16
#: Contexts of one range of the merge.
RANGE = 10_000


class Roller:
    """Hashes of substrings from one running sum: sum(value[byte] * base**place), shifted back to place 0."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.value, self.second = (np.frombuffer(rng.bytes(256 * 8), dtype=np.uint64) | np.uint64(1) for _ in range(2))
        base = 0x9E3779B97F4A7C15
        self.n = 0
        self.bases = (base, pow(base, -1, 1 << 64))
        self.grow(CHUNK + 4 * LENGTH)

    def grow(self, n: int) -> None:
        if n >= self.n:
            self.n = n + 1
            powers = [np.full(self.n, b, dtype=np.uint64) for b in self.bases]
            for p in powers:
                p[0] = 1
            self.up, self.down = (np.multiply.accumulate(p) for p in powers)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def roller() -> Roller:
    return worker_cache("suffix_roller", Roller)


def chunk_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roll: Roller, first: int = 0, last: int | None = None):
    """(text number, place, gram, sums): anchors of all windows of the texts [starts, ends) of ``data``.

    ``first`` and ``last`` limit the window starts, for texts that are cut into pieces.
    """
    n = len(data)
    sums = roll.sums(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), sums
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * roll.down[: n - GRAM + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 26) - 1)
    best = (grams & ~low) | places
    size = 1
    while 2 * size <= PLACES:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    rest = PLACES - size
    best = np.minimum(best[: len(best) - rest], best[rest:])
    # windows that lie in one text
    counts = np.maximum(0, ends - starts - LENGTH + 1)
    text = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    if first or last is not None:
        inside = (window >= first) & (window < (last if last is not None else n))
        text, window = text[inside], window[inside]
    at = (best[window] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    return text[new], at[new], grams[at[new]], sums


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place in the text, gram, context) for the texts of a column, a bounded piece at a time."""
    roll = roller()
    for a, b in slices(offsets, CHUNK):
        base, top = int(offsets[a]), int(offsets[b])
        if b - a > 1 or top - base <= 8 * CHUNK:
            pieces = [(base, top, 0, None)]
        else:  # one long text: window starts in steps, with the context around them and the last window of the step before
            pieces = [(max(base, x - PLACES), min(top, x + CHUNK + 2 * LENGTH), max(base, x - 1), x + CHUNK) for x in range(base, top, CHUNK)]
        for lo, hi, first, last in pieces:
            starts = np.maximum(offsets[a:b], lo) - lo
            ends = np.minimum(offsets[a + 1 : b + 1], hi) - lo
            text, at, gram, sums = chunk_anchors(data[lo:hi], starts, ends, roll, first - lo if last else 0, last - lo if last else None)
            if first > base and last:  # the step before has this anchor already
                text, at, gram = text[1:], at[1:], gram[1:]
            before = np.minimum(at - starts[text], PLACES - 1)
            behind = np.minimum(ends[text] - at, LENGTH)
            context = roll.hashes(sums, at - before, at + behind)
            context = mixed(context + before.astype(np.uint64) * np.uint64(1009) + behind.astype(np.uint64))
            yield text + a, at + lo - offsets[a + text], gram, context


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (gram, n), summed within a piece."""
    for batch in batches:
        for _, _, gram, _ in anchors(*column_bytes(batch.column(0))):
            one, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], names=["gram", "n"])


OCCURRENCES = "gram long, context long, h1 long, h2 long, doc_key long, place long"


def occurrence_batches(bits: np.ndarray):
    """Texts -> anchors whose gram may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, place, gram, context in anchors(*column_bytes(batch.column(0))):
                hit = may_hold(bits, gram)
                who = pa.array(text[hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[hit].view(np.int64)), pa.array(context[hit].view(np.int64)), *[batch.column(i).take(who) for i in (1, 2, 3)], pa.array(place[hit])],
                    names=["gram", "context", "h1", "h2", "doc_key", "place"],
                )

    return run


def run_batches(ranges: int):
    """(text, wanted: list of (place, gram, context, n)) -> sorted, front-coded runs, one for each range of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entry] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            by_range: dict[int, list[Entry]] = {}
            for e in held:
                by_range.setdefault(int.from_bytes(e[0][:8], "big") * ranges >> 64, []).append(e)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by_range), pa.int64()), pa.array([front_coded(v) for v in by_range.values()], pa.binary())], names=["range", "run"])

        for batch in batches:
            for text, wanted in zip(batch.column(0).cast(pa.large_binary()), batch.column(1)):
                text = text.as_py()
                for w in wanted.as_py():
                    p = w["place"]
                    gram = (w["gram"] & (2**64 - 1)).to_bytes(8, "big")
                    held.append((gram + text[p : p + LENGTH], text[max(0, p - PLACES + 1) : p], w["context"], w["n"]))
                if len(held) >= 4 * RANGE:
                    yield flush()
        if held:
            yield flush()

    return run


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges as few, sorted, disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def agreeing(group: list[tuple[int, Entry]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For the sorted contexts of one gram: context -> distances from window start to anchor at which another one has the same window.

    Contexts that occur often are covered already; they only bear witness.
    """
    if len(group) <= 6:
        found: list[list[tuple[int, int]]] = [[] for _ in group]
        for i, (_, a) in enumerate(group):
            shared = LENGTH + 8
            for j in range(i + 1, len(group)):
                shared = min(shared, group[j][0])
                b = group[j][1]
                low, high = max(0, LENGTH - (shared - 8)), min(PLACES - 1, common_suffix(a[1], b[1]))
                if low <= high:
                    found[i].append((low, high))
                    found[j].append((low, high))
    else:
        found = crowd(group)
    for (_, e), f in zip(group, found):
        if e[3] == 1 and f:
            yield e[2], joined(f)


def crowd(group: list[tuple[int, Entry]]) -> list[list[tuple[int, int]]]:
    """``agreeing`` for many contexts: the windows at every distance, equal if two independent 64-bit hashes are."""
    m, left = len(group), PLACES - 1
    text = np.zeros((m, left + LENGTH), dtype=np.uint8)
    before, behind = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, (_, (suffix, context, _, _)) in enumerate(group):
        before[i], behind[i] = len(context), len(suffix) - 8
        text[i, left - len(context) : left] = np.frombuffer(context, dtype=np.uint8)
        text[i, left : left + len(suffix) - 8] = np.frombuffer(suffix, dtype=np.uint8, offset=8)
    roll = roller()
    tables = []
    for value in (roll.value, roll.second):
        sums = np.zeros((m, text.shape[1] + 1), dtype=np.uint64)
        np.multiply(value[text], roll.up[: text.shape[1]], out=sums[:, 1:])
        tables.append(np.cumsum(sums, axis=1, out=sums))
    hit = np.zeros((m, PLACES), bool)
    for o in range(0, PLACES, AT_ONCE):
        distance = np.arange(o, min(PLACES, o + AT_ONCE))
        start = left - distance
        valid = (before[:, None] >= distance) & (behind[:, None] >= LENGTH - distance)
        windows = [sums[:, start + LENGTH] - sums[:, start] for sums in tables]
        # windows that do not lie in their text go to the end of their hash, so they never separate equal ones
        order = np.lexsort((~valid, windows[0]), axis=0)
        one, two, ok = (np.take_along_axis(x, order, axis=0) for x in (*windows, valid))
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & ok[1:] & ok[:-1]
        at, column = np.nonzero(same)
        hit[order[at, column], o + column] = True
        hit[order[at + 1, column], o + column] = True
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for (i, a), (_, b) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
        found[i].append((a, b - 1))
    return found


COVERED = "gram long, context long, low int, high int"


def covered_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["gram", "context", "low", "high"])


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by range -> (gram, context, low, high): distances from window start to anchor that are covered."""
    for runs in key_runs(batches, "range", least=1):
        rows: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, Entry]] = []

        def close() -> None:
            gram = int.from_bytes(group[0][1][0][:8], "big")
            gram -= (gram >> 63) << 64
            rows.extend((gram, context, a, b) for context, found in agreeing(group) for a, b in found)
            group.clear()

        for shared, entry in merged(runs["run"].to_pylist()):
            if group and shared < 8:
                close()
            group.append((shared, entry))
        if group:
            close()
        yield covered_rows(rows)


def window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) -> (gram, context, n, distance, w1, w2): every window of a context by two hashes."""
    for batch in batches:
        for text, wanted in zip(batch.column(0).cast(pa.large_binary()), batch.column(1)):
            text, rows = text.as_py(), []
            for w in wanted.as_py():
                p = w["place"]
                for o in range(max(0, LENGTH - (len(text) - p)), min(PLACES - 1, p) + 1):
                    digest = hashlib.blake2b(text[p - o : p - o + LENGTH], digest_size=16).digest()
                    rows.append((w["gram"], w["context"], w["n"], o, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 2))], names=["gram", "context", "n", "low", "w1", "w2"])


def range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single distances of a context -> their ranges."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
        yield covered_rows([(g, c, a, b) for g, c, lows in rows for a, b in joined([(x, x) for x in lows])])


def ask(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of every row that ``wanted`` names by (h1, h2, doc_key), with the list of its places."""
    lists = wanted.groupBy("h1", "h2", "doc_key").agg(F.collect_list(F.struct("place", "gram", "context", "n")).alias("wanted"))
    bits = filter_bits(lists.select("h1"), "h1")
    return texts.mapInArrow(lean(kept_by(bits)), texts.schema).join(lists, ["h1", "h2", "doc_key"]).select("text", "wanted")


def kept_by(bits: np.ndarray, inside: bool = True):
    """Rows whose h1 may be in the set, or surely is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_hold(bits, batch.column(1).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return run


def repeated_ranges(docs: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): texts (text, h1, h2, doc_key) and, by (h1, h2), the list of (start, end) byte ranges to remove.

    Texts are known by two 64-bit hashes, so exact copies are worked on once and share their ranges.
    """
    texts = whole_texts(docs).select("text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), id_key(F.col("doc_id")).alias("doc_key"))
    repeated = materialize(texts.select("text").mapInArrow(lean(gram_batches), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "suffix-grams")
    bits = filter_bits(repeated, "gram")
    places = materialize(texts.mapInArrow(lean(occurrence_batches(bits)), OCCURRENCES), "suffix-places")

    first = F.min(F.struct("h1", "h2", "doc_key", "place")).alias("first")
    contexts = materialize(places.groupBy("gram", "context").agg(F.count("*").alias("n"), first), "suffix-contexts")
    grams = contexts.groupBy("gram").agg(F.count("*").alias("k"), F.min("n").alias("rarest")).where("k > 1 and rarest = 1").select("gram", (F.col("k") > large).alias("crowded"))
    wanted = materialize(contexts.join(grams, "gram").select("gram", "context", "n", "first.*", "crowded"), "suffix-wanted")
    counts = {r["crowded"]: r["count"] for r in wanted.groupBy("crowded").count().collect()}

    # contexts seen twice are covered at every distance
    covered = contexts.where("n > 1").select("gram", "context", F.lit(0).alias("low"), F.lit(PLACES - 1).alias("high"))
    if counts.get(False):
        runs = ask(texts, wanted.where("not crowded").drop("crowded")).mapInArrow(lean(run_batches(counts[False] // RANGE + 1)), "range long, run binary")
        covered = covered.union(runs.repartition("range").sortWithinPartitions("range").mapInArrow(lean(merge_batches), COVERED))
    if counts.get(True):
        windows = materialize(ask(texts, wanted.where("crowded").drop("crowded")).mapInArrow(lean(window_batches), "gram long, context long, n long, low int, w1 long, w2 long"), "suffix-windows")
        twice = windows.groupBy("gram", "low", "w1", "w2").agg(F.sum("n").alias("total")).where("total > 1")
        hits = windows.where("n = 1").join(twice, ["gram", "low", "w1", "w2"]).groupBy("gram", "context").agg(F.collect_set("low").alias("lows"))
        covered = covered.union(hits.mapInArrow(lean(range_batches), COVERED))
    # written, so that a join with a context that many texts hold can be split
    covered = materialize(covered.groupBy("gram", "context").agg(F.collect_list(F.struct("low", "high")).alias("found")), "suffix-covered")

    spots = places.select("gram", "context", "h1", "h2", "place").join(covered, ["gram", "context"]).select("h1", "h2", "place", F.explode("found").alias("f"))
    ranges = spots.groupBy("h1", "h2").agg(F.collect_set(F.struct("place", F.col("f.low").alias("low"), F.col("f.high").alias("high"))).alias("found"))
    return texts, materialize(ranges, "suffix-ranges")


def removed_ranges(n: int, found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges [start, end) of a text of ``n`` bytes covered by windows at the found anchors."""
    out: list[tuple[int, int]] = []
    for f in found or ():
        p = f["place"]
        low, high = max(f["low"], LENGTH - (n - p), 0), min(f["high"], p)
        if low <= high:
            out.append((p - high, p - low + LENGTH - 1))
    return [(a, b + 1) for a, b in joined(out)]


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, text, found) -> the digest of what is left."""
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
            text = text.as_py()
            spans = removed_ranges(len(text), found.as_py())
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(text, spans)).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=["doc_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def suffix_report(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null and empty texts, and texts below 200 bytes, lose nothing. Repeated rows are copies: both lose what they share.
    Texts without a repeated string need no exchange; the others meet their ranges by hash.
    """
    texts, ranges = repeated_ranges(docs, large)
    bits = filter_bits(ranges.select("h1"), "h1")
    report = "doc_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    calm = texts.mapInArrow(lean(kept_by(bits, inside=False)), texts.schema).select("doc_key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    busy = texts.mapInArrow(lean(kept_by(bits)), texts.schema).join(ranges, ["h1", "h2"], "left").select("doc_key", "text", "found").mapInArrow(lean(cut_batches), report)
    return calm.union(busy).withColumn("doc_id", null_again(F.col("doc_key"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def shorten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, found) as the first two columns -> the text that is left, then the other columns."""
    for batch in batches:
        left = []
        for text, found in zip(batch.column(0), batch.column(1)):
            raw = text.as_py()
            if raw is not None and found.is_valid:
                raw = raw.encode()
                raw = without(raw, removed_ranges(len(raw), found.as_py())).decode("utf-8", errors="ignore")
            left.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), *batch.columns[2:]], names=["__clean", *batch.schema.names[2:]])


def drop_repeats(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", large: int = LARGE) -> DataFrame:
    """The same rows and columns with repeated strings cut out of the texts; a character cut in two goes.

    A changed text gets its new length; a null text stays null.
    """
    _, ranges = repeated_ranges(docs.select("doc_id", F.col(f"`{text_col}`").alias("text")), large)
    whole = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{text_col}`").alias("__text"), F.xxhash64(whole).alias("__h1"), F.xxhash64(whole, F.lit(1)).alias("__h2"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    found = ranges.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("found").alias("__found"))
    rest = [c for c in docs.columns if c != text_col]
    out = own.join(found, ["__h1", "__h2"], "left").select("__text", "__found", *[F.col(f"`{c}`") for c in rest], F.col("__found").isNotNull().alias("__cut"))
    fields = [StructField("__clean", StringType()), *[docs.schema[c] for c in rest], StructField("__cut", BooleanType())]
    cut = out.mapInArrow(lean(shorten_batches), StructType(fields))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("__clean").alias(text_col))
        elif c == length_col:
            columns.append(F.when(F.col("__cut"), F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return cut.select(*columns)
