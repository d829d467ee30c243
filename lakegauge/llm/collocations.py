"""Phrase collocations: word suffixes cut at four words, dealt to groups by prefixes that fit a memory budget, counted as subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.session import materialize

#: Words of a phrase at most, occurrences of a candidate at least, share (in percent) at which a longer candidate takes a shorter
#: one's place, phrases returned for each language.
DEPTH, LEAST, COVERS, TOP = 4, 30, 80, 2000
#: Suffixes that one group may hold; a prefix with more is extended by a word.
BUDGET = 1_000_000
#: Words with ``LEAST`` occurrences that are numbered and sent to every task; beyond it, words go by 64-bit hashes.
DICTIONARY_LIMIT = 4_000_000
#: Bytes of text worked on at a time; cut between pieces only.
BLOCK = 1 << 22

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANG = "und"


class Words:
    """The words of a block of texts: ``inverse`` points from each word in order to its (language, word), ``piece`` tells pieces apart."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, lang: np.ndarray):
        kinds = np.zeros(256, dtype=np.uint8)
        kinds[list(BLANKS)], kinds[list(BREAKS)] = 1, 2
        kind = kinds[data]
        word = kind == 0
        edge = np.empty(len(data), dtype=bool)
        edge[:1], edge[1:] = True, doc[1:] != doc[:-1]
        before = np.empty(len(data), dtype=bool)
        before[:1], before[1:] = False, word[:-1]
        starts = np.flatnonzero(word & (~before | edge))
        after = np.empty(len(data), dtype=bool)
        after[-1:], after[:-1] = True, ~word[1:] | edge[1:]
        ends = np.flatnonzero(word & after) + 1
        place = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=place[1:])
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + doc[starts]
        lower = data[word]
        lower = np.where((lower >= 65) & (lower <= 90), lower + 32, lower).astype(np.uint8)
        texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(lower)]).dictionary_encode()
        pairs = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (int(lang.max(initial=0)) + 1) + lang[doc[starts]]
        found, self.inverse, self.counts = np.unique(pairs, return_inverse=True, return_counts=True)
        self.lang = found % (int(lang.max(initial=0)) + 1)
        self.texts = texts.dictionary.take(pa.array(found // (int(lang.max(initial=0)) + 1)))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """(lang, text) -> words of about ``BLOCK`` bytes of text at a time, with the names of their languages."""
    breaks = np.zeros(256, dtype=bool)
    breaks[list(BREAKS)] = True
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        column = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        start = 0
        while start < len(data):
            end = min(start + BLOCK, len(data))
            while end < len(data):  # go on to the next end of a piece
                nxt = offsets[np.searchsorted(offsets, end)]
                hits = np.flatnonzero(breaks[data[end : min(end + 65536, nxt)]])
                if len(hits) or nxt <= end + 65536:
                    end = end + int(hits[0]) + 1 if len(hits) else int(nxt)
                    break
                end += 65536
            end = min(end, len(data))
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.clip(offsets, start, end)))
            yield Words(data[start:end], doc, lang), names
            start = end


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, names in blocks(batches):
        lang = pa.array([names[i] for i in words.lang], pa.string())
        yield pa.RecordBatch.from_arrays([lang, words.texts.cast(pa.string()), pa.array(words.counts)], names=["lang", "word", "n"])


def mixed(*words: np.ndarray) -> np.ndarray:
    """A 64-bit name of a prefix; two prefixes of one name are only both extended."""
    out = words[0].astype(np.uint64)
    for w in words[1:]:
        out = (out * np.uint64(0x9E3779B97F4A7C15) ^ (out >> np.uint64(31))) + w.astype(np.uint64)
    return out.view(np.int64)


def hashed(lang: str, word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 7) >> 1 or 1


class Suffixes:
    """Task functions over (lang, text): suffix counts of each block by the words' numbers."""

    def __init__(self, dictionary: pa.Table | None):
        self.dictionary = dictionary

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Distinct suffixes of two words and more of a block, sorted, as four columns of numbers (0: ended), and their counts.

        Rare words end a suffix: no candidate holds one.
        """
        number: dict[tuple[str, bytes], int] = {}
        if self.dictionary is not None:
            d = self.dictionary
            number = dict(zip(zip(d["lang"].to_pylist(), d["word"].cast(pa.binary()).to_pylist()), d["id"].to_pylist()))
        for words, names in blocks(batches):
            keys = zip((names[i] for i in words.lang), words.texts.to_pylist())
            ids = np.fromiter((number.get(k, 0) for k in keys) if self.dictionary is not None else (hashed(*k) for k in keys), dtype=np.int64, count=len(words.texts))
            w = [ids[words.inverse]]
            for k in range(1, DEPTH):
                nxt = np.zeros(len(w[0]), dtype=np.int64)
                same = words.piece[k:] == words.piece[:-k] if k < len(w[0]) else np.zeros(0, bool)
                nxt[: len(same)] = np.where(same, w[0][k:], 0)
                w.append(np.where(w[-1] > 0, nxt, 0))
            keep = (w[0] > 0) & (w[1] > 0)
            w = [x[keep] for x in w]
            if not len(w[0]):
                continue
            if self.dictionary is not None:  # numbers below 2^31: two words in one sort key
                order = np.lexsort((w[2] << 32 | w[3], w[0] << 32 | w[1]))
            else:
                order = np.lexsort(w[::-1])
            w = [x[order] for x in w]
            first = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in w])])
            yield [x[first] for x in w], np.diff(np.r_[first, len(w[0])])

    def prefix_counts(self, heavy: list[np.ndarray]):
        """Task function: counts of the prefixes one word longer than those in the last of ``heavy``."""
        k = len(heavy)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, n in self.rows(batches):
                held = np.isin(mixed(*w[:k]), heavy[-1])
                cols = [x[held] for x in w[: k + 1]]
                if not held.any():
                    continue
                first = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in cols])])
                out = [x[first] for x in cols] + [np.zeros(len(first), dtype=np.int64)] * (DEPTH - k - 1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.add.reduceat(n[held], first))], names=[*WORDS, "n"])

        return run

    def grouped(self, heavy: list[np.ndarray]):
        """Task function: all suffixes with the number of words of the prefix that names their group."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, n in self.rows(batches):
                size = np.ones(len(n), dtype=np.int32)
                for k, names in enumerate(heavy, 1):
                    size[(size == k) & np.isin(mixed(*w[:k]), names)] = k + 1
                yield pa.RecordBatch.from_arrays([*map(pa.array, w), pa.array(size), pa.array(n)], names=[*WORDS, "size", "n"])

        return run


WORDS = ["w1", "w2", "w3", "w4"]
NODES = "w1 long, w2 long, w3 long, w4 long, n long"


def subtree_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves of a group's subtrees -> the inner nodes and leaves of two words and more with the totals of their leaves.

    Nodes below the threshold go, but for those that a batch or group may hold only in part (at a batch's ends, or above the
    group's prefix): their parts are added up afterwards.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        w = [batch.column(i).to_numpy() for i in range(DEPTH)]
        size, n = batch.column(DEPTH).to_numpy(), batch.column(DEPTH + 1).to_numpy()
        change = np.zeros(len(n) - 1, dtype=bool)
        out: list[list[np.ndarray]] = []
        for depth in range(1, DEPTH + 1):
            change = change | (w[depth - 1][1:] != w[depth - 1][:-1])
            first = np.flatnonzero(np.r_[True, change])
            total = np.add.reduceat(n, first)
            keep = (total >= LEAST) | (size[first] > depth)
            keep[[0, -1]] = True
            keep &= w[depth - 1][first] > 0
            if depth > 1:
                at = first[keep]
                out.append([*[w[i][at] if i < depth else np.zeros(len(at), dtype=np.int64) for i in range(DEPTH)], total[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=[*WORDS, "n"])


def phrase_key(words: list[Column]) -> list[Column]:
    return [*words, *[F.lit(0).cast("long")] * (DEPTH - len(words))]


def candidates(texts: DataFrame, dictionary: pa.Table | None, common: list[int], budget: int) -> DataFrame:
    """(w1, w2, w3, w4, n) of all phrases of 2 to 4 words with ``LEAST`` occurrences; ``common`` are words beyond the budget."""
    suffixes, total_rows = Suffixes(dictionary), F.sum("n").cast("long")
    heavy = [mixed(np.array(common, dtype=np.int64))] if common else []
    while heavy and len(heavy) < DEPTH:
        k = len(heavy)
        longer = texts.mapInArrow(suffixes.prefix_counts(heavy), NODES).groupBy(*WORDS[: k + 1]).agg(total_rows.alias("n")).where(F.col("n") > budget)
        found = longer.toArrow()  # at most all occurrences / budget rows
        if not found.num_rows:
            break
        heavy.append(mixed(*[found[c].to_numpy() for c in WORDS[: k + 1]]))
    rows = materialize(texts.mapInArrow(suffixes.grouped(heavy), "w1 long, w2 long, w3 long, w4 long, size int, n long"), "collocation-suffixes")
    prefix = [F.when(F.col("size") > k, F.col(c)) if k else F.col(c) for k, c in enumerate(WORDS)]
    groups = max(1, -(-2 * rows.count() // budget))
    subtrees = rows.repartition(groups, *prefix).sortWithinPartitions(*WORDS)
    nodes = subtrees.mapInArrow(subtree_nodes, NODES)
    return materialize(nodes.groupBy(*WORDS).agg(total_rows.alias("n")).where(F.col("n") >= LEAST), "collocation-candidates")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET, dictionary_limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of every language.

    A null language counts as "und"; null and empty texts hold no words, texts of any length count whole, and repeated rows count
    each. Cuts of equal score go to the shorter first part, phrases of equal score and count to the smaller phrase. An empty table
    gives an empty result. Suffixes ahead of a prefix with more than ``budget`` occurrences are split by one word more, so that no
    group holds a frequent word whole; equal suffixes are one row a block before they are exchanged.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counts = materialize(texts.mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").cast("long").alias("n")), "collocation-words")
    sizes = counts.groupBy("lang").agg(F.sum("n").cast("long").alias("total"))
    frequent = counts.where(F.col("n") >= LEAST)
    if frequent.count() <= dictionary_limit:
        held = frequent.toArrow()
        dictionary = held.append_column("id", pa.array(np.arange(1, held.num_rows + 1)))
        numbered = materialize(docs.sparkSession.createDataFrame(dictionary), "collocation-names")
    else:
        dictionary = None
        names = frequent.select("lang", "word", "n").mapInArrow(named, "lang string, word string, n long, id long")
        numbered = materialize(names, "collocation-names")
        if not numbered.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("two words share a 64-bit hash")
    common = [r.id for r in numbered.where(F.col("n") > budget).select("id").collect()]
    found = candidates(texts, dictionary, common, budget)

    # occurrences of every part of a candidate; parts are words or candidates themselves
    words = [F.col(c) for c in WORDS]
    size = sum((F.col(c) > 0).cast("int") for c in WORDS)
    known = found.union(numbered.select(*phrase_key([F.col("id")]), "n"))
    known = known.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(WORDS)], F.col("n").alias("f"))
    cuts = [F.struct(F.lit(k).alias("k"), F.array(*phrase_key(words[:k])).alias("head"), F.array(*(words[k:] + phrase_key([])[:k])).alias("tail")) for k in range(1, DEPTH)]
    cut = found.withColumn("size", size).withColumn("cut", F.explode(F.slice(F.array(*cuts), F.lit(1), F.col("size") - 1)))

    def counted(df: DataFrame, part: str, name: str) -> DataFrame:
        on = [F.col(f"cut.{part}")[i] == F.col(f"k{i}") for i in range(DEPTH)]
        return df.join(known, on).drop(*[f"k{i}" for i in range(DEPTH)]).withColumnRenamed("f", name)

    scored = counted(counted(cut, "head", "l"), "tail", "r")
    score = F.expr(f"cast(n as decimal(38,0)) * {2_000_000} div (cast(l as decimal(38,0)) + r)")
    best = F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r"))
    scored = scored.groupBy(*WORDS, "n", "size").agg(best.alias("best"))

    # a phrase inside a longer candidate that is nearly as frequent goes
    inner = [(i, j) for i in range(DEPTH - 1) for j in range(i + 2, DEPTH + 1) if j - i < DEPTH]
    parts = [F.when(F.col("size") >= (j if i else j + 1), F.array(*phrase_key(words[i:j]))) for i, j in inner]
    inside = found.withColumn("size", size).where("size > 2").select("n", F.explode(F.array_compact(F.array(*parts))).alias("part")).groupBy("part").agg(F.max("n").alias("longest"))
    inside = inside.select(*[F.col("part")[i].alias(f"k{i}") for i in range(DEPTH)], "longest")
    left = scored.join(inside, [F.col(c) == F.col(f"k{i}") for i, c in enumerate(WORDS)], "left")
    left = left.where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("n") * COVERS))

    named_rows = left.select(*WORDS, F.col("n").alias("a"), "best")
    for c in WORDS:
        of = numbered.select(F.col("id").alias(c), F.col("word").alias(f"t{c}"), *([F.col("lang")] if c == "w1" else []))
        named_rows = named_rows.join(of, c, "left")
    named_rows = named_rows.select("lang", F.concat_ws(" ", *[f"t{c}" for c in WORDS]).alias("phrase"), "a", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = named_rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    top = some.where(F.col("place") <= TOP).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [hashed(a, b.encode()) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=["lang", "word", "n", "id"])


#: The same in SQL.
ORACLE_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {DEPTH + 1})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, phrase, f, unnest(range(1, k)) AS c, p FROM cand),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, c, x.f AS l, y.f AS r, ((2000000::HUGEINT * cuts.f) // (x.f + y.f))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(p[1:c], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(p[c + 1 :], ' ')),
best AS (SELECT lang, phrase, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(p[i : i + m - 1], ' ') AS phrase, max(f) AS longest FROM cand, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {COVERS} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
