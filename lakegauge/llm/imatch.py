"""Document fingerprints by I-Match: the terms of a middle band of document frequency, hashed for many random lexicon subsets.

Only DataFrame and SQL functions. A text and its successor meet in ranges of the ids that are cut by size; all later steps
(terms, lexicon, subsets, successor's fingerprint) stay in those ranges, so whole texts are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.session import materialize

from .common import id_key, null_again, whole_texts

#: Band of the lexicon: terms in at least one document of ``RARE`` and at most one of ``COMMON``. The lower end bounds the
#: lexicon by ``RARE`` times the mean number of distinct terms of a document, however many documents there are.
RARE, COMMON = 1000, 5
#: Texts with fewer distinct terms keep all of them.
SHORT = 32
#: Chains of nested random subsets of the lexicon; level j of a chain keeps a term with probability 1/2^(j+1).
CHAINS, LEVELS = 12, 12
#: Arithmetic of the subsets: a term is a number below 2^32, dealt out for chain r by (number * MULTIPLIERS[r]) mod PRIME.
PRIME = 2**31 - 1
MULTIPLIERS = [1 + (r + 1) * 178_956_970 % PRIME for r in range(CHAINS)]
#: A lexicon of more terms is joined without a broadcast.
LEXICON_LIMIT = 4_000_000
#: Characters of text in a range; at most so many ranges, which then grow and spill.
RANGE_CHARS, MOST_RANGES = 8_000_000, 8192

GAPS = r"[\x20\x09-\x0D.,;:!?]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text: in lower case, cut at blanks and sentence signs."""
    return F.array_distinct(F.filter(F.split(F.lower(text), GAPS), lambda t: t != ""))


def number(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")


def lexicon(rows: DataFrame) -> DataFrame:
    """(term, number) of the terms in the band; every document counts once for each of its terms."""
    total = rows.count()
    counts = rows.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    kept = counts.where((F.col("count") * RARE >= total) & (F.col("count") * COMMON <= total))
    return materialize(kept.select("term", number(F.col("term")).alias("number")), "imatch-lexicon")


def cut_points(rows: DataFrame) -> list[tuple[int, int]]:
    """The smallest (doc_id, h) of each range of about ``RANGE_CHARS`` characters; of the keys only these reach the driver."""
    keys = rows.select("doc_id", "h", F.length("text").alias("n"))
    ranges = min(MOST_RANGES, 1 + (keys.agg(F.sum("n")).first()[0] or 0) // RANGE_CHARS)
    least = keys.repartitionByRange(int(ranges), "doc_id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("key"))
    return sorted((r.key.doc_id, r.key.h) for r in least.select("key").collect())


def in_range(cuts: list[tuple[int, int]]) -> Column:
    """The range of a key, by halving."""

    def place(low: int, high: int) -> str:
        if high - low == 1:
            return str(low)
        mid = (low + high) // 2
        i, h = cuts[mid]
        return f"IF(doc_id < {literal(i)} OR (doc_id = {literal(i)} AND h < {literal(h)}), {place(low, mid)}, {place(mid, high)})"

    return F.expr(place(0, len(cuts)))


def literal(x: int) -> str:
    return f"CAST('{x}' AS BIGINT)"


def with_next(rows: DataFrame) -> DataFrame:
    """Every row with the text of the next one by (doc_id, h), the last with the first's.

    The first row of a range also goes to the end of the range before (``donor``), so no range has to look into another.
    """
    cuts = cut_points(rows)
    if not cuts:
        return rows.select("*", F.lit(0).alias("range"), F.lit(0).alias("donor"), F.col("text").alias("next"))
    first = F.expr("(doc_id, h) IN (" + ", ".join(f"({literal(i)}, {literal(h)})" for i, h in cuts) + ")")
    own = F.struct(F.col("range"), F.lit(0).alias("donor"))
    copy = F.struct(F.pmod(F.col("range") - 1, F.lit(len(cuts))).alias("range"), F.lit(1).alias("donor"))
    placed = rows.withColumn("range", in_range(cuts)).withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("range").orderBy("donor", "doc_id", "h")
    return placed.select("doc_id", "h", "text", "copies", "to.range", "to.donor").withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))


def folded(numbers: Column) -> Column:
    """A number from 1 to 65535 for a list in order, 0 for an empty one."""
    total = F.aggregate(numbers, F.lit(7).cast("long"), lambda a, x: (a * 1_000_003 + x) % PRIME)
    return F.when(F.size(numbers) > 0, (total % 65_535 + 1)).otherwise(F.lit(0)).cast("long")


def prints(numbers: Column) -> Column:
    """The hash of all numbers, then for each chain the hashes of its levels, sparser and sparser."""

    def chain(multiplier: Column) -> Column:
        first = F.filter(numbers, lambda t: t * multiplier % PRIME % 4 == 0)
        start = F.struct(F.transform(first, lambda t: t * multiplier % PRIME).alias("left"), F.array().cast("array<bigint>").alias("found"))

        def step(a: Column, size: Column) -> Column:
            return F.struct(F.filter(a["left"], lambda x: x % size == 0).alias("left"), F.concat(a["found"], F.array(folded(a["left"]))).alias("found"))

        sizes = F.array(*[F.lit(2**j).cast("long") for j in range(3, LEVELS + 3)])
        return F.aggregate(sizes, start, step, lambda a: a["found"])

    multipliers = F.array(*[F.lit(m).cast("long") for m in MULTIPLIERS])
    return F.struct(folded(numbers).alias("whole"), F.transform(multipliers, chain).alias("chains"))


def spelled(p: Column) -> Column:
    """A fingerprint as hex digits, four for each subset."""
    digits = lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))
    return F.concat(digits(p["whole"]), F.array_join(F.transform(F.flatten(p["chains"]), digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of chains whose sparsest subset that still holds a term of either text has the same hash for both."""
    filled = lambda c: F.size(F.filter(c, lambda x: x > 0))

    def agrees(x: Column, y: Column) -> Column:
        last = filled(x)
        same = F.when(last == 0, a["whole"] == b["whole"]).otherwise(F.get(x, last - 1) == F.get(y, last - 1))
        return F.when((last == filled(y)) & same, 1).otherwise(0)

    return F.aggregate(F.zip_with(a["chains"], b["chains"], agrees), F.lit(0), lambda n, k: n + k) / F.lit(float(CHAINS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the own one with its second half replaced by the start of the next document's text, which for the last
    document is the first's. Null texts are empty; rows without an id come first; rows of one id follow each other by a hash of
    their texts, equal rows are one until the end. A text whose terms all lie outside the band is known by the hash of all of
    them, an empty one by zero. Texts of any length are taken whole. An empty table gives an empty result.
    """
    rows = whole_texts(docs, id_col, text_col).select(id_key(F.col("doc_id")).alias("doc_id"), "text")
    lex = lexicon(rows)
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    pairs = with_next(rows.withColumn("h", F.xxhash64("text")))
    # equal rows follow each other: all but the last have their own text next, so each distinct row appears twice
    pairs = pairs.withColumn("turn", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    half = F.floor(F.length("text") / 2).cast("int")
    nxt = F.when(F.col("turn") == 1, F.col("text")).otherwise(F.col("next"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(nxt, F.lit(1), half))
    pairs = pairs.withColumn("edited", F.when(F.col("donor") == 1, F.lit("")).otherwise(edited))
    pairs = pairs.withColumns({"own": terms(F.col("text")), "other": terms(F.col("edited"))})

    # what the row needs of its texts is worked out before its terms become rows
    whole = lambda c: F.array(number(F.array_join(F.sort_array(c), " ")))
    tagged = lambda c, bit: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(bit).alias("side")))
    carried = {
        "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256), "own_all": whole("own"), "other_all": whole("other"),
        "n_own": F.size("own"), "n_other": F.size("other"), "tagged": F.concat(tagged(F.col("own"), 0), tagged(F.col("other"), 1)),
    }
    key = ["range", "donor", "doc_id", "h", "turn"]
    ready = pairs.select(*key, "copies", *[e.alias(c) for c, e in carried.items()])
    spread = ready.select(*[c for c in ready.columns if c != "tagged"], F.explode_outer("tagged").alias("t"))
    found = spread.withColumn("term", F.col("t.term")).join(F.broadcast(lex) if lex.count() <= LEXICON_LIMIT else lex, "term", "left")
    kept = F.coalesce(F.col("number"), F.when(F.when(F.col("t.side") == 0, F.col("n_own")).otherwise(F.col("n_other")) < SHORT, number(F.col("term"))))
    side = lambda bit: F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("t.side") == bit, kept))))
    lists = found.groupBy(*key).agg(side(0).alias("own"), side(1).alias("other"), *[F.first(c).alias(c) for c in ready.columns if c not in (*key, "tagged")])
    chosen = lambda c, every, n: F.when((F.size(c) == 0) & (F.col(n) > 0), F.col(every)).otherwise(F.col(c))
    lists = lists.withColumns({"own": chosen("own", "own_all", "n_own"), "other": chosen("other", "other_all", "n_other")})
    marks = lists.select(*key, "copies", "n_chars", "edited_sha256", prints(F.col("own")).alias("p"), prints(F.col("other")).alias("q"))

    # the last copy of a row (turn 0) is followed by the next document, the copies before it (turn 1) by itself
    order = Window.partitionBy("range").orderBy("donor", "doc_id", "h", F.desc("turn"))
    marks = marks.withColumn("r", F.when(F.col("turn") == 1, F.col("p")).otherwise(F.lead("p").over(order))).where("donor = 0")
    out = marks.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("turn") == 1, F.col("copies") - 1).otherwise(F.lit(1).cast("long")))))
    return out.select(
        null_again(F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", spelled(F.col("p")).alias("fingerprint"), spelled(F.col("q")).alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("q")).alias("near_edited"), likeness(F.col("p"), F.col("r")).alias("near_next"),
    )


#: The same in SQL. Lists per text, an unnested row per chain and level.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS "text" FROM documents),
n AS (SELECT doc_id, "text", coalesce(lead("text") OVER w, first_value("text") OVER w) AS nxt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left("text", length("text") - length("text") // 2) || left(nxt, length("text") // 2) AS edited FROM n),
texts AS (SELECT doc_id, 0 AS side, "text" AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
words AS (SELECT doc_id, side, list_distinct(list_filter(string_split_regex(lower(t), '{GAPS}'), lambda x: x <> '')) AS w FROM texts),
counts AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM words WHERE side = 0) GROUP BY 1),
lex AS (SELECT term FROM counts WHERE df * {RARE} >= (SELECT count(*) FROM d) AND df * {COMMON} <= (SELECT count(*) FROM d)),
kept AS (SELECT doc_id, side, list_sort(list(DISTINCT ('0x' || substr(md5(x.term), 1, 8))::BIGINT)) AS nums
  FROM (SELECT doc_id, side, len(w) AS k, unnest(w) AS term FROM words) x WHERE k < {SHORT} OR term IN (SELECT term FROM lex) GROUP BY ALL),
lists AS (SELECT doc_id, side, CASE WHEN nums IS NULL AND len(w) > 0 THEN [('0x' || substr(md5(array_to_string(list_sort(w), ' ')), 1, 8))::BIGINT] ELSE coalesce(nums, []) END AS nums
  FROM words LEFT JOIN kept USING (doc_id, side)),
subsets AS (SELECT doc_id, side, 0 AS r, 0 AS k, nums AS l FROM lists UNION ALL
  SELECT doc_id, side, m.r, z.k, list_filter(list_transform(nums, lambda x: x * m.m % {PRIME}), lambda x: x % (1 << (z.k + 1)) = 0)
  FROM lists, (SELECT unnest({list(range(1, CHAINS + 1))}) AS r, unnest({MULTIPLIERS}) AS m) m, (SELECT unnest(range(1, {LEVELS + 1})) AS k) z),
marks AS (SELECT doc_id, side, r, k, CASE WHEN len(l) = 0 THEN 0 ELSE list_reduce(list_prepend(7::BIGINT, l), lambda a, x: (a * 1000003 + x) % {PRIME}) % 65535 + 1 END AS h FROM subsets),
prints AS (SELECT doc_id, side, string_agg(printf('%04x', h), '' ORDER BY r, k) AS fingerprint, max(h) FILTER (r = 0) AS whole FROM marks GROUP BY ALL),
last AS (SELECT doc_id, side, r, max(k) FILTER (h > 0) AS deepest, arg_max(h, k) FILTER (h > 0) AS h FROM marks WHERE r > 0 GROUP BY ALL),
likes AS (SELECT p.doc_id, q.doc_id AS other, q.side, sum(CASE WHEN a.deepest IS DISTINCT FROM b.deepest THEN 0 WHEN a.deepest IS NULL THEN (p.whole = q.whole)::INT ELSE (a.h = b.h)::INT END) / {CHAINS}.0::DOUBLE AS near
  FROM e JOIN prints p ON p.doc_id = e.doc_id AND p.side = 0 JOIN prints q ON (q.doc_id = e.doc_id AND q.side = 1) OR (q.doc_id = e.next_id AND q.side = 0)
  JOIN last a ON a.doc_id = p.doc_id AND a.side = 0 JOIN last b ON b.doc_id = q.doc_id AND b.side = q.side AND b.r = a.r GROUP BY ALL)
SELECT e.doc_id, length("text")::BIGINT AS n_chars, sha256(edited) AS edited_sha256, p.fingerprint, q.fingerprint AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM e JOIN prints p ON p.doc_id = e.doc_id AND p.side = 0 JOIN prints q ON q.doc_id = e.doc_id AND q.side = 1
JOIN likes x ON x.doc_id = e.doc_id AND x.side = 1 JOIN likes y ON y.doc_id = e.doc_id AND y.side = 0
"""
