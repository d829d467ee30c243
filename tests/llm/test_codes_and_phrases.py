"""Collocations, vector codes and fingerprints against plain versions; awkward rows, hot keys, empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents, nothing, order

from lakegauge.llm import collocations as co, imatch, product_codes as pc

# ---- collocations -----------------------------------------------------------------------------------------


def plain_collocations(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < 30:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= 30 and 100 * b >= 80 * a and inside(q) for q, b in c.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:2000], 1)]
    return sorted(out)


def frequent_texts():
    rng = random.Random(3)
    words = ["the", "of", "Ünd", "new", "york", "city", "x", "日本"]
    rows = [(("en", "de", None)[i % 3], " ".join(rng.choices(words, [9, 6, 3, 2, 2, 2, 1, 1], k=60)) + rng.choice(". \n,!")) for i in range(120)]
    rows += [("en", "New York City is big; NEW york city, new york.")] * 40
    return rows + [("en", None), (None, None), ("fr", ""), ("fr", " .,; \t"), ("en", "the the the " * 3000), ("de", "a b c d e f " * 40 + "\n" + "rare word")]


@pytest.mark.parametrize(("budget", "limit"), [(1_000_000, 1_000_000), (200, 1_000_000), (200, 0)])
def test_collocations_equal_plain_counts(spark, monkeypatch, budget, limit):
    monkeypatch.setattr(co, "BLOCK", 5000)
    rows = frequent_texts()
    docs = spark.createDataFrame([(a, b, 1, "w") for a, b in rows], "lang string, text string, n long, w1 string").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(docs, budget=budget, dictionary_limit=limit).collect())
    assert got == plain_collocations(rows) and len(got) > 50


def test_collocations_of_awkward_and_empty_tables(spark):
    docs = documents(spark)
    assert sorted(tuple(r) for r in co.collocations(docs).collect()) == plain_collocations([(r.lang, r.text) for r in docs.collect()])
    assert co.collocations(nothing(spark)).collect() == []


def test_blocks_cut_at_pieces_only():
    import pyarrow as pa

    text = "one two three four five, six seven. " * 50
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "x" * 9000 + " y"])], names=["lang", "text"])
    old, co.BLOCK = co.BLOCK, 17
    try:
        words = [(w.texts[i].as_py(), p) for w, _ in co.blocks(iter([batch])) for i, p in zip(w.inverse, w.piece)]
    finally:
        co.BLOCK = old
    assert [w.decode() for w, _ in words] == re.findall("[a-z]+", text + " " + "x" * 9000 + " y")


# ---- vector codes -----------------------------------------------------------------------------------------


def plain_codes(rows):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [[int(np.floor(256 * x)) for x in r[1]] for r in kept]
    w = len(ints[0]) // 16
    parts = [[v[p * w : (p + 1) * w] for p in range(16)] for v in ints]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:64]
    books = [[list(parts[i][p]) for i in first] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(b)), key=lambda e: (dist(v[p], b[e]), e)) for p, b in enumerate(books)] for v in parts]
    for _ in range(2):
        got = near()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [parts[i][p] for i in range(len(parts)) if got[i][p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = near()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(dist(parts[i][p], books[p][got[i][p]]) for p in range(16)) for i in range(len(parts))]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{e:02x}" for e in g), e, by_label[r[2]], digest) for r, g, e in zip(kept, got, errors)]


def test_codes_equal_plain_search(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=32) * (0.02 if i % 3 else 1))], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows += [rows[5], (7, rows[9][1], 2), (None, rows[3][1], None), (900, None, 1), (901, [1.0, None] * 16, 1), (902, [float("nan")] * 32, None), (903, [float("inf")] * 32, 2), (904, [], 1), (905, [0.0] * 32, 3), (906, [0.0] * 32, None)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, code string, n long").repartition(3)
    assert order(pc.product_codes(df).collect()) == order(plain_codes(rows))
    assert pc.product_codes(df.limit(0)).collect() == []
    few = df.where("vec_id < 5")
    assert order(pc.product_codes(few).collect()) == order(plain_codes([r for r in rows if r[0] is not None and r[0] < 5]))


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(6)
    for width in (1, 4, 9):
        entries = rng.integers(-3, 4, (64, width))
        x = rng.integers(-5, 6, (500, width))
        index, distance = pc.Codebook(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


# ---- fingerprints -----------------------------------------------------------------------------------------


def plain_terms(text):
    return {t for t in re.split("[\x20\x09-\x0d.,;:!?]+", text.lower()) if t}


def number(t):
    return int(hashlib.md5(t.encode()).hexdigest()[:8], 16)


def folded(xs):
    h = 7
    for x in xs:
        h = (h * 1_000_003 + x) % imatch.PRIME
    return h % 65535 + 1 if xs else 0


def plain_print(text, lexicon):
    own = plain_terms(text)
    kept = sorted({number(t) for t in own if t in lexicon or len(own) < imatch.SHORT}) or ([number(" ".join(sorted(own, key=str.encode)))] if own else [])
    chains = []
    for m in imatch.MULTIPLIERS:
        dealt = [t * m % imatch.PRIME for t in kept]
        chains.append([folded([x for x in dealt if x % 2**j == 0]) for j in range(2, imatch.LEVELS + 2)])
    return folded(kept), chains


def plain_likeness(a, b):
    n = 0
    for x, y in zip(a[1], b[1]):
        i, j = sum(v > 0 for v in x), sum(v > 0 for v in y)
        n += i == j and (a[0] == b[0] if i == 0 else x[i - 1] == y[i - 1])
    return n / imatch.CHAINS


def plain_fingerprints(rows):
    rows = [(i, t or "") for i, t in rows]
    df = Counter(t for _, x in rows for t in plain_terms(x))
    lexicon = {t for t, n in df.items() if n * imatch.RARE >= len(rows) and n * imatch.COMMON <= len(rows)}
    rows.sort(key=lambda r: (-(2**63) if r[0] is None else r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        p, q, r = (plain_print(x, lexicon) for x in (t, edited, nxt))
        spell = lambda f: f"{f[0]:04x}" + "".join(f"{v:04x}" for c in f[1] for v in c)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spell(p), spell(q), plain_likeness(p, q), plain_likeness(p, r)))
    return out


@pytest.mark.parametrize("chars", [8_000_000, 3000])
def test_fingerprints_equal_plain_version(spark, monkeypatch, chars):
    monkeypatch.setattr(imatch, "RANGE_CHARS", chars)
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    table = spark.createDataFrame([(i, t, "en", "s", 1, 1, "f", True, 2, "m") for i, t in rows.items()], SCHEMA).repartition(3)
    assert order(imatch.fingerprints(table).collect()) == order(plain_fingerprints(list(rows.items())))


def test_repeated_rows_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_CHARS", 300)
    rows = [(1, "first words here"), *[(2, "equal words in every row")] * 5, (3, "the last one"), (None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.fingerprints(table).collect()
    assert order(got) == order(plain_fingerprints(rows))
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1
    assert imatch.fingerprints(nothing(spark)).collect() == []
    assert len(imatch.fingerprints(documents(spark)).collect()) == documents(spark).count()
