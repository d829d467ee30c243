import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import documents, nothing, order, prose, texts

from lakegauge.llm import compact_windows, lattice, simhash, suffix_dedup, suffix_runs
from lakegauge.llm.common import components, forest


def plain_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("large", [4096, 2])
def test_simhash_equals_brute_force(spark, large):
    marks = [plain_mark(t or "") for _, t in texts()]
    top = forest((a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3)
    groups = {}
    for k, (i, _) in enumerate(texts()):
        groups.setdefault(top.get(k, k), []).append(i)
    name = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = [(i, marks[k] - (marks[k] >> 63 << 64), name[top.get(k, k)]) for k, (i, _) in enumerate(texts())]
    got = simhash.simhash_classes(documents(spark), large).select("doc_id", "mark", "component_id").collect()
    assert order(got) == order(want)


def test_close_marks_split_large_keys_without_loss(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 3).tolist()
    marks = {b ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(60)}
    marks = sorted(m - (m >> 63 << 64) for m in marks)
    df = spark.createDataFrame([(m, k) for k, m in enumerate(marks)], "mark long, rep long")
    got = {r["node"]: r["component"] for r in components(simhash.close_marks(df, large=8)).collect()}
    want = forest((a, b) for a in range(len(marks)) for b in range(a) if ((marks[a] ^ marks[b]) % 2**64).bit_count() <= 3)
    assert got == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    out = simhash.drop_near_copies(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert ids.count(60) == 1 and 61 not in ids and ids.count(73) == 1
    assert {r["component_id"] for r in simhash.simhash_classes(docs).collect()} == set(ids)
    assert simhash.drop_near_copies(nothing(spark)).count() == 0


def test_near_copies_without_ids_stay_apart(spark):
    rows = [(None, "alpha beta gamma delta epsilon", 1), (None, "one two three four five six", 2), (None, "alpha beta gamma delta epsilon", 3), (7, None, 4), (None, "", 5)]
    out = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, component int")).collect()
    assert order((r["doc_id"], r["text"]) for r in out) == order([rows[0][:2], rows[1][:2], rows[3][:2]])


def plain_cut(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("large", [2048, 2])
def test_suffix_dedup_equals_brute_force(spark, large):
    assert order(suffix_dedup.suffix_report(documents(spark), large).collect()) == order(plain_cut(texts()))


def test_suffix_dedup_of_shifted_passages(spark):
    import random

    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(k, prose(rng, 20) + passage[rng.randint(0, 30) : len(passage) - rng.randint(0, 60)] + prose(rng, 20)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(plain_cut(rows))
    assert order(suffix_dedup.suffix_report(df).collect()) == want
    assert order(suffix_dedup.suffix_report(df, large=5).collect()) == want


def test_anchors_of_long_texts_come_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = rng.integers(97, 123, 60_000).astype(np.uint8)
    text[40_000:41_000] = text[7_900:8_900]  # over a cut
    offsets = np.array([0, len(text)])
    listed = lambda: [x for part in suffix_dedup.anchors(text, offsets) for x in zip(*(c.tolist() for c in part))]
    whole = listed()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    assert listed() == whole and len(set(whole)) == len(whole)
    unique = rng.integers(97, 123, 4_800_000).astype(np.uint8).tobytes().decode()
    (row,) = suffix_dedup.suffix_report(spark.createDataFrame([(1, unique)], "doc_id long, text string")).collect()
    assert tuple(row) == (1, len(unique), 0, 0, hashlib.sha256(unique.encode()).hexdigest())


def test_shortened_documents(spark):
    docs = documents(spark)
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[61]["text"] == "" and left[61]["n_chars"] == 0 and left[70]["text"] is None
    assert suffix_dedup.drop_repeats(nothing(spark)).count() == 0 and suffix_dedup.suffix_report(nothing(spark)).count() == 0


def test_loser_tree_merges_like_a_sort():
    import random

    rng = random.Random(2)
    for k in range(1, 8):
        entries = [(bytes(rng.choices(b"ab", k=rng.randint(0, 12))), b"l", n, 1) for n in range(60)]
        runs = [sorted(entries[r::k]) for r in range(k)]
        got = list(suffix_runs.merged([suffix_runs.front_coded(r) for r in runs]))
        assert [e[0] for _, e in got] == sorted(e[0] for e in entries)
        for (_, a), (shared, b) in zip(got, got[1:]):
            assert shared == suffix_runs.common_prefix(a[0], b[0])


def test_compact_windows_cover_each_sequence_once():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 150).astype(np.uint64)
    _, left, c, right, key = compact_windows.windows(hashes, np.array([0, 150]), 1)
    value = compact_windows.mixed(hashes * np.uint64(5) + np.uint64(0x1F83D9ABFB41BD6B + 1)) >> np.uint64(26)
    for i in range(150):
        for j in range(i + compact_windows.SHORTEST - 1, 150):
            own = [k for k in range(len(c)) if left[k] <= i <= c[k] <= j <= right[k]]
            assert len(own) == 1 and c[own[0]] == i + int(value[i : j + 1].argmin())


def test_passages_and_copies_are_found(spark):
    rows = compact_windows.near_passages(documents(spark)).collect()
    links = {frozenset((r["doc_id"], r["partner_id"])) for r in rows if r["kind"] == "passage"}
    top = forest(tuple(x) for x in links)
    assert len({top[i] for i in range(40, 46)}) == 1  # all share one passage
    assert top[60] == top[62] == top[63]  # one word changed; the first part
    copies = {(r["doc_id"], r["partner_id"]) for r in rows if r["kind"] == "copy"}
    assert (61, 60) in copies and (60, 60) not in copies
    by_id = {i: (t or "").lower().split() for i, t in texts()}
    for r in rows:
        if r["kind"] == "passage":
            assert not {r["doc_id"], r["partner_id"]} & set(range(10, 40))
            a, b = by_id[r["doc_id"]][r["start"] : r["end"]], by_id[r["partner_id"]][r["partner_start"] : r["partner_end"]]
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
            assert min(len(a), len(b)) >= 50 and math.isclose(r["similarity"], len(x & y) / len(x | y)) and r["similarity"] >= 0.8
    assert compact_windows.near_passages(nothing(spark)).count() == 0


def edited(rng, words, places):
    """``words`` with a word replaced, inserted or deleted at each of the places."""
    out = list(words)
    for p in sorted(places, reverse=True):
        kind = rng.choice(["replace", "replace", "insert", "delete"])
        out[p : p + (kind != "insert")] = [] if kind == "delete" else [f"edit{p}"]
    return out


def row(words):
    return np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(len(words) - 4)], dtype=np.int64)


def jaccard(x, y):
    x, y = set(x.tolist()), set(y.tolist())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("around", [0, 7, 40])
def test_edited_passages_are_verified(around):
    import random

    rng = random.Random(8)
    said = 0
    cases = [(50, [p], True) for p in range(50)]
    cases += [(n, rng.sample(range(n), k), False) for n in range(50, 151, 5) for k in (1, 2) for _ in range(8)]
    for n, places, replace in cases:
        passage = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        other = [f"edit{k}" if k in places else w for k, w in enumerate(passage)] if replace else edited(rng, passage, places)
        if len(other) < 50 or jaccard(row(passage), row(other)) < 0.8:
            continue
        said += 1
        frame = lambda tag, w: [f"{tag}{i}" for i in range(around)] + w + [f"{tag}{i}" for i in range(around, 2 * around)]
        x, y = row(frame("a", passage)), row(frame("b", other))
        found = compact_windows.verified(x, y)
        assert found, (n, places)
        for a, b, c, d, similarity in found:
            assert min(b - a, d - c) >= 46 and similarity >= 0.8 and math.isclose(similarity, jaccard(x[a:b], y[c:d]))
    assert said > 250
    assert compact_windows.verified(row([f"a{i}" for i in range(80)]), row([f"b{i}" for i in range(80)])) == []


def test_counts_of_hits_find_what_sets_find():
    rng = np.random.default_rng(5)
    said = 0
    for _ in range(300):
        x = rng.permutation(1000)[: rng.integers(46, 260)]
        y = x[rng.random(len(x)) < rng.choice([0.7, 0.9, 0.97])]
        for _ in range(rng.integers(0, 4)):  # new shingles, and a part that stands elsewhere
            at = rng.integers(0, len(y) + 1)
            y = np.concatenate([y[:at], 2000 + rng.permutation(1000)[: rng.integers(1, 40)], y[at:]])
        y = np.roll(y, rng.integers(0, len(y))) if rng.random() < 0.3 else y
        y = y[np.sort(np.unique(y, return_index=True)[1])]
        place = np.full(4000, -1)
        place[y] = np.arange(len(y))
        want = compact_windows.verified(x, y)
        assert compact_windows.verified_once(place[x], len(y)) == want
        said += len(want) > 0
    assert 60 < said < 290


def test_shingles_travel_once_however_many_ranges_ask():
    words = [f"w{i}" for i in range(300)]
    text = pa.array([" ".join(words)])
    wanted = pa.array([[{"p0": a, "p1": a + 60} for a in (0, 5, 9, 20, 200, 280)]], pa.list_(pa.struct([("p0", pa.int64()), ("p1", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([text, pa.array([7], pa.int64()), wanted], names=["text", "h1", "wanted"])
    (got,) = compact_windows.fetch_batches(iter([batch]))
    assert got.column("p0").to_pylist() == [0, 200, 280]
    assert [len(s) for s in got.column("shingles").to_pylist()] == [81, 61, 16]
    # a tile of the text and its copy, with candidates that lie in its ranges
    tile = 5
    rows = [(tile, t, 0, p, 0, 0, 0, s) for t in (7, 8) for p, s in zip(got.column("p0").to_pylist(), got.column("shingles").to_pylist())]
    rows += [(tile, 7, 8, 0, 60, 0, 60, None), (tile, 7, 8, 200, 260, 200, 260, None), (tile, 7, 8, 280, 340, 280, 340, None)]
    kinds = [*[pa.int64()] * 7, pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*compact_windows.TILED, "shingles"])
    cuts = iter([batch.slice(0, 4), batch.slice(4, 3), batch.slice(7)])
    got = [tuple(r.values()) for b in compact_windows.verify_batches(cuts) for r in b.to_pylist()]
    assert got == [(7, 0, 65, 8, 0, 65, 1.0), (7, 200, 265, 8, 200, 265, 1.0)]


@pytest.mark.parametrize("meeting", [512, 4])
def test_texts_of_a_triple_meet_once_wherever_they_are_dealt(spark, monkeypatch, meeting):
    rng = np.random.default_rng(2)
    rows = [(int(t), int(h) - 40, int(p), int(p) + 50) for t, h, p in zip(rng.integers(0, 12, 400), rng.integers(0, 80, 400), rng.integers(0, 3, 400))]
    rows += rows[:50]
    want = {(x[1], y[1], *x[2:], *y[2:]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1]}
    monkeypatch.setattr(compact_windows, "MEETING", meeting)
    frame = spark.createDataFrame(rows, "triple long, h1 long, p0 long, p1 long")
    dealt = compact_windows.dealt(frame, frame.groupBy("triple").agg(compact_windows.F.count("*").alias("n")))
    assert (dealt.where("side >= 0").count() > 0) == (meeting < 40)
    runs = np.array(sorted(map(tuple, dealt.collect())))
    cuts = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], names=dealt.columns) for part in np.array_split(runs, 7)]
    got = [tuple(r[c] for c in compact_windows.CANDIDATE) for b in compact_windows.meeting_batches(iter(cuts)) for r in b.to_pylist()]
    # (a, b, a0, a1, b0, b1); a pair may come of several triples, of one triple once
    assert set(got) == want
    once = Counter((x[1], y[1], *x[2:], *y[2:]) for t in range(12) for x in {r for r in rows if r[0] == t} for y in {r for r in rows if r[0] == t} if x[1] < y[1])
    assert Counter(got) == once


def test_passages_around_a_common_line_are_found(spark):
    import random

    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line = fresh(40)
    rows, want = [], set()
    for k in range(24):
        passage = [fresh(10) + " " + line + " " + fresh(10)] * 2
        if k % 2:  # a word changed in the common line
            words = passage[1].split()
            words[30] = "changed"
            passage[1] = " ".join(words)
        rows += [(2 * k + i, fresh(30) + " " + p + " " + fresh(30)) for i, p in enumerate(passage)]
        want |= set() if k % 2 else {frozenset((2 * k, 2 * k + 1))}
    rows += [(100 + k, fresh(50) + " " + line + " " + fresh(50)) for k in range(20)]
    got = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = {frozenset((r["doc_id"], r["partner_id"])) for r in got}
    assert want <= links
    assert all(len({i // 2 for i in x}) == 1 and max(x) < 100 for x in links)


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        for k in range(8):
            rows.append([100 * g + k, (base + rng.normal(size=16) * 0.06 * (k % 4)).tolist(), g % 3])
    rows += [[5000, rows[0][1], 0], [5001, rows[0][1], 1], [5002, rows[0][1], None], [5003, None, 0], [5004, [0.0] * 16, 0], [5005, [float("nan")] * 16, 0]]
    rows += [[5006, [1.0] * 15 + [None], 0], [5007, [], 0], [5008, [1e200] * 16, 2], [5009, [1e200] * 16, 2], [None, rows[3][1], 0], [0, rows[0][1], 0]]
    return rows, spark.createDataFrame([tuple(r) + (True, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean, n int")


@pytest.mark.parametrize("large", [2048, 3])
def test_lattice_links_equal_brute_force(spark, large):
    rows, df = vectors(spark)
    low = -(2**63)
    unit = []
    for i, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=float) / np.abs(v).max() if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    links = Counter(x for p in near for x in p)
    top = forest(near)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(top.get(k, k), []).append(low if r[0] is None else r[0])
    want = []
    for k, r in enumerate(rows):
        first = min(groups[top.get(k, k)])
        want.append((r[0], links[k], None if first == low else first, first == (low if r[0] is None else r[0])))
    got = lattice.embedding_links(df, large=large).collect()
    found, all_links = sum(r["n_links"] for r in got), sum(links.values())
    assert len(got) == len(want) and 0.98 * all_links <= found <= all_links
    if found == all_links:
        assert order(got) == order(want)
    assert lattice.embedding_links(df.where("false")).count() == 0


def test_lattice_keeps_rows_of_one_id_apart_and_labels_as_they_are(spark):
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near_x, near_y = [1.0, 0.01, 0.0, 0.0], [0.01, 1.0, 0.0, 0.0]
    rows = [(1, x, "a"), (1, y, "a"), (2, near_x, "a"), (3, near_y, "a"), (4, x, "b")]
    got = lattice.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    rows = [(1, x, 1.2), (2, near_x, 1.4), (3, near_x, 1.2)]
    got = lattice.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_triples_of_a_text_that_repeats_itself_stay_few():
    def own(hashes):
        rows = []
        for f in range(compact_windows.FUNCTIONS):
            _, left, c, right, key = compact_windows.windows(hashes, np.array([0, len(hashes)]), f)
            rows += [{"key": k, "c": x, "l": a, "r": b, "loose": True} for k, x, a, b in zip(key.tolist(), c.tolist(), left.tolist(), right.tolist())]
        kind = pa.struct([("key", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("loose", pa.bool_())])
        return pa.array([rows], pa.list_(kind))

    one = np.full(1000, 7, dtype=np.uint64)
    found = [t for _, t, _, _ in compact_windows.triples(own(one))]
    assert sum(map(len, found)) == 20  # of six functions three
    few = np.tile(np.arange(30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 40)
    seen = {t for _, ts, _, _ in compact_windows.triples(own(few)) for t in ts.tolist()}
    short = {t for _, ts, _, _ in compact_windows.triples(own(few[:120])) for t in ts.tolist()}
    assert short <= seen and len(seen) == 20


def test_lattice_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    point = lattice.decode(y)
    step = lattice.roots()
    own = ((y - point) ** 2).sum(axis=1)
    others = ((y[:, None, :] - point[:, None, :] - step[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all() and len(step) == 240
