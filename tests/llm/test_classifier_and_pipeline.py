import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import documents, nothing, order, prose, texts

import corpus_pipeline
from lakegauge.llm import common, kneser_ney


def plain_model(raw: list[bytes]):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition."""
    n = kneser_ney.ORDER
    counts = {n: Counter()}
    for b in raw:
        padded = b"\n" * (n - 1) + b
        counts[n].update(padded[i : i + n] for i in range(len(b)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    held = {}
    for k in counts:
        c = Counter(counts[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        held[k] = [min(max(j - (j + 1) * y * c[j + 1] / c[j] if c[j] else 0.75, 0.05), j - 0.05) for j in (1, 2, 3)]
    after = {k: {} for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            after[k].setdefault(g[:-1], []).append(c)

    def p(g: bytes) -> float:
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        several = after[k].get(g[:-1])
        if not several:
            return lower
        d = held[k]
        gamma = sum(d[min(c, 3) - 1] for c in several) / sum(several)
        c = counts[k].get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(several) + gamma * lower

    return p


def bits_of(p, text: bytes) -> float:
    n = kneser_ney.ORDER
    padded = b"\n" * (n - 1) + text
    return sum(-math.log2(p(padded[i : i + n])) for i in range(len(text)))


def test_a_worker_lets_go_of_what_others_kept():
    made = []
    keep = lambda: common.worker_cache("probe", lambda: made.append(1) or object())
    assert keep() is keep() and len(made) == 1
    common.drop_worker_cache()
    common.drop_worker_cache()
    assert keep() is keep() and len(made) == 2


def test_a_task_leaves_no_free_memory_behind():
    import gc
    import re
    from pathlib import Path

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    text = pa.array([prose(random.Random(k), 400) for k in range(2000)])
    batches = lambda: iter([pa.RecordBatch.from_arrays([text], names=["text"])])
    for batch in common.lean(kneser_ney.model_batches)(batches()):
        pass
    before, most = held(), 0
    for batch in common.lean(kneser_ney.model_batches)(batches()):
        most = max(most, held())
    del batch
    gc.collect()
    assert most > before + 8 and held() < before + (most - before) / 2


def test_scores_equal_the_definition(spark):
    docs = documents(spark).where("doc_id <> 80")
    ids = np.array(sorted({i for i, _ in texts() if i is not None and i < 30}), dtype=np.int64)
    p = plain_model([(t or "").encode() for i, t in texts() if i in ids])
    got = kneser_ney.scores(docs, ids).collect()
    want = [(i, (t or "").encode()) for i, t in texts() if i is not None and i != 80]
    assert len(got) == len(want)
    one = order((r["doc_id"], r["n_bytes"], round(r["bits"], 3)) for r in got)
    two = order((i, len(b), round(bits_of(p, b), 3)) for i, b in want)
    for a, b in zip(one, two):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.01


def test_probabilities_of_a_history_sum_to_one():
    p = plain_model([b"the cat sat on the mat", b"the dog"])
    for history in (b"the ", b"zzzz", b"\n\n\n\n"):
        assert math.isclose(sum(p(history + bytes([b])) for b in range(256)), 1, rel_tol=1e-9)


def labelled(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(300):
        bad = i % 10 == 0
        text = " ".join(w + "%%%" for w in prose(rng, 80).upper().split()) if bad else prose(rng, 80)
        rows.append((i, text, "en" if i % 2 else "de", "s", len(text)))
        marks.append((i, 0 if bad else 1, 0))
    rows += [(400, None, "en", None, None), (401, "", None, None, 0), (402, prose(rng, 100), "xx", None, 1), (None, prose(rng, 50), "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks + [(None, 1, 0), (7, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_kept_documents(spark):
    docs, labels = labelled(spark)
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(docs, labels.where("doc_id < 200")).collect()}
    bad = [i for i in range(300) if i % 10 == 0]
    assert not any(kept[i] for i in bad) and sum(not kept[i] for i in range(300) if i % 10) <= 5
    assert kept[400] and kept[401] and kept[402]
    out = kneser_ney.drop_poor(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {400, 401, None}


def test_texts_do_not_travel_to_drop_poor_ones(spark, monkeypatch):
    docs, labels = labelled(spark)
    docs = docs.union(docs.limit(20))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = kneser_ney.drop_poor(docs, labels)
        shuffled = [x for x in few._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        few = order(few.collect())
        monkeypatch.setattr(kneser_ney, "SMALL_POOR", 0)  # joined by shuffle
        many = order(kneser_ney.drop_poor(docs, labels).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not shuffled and few == many and 0 < len(few) < docs.count()


def test_kept_documents_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "ENOUGH", 10)
    docs, labels = labelled(spark)
    rows = [(r["doc_id"], (r["text"] or "").encode(), r["lang"]) for r in docs.collect()]
    model, held = kneser_ney.trusted_ids(labels)
    trusted = dict.fromkeys(model.tolist(), True) | dict.fromkeys(held.tolist(), False)
    assert set(trusted) == {i for i in range(300) if i % 10}
    p = plain_model([t for i, t, _ in rows if trusted.get(i)])
    bits = {(i, t): bits_of(p, t) for i, t, _ in rows}
    judged = {}
    for lang in ("en", "de", None):
        own = [(t, bits[i, t]) for i, t, x in rows if trusted.get(i) is False and lang in (x, None)]
        usual = sum(b for _, b in own) / sum(len(t) for t, _ in own)
        means = sorted((b + kneser_ney.PRIOR * usual) / (len(t) + kneser_ney.PRIOR) for t, b in own)
        judged[lang] = usual, means[math.ceil(kneser_ney.QUANTILE * len(means)) - 1] + kneser_ney.SLACK
    got = {(r["doc_id"], r["n_bytes"]): r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        usual, limit = judged.get(lang, judged[None])
        score = (bits[i, t] + kneser_ney.PRIOR * usual) / (len(t) + kneser_ney.PRIOR)
        r = got[i, len(t)]
        assert math.isclose(r["score"], score, abs_tol=1e-3) and math.isclose(r["limit"], limit, abs_tol=1e-3)
        assert abs(score - limit) < 2e-3 or r["kept"] == (score <= limit)


def test_all_trusted_documents_count_however_many(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TRUSTED", 10, raising=False)  # the former bound
    docs, labels = labelled(spark)
    assert {i for ids in kneser_ney.trusted_ids(labels) for i in ids.tolist()} == {i for i in range(300) if i % 10}
    small = order((r["doc_id"], r["n_bytes"], round(r["score"], 6), r["kept"]) for r in kneser_ney.classify(docs, labels).collect())
    monkeypatch.setattr(kneser_ney, "SMALL_IDS", 5)  # joined by shuffle
    assert order((r["doc_id"], r["n_bytes"], round(r["score"], 6), r["kept"]) for r in kneser_ney.classify(docs, labels).collect()) == small


def test_without_trusted_text_all_stay(spark):
    docs, labels = labelled(spark)
    assert kneser_ney.classify(docs, labels.where("false")).where("not kept").count() == 0
    assert kneser_ney.classify(nothing(spark), labels).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, labels = labelled(spark)
    shared = prose(random.Random(1), 80)
    more = [(500 + k, prose(random.Random(k), 60) + " " + shared + " " + prose(random.Random(90 + k), 60), "en", "s", 1) for k in range(3)]
    near = more[0][1].replace("e ", "e  ", 1)
    more += [(600, near, "en", "s", 1), (601, "key: token=abcdefghijklmnop123 " + prose(random.Random(77), 400), "en", "s", 1)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = steps[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in steps.items()}
    assert not ids["quality_classifier"] & set(range(0, 300, 10)) and 500 in ids["quality_classifier"]
    assert 600 not in ids["simhash_near_dedup"] and {500, 501, 502} <= ids["simhash_near_dedup"]
    cut = steps["suffix_array_dedup"].where("doc_id between 500 and 502").collect()
    assert all(shared[:200] not in r["text"] and len(r["text"]) == r["n_chars"] for r in cut)
    assert "abcdefghijklmnop123" not in steps["secret_scan"].where("doc_id = 601").first()["text"]
    assert ids["best_fit_packing"] == ids["secret_scan"]
    assert order(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()) == order(rows.select("doc_id", "piece", "length").collect())


def test_questions_are_written_in_order(spark, monkeypatch):
    """The numbers that blocks ask for are sorted within each file and compressed well: they are most of what is written."""
    from lakegauge.llm import kneser_ney
    from lakegauge.session import materialize

    kept = {}

    def watched(df, label, *compression):
        kept[label] = materialize(df, label, *compression)
        return kept[label]

    monkeypatch.setattr(kneser_ney, "materialize", watched)
    docs = spark.createDataFrame([(i, f"text {i} of {i * i} words", "en") for i in range(60)], "doc_id long, text string, lang string").repartition(4)
    kneser_ney.scores(docs, np.arange(30)).count()
    files = kept["kn-asked"].inputFiles()
    assert files and all(".zstd." in f for f in files)
    for f in files:
        rows = [tuple(r) for r in spark.read.parquet(f).coalesce(1).collect()]
        assert rows == sorted(rows)


def test_packed_answers_come_back_by_block(monkeypatch):
    monkeypatch.setattr(kneser_ney, "HELD", 100)
    rng = np.random.default_rng(5)
    block, k, bits = rng.integers(-3, 3, 1000) << 40, rng.permutation(1 << 20)[:1000] << 19, rng.random(1000) * 30
    whole = pa.RecordBatch.from_arrays([pa.array(block), pa.array(k), pa.array(bits)], names=["block", "k", "bits"])
    out = pa.Table.from_batches(kneser_ney.answer_batches(iter([whole.slice(a, 70) for a in range(0, 1000, 70)])))
    assert out.num_rows < 100
    for b in np.unique(block):
        got = kneser_ney.unpacked(out.filter(pa.array(out["block"].to_numpy() == b))["answers"])
        order = np.argsort(k[block == b])
        assert (got[0] == k[block == b][order]).all() and (got[1] == bits[block == b][order]).all()
    assert all(len(x) == 0 for x in kneser_ney.unpacked(out["answers"].slice(0, 0))) and not list(kneser_ney.answer_batches(iter([])))
