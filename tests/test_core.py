"""Behaviour of the core library on small cases, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from lexaudit.functions import hashing as H
from lexaudit.functions import segment as SEG
from lexaudit.functions import text as T
from lexaudit.operators import alignment, learning, metrics
from lexaudit.operators import audit as A
from lexaudit.plans import workflow
from lexaudit.sources import files
from lexaudit.streaming import live, serving

SF = "/root/testdata/sf0.001"
CORE = [q for q in __spark_entry__._core.QUERIES]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 7)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [q for q in CORE if q in __spark_entry__._core.ORACLE])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in con.description]
    want = sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in con.fetchall()), key=repr)
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


# --- text ------------------------------------------------------------------------------------------------
def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_text_functions(spark):
    r = one(spark, " It’s a 🦊, isn't it? Café 42! ", T.words("t"), T.utf16_length("t"), T.normalized("t"), T.content_words("t"))
    assert r.c0 == ["It’s", "a", "isn't", "it", "Café", "42"] and r.c1 == 31 and r.c2 == "it s a isn t it café 42" and r.c3 == ["It’s", "isn't", "Café"]
    assert one(spark, " ".join(f"w{i}" for i in range(40)), T.prefix("t")).c0 == " ".join(f"w{i}" for i in range(10, 40))
    assert one(spark, "  x  ", T.trimmed("t")).c0 == "x"
    assert one(spark, "too short", T.insufficient("t")).c0 and one(spark, "one two three four five six seven eight", T.insufficient("t")).c0 is None
    assert one(spark, "a b c", T.shingles("t")).c0 == ["a b c"] and one(spark, "a b c d e f", T.shingles("t")).c0 == ["a b c d e", "b c d e f"]


def test_segmentation_case():
    text = "Dr. A. Smith said “hello 🦊.” Then he left.\n\nA wrapped\nline ends here."
    got = SEG.segment(text)
    assert "".join(s[3] for s in got) == text and len(got) == 3
    assert got[1][1] == len(text[: text.index("Then")].encode("utf-16-le")) // 2 and got[1][4].endswith("hello")


@given(st.text(alphabet=st.sampled_from(list("aB. !?\n\"é🦊1,;")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_segments_are_the_text(text):
    got = SEG.segment(text)
    units = text.encode("utf-16-le")
    assert all(units[2 * a : 2 * b].decode("utf-16-le") == t for _, a, b, t, _ in got)
    assert "".join(t for _, _, _, t, _ in got).split() == text.split() and all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False))


def test_segments_equal_icu(spark):
    jvm = spark._jvm
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    it = jvm.com.ibm.icu.text.BreakIterator.getSentenceInstance(jvm.java.util.Locale.ENGLISH)
    for text in [*docs, "He paid 3.5 euros. why? (Yes.) No... maybe; e.g. this. A.B. met C."]:
        line = text.replace("\n", " ")
        it.setText(line)
        want = []
        while (b := it.next()) != -1:
            want.append(b)
        assert SEG.breaks(line) == want


def test_alignment():
    assert alignment.align_record("One. 🦊 Two  three.\n", ["One.", "🦊 Two three."])[1][1:5] == (5, 19, "🦊 Two  three.", "🦊 Two three.")
    assert alignment.align_record("One. Two.", ["One.", "Tow."])[0][-1] and alignment.align_record("One. Two.", ["One."])[0][-1] == "text left over"


def test_prng_is_the_32_bit_generator(spark):
    def draws(seed, n):
        out, m = [], (1 << 32) - 1
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & m
            t = ((seed ^ seed >> 15) * (1 | seed)) & m
            t ^= (t + ((t ^ t >> 7) * (61 | t))) & m
            out.append(((t ^ t >> 14) & m) / 4294967296)
        return out

    got = [r.u for r in spark.range(50).select(H.mulberry32("id", 23092026).alias("u")).collect()]
    assert got == draws(23092026, 50)


# --- metrics -----------------------------------------------------------------------------------------------
def rows_of(spark, data):
    return spark.createDataFrame(data, "source_id string, label int, status string, calibrated double")


def test_hand_checked_metrics(spark):
    r = rows_of(spark, [("a", 1, "scored", 0.8), ("b", 0, "scored", 0.2), ("c", 1, "insufficient", None)])
    m = metrics.rates(metrics.confusion(r, 0.5)).first()
    assert (m.recall, m.answered_recall, m.coverage) == (0.5, 1.0, 2 / 3)
    k = metrics.ranking(metrics.by_score(r)).first()
    assert (k.auroc, k.auprc) == (1.0, 1.0)
    tied = rows_of(spark, [("a", 1, "scored", 0.5), ("b", 0, "scored", 0.5)])
    k = metrics.ranking(metrics.by_score(tied)).first()
    assert (k.auroc, k.auprc, metrics.ece(metrics.reliability(metrics.by_score(tied))).first().ece) == (0.5, 0.5, 0.0)
    nan = rows_of(spark, [("a", 0, "scored", float("nan")), ("b", 0, "failed", 0.9)])
    assert metrics.confusion(nan, 0.5).first().fp == 0 and metrics.rates(metrics.confusion(nan, 0.5)).first().recall is None


def brute_bins(scores):
    scores, at, out = sorted(scores), 0, []
    while at < len(scores):
        end = min(len(scores), at + -(-len(scores) // 10))
        while end < len(scores) and scores[end][0] == scores[end - 1][0]:
            end += 1
        out.append((end - at, sum(s for s, _ in scores[at:end]) / (end - at), sum(x for _, x in scores[at:end]) / (end - at)))
        at = end
    return out


def test_ranking_bins_and_bootstrap_against_brute_force(spark):
    rnd = random.Random(7)
    data = [(f"s{rnd.randrange(6)}", rnd.randrange(2), "scored", rnd.randrange(12) / 12) for _ in range(90)]
    r = rows_of(spark, data)
    pos, neg = [c for _, y, _, c in data if y], [c for _, y, _, c in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.ranking(metrics.by_score(r)).first().auroc == pytest.approx(auc)
    got = [(b.n, b.score, b.rate) for b in metrics.reliability(metrics.by_score(r)).orderBy("bin").collect()]
    assert np.allclose(got, brute_bins([(c, y) for _, y, _, c in data]))
    draws = [x.u for x in spark.range(600).select(H.mulberry32("id", metrics.SEED).alias("u")).collect()]
    keys = sorted({s for s, *_ in data})
    by = {k: [d for d in data if d[0] == k] for k in keys}
    want, ece = [], []
    for i in range(600 // len(keys)):
        s = [d for k in range(len(keys)) for d in by[keys[int(draws[i * len(keys) + k] * len(keys))]]]
        want.append(sum(d[3] >= 0.5 and d[1] for d in s) / max(1, sum(d[1] for d in s)))
        ece.append(sum(n * abs(a - b) for n, a, b in brute_bins([(d[3], d[1]) for d in s])) / len(s))
    n = len(want)
    got = sorted(r.recall for r in metrics.bootstrap(r, 0.5, n).collect())
    assert np.allclose(got, sorted(want))
    assert np.allclose(sorted(x.ece for x in metrics.bootstrap_ece(r, n).collect()), sorted(ece))


# --- learning ------------------------------------------------------------------------------------------------
def test_fit_and_threshold(spark):
    w, b = learning.fit_logistic([[0], [0.1], [0.9], [1]], [0, 0, 1, 1])
    assert w[0] > 0
    df = spark.createDataFrame([([x], y) for x, y in zip((0.0, 0.1, 0.9, 1.0), (0, 0, 1, 1), strict=True)], "features array<double>, label int")
    w2, b2 = learning.fit_distributed(df, 1, steps=5)
    w3, b3 = learning.fit_logistic([[0], [0.1], [0.9], [1]], [0, 0, 1, 1], steps=5)
    assert np.allclose([*w2, b2], [*w3, b3])
    with pytest.raises(ValueError):
        learning.fit_logistic([[1], [2]], [1, 1])
    r = rows_of(spark, [("a", 0, "scored", 0.1), ("b", 0, "scored", 0.4), ("c", 1, "scored", 0.7), ("d", 0, "failed", None)])
    t = {x.target: x.threshold for x in learning.select_threshold(r, [0.0, 0.34, 1.0]).collect()}
    assert t == {0.0: 0.7, 0.34: 0.4, 1.0: 0.1}
    worst = rows_of(spark, [("a", 0, "scored", 0.9), ("c", 1, "scored", 0.1)])
    assert learning.select_threshold(worst, [0.0]).first().threshold == learning.ABSTAIN_ALL


def test_calibration_on_counts_equals_rows(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(1, 20) / 20, rnd.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame([(r, y, "scored") for r, y in data], "raw double, label int, status string")
    m = learning.fit_calibration(df).first()
    w, b = learning.fit_logistic(learning.logit(np.array([r for r, _ in data]))[:, None], [y for _, y in data], **learning.CALIBRATION)
    assert (m.weight, m.intercept) == pytest.approx((w[0], b), abs=1e-9)


# --- audits ----------------------------------------------------------------------------------------------------
def test_greedy_retention_equals_a_loop(spark):
    rnd = random.Random(11)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)}
    out, near = {}, {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    for x in range(40):
        kept = [a for a in sorted(near.get(x, ())) if a not in out]
        if kept:
            out[x] = kept[0]
    got = {r.id: r.retained for r in A.greedy_retained(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert got == out


def test_near_pairs_equal_all_pairs(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnop") * 2 for _ in range(60)] for _ in range(8)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:30] + ["zz"] + b[31:]) for b in base] + [" ".join(b[:-1]) for b in base]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    got = {(r.a, r.b) for r in A.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    assert got == want and want


def example_rows():
    out = []
    for split in ("train", "dev", "test"):
        for domain in ("news", "essays", "reports", "abstracts"):
            for n in range(3):
                sid = f"{domain}:{split}:{n}"
                filler = " ".join(f"{H.__name__[:2]}{hash_word(sid, k)}" for k in range(12))
                for version, label in (("v0", 0), ("v4", 1)):
                    text = f"{filler} {'generated tail words' if label else 'plain human tail'}"
                    out.append((f"{sid}:{version}", sid, hash_word(sid, 99, 64), split, domain, "qwen3-8b" if split == "test" else "gen", version, text, "", 0, len(text), label, "made", None))
    return out


def hash_word(sid, k, n=10):
    import hashlib

    return hashlib.sha256(f"{sid}{k}".encode()).hexdigest()[:n]


EXAMPLE = "id string, sourceId string, sourceHash string, officialSplit string, domain string, generator string, version string, text string, preceding string, start int, end int, label int, provenance string, authorId string"


def test_prepare_is_the_same_in_any_order_and_rejects_leaks(spark, tmp_path):
    rows = example_rows()
    a, ma = workflow.prepare(spark.createDataFrame(rows, EXAMPLE), {"development": 8, "calibration": 8, "test": 8})
    b, mb = workflow.prepare(spark.createDataFrame(rows[::-1], EXAMPLE), {"development": 8, "calibration": 8, "test": 8})
    assert {k: v for k, v in ma.items() if k != "created"} == {k: v for k, v in mb.items() if k != "created"} and a.count() == 48
    workflow.load(a, ma)
    with pytest.raises(A.AuditError):
        workflow.load(a.withColumn("label", 1 - F.col("label")), ma)
    at = EXAMPLE.split(", ")
    change = lambda r, **kw: tuple(kw.get(c.split()[0], v) for c, v in zip(at, r, strict=True))
    for bad in ({"sourceId": rows[-1][1]}, {"sourceHash": rows[-1][2]}):
        with pytest.raises(A.AuditError):
            workflow.audit(spark.createDataFrame([change(rows[0], **bad), *rows[1:]], EXAMPLE))
    with pytest.raises(A.AuditError):
        workflow.audit(spark.createDataFrame([change(r, authorId="x") for r in rows], EXAMPLE))
    spec = workflow.freeze(str(tmp_path / "spec.json"), ma, {"weight": 1.0, "intercept": 0.0, "threshold": 0.5}, "sentence")
    workflow.open_test(str(tmp_path / "receipt.json"), spec, "first")
    workflow.open_test(str(tmp_path / "receipt.json"), spec, "first")
    with pytest.raises(A.AuditError):
        workflow.open_test(str(tmp_path / "receipt.json"), spec, "second")


def test_evaluate_and_report(spark, tmp_path):
    rows = [(r[0], r[1], r[9], r[10], r[11], "scored", 0.9 if r[11] else 0.1, r[6], "held-out" if r[5] == "qwen3-8b" else "gen", r[4]) for r in example_rows()]
    df = spark.createDataFrame(rows, "id string, source_id string, start int, end int, label int, status string, calibrated double, version string, generator string, domain string")
    reports, gates, verdict = workflow.evaluate(df, 0.5, 50)
    g = {(r["slice"], r.metric): r.gate for r in gates.collect()}
    assert g[("overall", "recall")] == "pass" and verdict in ("inconclusive", "fail")
    workflow.report(str(tmp_path / "r.md"), reports, verdict)
    assert "| overall |" in (tmp_path / "r.md").read_text()


# --- sources and serving -----------------------------------------------------------------------------------------
def test_parse_list():
    assert files.parse_list('["a", "b"]') == files.parse_list("['a', 'b']") == ["a", "b"]
    assert files.parse_list("__import__('os').getcwd()") is None and files.parse_list("3") is None and files.parse_list(None) is None


def test_json_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": "🦊\\n"}\n\n{"a": \n')
    assert [r.line for r in files.malformed_lines(spark, str(p), "a string").collect()] == [3]
    files.write_jsonl(spark.createDataFrame([("🦊\n", None)], "a string, b string"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), spark.createDataFrame([], "a string, b string").schema).first().a == "🦊\n"
    with pytest.raises(Exception):  # noqa: B017
        files.write_jsonl(spark.range(1), str(tmp_path / "out"))
    files.write_json(str(tmp_path / "j.json"), {"a": 1}, exclusive=True)
    with pytest.raises(FileExistsError):
        files.write_json(str(tmp_path / "j.json"), {"a": 2}, exclusive=True)
    files.write_json(str(tmp_path / "j.json"), {"a": 2})
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 2}


def test_ledger(spark):
    ev = [("l", 0, "reserve", 0, 0), ("l", 1, "reserve", 1, 0), ("l", 2, "reserve", 2, 0), ("l", 3, "settle", 0, 100), ("l", 4, "settle", 0, 100)]
    out = serving.ledger(spark.createDataFrame(ev, "ledger string, seq long, op string, reservation long, used long"), 25.0, 2, 128_000).orderBy("seq").collect()
    assert [r.accepted for r in out] == [True, True, False, True, False] and out[-1].tokens == 64_100
    with pytest.raises(ValueError):
        serving.ledger(spark.createDataFrame(ev, "ledger string, seq long, op string, reservation long, used long"), 26.0, 2, 1)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.rate_limited(stream, 2, 6 * 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("limited").exceptAll(serving.rate_limit(events, 2, 6 * 3600)).count() == 0 and spark.table("limited").count() == events.count()


def test_calibration_error_of_resamples_over_ranges_makes_no_row_for_each_score_of_a_replicate(spark, monkeypatch):
    """Many ranges of scores, few cells at a time, and a source without a score; no plan joins draws with scores."""
    rnd = random.Random(3)
    data = [(f"s{rnd.randrange(7)}", rnd.randrange(2), "scored", rnd.randrange(40) / 40) for _ in range(300)] + [("s9", 0, "failed", None)]
    r, n = rows_of(spark, data), 25
    monkeypatch.setattr(metrics, "draws", None)
    keys = ["s0", "s1", "s2", "s3", "s4", "s5", "s6", "s9"]
    u = H.mulberry32_values(np.arange(n * len(keys)), metrics.SEED)
    assert u.tolist() == [x.u for x in spark.range(n * len(keys)).select(H.mulberry32("id", metrics.SEED).alias("u")).collect()]
    want = {}
    for i in range(n):
        s = [d for k in range(len(keys)) for d in data if d[0] == keys[int(u[i * len(keys) + k] * len(keys))] and d[2] == "scored"]
        want[i] = sum(m * abs(a - b) for m, a, b in brute_bins([(d[3], d[1]) for d in s])) / len(s)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.replicate: x.ece for x in metrics.bootstrap_ece(r, n).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(want)


def test_gold_alignment_does_not_search_the_rest_of_the_text(monkeypatch):
    """Sentences with other white space are compared in place: no pattern is compiled, and what follows is not looked through."""
    monkeypatch.setattr(alignment.re, "compile", None)
    text = "\n".join(f"Line {i} has some words." for i in range(2000))
    got = alignment.align_record(text, [line.replace(" ", "  ") for line in text.split("\n")])
    assert len(got) == 2000 and all(r[7] and r[8] is None for r in got) and got[-1][3] == "Line 1999 has some words."
    assert alignment.align_record("a b c", ["a  b", "d"])[0][-1] and alignment.align_record("ab c", ["a  b"])[0][-1]


def test_word_questions_are_counted_in_their_row(spark):
    """No question is shuffled or sorted."""
    plan = __spark_entry__.queries()["word_questions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_results_leave_in_small_batches():
    """Sentences of a batch of texts are not held together: 1,000 rows are made before the first batch leaves."""
    import pyarrow as pa

    from lexaudit.functions.batches import record_batches

    made = []
    rows = ((made.append(i) or i, str(i)) for i in range(2500))
    out = record_batches(rows, [("id", pa.int64()), ("text", pa.string())])
    assert next(out).num_rows == 1000 and len(made) == 1000
    assert [b.num_rows for b in out] == [1000, 500]


def test_sets_without_a_shared_prefix_leave_before_they_are_written(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    texts += [texts[0].replace("w0x59", "other"), texts[3], "all rights reserved by us " + texts[5], "all rights reserved by us " + texts[6]]
    written, cut = [], A.cut
    monkeypatch.setattr(A, "cut", lambda s, df: written.append((df.columns, (out := cut(s, df)).count())) or out)
    got = A.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    assert {(r.a, r.b) for r in got} == {(0, 30), (5, 32), (6, 33)}
    assert next(n for c, n in written if c == ["id", "s"]) < 15
