"""The TF-IDF model of the comparisons, held against a direct dense fit with 1,500 features and 500 steps."""

from __future__ import annotations

import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lexaudit.operators import learning as L


def direct(train, texts, features=1500, steps=500):
    split = [t.lower().split() for t in train["text"]]
    df = Counter(t for s in split for t in set(s))
    terms = sorted((t for t, n in df.items() if n >= 2), key=lambda t: (-df[t], t))[:features]
    idf = np.array([np.log((1 + len(split)) / (1 + df[t])) + 1 for t in terms])

    def dense(docs):
        x = np.array([[1 + np.log(c[t]) if c[t] else 0.0 for t in terms] for c in map(Counter, docs)]) * idf
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    w, b = L.fit_logistic(dense(split), train["label"], steps=steps)
    return L._sigmoid(b + dense([t.lower().split() for t in texts]) @ w)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(2200)]
    made = []
    for i in range(240):
        own = words[:1200] if i % 2 else words[1000:]
        made.append((i, f"s{i % 40}", i % 2, "scored", (i % 97 + 1) / 99, " ".join(rnd.choice(own) for _ in range(60))))
    return pd.DataFrame(made, columns=["doc_id", "source_id", "label", "status", "raw", "text"])


def test_comparison_fits_the_whole_model(spark, rows):
    got = L.cross_validated(spark.createDataFrame(rows), ("tfidf",)).toPandas().sort_values("doc_id")
    for fold, held in got.groupby("fold"):
        train = rows[~rows["doc_id"].isin(held["doc_id"])].sort_values(["source_id", "doc_id"])
        test = rows[rows["doc_id"].isin(held["doc_id"])].sort_values("doc_id")
        own = direct(train, train["text"])
        w, b = L.fit_logistic(L.logit(own)[:, None], train["label"], **L.CALIBRATION)
        assert held["calibrated"].to_numpy() == pytest.approx(L._sigmoid(b + L.logit(direct(train, test["text"])) * w[0]), rel=1e-7), fold


def test_combined_threshold_and_recommendation(spark, rows):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(len(rows), 3)) + rows["label"].to_numpy()[:, None] * 2
    data = rows.assign(features=x.tolist(), status=np.where(rows.doc_id % 17 == 3, "insufficient", "scored"))
    data.loc[data.doc_id % 17 == 3, "features"] = None
    schema = "doc_id long, source_id string, label long, status string, raw double, text string, features array<double>"
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), schema)
    got = L.cross_validated(df, ("raw", "prior", "combined"))
    held = got.toPandas()
    assert len(held) == 3 * len(rows) and held[held.status != "scored"].calibrated.isna().all()
    for fold, own in held[held.method == "combined"].groupby("fold"):
        train = data[~data.doc_id.isin(own.doc_id)].sort_values(["source_id", "doc_id"])
        ok = train[train.status == "scored"]
        w, b = L.fit_logistic(np.stack(ok.features), ok.label)
        raw = L._sigmoid(b + np.stack(ok.features) @ w)
        w1, b1 = L.fit_logistic(L.logit(raw)[:, None], ok.label, **L.CALIBRATION)
        c = L._sigmoid(b1 + L.logit(raw) * w1[0])
        negatives = (train.label == 0).sum()
        want = next(t for t in [*sorted(set(c)), L.ABSTAIN_ALL] if (c[(ok.label == 0).to_numpy()] >= t).sum() / negatives <= 0.05)
        assert own.threshold.iloc[0] == pytest.approx(want, rel=1e-9), fold
    s = {r.method: r for r in L.recommended(L.compared(got), max_fpr=0.1).collect()}
    assert s["combined"].recommended and not s["raw"].recommended and s["combined"].recall > 0.8 and 0 <= s["combined"].ece < 0.3
    made = [("raw", 0.01, 0.79), ("combined", 0.02, 0.8), ("tfidf", 0.9, 0.99), ("prior", None, None)]
    pick = lambda rows: [r.method for r in L.recommended(spark.createDataFrame(rows, "method string, fpr double, recall double")).collect() if r.recommended]
    assert pick(made) == ["raw"] and pick([("raw", 0.01, 0.7), *made[1:]]) == ["combined"] and pick(made[2:]) == []


def test_threshold_needs_both_classes(spark):
    rows = spark.createDataFrame([("a", 0, "scored", 0.5), ("b", 0, "scored", 0.7)], "source_id string, label int, status string, calibrated double")
    with pytest.raises(Exception, match="both classes"):
        L.select_threshold(rows, [0.05]).collect()


def _as_frame(spark, rows):
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=(len(rows), 3)) + rows["label"].to_numpy()[:, None]
    data = rows.assign(features=x.tolist(), status=np.where(rows.doc_id % 17 == 3, "insufficient", "scored"))
    data.loc[data.doc_id % 17 == 3, ["features", "raw"]] = None
    data.loc[data.doc_id == 50, "text"] = None
    schema = "doc_id long, source_id string, label long, status string, raw double, text string, features array<double>"
    return spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), schema)


def test_comparison_over_partitions_is_the_one_in_memory(spark, rows):
    """Each step as a sum over the partitions gives what one task for a fold gives, and no task gets a fold's rows."""
    df, methods = _as_frame(spark, rows), ("raw", "prior", "combined", "tfidf")
    held = L.cross_validated(df, methods)
    assert "FlatMapGroupsInPandas" not in held._jdf.queryExecution().toString()
    one = held.toPandas().sort_values(["method", "doc_id"]).reset_index(drop=True)
    more = L.cross_validated(df, methods, alone=0).toPandas().sort_values(["method", "doc_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, more, rtol=1e-9)
    assert len(one) == 4 * len(rows) and (one.calibrated.isna() == (one.status != "scored")).all()


def test_threshold_is_the_least_that_fits():
    """Byte by byte over blocks, with ties, against a search through all candidates."""
    rng = np.random.Generator(np.random.PCG64(3))
    label, x = (rng.random(400) < 0.4).astype(float), np.round(rng.normal(size=(3, 400)), 1)
    p, out, more = np.array([[1.5, -0.7, 0.0], [0.2, 0.1, -1.0]]), rng.random((3, 400)) < 0.8, np.array([0, 40, 3])
    own = (out & (label == 0)).sum(axis=1)
    cells = L._Held([{"label": label[i : i + 70], "x": x[:, i : i + 70], "out": out[:, i : i + 70]} for i in range(0, 400, 70)])
    for max_fpr in (0.0, 0.05, 0.3, 0.999, 1.0):
        got = L._thresholds(cells.total, p, own, own + more, max_fpr)
        for m in range(3):
            c = L._sigmoid(p[1, m] + p[0, m] * x[m])
            fits = lambda t, m=m, c=c: (c[out[m] & (label == 0)] >= t).sum() / (own + more)[m] <= max_fpr
            assert got[m] == next(t for t in [*np.unique(c[out[m]]), L.ABSTAIN_ALL] if fits(t)), (max_fpr, m)


def test_a_task_holds_one_block_at_a_time():
    """40 blocks of a megabyte, and what is made of them, take a few megabytes of memory however often they are summed."""

    class Alone:
        def total(self, part, add):
            return part

    tracemalloc.start()
    with L._Spread((pickle.dumps({"x": np.full(1 << 17, float(i))}) for i in range(40)), Alone(), lambda b: b) as s:
        with s.mapped(lambda b: {"x": b["x"] + 1}) as more:
            assert [more.total(lambda b: b["x"].sum()) for _ in range(2)] == [(1 << 17) * 820.0] * 2
            assert s.total(lambda b: b["x"].max(), np.maximum) == 39
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20


def test_comparison_refuses_what_no_fit_can_take(spark, rows):
    with pytest.raises(ValueError, match="both classes"):
        L.cross_validated(spark.createDataFrame(rows.assign(label=0)), ("tfidf",))
    with pytest.raises(ValueError, match="finite"):
        L.cross_validated(spark.createDataFrame(rows.assign(features=[[1.0, float("nan")]] * len(rows))), ("combined",))
