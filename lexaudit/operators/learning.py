"""Fixed-step logistic regression, calibration maps, thresholds, TF-IDF, and grouped comparisons.

A fit runs the same number of full-batch steps every time.  One-dimensional fits
(calibration) run on counts of distinct (score, label), which stay small at any
number of rows; many-dimensional ones run over partitions (``fit_distributed``),
and those of a comparison all at once (``cross_validated``).
"""

from __future__ import annotations

import functools
import hmac
import io
import os
import pickle
import secrets
import socket
import struct
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H
from ..functions import text as T
from .shared import cut, running

CALIBRATION = {"decay": 0.001, "rate": 0.05, "steps": 1200}
ABSTAIN_ALL = 1.000001


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit_logistic(x, y, steps: int = 500, decay: float = 0.01, rate: float = 0.3, weight=None) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``steps`` full-batch gradient steps from zero; L2 on the weights only."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim != 2 or len(x) != len(y) or len(x) < 2 or len(set(y.tolist())) != 2:
        raise ValueError("fitting needs both classes and as many rows of features as labels")
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    share = np.full(len(y), 1 / len(y)) if weight is None else np.asarray(weight, float) / np.sum(weight)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = (_sigmoid(b + x @ w) - y) * share
        w, b = w - rate * (decay * w + error @ x), b - rate * error.sum()
    return w, float(b)


def fit_distributed(rows: DataFrame, dims: int, steps: int = 500, decay: float = 0.01, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """The same fit over partitions: each step sums one gradient per partition. rows: features array<double>, label."""
    rows = rows.select("features", "label").cache()
    n, w, b = rows.count(), np.zeros(dims), 0.0
    for _ in range(steps):
        wb = (w, b)

        def gradients(parts, wb=wb):
            total = np.zeros(dims + 1)
            for p in parts:
                if len(p):
                    x = np.stack(p["features"].to_numpy())
                    error = _sigmoid(wb[1] + x @ wb[0]) - p["label"].to_numpy()
                    total += np.append(error @ x, error.sum())
            yield pd.DataFrame({"k": range(dims + 1), "g": total})

        g = {r.k: r.g for r in rows.mapInPandas(gradients, "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()}
        w, b = w - rate * (decay * w + np.array([g[i] for i in range(dims)]) / n), b - rate * g[dims] / n
    rows.unpersist()
    return w, b


def predicted(features: Column, weights: list[float], intercept: float) -> Column:
    """Probability of an array of features."""
    w = F.array(*map(F.lit, weights))
    return H.sigmoid(F.lit(intercept) + F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def fit_calibration(rows: DataFrame, by: list[str] = (), raw: str = "raw", label: str = "label") -> DataFrame:
    """(by, weight, intercept): a logistic map of logit(raw) over scored rows, fitted on their counts."""
    counts = rows.filter(F.col("status") == "scored").groupBy(*by, F.col(raw).alias("raw"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    keys = list(by)
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "weight double, intercept double"])

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["raw", "label"])
        w, b = fit_logistic(logit(p["raw"].to_numpy())[:, None], p["label"], weight=p["n"], **CALIBRATION)
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "weight": [w[0]], "intercept": [b]})

    return counts.groupBy(*keys).applyInPandas(fit, schema)


def calibrated(rows: DataFrame, maps: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Rows with ``calibrated`` from the map of their group; null without a raw score."""
    j = rows.join(F.broadcast(maps), list(by))
    return j.withColumn("calibrated", F.when(F.col("status") == "scored", H.sigmoid(F.col("intercept") + F.col("weight") * H.logit(raw)))).drop("weight", "intercept")


def select_threshold(rows: DataFrame, targets: list[float], by: list[str] = ()) -> DataFrame:
    """(by, target, threshold): the least score at which false positives over all negatives stay within the target."""
    keys = list(by)
    negatives = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))
    scored = rows.filter((F.col("status") == "scored") & F.col("calibrated").isNotNull()).groupBy(*keys, F.col("calibrated").alias("score")).agg(F.count_if(F.col("label") == 0).alias("fp"))
    cum = running(scored.withColumnRenamed("fp", "own"), [F.desc("score")], {"fp": "own"}, keys).drop("own")
    goals = F.explode(F.array(*map(F.lit, targets))).alias("target")
    both = F.assert_true((F.col("negatives") > 0) & (F.col("positives") > 0), "threshold selection needs both classes")
    base = negatives.select(*keys, "negatives", goals, both.alias("checked")).filter("checked is null").drop("checked")
    # one row for each group and target goes to the scores, which may be as many as there are rows
    one = keys or ["__one"]
    base, cum = (base, cum) if keys else (base.withColumn("__one", F.lit(1)), cum.withColumn("__one", F.lit(1)))
    wide = cum.join(F.broadcast(base) if not keys else base, one)
    fits = F.when(F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double")) <= F.col("target"), F.col("score"))
    best = wide.groupBy(*one, "target").agg(F.min(fits).alias("least"))
    return base.join(best, [*one, "target"], "left").select(*keys, "target", F.coalesce("least", F.lit(ABSTAIN_ALL)).alias("threshold"))


# --- TF-IDF --------------------------------------------------------------------------------------------
def tfidf_vocabulary(docs: DataFrame, id_col: str, text_col: str = "text", features: int = 1500) -> DataFrame:
    """(term, df, idf): terms of at least two documents, the most frequent ones first, ties by term."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(T.tokens(text_col))).alias("term"))
    top = terms.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2").orderBy(F.desc("df"), "term").limit(features)
    return top.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, value) of unit length; the vocabulary is bounded by its number of features, so it is broadcast."""
    tf = docs.select(id_col, F.explode(T.tokens(text_col)).alias("term")).join(F.broadcast(vocabulary.select("term", "idf")), "term")
    tf = tf.groupBy(id_col, "term", "idf").agg(F.count("*").alias("tf")).withColumn("v", (1 + F.log("tf")) * F.col("idf"))
    norms = tf.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return tf.join(norms, id_col).select(id_col, "term", (F.col("v") / F.col("norm")).alias("value"))


def fold_vocabularies(rows: DataFrame, folds: int, features: int = 1500) -> DataFrame:
    """(fold, place, term, idf): for each fold the vocabulary of the rows that are not its own. rows: own, text.

    Documents of a term are counted once for each fold of its own; each training count is the total less one fold's.
    """
    each = rows.select("own", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).groupBy("own", "term").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("own").agg(F.count("*").alias("n_docs"))
    spread = each.groupBy("term").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("own") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(folds)])
    df = spread.select("term", F.inline(F.array(*[F.struct(F.lit(k).alias("fold"), (F.col("total") - F.col(f"n{k}")).alias("df")) for k in range(folds)]))).filter("df >= 2")
    place = lambda *by: F.row_number().over(Window.partitionBy("fold", *by).orderBy(F.desc("df"), "term"))
    # the first ones of each part by hash, then those of all parts: no task sorts a fold's whole list of terms
    first = df.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64))).withColumn("place", place("part")).filter(F.col("place") <= features)
    top = first.drop("part").withColumn("place", place()).filter(F.col("place") <= features)
    n = sizes.agg(F.sum("n_docs").alias("all"), F.map_from_entries(F.collect_list(F.struct("own", "n_docs"))).alias("own"))
    n = n.select(F.explode(F.array(*map(F.lit, range(folds)))).alias("fold"), "all", "own").select("fold", (F.col("all") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))).alias("n_train"))
    return top.join(F.broadcast(n), "fold").select("fold", (F.col("place") - 1).alias("place"), "term", (F.log(F.lit(1.0) + F.col("n_train")) - F.log(1 + F.col("df")) + 1).alias("idf"))


# --- comparisons ---------------------------------------------------------------------------------------
# All folds and methods descend together.  Rows stand in blocks: small pickled sets of arrays, which tasks read one
# after another, so that a task holds one block and its sums whatever the number of rows.
def _pack(ids: pa.RecordBatch, data: pa.RecordBatch, words: np.ndarray, idf: np.ndarray) -> bytes:
    """One block. data: own, label, status, raw, and features and hashes where there are; words: sorted hashes of all vocabularies, idf: (fold, word), 0 outside a fold's."""
    n, col = data.num_rows, lambda c: data.column(data.schema.get_field_index(c))
    number = lambda c: col(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as w:
        w.write_batch(ids)
    ok = pc.equal(col("status"), "scored").fill_null(False).to_numpy(zero_copy_only=False)
    block = {"ids": sink.getvalue().to_pybytes(), "own": col("own").fill_null(-1).to_numpy().astype(np.int32), "label": number("label"), "ok": ok, "raw": number("raw")}
    if "features" in data.schema.names:
        f = col("features")
        there = f.is_valid().to_numpy(zero_copy_only=False)
        x = [np.asarray(v, float) for v in f.drop_null().to_pylist()]
        block |= {"usable": there, "x": np.full((n, len(x[0]) if x else 0), np.nan)}
        if x:
            block["x"][there] = np.stack(x)
    if "hashes" in data.schema.names:
        h = col("hashes")
        lengths = h.value_lengths().fill_null(0).to_numpy()
        flat = h.flatten().to_numpy()
        place = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
        known = words[place] == flat if len(words) else np.zeros(len(flat), bool)
        cells, tf = np.unique(np.repeat(np.arange(n), lengths)[known] * len(words) + place[known], return_counts=True)
        row, column = np.divmod(cells, max(len(words), 1))
        counts, code = np.unique(tf, return_inverse=True)
        values = 1 + np.log(counts)
        squares = [np.bincount(row, np.square(values[code] * i[column]), n) for i in idf]
        norm = np.sqrt(np.stack(squares))
        small = lambda x, top: x.astype(np.min_scalar_type(top))
        block |= {"size": np.bincount(row, minlength=n).astype(np.int32), "column": small(column, len(words)), "values": values, "code": small(code, len(values)), "norm": np.where(norm == 0, 1, norm)}
    return pickle.dumps(block, protocol=5)


def _blocks(rows: DataFrame, words: np.ndarray, idf: np.ndarray, entries: int = 150_000, most: int = 2_000) -> DataFrame:
    """(block): all rows, in blocks of at most ``most`` rows and about ``entries`` tokens (one row may have more)."""
    names = rows.columns

    def make(batches):
        for batch in batches:
            tokens = np.ones(batch.num_rows, np.int64)
            if "hashes" in names:
                tokens += batch.column(names.index("hashes")).value_lengths().fill_null(0).to_numpy()
            ends, start = np.cumsum(tokens), 0
            while start < batch.num_rows:
                full = np.searchsorted(ends, (ends[start - 1] if start else 0) + entries, "right")
                stop = max(start + 1, min(int(full), start + most))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(part.select(["doc_id", "source_id", "label", "status"]), part, words, idf)], pa.binary())], names=["block"])
                start = stop

    return rows.mapInArrow(make, "block binary")


def _fold_counts(block: dict, folds: int) -> np.ndarray:
    """(fold, 9): rows, positives and negatives outside each fold, of all, scored and usable rows."""
    groups = [np.ones(len(block["own"]), bool), block["ok"], block.get("usable", block["ok"])]
    y = block["label"]
    return np.array([[np.count_nonzero(g & of & (block["own"] != k)) for g in groups for of in (np.ones(len(y), bool), y == 1, y == 0)] for k in range(folds)])


def _opened(block: dict) -> dict:
    """The block with its entries as numbers to compute with, and where each row that has entries begins."""
    if "size" in block:
        full = np.flatnonzero(block["size"])
        block |= {"t": block["values"][block["code"]], "c": block["column"].astype(np.intp), "full": full, "start": (np.cumsum(block["size"]) - block["size"])[full]}
    return block


def _slopes(block: dict, p: np.ndarray, ks: list[int], n: dict, idf: np.ndarray, dims: int) -> np.ndarray:
    """The block's part of the gradients of TF-IDF (first idf.shape[1] + 1 rows of ``p``) and combined (the last dims + 1) in the folds ``ks``."""
    g, v = np.zeros_like(p), idf.shape[1]
    y = block["label"]
    for j, k in enumerate(ks):
        out = block["own"] != k
        if v and "size" in block:
            w, z = p[:v, j] * idf[k], np.zeros(len(y))
            if len(block["full"]):
                z[block["full"]] = np.add.reduceat(w.take(block["c"], mode="clip") * block["t"], block["start"])
            e = (_sigmoid(p[v, j] + z / block["norm"][k]) - y) * out / n["all"][k]
            g[:v, j] = idf[k] * np.bincount(block["c"], block["t"] * np.repeat(e / block["norm"][k], block["size"]), v)
            g[v, j] = e.sum()
        if dims:
            use = out & block["usable"]
            x = block["x"][use]
            if len(x):
                e = (_sigmoid(p[-1, j] + x @ p[-1 - dims : -1, j]) - y[use]) / n["usable"][k]
                g[-1 - dims : -1, j], g[-1, j] = e @ x, e.sum()
    return g


def _raw(block: dict, method: str, k: int, p: np.ndarray, prior: np.ndarray, idf: np.ndarray, dims: int) -> np.ndarray:
    """Scores of all rows by the models of fold k. A row's sum has one order, so equal rows have equal scores."""
    v, n = idf.shape[1], len(block["own"])
    if method == "tfidf":
        z = np.bincount(np.repeat(np.arange(n), block["size"]), (p[:v, k] * idf[k])[block["c"]] * block["t"], n) / block["norm"][k]
        return _sigmoid(p[v, k] + z)
    if method == "combined":
        return _sigmoid(p[-1, k] + (block["x"] * p[-1 - dims : -1, k]).sum(axis=1)) if block["x"].shape[1] else np.full(n, np.nan)
    return np.full(n, prior[k]) if method == "prior" else block["raw"]


def _map_slopes(s: dict, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of some scored rows in the gradients of the calibration maps: x (map, row), out (map, row), label."""
    e = (_sigmoid(p[1][:, None] + p[0][:, None] * s["x"]) - s["label"]) * s["out"] / n[:, None]
    return np.stack([(e * s["x"]).sum(axis=1), e.sum(axis=1)])


def _digits(s: dict, p: np.ndarray, found: np.ndarray, byte: int) -> np.ndarray:
    """(map, 256): how many negatives have which next byte of their score, of those that share the bytes found."""
    c = _sigmoid(p[1][:, None] + p[0][:, None] * s["x"]).view(np.uint64)
    shift = np.uint64(8 * (7 - byte))
    use = s["out"] & (s["label"] == 0) & ((c >> shift >> np.uint64(8)) == found[:, None] if byte else True)
    digit = ((c >> shift) & np.uint64(255)).astype(np.intp)
    return np.stack([np.bincount(d[u], minlength=256) for d, u in zip(digit, use, strict=True)])


def _least(s: dict, p: np.ndarray, over: np.ndarray) -> np.ndarray:
    c = _sigmoid(p[1][:, None] + p[0][:, None] * s["x"])
    return np.where(s["out"] & (c > over[:, None]), c, ABSTAIN_ALL).min(axis=1, initial=ABSTAIN_ALL)


def _thresholds(total, p: np.ndarray, scored_negatives: np.ndarray, negatives: np.ndarray, max_fpr: float) -> np.ndarray:
    """For each map the least score at which false positives stay within ``max_fpr``: over the negative of the first rank that does not fit, found byte by byte."""
    allowed = np.floor(max_fpr * negatives).astype(np.int64) + 1
    while (over := allowed / negatives > max_fpr).any():
        allowed = allowed - over
    left, found = allowed.copy(), np.zeros(len(negatives), np.uint64)
    for byte in range(8):
        upward = np.cumsum(total(lambda s, found=found, byte=byte: _digits(s, p, found, byte))[:, ::-1], axis=1)
        k = np.argmax(upward > left[:, None], axis=1)
        left = left - np.where(k > 0, np.take_along_axis(upward, np.maximum(k - 1, 0)[:, None], 1)[:, 0], 0)
        found = (found << np.uint64(8)) | (255 - k).astype(np.uint64)
    bound = np.where(scored_negatives > allowed, found.view(float), -1.0)
    return total(lambda s: _least(s, p, bound), np.minimum)


def _descend(total, slopes, start: np.ndarray, decayed: np.ndarray, steps: int, decay: float, rate: float) -> np.ndarray:
    p = start
    for _ in range(steps):
        p = p - rate * (decay * decayed * p + total(lambda b, p=p: slopes(b, p)))
    return p


def _fitted(blocks, methods: tuple[str, ...], ks: list[int], n: dict, idf: np.ndarray, dims: int, max_fpr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(models, maps, thresholds) of the folds ``ks``, by sums over blocks (``_Held`` or ``_Spread``): models (parameter, fold), maps (2, method and fold)."""
    v, folds = idf.shape[1], len(ks)
    p = np.zeros((v + 1 + dims + 1, folds))
    if "tfidf" in methods or dims:
        decayed = np.ones((len(p), 1))
        decayed[[v, -1]] = 0
        p = _descend(blocks.total, lambda b, q: _slopes(b, q, ks, n, idf, dims), p, decayed, 500, 0.01, 0.3)
    full = np.zeros((len(p), len(n["all"])))
    full[:, ks] = p

    def scores(b):
        y, own = b["label"][b["ok"]], b["own"][b["ok"]]
        x = [logit(_raw(b, m, k, full, n["prior"], idf, dims)[b["ok"]]) for m in methods for k in ks]
        return {"label": y, "x": np.stack(x), "out": np.stack([own != k for m in methods for k in ks])}

    each = lambda name: np.array([n[name][k] for _ in methods for k in ks])
    ok = each("ok")
    with blocks.mapped(scores) as s:
        maps = _descend(s.total, lambda b, q: _map_slopes(b, q, ok), np.zeros((2, len(methods) * folds)), np.array([[1.0], [0.0]]), CALIBRATION["steps"], CALIBRATION["decay"], CALIBRATION["rate"])
        return p, maps, _thresholds(s.total, maps, each("ok_negatives"), each("negatives"), max_fpr)


class _Held:
    """Blocks in memory."""

    def __init__(self, blocks: list):
        self.blocks = blocks

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.blocks = []

    def total(self, f, add=np.add):
        return functools.reduce(add, map(f, self.blocks))

    def mapped(self, f):
        return _Held(list(map(f, self.blocks)))


class _Peers:
    """Sums over the tasks of a barrier stage, in order of their places; all tasks get the same. A job for each step would cost more than the step."""

    def __init__(self):
        task = BarrierTaskContext.get()
        place, infos = task.partitionId(), task.getTaskInfos()
        host = infos[0].address.rsplit(":", 1)[0].strip("[]")
        server = socket.create_server((host, 0), backlog=len(infos), family=socket.AF_INET6 if ":" in host else socket.AF_INET) if place == 0 else None
        port, secret = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(32)}" if server else "")[0].split()
        self.first, self.ends = place == 0, []
        if server:
            found = {}
            with server:
                server.settimeout(300)
                while len(found) < len(infos) - 1:
                    end = self._end(server.accept()[0])
                    said = end.read(64 + 8)
                    if hmac.compare_digest(said[:64], secret.encode()):
                        found[int(said[64:])] = end
            self.ends = [found[k] for k in sorted(found)]
        else:
            self.ends = [self._end(socket.create_connection((host, int(port)), 300))]
            self.ends[0].write(secret.encode() + b"%8d" % place)
            self.ends[0].flush()

    @staticmethod
    def _end(s: socket.socket):
        s.settimeout(1800)
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return s.makefile("rwb")

    @staticmethod
    def _send(end, x: np.ndarray | None) -> None:
        held = io.BytesIO()
        if x is not None:
            np.save(held, x, allow_pickle=False)
        end.write(struct.pack("<q", held.tell()) + held.getvalue())
        end.flush()

    @staticmethod
    def _take(end) -> np.ndarray | None:
        size = struct.unpack("<q", end.read(8))[0]
        return np.load(io.BytesIO(end.read(size)), allow_pickle=False) if size else None

    def total(self, part: np.ndarray | None, add) -> np.ndarray:
        if not self.first:
            self._send(self.ends[0], part)
            return self._take(self.ends[0])
        out = functools.reduce(add, [x for x in [part, *map(self._take, self.ends)] if x is not None])
        for end in self.ends:
            self._send(end, out)
        return out


class _Spread:
    """The blocks of one of several tasks, in a local file of which one block is in memory at a time; sums go over all tasks."""

    def __init__(self, blocks, peers: _Peers, opened=_opened):
        self.peers, self.opened = peers, opened
        self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for b in blocks:
            self.file.write(struct.pack("<q", len(b)) + b)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def __iter__(self):
        self.file.seek(0)
        while head := self.file.read(8):
            yield self.opened(pickle.loads(self.file.read(struct.unpack("<q", head)[0])))

    def total(self, f, add=np.add):
        out = None
        for b in self:
            part = f(b)
            out = part if out is None else add(out, part)
        return self.peers.total(out, add)

    def mapped(self, f):
        return _Spread((pickle.dumps(f(b), protocol=5) for b in self), self.peers, lambda b: b)


def _summed(rdd, f, add=np.add) -> np.ndarray:
    """The sum of ``f`` over blocks in an RDD: one job, which brings one array from each partition."""

    def run(parts):
        out = None
        for b in parts:
            part = f(pickle.loads(b))
            out = part if out is None else add(out, part)
        return [] if out is None else [out]

    return functools.reduce(add, rdd.mapPartitions(run).collect())


def cross_validated(rows: DataFrame, methods: tuple[str, ...] = ("raw", "prior", "tfidf"), folds: int = 5, max_fpr: float = 0.05, features: int = 1500, alone: int = 8 << 20) -> DataFrame:
    """Held-out predictions of each method: (method, fold, doc_id, source_id, label, status, calibrated, threshold).

    A fold refits, calibrates and thresholds without its own rows.  Texts do not travel: Spark makes the vocabularies, and
    sparse vectors are written once for all folds, without a shuffle of terms.  Blocks of up to ``alone`` bytes are fitted
    in one task for each fold; else all tasks of a barrier stage fit together, and each step sums gradients over them.
    Rows: doc_id, source_id, label (0 or 1), status, raw, text for tfidf, and features (array of numbers) for combined.
    """
    spark = rows.sparkSession
    names = ["doc_id", "source_id", "label", "status"]
    keyed = rows.withColumn("own", F.coalesce(H.hash_fold("source_id", folds), F.lit(-1)))
    kind = {c: rows.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join(f"{c} {kind[c]}" for c in names) + ", method string, calibrated double, threshold double, fold int"
    more = [F.col("features").cast("array<double>").alias("features")] if "combined" in methods else []
    words, idf = np.empty(0, np.int64), np.zeros((folds, 0))
    if "tfidf" in methods:
        # bounded by the number of features and folds
        vocabulary = fold_vocabularies(keyed.select("own", "text"), folds, features).select("fold", F.xxhash64("term").alias("h"), "idf").collect()
        words = np.array(sorted({r.h for r in vocabulary}), np.int64)
        idf = np.zeros((folds, len(words)))
        for r in vocabulary:
            idf[r.fold, np.searchsorted(words, r.h)] = r.idf
        more.append(F.transform(T.tokens("text"), lambda t: F.xxhash64(t)).alias("hashes"))
    made = _blocks(keyed.select(*names, "raw", "own", *more), words, idf)
    # as many partitions as tasks can run at once: those of a barrier stage have to
    sc = spark.sparkContext._jsc.sc()
    slots = max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))
    made = cut(spark, made.repartition(slots))
    size = made.agg(F.sum(F.octet_length("block"))).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    blocks = made.rdd.map(lambda r: bytes(r[0]))
    counts = _summed(blocks, lambda b: _fold_counts(b, folds))
    dims = int(_summed(blocks, lambda b: np.array(b["x"].shape[1]), np.maximum)) if "combined" in methods else 0
    bad = _summed(blocks, lambda b: _unfit(b, methods, dims))
    need = [3, *([0] if "tfidf" in methods else []), *([6] if "combined" in methods else [])]
    if bad[0] or any((counts[:, i + 1 : i + 3] == 0).any() for i in need):
        raise ValueError("fitting needs both classes and as many rows of features as labels")
    if bad[1]:
        raise ValueError("features must be finite")
    n = {"all": counts[:, 0], "prior": counts[:, 1] / counts[:, 0], "negatives": counts[:, 2], "ok": counts[:, 3], "ok_negatives": counts[:, 5], "usable": counts[:, 6]}
    if size <= alone:
        held = spark.sparkContext.broadcast(blocks.collect())
        one = lambda k: _fitted(_Held([_opened(pickle.loads(b)) for b in held.value]), methods, [k], n, idf, dims, max_fpr)
        each = spark.sparkContext.parallelize(range(folds), folds).map(one).collect()
        held.destroy()
        p = np.concatenate([e[0] for e in each], axis=1)
        maps, thresholds = np.stack([e[1] for e in each], axis=2), np.stack([e[2] for e in each], axis=1)
    else:

        def fit(parts):
            peers = _Peers()
            with _Spread(parts, peers) as mine:
                fitted = _fitted(mine, methods, list(range(folds)), n, idf, dims, max_fpr)
            return [fitted] if peers.first else []

        p, maps, thresholds = blocks.barrier().mapPartitions(fit).collect()[0]
        maps, thresholds = maps.reshape(2, len(methods), folds), thresholds.reshape(len(methods), folds)

    def judge(batches):
        for batch in batches:
            for one in batch.column(0):
                b = _opened(pickle.loads(one.as_buffer()))
                ids = pa.ipc.open_stream(b["ids"]).read_next_batch()
                for i, m in enumerate(methods):
                    for k in np.unique(b["own"][b["own"] >= 0]):
                        c = _sigmoid(maps[1, i, k] + maps[0, i, k] * logit(_raw(b, m, k, p, n["prior"], idf, dims)))
                        mine = b["own"] == k
                        own = ids.filter(pa.array(mine))
                        count = own.num_rows
                        score = pa.array(c[mine], mask=~b["ok"][mine])
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([m] * count), score, pa.array(np.full(count, thresholds[i, k])), pa.array(np.full(count, k, np.int32))], names=[*names, "method", "calibrated", "threshold", "fold"])

    return made.mapInArrow(judge, schema)


def _unfit(block: dict, methods: tuple[str, ...], dims: int) -> np.ndarray:
    """How many rows have a label that is not 0 or 1, and how many a number that no fit can take."""
    wrong = ~np.isin(block["label"], (0, 1))
    lost = np.zeros(len(wrong), bool)
    if "combined" in methods:
        finite = np.isfinite(block["x"]).all(axis=1) if block["x"].shape[1] == dims else np.zeros(len(wrong), bool)
        lost |= (block["usable"] | block["ok"]) & ~finite
    if any(m not in ("tfidf", "combined", "prior") for m in methods):
        lost |= block["ok"] & ~np.isfinite(block["raw"])
    return np.array([wrong.sum(), lost.sum()])


def compared(predictions: DataFrame) -> DataFrame:
    """One row for each method: fpr, recall, precision, f1, coverage at the folds' own thresholds; auroc, brier and ece of the scores."""
    from . import metrics as M

    predictions = cut(predictions.sparkSession, predictions)  # each metric would fit the models anew
    decided = predictions.withColumn("calibrated", F.when(F.col("calibrated").isNotNull(), (F.col("calibrated") >= F.col("threshold")).cast("double")))
    point = M.rates(M.confusion(decided, 0.5, ["method"])).select("method", "fpr", "recall", "precision", "f1", "coverage")
    s = M.by_score(predictions, ["method"])
    for part in (M.ranking(s, ["method"]), M.brier(predictions, ["method"]), M.ece(M.reliability(s, ["method"]), ["method"])):
        point = point.join(part, "method", "left")
    return point


def recommended(summaries: DataFrame, simple: tuple[str, ...] = ("raw",), max_fpr: float = 0.05, least_recall: float = 0.5, within: float = 0.02) -> DataFrame:
    """``summaries`` with ``recommended``: of the methods within the bounds the one of most recall, ties by name; a simple one that is ``within`` of it goes first."""
    fits = F.coalesce((F.col("fpr") <= max_fpr) & (F.col("recall") >= least_recall), F.lit(False))
    best = summaries.filter(fits).agg(F.max("recall").alias("__best"))
    close = F.col("method").isin(*simple) & (F.col("recall") >= F.col("__best") - within)
    order = F.struct(F.when(close, 0).otherwise(1), -F.col("recall"), "method")
    ranked = summaries.join(F.broadcast(best), F.lit(True), "left").withColumn("__fits", fits)
    first = ranked.filter("__fits").agg(F.min_by("method", order).alias("__first"))
    return ranked.join(F.broadcast(first), F.lit(True), "left").withColumn("recommended", F.coalesce(F.col("method") == F.col("__first"), F.lit(False))).select(*summaries.columns, "recommended")
