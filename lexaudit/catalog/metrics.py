"""Evaluation queries: counts, rates, ranking, calibration, bootstrap, gates, latency and study summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators.shared import cut
from .base import labelled, query, table

T0 = 0.6
R = 1000
_MARK = f"(status = 'scored' AND calibrated >= {T0})"


def _conf(by: str, src: str = "labelled") -> str:
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}count(*) AS n, count_if(label = 1)::BIGINT AS positive, count_if(label = 0)::BIGINT AS negative, count_if(coalesce({_MARK}, FALSE) AND label = 1)::BIGINT AS tp,
count_if(coalesce({_MARK}, FALSE) AND label = 0)::BIGINT AS fp, count_if(status = 'scored')::BIGINT AS scored, count_if(status = 'scored' AND label = 1)::BIGINT AS scored_positive, count_if(status = 'failed')::BIGINT AS failed,
(count(*) - count_if(status = 'scored'))::BIGINT AS abstained FROM {src}""" + (f" GROUP BY {by}" if by else "")


def _rates(src: str) -> str:
    d = lambda a, b, c: f"round({a}::DOUBLE / nullif({b}, 0), 9) AS {c}"
    return ", ".join([d("scored", "n", "coverage"), d("fp", "negative", "fpr"), d("tp", "positive", "recall"), d("tp", "(tp + fp)", "precision"), d("(2 * tp)", "(positive + tp + fp)", "f1"), d("tp", "scored_positive", "answered_recall"), d("fp", "(scored - scored_positive)", "answered_fpr")])


RATES = ("coverage", "fpr", "recall", "precision", "f1", "answered_recall", "answered_fpr")
_SCORES = ", sc AS (SELECT domain, calibrated AS score, count(*) AS n, sum(label) AS p FROM labelled WHERE status = 'scored' GROUP BY ALL)"
_RANK = f"""{_SCORES}, w AS (SELECT *, sum(p) OVER a AS cp, sum(n) OVER a AS cn, sum(p) OVER (PARTITION BY domain) AS tp, sum(n) OVER (PARTITION BY domain) AS tn FROM sc WINDOW a AS (PARTITION BY domain ORDER BY score DESC))"""
_BINS = """, u AS (SELECT calibrated AS score, count(*) AS n, sum(label) AS p FROM labelled WHERE status = 'scored' GROUP BY ALL),
c AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY score)::BIGINT AS e, sum(n) OVER ()::BIGINT AS total FROM u),
b AS (WITH RECURSIVE r(k, lo) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, (SELECT min(e) FROM c WHERE e >= least(total, lo + ceil(total / 10.0)::BIGINT)) FROM r WHERE k < 10 AND lo < (SELECT max(total) FROM c)) SELECT * FROM r),
bins AS (SELECT bin, sum(n)::BIGINT AS n, sum(n * score) / sum(n) AS score, sum(p)::DOUBLE / sum(n) AS rate FROM (SELECT c.*, (SELECT count(*) FROM b WHERE lo < e)::INT AS bin FROM c) GROUP BY bin)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(f", k AS ({_conf('domain')}), {_RANK[2:]}, a AS (SELECT domain, round(sum((n - p) * (cp - p + p / 2.0)) / nullif(max(tp) * (max(tn) - max(tp)), 0)::DOUBLE, 9) AS auroc, round(sum(p * cp / cn::DOUBLE) / nullif(max(tp), 0), 9) AS auprc FROM w GROUP BY domain), "
       "br AS (SELECT domain, round(avg((calibrated - label) ** 2), 9) AS brier FROM labelled WHERE status = 'scored' GROUP BY domain) "
       f"SELECT k.domain, k.* EXCLUDE (domain), {_rates('k')}, auroc, auprc, brier FROM k LEFT JOIN a USING (domain) LEFT JOIN br USING (domain)", True)  # fmt: skip
def flagship_metrics(spark, d):
    """Score, calibrate and evaluate all labelled documents by language."""
    rows = labelled(spark, d)
    out = M.rates(M.confusion(rows, T0, ["domain"])).join(M.ranking(M.by_score(rows, ["domain"]), ["domain"]), "domain", "left").join(M.brier(rows, ["domain"]), "domain", "left")
    return _rounded(out, *RATES, "auroc", "auprc", "brier")


@query(_conf("domain"), True)
def confusion_counts(spark, d):
    return M.confusion(labelled(spark, d), T0, ["domain"])


@query(f", k AS ({_conf('')}) SELECT {_rates('k')} FROM k", True)
def point_metrics(spark, d):
    return _rounded(M.rates(M.confusion(labelled(spark, d), T0)).select(*RATES), *RATES)


@query(f"{_RANK} SELECT domain, round(sum((n - p) * (cp - p + p / 2.0)) / nullif(max(tp) * (max(tn) - max(tp)), 0)::DOUBLE, 9) AS auroc FROM w GROUP BY domain", True)
def auroc(spark, d):
    return _rounded(M.ranking(M.by_score(labelled(spark, d), ["domain"]), ["domain"]).select("domain", "auroc"), "auroc")


@query(f"{_RANK} SELECT domain, round(sum(p * cp / cn::DOUBLE) / nullif(max(tp), 0), 9) AS auprc FROM w GROUP BY domain", True)
def auprc(spark, d):
    return _rounded(M.ranking(M.by_score(labelled(spark, d), ["domain"]), ["domain"]).select("domain", "auprc"), "auprc")


@query("SELECT domain, round(avg((calibrated - label) ** 2), 9) AS brier FROM labelled WHERE status = 'scored' GROUP BY domain", True)
def brier(spark, d):
    return _rounded(M.brier(labelled(spark, d), ["domain"]), "brier")


@query(f"{_BINS} SELECT bin, n, round(score, 9) AS score, round(rate, 9) AS rate FROM bins", True)
def reliability_bins(spark, d):
    return _rounded(M.reliability(M.by_score(labelled(spark, d))), "score", "rate")


@query(f"{_BINS} SELECT round(sum(n * abs(score - rate)) / sum(n), 9) AS ece FROM bins", True)
def ece(spark, d):
    return _rounded(M.ece(M.reliability(M.by_score(labelled(spark, d)))), "ece")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return e.agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.count("*").alias("n"))


_SRC = f"""src AS ({_conf('source_id')}), o AS (SELECT *, row_number() OVER (ORDER BY source_id) - 1 AS place FROM src),
sn AS (SELECT count(*) AS m FROM src), g AS (SELECT i, i // m AS replicate, m, ((23092026 + (i + 1)::HUGEINT * 1831565813) % 4294967296)::UBIGINT AS s FROM sn, range({R} * m) AS r(i)),
g1 AS (SELECT *, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::UBIGINT AS t FROM g),
g2 AS (SELECT *, xor(t, ((t::HUGEINT + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296) % 4294967296)::UBIGINT) AS v FROM g1),
dr AS (SELECT replicate, floor(xor(v, v >> 14)::DOUBLE / 4294967296 * m)::BIGINT AS place FROM g2),
rp AS (SELECT replicate, sum(positive) AS p, sum(negative) AS n, sum(tp) AS tp, sum(fp) AS fp FROM dr JOIN o USING (place) GROUP BY replicate),
lo AS (SELECT 'fpr' AS metric, fp::DOUBLE / nullif(n, 0) AS x FROM rp UNION ALL SELECT 'recall', tp::DOUBLE / nullif(p, 0) FROM rp UNION ALL SELECT 'f1', 2.0 * tp / nullif(p + tp + fp, 0) FROM rp),
ci AS MATERIALIZED (SELECT metric, round(quantile_disc(x, 0.025), 9) AS low, round(quantile_disc(x, 0.975), 9) AS high, count(*) AS replicates FROM lo WHERE x IS NOT NULL GROUP BY metric)"""


@query(f", {_SRC} SELECT metric, low, high, replicates FROM ci", True)
def bootstrap_intervals(spark, d):
    return _rounded(M.intervals(M.bootstrap(labelled(spark, d), T0, R), ["fpr", "recall", "f1"]), "low", "high")


@query("SELECT k::INT AS sources, round(1 - pow(0.025, 1.0 / k), 9) AS fpr_high, round(pow(0.025, 1.0 / k), 9) AS recall_low FROM range(2, 200) AS r(k)")
def boundary_widening(spark, d):
    k = spark.range(2, 200).select(F.col("id").cast("int").alias("sources"))
    ci = lambda m: k.withColumn("metric", F.lit(m)).withColumn("low", F.lit(1.0)).withColumn("high", F.lit(0.0))
    w = lambda m: M.widened(ci(m), F.lit(0.0), F.lit(1.0), F.col("sources"), F.col("sources"))
    return w("fpr").select("sources", F.round("high", 9).alias("fpr_high")).join(w("recall").select("sources", F.round("low", 9).alias("recall_low")), "sources")


_GATES = "SELECT metric, CASE WHEN metric = 'fpr' THEN CASE WHEN high <= 0.05 THEN 'pass' WHEN low > 0.05 THEN 'fail' ELSE 'inconclusive' END ELSE CASE WHEN low >= 0.5 THEN 'pass' WHEN high < 0.5 THEN 'fail' ELSE 'inconclusive' END END AS gate FROM ci WHERE metric <> 'f1'"


def _gates(spark, d):
    ci = M.intervals(M.bootstrap(labelled(spark, d), T0, R), ["fpr", "recall"])
    low, high = F.col("low"), F.col("high")
    return ci.select("metric", F.when(F.col("metric") == "fpr", M.gate(low, high, 0.05, True)).otherwise(M.gate(low, high, 0.5, False)).alias("gate"))


@query(f", {_SRC} {_GATES}", True)
def gates(spark, d):
    return _gates(spark, d)


_SLICES = """, cn AS (SELECT *, version <> 'v0' OR row_number() OVER (PARTITION BY version = 'v0', source_id, n_words ORDER BY doc_id) = 1 AS canonical, CASE WHEN n_tokens < 8 THEN 'short' WHEN n_tokens < 30 THEN 'medium' ELSE 'long' END AS band FROM (SELECT *, CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 0 ELSE len(string_split_regex(trim(text, E' \\t\\n\\r'), '\\s+')) END AS n_tokens FROM labelled)),
sl AS (SELECT * EXCLUDE (band), unnest(list_filter([CASE WHEN canonical THEN 'overall' END, CASE WHEN canonical AND version = 'v0' THEN 'human_only' END, CASE WHEN generator = 'held-out' THEN 'held_out' END, CASE WHEN version = 'v4' THEN 'v4' END,
'domain:' || domain, 'generator:' || generator, 'version:' || version, 'lengthBand:' || band], lambda x: x IS NOT NULL)) AS slice FROM cn)"""


def _sliced(spark, d, bands: bool = True):
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy(F.col("version") == "v0", "source_id", "n_words").orderBy("doc_id")) == 1
    rows = labelled(spark, d)
    rows = rows.withColumn("lengthBand", T.length_band("text")) if bands else rows
    # texts stay behind: no window, slice or written step carries them
    rows = rows.select("doc_id", "source_id", "label", "status", "calibrated", "generator", "version", "domain", "n_words", *(["lengthBand"] if bands else []))
    rows = rows.withColumn("canonical", (F.col("version") != "v0") | first)
    return M.sliced(rows, F.col("canonical"))


def _study_src(ece: bool) -> str:
    """Intervals of the four slices from the same draws; the calibration error of each resample walks its bins one after another."""
    return f"""{_SLICES}, st AS (SELECT * FROM sl WHERE slice IN ('overall', 'held_out', 'v4', 'human_only')), src AS ({_conf('slice, source_id', 'st')}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY source_id) - 1 AS place FROM src), sn AS (SELECT slice, count(*) AS m FROM src GROUP BY slice),
g AS (SELECT slice, i, i // m AS replicate, m, ((23092026 + (i + 1)::HUGEINT * 1831565813) % 4294967296)::UBIGINT AS s FROM (SELECT slice, m, unnest(range({R} * m)) AS i FROM sn)),
g1 AS (SELECT *, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::UBIGINT AS t FROM g),
g2 AS (SELECT *, xor(t, ((t::HUGEINT + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296) % 4294967296)::UBIGINT) AS v FROM g1),
dr AS MATERIALIZED (SELECT slice, replicate, floor(xor(v, v >> 14)::DOUBLE / 4294967296 * m)::BIGINT AS place FROM g2),
rp AS (SELECT slice, replicate, sum(positive) AS p, sum(negative) AS n, sum(tp) AS tp, sum(fp) AS fp FROM dr JOIN o USING (slice, place) GROUP BY ALL),
wn AS (SELECT replicate, place, count(*) AS times FROM dr WHERE slice = 'overall' GROUP BY ALL),
sc AS (SELECT place, calibrated AS score, count(*) AS n, sum(label) AS p FROM st JOIN o USING (slice, source_id) WHERE slice = 'overall' AND st.status = 'scored' GROUP BY ALL),
u AS (SELECT replicate, score, sum(n * times)::BIGINT AS n, sum(p * times)::BIGINT AS p FROM wn JOIN sc USING (place) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY score)::BIGINT AS e, sum(n) OVER (PARTITION BY replicate)::BIGINT AS total FROM u),
b AS (WITH RECURSIVE r(replicate, total, k, lo) AS (SELECT DISTINCT replicate, total, 0, 0::BIGINT FROM c UNION ALL
  SELECT r.replicate, r.total, r.k + 1, min(c.e) FROM r JOIN c ON c.replicate = r.replicate AND c.e >= least(r.total, r.lo + ceil(r.total / 10.0)::BIGINT) WHERE r.k < 10 AND r.lo < r.total GROUP BY r.replicate, r.total, r.k) SELECT * FROM r),
bins AS (SELECT replicate, bin, sum(n) AS n, sum(n * score) / sum(n) AS score, sum(p)::DOUBLE / sum(n) AS rate FROM (SELECT c.*, (SELECT count(*) FROM b WHERE b.replicate = c.replicate AND lo < e) AS bin FROM c) GROUP BY ALL),
lo AS (SELECT slice, 'fpr' AS metric, fp::DOUBLE / nullif(n, 0) AS x FROM rp UNION ALL SELECT slice, 'recall', tp::DOUBLE / nullif(p, 0) FROM rp UNION ALL SELECT slice, 'f1', 2.0 * tp / nullif(p + tp + fp, 0) FROM rp
  {"UNION ALL SELECT 'overall', 'ece', sum(n * abs(score - rate)) / sum(n) FROM bins GROUP BY replicate" if ece else ""}),
tt AS (SELECT slice, sum(fp) AS fp, sum(negative) AS neg, sum(tp) AS tp, sum(positive) AS pos, count_if(negative > 0) AS ns, count_if(positive > 0) AS ps FROM src GROUP BY slice),
ci0 AS (SELECT slice, metric, quantile_disc(x, 0.025) AS low, quantile_disc(x, 0.975) AS high, count(*) AS replicates FROM lo WHERE x IS NOT NULL GROUP BY ALL),
ci AS MATERIALIZED (SELECT slice, metric, CASE WHEN metric = 'recall' AND tp = pos AND ps >= 2 THEN least(low, pow(0.025, 1.0 / ps)) ELSE low END AS low, CASE WHEN metric = 'fpr' AND fp = 0 AND ns >= 2 THEN greatest(high, 1 - pow(0.025, 1.0 / ns)) ELSE high END AS high, replicates FROM ci0 JOIN tt USING (slice))"""


def _study_intervals(spark, d):
    gated = _sliced(spark, d, bands=False).filter(F.col("slice").isin(*{s for s, *_ in M.GATES})).select("slice", "source_id", "label", "status", "calibrated")
    return M.study_intervals(cut(spark, gated), T0, R)


@query(f"{_study_src(True)} SELECT round(low, 9) AS low, round(high, 9) AS high, metric, replicates FROM ci WHERE metric = 'ece'", True)
def bootstrap_ece(spark, d):
    """Interval of the calibration error over resampled sources of the canonical rows."""
    own = cut(spark, _sliced(spark, d, bands=False).filter("slice = 'overall'").select("source_id", "label", "status", "calibrated"))
    return _rounded(M.intervals(M.bootstrap_ece(own, R), ["ece"]), "low", "high")


@query(
    f"{_study_src(True)}, w AS (SELECT * FROM (VALUES ('overall', 'fpr', 0.05, TRUE), ('overall', 'recall', 0.5, FALSE), ('held_out', 'fpr', 0.05, TRUE), ('held_out', 'recall', 0.5, FALSE), ('v4', 'fpr', 0.05, TRUE), ('v4', 'recall', 0.5, FALSE), ('human_only', 'fpr', 0.05, TRUE), ('overall', 'ece', 0.05, TRUE)) AS t(slice, metric, bound, at_most)) "
    "SELECT w.slice, w.metric, bound::DOUBLE AS bound, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN low IS NULL OR high IS NULL THEN 'inconclusive' WHEN at_most AND high <= bound OR NOT at_most AND low >= bound THEN 'pass' WHEN at_most AND low > bound OR NOT at_most AND high < bound THEN 'fail' ELSE 'inconclusive' END AS gate FROM w LEFT JOIN ci USING (slice, metric)",
    True,
)
def study_gates(spark, d):
    """The eight gates of a study: three slices, rows of humans, and the calibration error."""
    return _rounded(M.study_gates(_study_intervals(spark, d)), "low", "high")


@query(f", {_SRC}, ga AS ({_GATES}) SELECT CASE WHEN bool_or(gate = 'fail') THEN 'fail' WHEN bool_and(gate = 'pass') THEN 'pass' ELSE 'inconclusive' END AS decision FROM ga", True)
def decision(spark, d):
    return M.decision(_gates(spark, d))


@query(f"{_SLICES}, k AS ({_conf('slice', 'sl')}), q AS (SELECT slice, count(DISTINCT source_id) FILTER (WHERE label = 0) AS negative_sources, count(DISTINCT source_id) FILTER (WHERE label = 1) AS positive_sources FROM sl GROUP BY slice) SELECT k.slice, n, positive, negative, tp, fp, scored, {_rates('k')}, negative_sources, positive_sources FROM k JOIN q USING (slice)", True)
def slice_metrics(spark, d):
    rows = _sliced(spark, d)
    src = rows.groupBy("slice").agg(F.count_distinct(F.when(F.col("label") == 0, F.col("source_id"))).alias("negative_sources"), F.count_distinct(F.when(F.col("label") == 1, F.col("source_id"))).alias("positive_sources"))
    k = _rounded(M.rates(M.confusion(rows, T0, ["slice"])), *RATES)
    return k.select("slice", "n", "positive", "negative", "tp", "fp", "scored", *RATES).join(src, "slice")


@query(f"{_SLICES}, k AS ({_conf('slice', 'sl')}), z AS (SELECT *, {_rates('k')} FROM k) SELECT '| ' || slice || ' | ' || n || ' | ' || coalesce(printf('%.3f', fpr), 'N/A') || ' | ' || coalesce(printf('%.3f', recall), 'N/A') || ' |' AS line FROM z", True)
def report_lines(spark, d):
    k = _rounded(M.rates(M.confusion(_sliced(spark, d), T0, ["slice"])), *RATES)
    number = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("N/A"))
    shown = lambda c: F.when(F.col(c).isNull(), "N/A").otherwise(number(c))
    return k.select(F.concat(F.lit("| "), "slice", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), shown("fpr"), F.lit(" | "), shown("recall"), F.lit(" |")).alias("line"))


# --- latency and study summaries ---------------------------------------------------------------------
_OBS = "o AS (SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS ms, CASE WHEN event_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS cache, event_type = 'error' AS failed FROM events)"


def _obs(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("ms"), F.when(F.col("event_id") % 3 == 0, "hit").otherwise("miss").alias("cache"), (F.col("event_type") == "error").alias("failed"))


@query(f"WITH {_OBS} SELECT coalesce(cache, 'all') AS cache, count(*) AS n, count_if(ms IS NULL)::BIGINT AS incomplete, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, count_if(failed)::BIGINT AS failed FROM o GROUP BY GROUPING SETS ((cache), ())")
def latency_summary(spark, d):
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)")
    g = _obs(spark, d).rollup("cache").agg(F.count("*").alias("n"), F.count_if(F.col("ms").isNull()).alias("incomplete"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.count_if("failed").alias("failed"))
    return g.withColumn("cache", F.coalesce("cache", F.lit("all")))


@query("WITH g AS (SELECT b, c FROM (VALUES (1), (4), (8)) AS x(b), (VALUES (1), (3), (6)) AS y(c)), e AS (SELECT CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS b, CASE user_id % 2 WHEN 0 THEN 1 ELSE 3 END AS c, value FROM events) SELECT g.b AS batch, g.c AS concurrency, count(value) AS n, quantile_disc(value, 0.5) AS p50, max(value) AS worst FROM g LEFT JOIN e ON g.b = e.b AND g.c = e.c GROUP BY ALL")
def runtime_grid(spark, d):
    grid = spark.sql("SELECT * FROM VALUES (1), (4), (8) AS b(batch) CROSS JOIN VALUES (1), (3), (6) AS c(concurrency)")
    i = F.col("event_id") % 4
    e = table(spark, d, "events").select(F.when(i == 0, 1).when(i == 1, 4).otherwise(8).alias("batch"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(3).alias("concurrency"), "value")
    runs = e.groupBy("batch", "concurrency").agg(F.count("value").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.max("value").alias("worst"))
    return grid.join(runs, ["batch", "concurrency"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN 'plain' ELSE 'highlighted' END AS condition, count(*) AS tasks, round(avg(length(text)), 9) AS mean_task, round(avg((turn % 3 > 0)::INT), 9) AS comprehension, count_if(turn % 5 = 1 AND length(text) > 250)::BIGINT AS false_accusations, count(DISTINCT conv_id) >= 10 AS enough FROM conversations GROUP BY ALL")
def study_summary(spark, d):
    c = table(spark, d, "conversations").withColumn("condition", F.when(F.col("conv_id") % 2 == 0, "plain").otherwise("highlighted"))
    return c.groupBy("condition").agg(
        F.count("*").alias("tasks"), F.round(F.avg(F.length("text")), 9).alias("mean_task"), F.round(F.avg((F.col("turn") % 3 > 0).cast("int")), 9).alias("comprehension"),
        F.count_if((F.col("turn") % 5 == 1) & (F.length("text") > 250)).alias("false_accusations"), (F.count_distinct("conv_id") >= 10).alias("enough"),
    )


@query("SELECT round(sum(n_words) FILTER (WHERE status = 'scored') / 1000.0, 6) AS thousand_words, round(count(*) * 0.042 / nullif(sum(n_words) FILTER (WHERE status = 'scored') / 1000.0, 0), 9) AS cost FROM examples", True)
def unit_cost(spark, d):
    words = F.sum(F.when(F.col("status") == "scored", F.col("n_words"))) / 1000
    e = labelled_free(spark, d)
    return e.agg(F.round(words, 6).alias("thousand_words"), F.round(F.try_divide(F.count("*") * F.lit(0.042), words), 9).alias("cost"))


def labelled_free(spark, d):
    from .base import examples

    return examples(spark, d)
