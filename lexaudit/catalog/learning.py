"""Learning and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import learning as L
from ..operators import metrics as M
from ..operators import scoring as S
from .base import WORD_SQL, examples, labelled, query, table
from .text import _STOP

_SIG = lambda z: f"(1 / (1 + exp(-greatest(-35, least(35, {z})))))"
_LOGIT = lambda p: f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


@query()
def fit_logistic(spark, d):
    """Calibration maps fitted for each language on counts of scores; held against a direct fit in the tests."""
    m = L.fit_calibration(labelled(spark, d), ["domain"])
    return m.select("domain", F.round("weight", 6).alias("weight"), F.round("intercept", 6).alias("intercept"))


@query(f"SELECT event_id, round({_SIG('-0.5 + 0.8 * (value / 100) - 1.2 * (user_id % 7) / 7.0')}, 9) AS p FROM events")
def logistic_predict(spark, d):
    e = table(spark, d, "events").select("event_id", F.array(F.col("value") / 100, (F.col("user_id") % 7) / F.lit(7.0)).alias("x"))
    return e.select("event_id", F.round(L.predicted(F.col("x"), [0.8, -1.2], -0.5), 9).alias("p"))


@query(f"SELECT doc_id, CASE WHEN raw IS NOT NULL THEN round({_SIG('-0.4 + 1.3 * ' + _LOGIT('raw'))}, 9) END AS p FROM examples", True)
def calibrated_scores(spark, d):
    return examples(spark, d).select("doc_id", F.round(H.calibrate("raw", 1.3, -0.4), 9).alias("p"))


def _threshold_sql(targets: str) -> str:
    return f""", n AS (SELECT count_if(label = 0) AS neg FROM labelled), c AS (SELECT score, sum(fp) OVER (ORDER BY score DESC) AS fp FROM (SELECT calibrated AS score, count_if(label = 0) AS fp FROM labelled WHERE status = 'scored' GROUP BY 1))
SELECT target::DOUBLE AS target, coalesce(min(score) FILTER (WHERE fp / neg::DOUBLE <= target), 1.000001)::DOUBLE AS threshold FROM c, n, (SELECT unnest({targets}::DOUBLE[]) AS target) GROUP BY target"""


@query(_threshold_sql("[0.05]"), True)
def select_threshold(spark, d):
    return L.select_threshold(labelled(spark, d), [0.05])


@query(_threshold_sql("[0.0, 0.01, 0.05, 0.1, 0.2]"), True)
def threshold_scenarios(spark, d):
    return L.select_threshold(labelled(spark, d), [0.0, 0.01, 0.05, 0.1, 0.2])


_DEV = "t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM examples WHERE split = 'development')"
_VOCAB = f", {_DEV}, v AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY df DESC, term LIMIT 1500), vi AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM examples WHERE split = 'development')) / (1 + df)) + 1 AS idf FROM v)"


@query(f"{_VOCAB} SELECT term, df, round(idf, 9) AS idf FROM vi", True)
def tfidf_vocab(spark, d):
    return L.tfidf_vocabulary(examples(spark, d).filter("split = 'development'"), "doc_id").withColumn("idf", F.round("idf", 9))


@query(f"{_VOCAB}, w AS (SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS v FROM t JOIN vi USING (term) GROUP BY ALL) SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM w", True)
def tfidf_vectors(spark, d):
    dev = examples(spark, d).filter("split = 'development'")
    return L.tfidf_vectors(dev, L.tfidf_vocabulary(dev, "doc_id"), "doc_id").withColumn("value", F.round("value", 9))


@query("SELECT domain, round(avg(label), 9) AS prior FROM labelled GROUP BY domain", True)
def class_prior(spark, d):
    return labelled(spark, d).groupBy("domain").agg(F.round(F.avg("label"), 9).alias("prior"))


@query("SELECT doc_id, round((sum(label) OVER () - sum(label) OVER (PARTITION BY source_id)) / (count(*) OVER () - count(*) OVER (PARTITION BY source_id))::DOUBLE, 9) AS prior FROM labelled", True)
def loso_prior(spark, d):
    """Leave one source out: totals less the source's own."""
    rows = labelled(spark, d).select("doc_id", "source_id", "label")
    own = rows.groupBy("source_id").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    total = own.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    rest = own.crossJoin(F.broadcast(total)).select("source_id", F.round(F.try_divide(F.col("tp") - F.col("p"), (F.col("tn") - F.col("n")).cast("double")), 9).alias("prior"))
    return rows.join(rest, "source_id").select("doc_id", "prior")


def _features(spark, d):
    """Six features of each labelled document: its raw score, mean and upper of its word scores, and three stand-in style scores."""
    style = [H.hash_unit(F.concat_ws(":", "id", F.lit(f"style{k}"))) for k in range(3)]
    both = S.word_score_lists(labelled(spark, d), "doc_id", keep=("id", "source_id", "label", "status", "raw", "text"))
    six = F.array("raw", S.mean_score(), S.upper_score(), *style)
    return both.withColumn("features", F.when(F.col("status") == "scored", six))


@query()
def cv_compare(spark, d):
    """Five source-grouped folds: each method refitted, calibrated and thresholded without the fold it is judged on; the recommended one is marked."""
    predictions = L.cross_validated(_features(spark, d), ("raw", "prior", "combined", "tfidf"))
    return L.recommended(L.compared(predictions)).orderBy(F.desc("recall"), "method")


@query()
def grouped_threshold_study(spark, d):
    """Three folds by place of the source within its language; the pooled decisions by fold."""
    from ..operators.sampling import positional_folds

    rows = labelled(spark, d)
    folds = positional_folds(rows.select("domain", "source_id").distinct(), "domain", "source_id").select("domain", "source_id", (F.col("fold") % 3).alias("own"))
    rows = rows.join(folds, ["domain", "source_id"]).withColumn("fold", F.explode(F.array(*map(F.lit, range(3)))))
    train, test = rows.filter("own <> fold"), rows.filter("own = fold")
    maps = L.fit_calibration(train, ["fold"])
    cut_at = L.select_threshold(L.calibrated(train.drop("calibrated"), maps, ["fold"]), [0.05], ["fold"]).select("fold", "threshold")
    held = L.calibrated(test.drop("calibrated"), maps, ["fold"]).join(F.broadcast(cut_at), "fold")
    held = held.withColumn("calibrated", F.when(F.col("calibrated").isNotNull(), (F.col("calibrated") >= F.col("threshold")).cast("double")))
    return M.rates(M.confusion(held, 0.5, ["fold"])).select("fold", "n", "tp", "fp", "fpr", "recall")


@query()
def run_tfidf(spark, d):
    """Held-out scores of the TF-IDF baseline for all labelled documents."""
    return L.cross_validated(labelled(spark, d), ("tfidf",)).select("doc_id", "fold", "status", F.round("calibrated", 6).alias("calibrated"))


_IDENTITY = "'{\"method\":\"' || m || '\",\"scorer\":\"stand-in-1\",\"segmenter\":\"paragraph-1\",\"filter\":\"stop-words-1\",\"prefix\":\"30\"'"


@query(f"SELECT m AS method, c AS calibrated, sha256({_IDENTITY} || CASE WHEN c THEN ',\"weight\":\"1.700000000\",\"intercept\":\"-0.300000000\"' ELSE '' END || '}}') AS identity FROM (SELECT unnest(['sentence', 'sentence-context', 'prefix-mean', 'prefix-upper', 'combined']) AS m), (SELECT unnest([TRUE, FALSE]) AS c)")
def scoring_identities(spark, d):
    m = spark.range(1).select(F.explode(F.array(*map(F.lit, S.METHODS))).alias("method"), F.array(F.lit(True), F.lit(False)).alias("c")).select("method", F.explode("c").alias("calibrated"))
    w, i = (F.when(F.col("calibrated"), F.lit(x)) for x in (1.7, -0.3))
    return m.select("method", "calibrated", S.scoring_identity("method", w, i).alias("identity"))


# --- scoring -----------------------------------------------------------------------------------------------
_Q = rf""", q AS MATERIALIZED (SELECT doc_id, i AS pos, w[i + 1] AS word, array_to_string(w[greatest(i - 29, 1) : i], ' ') AS prefix FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {WORD_SQL}) AS w FROM examples))
  WHERE NOT list_contains({_STOP}, lower(w[i + 1])) AND regexp_matches(w[i + 1], '\p{{L}}')),
ws AS MATERIALIZED (SELECT doc_id, pos, ('0x' || substr(sha256(concat_ws(':', doc_id, pos, word)), 1, 4))::INT / 65535.0::DOUBLE AS raw FROM q)"""


@query(f"{_Q} SELECT e.doc_id, count(q.pos) AS n, coalesce(sum(length(prefix)), 0)::BIGINT AS prefix_chars, max(word) AS last_word FROM examples e LEFT JOIN q USING (doc_id) GROUP BY e.doc_id", True)
def word_questions(spark, d):
    """Counted beside the text: no question leaves its row, so nothing is shuffled or sorted."""
    q = S.question_lists(table(spark, d, "documents"), "doc_id")
    chars = F.aggregate("questions", F.lit(0).cast("long"), lambda n, x: n + F.length(x["prefix"]))
    last = F.array_max(F.transform("questions", lambda x: x["word"]))
    return q.select("doc_id", F.coalesce(F.array_size("questions"), F.lit(0)).cast("long").alias("n"), F.coalesce(chars, F.lit(0).cast("long")).alias("prefix_chars"), last.alias("last_word"))


def _scores(spark, d):
    return S.word_score_lists(table(spark, d, "documents"), "doc_id")


@query(f"{_Q} SELECT e.doc_id, coalesce(round(avg(ws.raw), 9), 0) AS mean, count(ws.raw) AS n FROM examples e LEFT JOIN ws USING (doc_id) GROUP BY e.doc_id", True)
def prefix_mean(spark, d):
    return _scores(spark, d).select("doc_id", F.round(S.mean_score(), 9).alias("mean"), F.size("scores").cast("long").alias("n"))


@query(f"{_Q}, up AS (SELECT doc_id, round(avg(raw), 9) AS upper FROM (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM ws) WHERE k <= greatest(1, ceil(n / 4.0)) GROUP BY doc_id) SELECT e.doc_id, coalesce(upper, 0) AS upper FROM examples e LEFT JOIN up USING (doc_id)", True)
def prefix_upper(spark, d):
    return _scores(spark, d).select("doc_id", F.round(S.upper_score(), 9).alias("upper"))


@query(f"{_Q}, m AS (SELECT doc_id, avg(raw) AS mean FROM ws GROUP BY doc_id) SELECT e.doc_id, status, CASE WHEN status = 'scored' THEN round(coalesce(mean, 0), 9) END AS raw FROM examples e LEFT JOIN m USING (doc_id)", True)
def score_sentences(spark, d):
    """The status rule over word means: short and failed texts keep no score, a text without content words scores 0."""
    e = S.word_score_lists(examples(spark, d), "doc_id", keep=("status",))
    return e.select("doc_id", "status", F.when(F.col("status") == "scored", F.round(S.mean_score(), 9)).alias("raw"))


@query(f"{_Q}, m AS (SELECT doc_id, avg(raw) AS mean FROM ws GROUP BY doc_id) SELECT doc_id, round({_SIG('-1.0 + 0.7 * raw + 1.5 * coalesce(mean, 0)')}, 9) AS p FROM examples LEFT JOIN m USING (doc_id) WHERE status = 'scored'", True)
def combined_predict(spark, d):
    e = S.word_score_lists(examples(spark, d).filter("status = 'scored'"), "doc_id", keep=("raw",)).select("doc_id", "raw", S.mean_score().alias("mean"))
    return e.select("doc_id", F.round(L.predicted(F.array("raw", "mean"), [0.7, 1.5], -1.0), 9).alias("p"))


_PACK = """, i AS (SELECT source_id, doc_id, strlen(text)::BIGINT AS s, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS k FROM examples),
pk AS (WITH RECURSIVE r AS (SELECT source_id, doc_id, s, k, s AS used, 0 AS batch FROM i WHERE k = 1 UNION ALL
SELECT i.source_id, i.doc_id, i.s, i.k, CASE WHEN r.used + i.s > 55000 THEN i.s ELSE r.used + i.s END, CASE WHEN r.used + i.s > 55000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN i ON i.source_id = r.source_id AND i.k = r.k + 1) SELECT * FROM r)"""


def _packed(spark, d):
    return S.pack(table(spark, d, "documents"), "source", "doc_id", F.octet_length("text"))


@query(f"{_PACK} SELECT source_id AS source, doc_id, s AS size, batch FROM pk", True)
def pack_batches(spark, d):
    return _packed(spark, d)


@query(f"{_PACK}, t AS (SELECT count(DISTINCT (source_id, batch)) AS requests, sum(s) AS bytes FROM pk) SELECT requests, ceil(bytes / 3)::BIGINT AS tokens, requests * 64000 AS reserved_tokens, round(bytes / 3 * (0.042 / 1e6), 9) AS usd, round(requests * 64000 * (0.042 / 1e6), 9) AS reserved_usd FROM t", True)
def request_estimate(spark, d):
    return S.estimate(_packed(spark, d), "source")
