"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Base statistics are computed inside each row from the whole text.  Rows that
pass the base rules are grouped by language and source, and each group gets a
minimum-covariance-determinant estimate: the ``share`` of its rows whose
covariance has the least determinant.

1. Starts that aggregates can make, all from medians and median deviations: no
   correlation, robust pairwise correlations (Gnanadesikan-Kettenring), those of
   hyperbolic tangents, of spatial signs, and the classical moments.  (The rank
   starts of the usual six would need each group sorted as a whole.)
2. Concentration steps: the rows nearest by Mahalanobis distance give the next
   mean and covariance.  Two for every start; the start with the least
   determinant goes on until no group's determinant falls any more.
3. One reweighting: mean and covariance of the rows within the 97.5 % quantile.
4. A row is rejected if its squared distance is over the ``level`` quantile of
   chi-square.  Both covariances are made consistent for normal samples.

The covariance is regularised by a diagonal target, the square of ``FLOORS``:
most texts have no symbols, repeated lines or repeated windows at all, and
without it the determinant of such a group is 0 and a single one an outlier.

Nearest rows are found by an exact percentile of distances rounded in the
logarithm, so a group needs as many counters as there are rounded values and no
task holds a group's rows.  Groups of under ``min_group`` rows are pooled by
language, and then all together; a last pool of fewer rows than twice the
dimensions cannot be estimated and rejects nothing.

Defined results: a null text has no words and fails the base rules; null
languages and sources are groups of their own; equal rows get equal verdicts; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Statistics of the vector, and the least standard deviation of each (in the transformed unit): log 2, which is the step from
#: none to one of what is counted; for the mean word length, its sampling error in the shortest text that passes the base rules.
FLOORS = {"f_words": math.log(2), "f_length": 0.07, "f_symbols": math.log(2), "f_dup_lines": math.log(2), "f_repeats": math.log(2)}
#: Share of rows that an estimate is made from.
SHARE = 0.75


def chi_square_cdf(x: float, k: float) -> float:
    """The series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / (k / 2)
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= (x / 2) / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float, k: int) -> float:
    """What makes the covariance of the ``share`` nearest rows of a normal sample that of the sample (Croux and Haesbroeck 1999)."""
    return share / chi_square_cdf(chi_square_quantile(share, k), k + 2)


def base_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*keep, text.alias("__t"), F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).alias("__line"))
    b = a.select(*keep, "__t", "__line", F.when(F.col("__line") == "", F.array().cast("array<string>")).otherwise(F.split("__line", " ")).alias("__w"))
    n = F.size("__w")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    c = b.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.when(n > 0, F.length("__line") - n + 1).otherwise(0).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform(at, lambda i: F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2])).alias("__h"),
    )
    m = F.size("__h")
    d = c.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # only a text with a repeated window needs its windows in order
        F.when(F.size(F.array_distinct("__h")) < m, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__s"),
    )
    k = F.size("__s")
    same = F.zip_with(F.slice("__s", F.lit(1), k - 1), F.slice("__s", F.lit(2), k - 1), lambda x, y: x["h"] == y["h"])
    e = d.select("*", F.when(F.col("__s").isNotNull(), F.arrays_zip(F.transform("__s", lambda x: x["i"]).alias("i"), F.concat(same, F.array(F.lit(False))).alias("n"), F.concat(F.array(F.lit(False)), same).alias("p"))).alias("__z"))
    g = e.select("*", F.sort_array(F.transform(F.filter("__z", lambda z: z["n"] | z["p"]), lambda z: z["i"])).alias("__r"))
    r = F.size("__r")
    covered = F.aggregate(F.zip_with(F.slice("__r", F.lit(2), r - 1), F.slice("__r", F.lit(1), r - 1), lambda y, x: F.least(y - x, F.lit(3))), F.lit(3), lambda s, x: s + x)
    n_repeat = F.when(F.col("__r").isNotNull(), covered).otherwise(0).cast("long")
    out = g.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", n_repeat.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed() -> dict[str, Column]:
    """The statistic vector: logarithms of counts and rates, which are closer to normal than the rates themselves."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f_words": F.log1p("n_words"),
        "f_length": F.log(chars / words),
        "f_symbols": F.log1p(1000 * F.col("n_symbols") / chars),
        "f_dup_lines": F.log1p("n_dup_lines"),
        "f_repeats": F.log1p(100 * F.col("n_repeat_words") / words),
    }


def _cholesky(cov: dict[tuple[str, str], Column], names: list[str]) -> dict[str, Column]:
    """Entries l_i_j of the lower triangular root, as expressions of the covariances; each is one of the columns below it."""
    steps = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = cov[(b, a)]
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            steps[f"l_{i}_{j}"] = F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}")
    return steps


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for k, done in enumerate(z):
            rest = rest - F.col(f"l_{i}_{k}") * done
        z.append(rest / F.col(f"l_{i}_{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _with_root(estimate: DataFrame, cov: dict[tuple[str, str], Column], names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and m_* of ``estimate`` with the root l_i_j of ``cov`` and the logarithm of its determinant."""
    steps = _cholesky(cov, names)
    for name, x in steps.items():
        estimate = estimate.withColumn(name, x)
    det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(names))), F.log("l_0_0")) * 2
    return estimate.select(*keep, *[f"m_{c}" for c in names], *steps, det.alias("det"))


def _starts(rows: DataFrame, floors: dict[str, float]) -> DataFrame:
    """pool, start, m_* and l_i_j of the starts of each pool."""
    names = list(floors)
    pairs, off = list(combinations_with_replacement(names, 2)), list(combinations(names, 2))
    mid = C.small_side(rows.groupBy("pool").agg(*[F.median(F.round(c, 2)).alias(f"m_{c}") for c in names]), 100)
    spread = rows.join(mid, "pool").groupBy("pool").agg(*[F.median(F.round(F.abs(F.col(c) - F.col(f"m_{c}")), 2)).alias(f"s_{c}") for c in names])
    scale = C.small_side(spread.join(mid, "pool").select("pool", *[f"m_{c}" for c in names], *[F.sqrt((1.4826 * F.col(f"s_{c}")) ** 2 + floors[c] ** 2).alias(f"s_{c}") for c in names]), 200)
    z = rows.join(scale, "pool").select("pool", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in names])
    z = z.withColumn("norm", F.greatest(sum((F.col(c) ** 2 for c in names[1:]), F.col(names[0]) ** 2), F.lit(1e-12)))
    quartiles = lambda x: F.percentile(F.round(x, 2), F.array(F.lit(0.25), F.lit(0.75)))
    sums = z.groupBy("pool").agg(
        *[quartiles(F.col(a) + F.col(b)).alias(f"p_{a}_{b}") for a, b in off], *[quartiles(F.col(a) - F.col(b)).alias(f"q_{a}_{b}") for a, b in off],
        *[F.avg(F.tanh(a) * F.tanh(b)).alias(f"t_{a}_{b}") for a, b in pairs], *[F.avg(F.col(a) * F.col(b) / F.col("norm")).alias(f"g_{a}_{b}") for a, b in pairs],
        *[F.avg(c).alias(f"a_{c}") for c in names], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    )
    sums = C.cut(sums)
    zero, one = F.lit(0.0), F.lit(1.0)
    width = lambda k, a, b: (F.get(f"{k}_{a}_{b}", F.lit(1)) - F.get(f"{k}_{a}_{b}", F.lit(0))) ** 2
    part = lambda x, y: F.when(y > 0, F.greatest(F.lit(-0.95), F.least(F.lit(0.95), x / y))).otherwise(zero)
    pairwise = {(a, b): part(width("p", a, b) - width("q", a, b), width("p", a, b) + width("q", a, b)) for a, b in off}
    of_sums = lambda k: {(a, b): part(F.col(f"{k}_{a}_{b}"), F.sqrt(F.col(f"{k}_{a}_{a}") * F.col(f"{k}_{b}_{b}"))) for a, b in off}
    kinds = [({}, zero), (pairwise, zero), (of_sums("t"), zero), (of_sums("g"), zero), (None, None)]
    entries = []
    for k, (correlation, centre) in enumerate(kinds):
        own = [F.lit(k).alias("start")]
        own += [(F.col(f"a_{c}") if centre is None else centre).alias(f"z_{c}") for c in names]
        if correlation is None:
            own += [(F.col(f"c_{a}_{b}") + (F.lit(1e-6) if a == b else zero)).alias(f"r_{a}_{b}") for a, b in pairs]
        else:
            own += [(one if a == b else correlation.get((a, b), zero)).alias(f"r_{a}_{b}") for a, b in pairs]
        entries.append(F.struct(*own))
    r = C.cut(sums.select("pool", F.inline(F.array(*entries))))
    for name, x in _cholesky({(a, b): F.col(f"r_{a}_{b}") for a, b in pairs}, names).items():
        r = r.withColumn(name, x)
    # correlations taken pair by pair need not belong together: such a start is that without correlation
    good = F.lit(True)
    for i in range(len(names)):
        good = good & F.coalesce(F.col(f"l_{i}_{i}") > 1e-3, F.lit(False)) & ~F.isnan(F.coalesce(F.col(f"l_{i}_{i}"), zero))
    r = r.select("pool", "start", *[f"z_{c}" for c in names], *[F.when(good, F.col(f"l_{i}_{j}")).otherwise(1.0 if i == j else 0.0).alias(f"l_{i}_{j}") for i in range(len(names)) for j in range(i + 1)])
    back = r.join(scale, "pool").select(
        "pool", "start", *[(F.col(f"m_{c}") + F.col(f"s_{c}") * F.col(f"z_{c}")).alias(f"m_{c}") for c in names],
        *[(F.col(f"s_{a}") * F.col(f"l_{i}_{j}")).alias(f"l_{i}_{j}") for i, a in enumerate(names) for j in range(i + 1)],
    )
    return C.small_side(back, 300)


def _moments(chosen: DataFrame, keep: list[str], floors: dict[str, float], factor: float) -> DataFrame:
    """``keep``, m_*, l_i_j and det of the rows of each group; factor: what the choice took from the covariance."""
    names = list(floors)
    pairs = list(combinations_with_replacement(names, 2))
    raw = chosen.groupBy(*keep).agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    return C.small_side(_with_root(raw, {(a, b): F.col(f"c_{a}_{b}") * factor + (floors[a] ** 2 if a == b else 0.0) for a, b in pairs}, names, keep), 300)


def _concentrated(rows: DataFrame, estimate: DataFrame, share: float, floors: dict[str, float]) -> DataFrame:
    """One concentration step for each pool and start."""
    names = list(floors)
    near = rows.join(estimate, "pool").select("pool", "start", *names, F.round(F.log(_distance(names) + 1e-6), 2).alias("q"))
    bound = C.small_side(near.groupBy("pool", "start").agg(F.percentile("q", share).alias("bound")), 60)
    return _moments(near.join(bound, ["pool", "start"]).filter("q <= bound"), ["pool", "start"], floors, consistency(share, len(names)))


def _least(estimates: DataFrame) -> DataFrame:
    """Of each pool's estimates that with the least determinant."""
    first = estimates.groupBy("pool").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    return C.small_side(estimates.join(first, ["pool", "start"]), 300)


def determinant_estimates(rows: DataFrame, share: float = SHARE, floors: dict[str, float] = FLOORS, most_steps: int = 30) -> DataFrame:
    """For each value of ``pool`` the estimate of the least determinant found: m_*, l_i_j, det. rows: pool and the statistics."""
    estimate = _starts(rows, floors)
    for _ in range(2):
        estimate = _concentrated(rows, estimate, share, floors)
    estimate = _least(estimate)
    for _ in range(most_steps):
        after = _concentrated(rows, estimate, share, floors)
        both = estimate.select("pool", "det").join(after.select("pool", F.col("det").alias("next")), "pool")
        fell = both.agg(F.max(F.col("det") - F.col("next"))).first()[0]
        # a step can only raise a determinant by what the rounding of distances does
        estimate = _least(estimate.withColumn("start", F.lit(1)).unionByName(after.withColumn("start", F.lit(0))))
        if fell is None or fell < 1e-3:
            break
    return estimate


def robust_estimates(rows: DataFrame, share: float = SHARE, floors: dict[str, float] = FLOORS) -> DataFrame:
    """For each value of ``pool``: the reweighted means m_* and root l_i_j of the covariance."""
    names = list(floors)
    inside = rows.join(determinant_estimates(rows, share, floors), "pool").filter(_distance(names) <= chi_square_quantile(0.975, len(names)))
    return _moments(inside.select("pool", *names), ["pool"], floors, consistency(0.975, len(names)))


def quality_verdicts(docs: DataFrame, level: float = 0.999, min_group: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the base statistics, base_failed, distance (squared; null if base_failed or nothing to measure by) and kept."""
    plain = docs.select(id_col, text_col, F.coalesce(F.col(lang_col), F.lit("\x01")).alias("__lang"), F.coalesce(F.col(source_col), F.lit("\x01")).alias("__source"))
    stats = C.cut(base_statistics(plain, [id_col, "__lang", "__source"], text_col))
    fit = stats.filter(~F.col("base_failed")).select(id_col, "__lang", "__source", *[v.alias(k) for k, v in transformed().items()])
    groups = fit.groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    langs = groups.filter(F.col("n") < min_group).groupBy("__lang").agg(F.sum("n").alias("n_lang"))
    pool = F.when(F.col("n") >= min_group, F.concat_ws("\x02", F.lit("group"), "__lang", "__source")).when(F.col("n_lang") >= min_group, F.concat_ws("\x02", F.lit("lang"), "__lang")).otherwise(F.lit("all"))
    pools = C.cut(groups.join(langs, "__lang", "left").select("__lang", "__source", pool.alias("pool"), "n"))
    big = pools.groupBy("pool").agg(F.sum("n").alias("n_pool")).filter(F.col("n_pool") > 2 * len(FLOORS)).select("pool")
    placed = pools.join(big, "pool", "left_semi").select("__lang", "__source", "pool")
    estimate = robust_estimates(C.cut(fit.join(C.small_side(placed, 100), ["__lang", "__source"]).select("pool", *FLOORS)))
    known = C.small_side(placed.join(estimate, "pool").drop("pool"), 300)
    names = list(FLOORS)
    measured = stats.select("*", *[v.alias(k) for k, v in transformed().items()]).join(known, ["__lang", "__source"], "left")
    distance = F.when(~F.col("base_failed"), _distance(names))
    return measured.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= chi_square_quantile(level, len(names)))).alias("kept"),
    )
