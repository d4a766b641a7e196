"""Language identification in two steps: family first, then one-versus-one linear SVMs within it.

Features are counts of hashed byte n-grams (1 to 4 bytes of lowered text, runs
of other characters made one space), damped by log(1 + n) and normalised.  A
one-versus-rest linear SVM for each family picks the family of a whole text;
one-versus-one linear SVMs between the family's languages vote, and summed
margins break a tie.  The SVMs are fitted by dual coordinate descent on a
bounded sample of labelled rows: at most ``per_language`` rows of a language and
``max_rows`` in all, those with the smallest seeded hash of their id.  Every row
is predicted from its text alone.

Defined results: ``und`` with score 0 for a null text or one without letters,
and for all rows where nothing is labelled; rows without a language are not
learned from; a sole language gets score 1; equal rows get equal predictions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BUCKETS = 1 << 13
#: Families of languages by ISO 639-1 code (fixed values); a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu", "se"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "sd", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["am", "ar", "he", "mt", "ti"],
    "malayo-polynesian": ["id", "jv", "mg", "ms", "su", "tl"],
    "bantu": ["rw", "sn", "st", "sw", "tn", "xh", "zu"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # (families, BUCKETS + 1); empty for one family
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]


def features(text: str) -> np.ndarray:
    """Normalised n-gram features of a text, with a constant at the end."""
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    step = 1 << 20
    for at in range(0, len(raw), step):
        part = raw[at : at + step + 3]
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, 5):
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            own = gram[: min(step, len(gram))]
            counts += np.bincount(((own + np.uint32(n * 0x9E37)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)
    x = np.log1p(counts)
    return np.append(x / max(np.linalg.norm(x), 1e-12), 0.3).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge SVM, by dual coordinate descent; classes weigh the same."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    shrink = 0.5 / (c * weight)
    norm = np.einsum("ij,ij->i", x, x) + shrink
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + shrink[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def fit(x: np.ndarray, langs: list[str]) -> Model:
    labels = np.array(langs)
    family = np.array([_FAMILY.get(v, f"own:{v}") for v in langs])
    families = sorted(set(family.tolist()))
    one_rest = np.array([linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.empty((0, x.shape[1]))
    languages = {f: sorted(set(labels[family == f].tolist())) for f in families}
    pairs, weights = {}, {}
    for f, own in languages.items():
        pairs[f] = list(combinations(range(len(own)), 2))
        rows = [np.flatnonzero((labels == own[a]) | (labels == own[b])) for a, b in pairs[f]]
        weights[f] = np.array([linear_svm(x[r], np.where(labels[r] == own[a], 1.0, -1.0)) for r, (a, _) in zip(rows, pairs[f], strict=True)])
    return Model(families, one_rest, languages, pairs, weights)


def _chance(margin):
    return 1 / (1 + np.exp(-np.clip(4 * margin, -35, 35)))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    if text is None or not model.families or not _LETTER.search(text):
        return "und", 0.0
    x = features(text)
    family, score = model.families[0], 1.0
    if len(model.families) > 1:
        margins = model.family_weights @ x
        best = int(margins.argmax())
        family, score = model.families[best], float(_chance(margins[best]))
    own = model.languages[family]
    if len(own) == 1:
        return own[0], score
    votes, sums, sure = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own))
    for (a, b), margin in zip(model.pairs[family], model.pair_weights[family] @ x, strict=True):
        votes[a if margin >= 0 else b] += 1
        sums[a] += margin
        sums[b] -= margin
        sure[a] += _chance(margin)
        sure[b] += _chance(-margin)
    best = int(np.lexsort((-sums, -votes))[0])
    return own[best], score * float(sure[best]) / (len(own) - 1)


def train(labelled: DataFrame, per_language: int = 300, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the bounded sample of ``labelled``; only its features come to the driver."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(3), F.col(id_col).cast("string")).alias("h"))
    sizes = dict(map(tuple, known.groupBy("lang").agg(F.count("*")).orderBy("lang").limit(max_rows).collect()))
    if not sizes:
        return Model([], np.empty((0, 0)), {}, {}, {})
    bound = max(1, min(per_language, max_rows // len(sizes)))
    # about one and a half times the bound by a hash threshold for each language, then exactly the bound
    limits = {v: min(1.0, (1.5 * bound + 20) / n) for v, n in sizes.items()}
    limit = F.create_map(*[F.lit(z) for v, f in limits.items() for z in (v, -(2.0**63) + f * 2.0**64)])
    drawn = known.filter(F.col("h").cast("double") <= limit[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", F.crc32(F.col("text").cast("binary")))
    chosen = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= bound).select("lang", "text")

    def run(batches):
        for batch in batches:
            kept = [(v, features(t)) for v, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in kept], pa.string()), pa.array([x.tobytes() for _, x in kept], pa.binary())], names=["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in chosen.mapInArrow(run, "lang string, x binary").collect())
    if not rows:
        return Model([], np.empty((0, 0)), {}, {}, {})
    return fit(np.array([np.frombuffer(x, np.float32) for _, x in rows]).astype(np.float64), [v for v, _ in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row with lang_pred and score."""
    text = text_col if text_col in keep else "__text"
    chosen = docs.select(*keep) if text == text_col else docs.select(*keep, F.col(text_col).alias(text))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            got = [predict(model, t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([v for v, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_ids(docs: DataFrame, fold: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside the held-out fold and predict all rows."""
    split = docs.select(id_col, text_col, lang_col, (C.id_bucket(id_col, fold) == held).alias("held_out"))
    return identify(split, train(split.filter(~F.col("held_out")), id_col=id_col, text_col=text_col, lang_col=lang_col), text_col, (id_col, "held_out"))
