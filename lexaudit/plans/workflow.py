"""The study workflow: prepare, fit, run, calibrate, freeze, open the test split once, evaluate, report.

Tables stay DataFrames; what a step fixes (manifest, specification, receipt) is
one small JSON artifact with digests of what it was made from.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import audit as A
from ..operators import learning as L
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators.shared import cut
from ..schemas import SEED, SPLITS
from ..sources.files import write_json

#: Rows of each split that a study samples (fixed values).
SIZES = {"development": 100, "calibration": 200, "test": 400}


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def table_digest(df: DataFrame, id_col: str) -> str:
    """Digest of all rows, the same in any order: row digests are summed in four 60-bit parts, which needs no gathering."""
    row = H.digest(F.to_json(F.struct(*sorted(df.columns))))
    parts = [F.sum(F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    return digest([str(x) for x in df.agg(F.count("*"), *parts).first()])


def audit(rows: DataFrame, quarantined: DataFrame | None = None, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(sources that stay, issues). A broken rule, an author or a text that crosses splits raises.

    Rows as research examples; source texts are the seed rows (version v0) in order.
    """
    broken = {r.rule: r.violations for r in A.rule_counts(rows, A.example_rules()).collect() if r.violations}
    A.require(not broken, f"rules broken: {broken}")
    A.require(A.repeated_ids(rows, "id").isEmpty(), "an id is repeated or missing")
    split = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])[F.col("officialSplit")]
    rows = rows.withColumn("split", split)
    A.require(A.inconsistent(rows, "sourceId", ["split", "domain", "sourceHash"]).isEmpty(), "a source has several splits, domains or hashes")
    A.require(A.crossing(rows, "authorId", "split").isEmpty(), "an author crosses splits")
    A.require(A.crossing(rows, "sourceHash", "split").isEmpty(), "a human source crosses splits")
    A.require(A.without_seed(rows, "sourceId", F.col("version") == "v0").isEmpty(), "a source has no human seed")
    seeds = A.canonical_seeds(rows.filter("version = 'v0'"), F.lit(True), ["sourceId", "start"], "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ")
    sources = seeds.groupBy("sourceId", "split", "domain", "sourceHash").agg(text.alias("text"))
    same = A.duplicate_owners(sources, "sourceHash", "sourceId").select("sourceId", F.lit("duplicate-source").alias("kind"), "retained")
    left = sources.join(same.select("sourceId"), "sourceId", "left_anti")
    if quarantined is not None:
        left = left.join(quarantined.select("sourceId"), "sourceId", "left_anti")
    reps = A.representatives(left, "sourceId")
    pairs = A.near_duplicate_pairs(left, "sourceId", least=least).select("a", "b").unionByName(reps.filter("sourceId <> rep").select(F.col("rep").alias("a"), F.col("sourceId").alias("b")))
    both = pairs.join(left.select(F.col("sourceId").alias("a"), F.col("split").alias("sa")), "a").join(left.select(F.col("sourceId").alias("b"), F.col("split").alias("sb")), "b")
    A.require(both.filter("sa <> sb").isEmpty(), "near-duplicate sources cross splits")
    near = A.greedy_retained(pairs).select(F.col("id").alias("sourceId"), F.lit("near-duplicate").alias("kind"), "retained")
    stays = left.join(near.select("sourceId"), "sourceId", "left_anti").select("sourceId", "split", "domain", "sourceHash")
    return stays, same.unionByName(near)


def prepare(rows: DataFrame, sizes: dict[str, int] = SIZES, quarantined: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The sampled examples and their manifest: equal quotas for the domains of each split, by hash order."""
    sources, issues = audit(rows, quarantined)
    n_domains = 4
    quota = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n // n_domains)])
    ranked = S.hash_sample(sources, ["split", "domain"], "sourceId", max(sizes.values()) // n_domains, SEED)
    chosen = ranked.filter(F.col("place") <= quota[F.col("split")]).select("sourceId", "split")
    examples = rows.drop("split").join(chosen, "sourceId")
    counts = {f"{r.split}:{r.domain}": [sizes[r.split] // n_domains, r.n] for r in sources.groupBy("split", "domain").agg(F.count("*").alias("n")).collect() if r.split in sizes}
    manifest = {
        "version": 1, "seed": SEED, "counts": counts, "issues": issues.count(), "data_digest": table_digest(examples, "id"),
        "ids_digest": chosen.agg(H.set_digest(F.concat_ws(",", "sourceId", "split")).alias("d")).first().d, "created": datetime.datetime.now(datetime.UTC).isoformat(),
    }
    return examples, manifest


def load(examples: DataFrame, manifest: dict) -> DataFrame:
    """The examples, if they are still those of the manifest."""
    A.require(table_digest(examples, "id") == manifest["data_digest"], "the examples differ from the manifest")
    return examples


def calibrate(scored: DataFrame, max_fpr: float = 0.05) -> dict:
    """Map and threshold from the calibration split's canonical rows."""
    rows = A.canonical_seeds(scored.filter("split = 'calibration'"), F.col("version") == "v0", ["sourceId", "start", "end"], "id")
    m = L.fit_calibration(rows).first()
    done = rows.withColumn("calibrated", F.when(F.col("status") == "scored", H.calibrate("raw", m.weight, m.intercept)))
    return {"weight": m.weight, "intercept": m.intercept, "threshold": L.select_threshold(done, [max_fpr]).first().threshold}


def freeze(path: str, manifest: dict, calibration: dict, method: str) -> dict:
    spec = {"method": method, "manifest": digest(manifest), "calibration": calibration}
    spec["digest"] = digest(spec)
    write_json(path, spec, exclusive=True)
    return spec


def open_test(path: str, spec: dict, declaration: str) -> None:
    """The test split opens once: the first opening is recorded, a later one must declare the same."""
    receipt = {"spec": spec["digest"], "declaration": declaration}
    try:
        write_json(path, receipt, exclusive=True)
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            A.require(json.load(f) == receipt, "the test split was opened with another declaration")


def evaluate(scored: DataFrame, threshold: float, replicates: int = 1000) -> tuple[DataFrame, DataFrame, str]:
    """(slice metrics, gates, decision). Rows: source_id, id, start, end, label, status, calibrated, version, generator, domain."""
    canonical = A.canonical_seeds(scored.select("*"), F.col("version") == "v0", ["source_id", "start", "end"], "id").select("id", F.lit(True).alias("canonical"))
    rows = M.sliced(scored.join(canonical, "id", "left").withColumn("canonical", F.coalesce("canonical", F.lit(False))), F.col("canonical"))
    reports = M.report(rows, threshold, ["slice"])
    gates = M.study_gates(M.study_intervals(cut(rows.sparkSession, rows), threshold, replicates))
    return reports, gates, M.decision(gates).first().decision


def report(path: str, reports: DataFrame, decision: str) -> None:
    """Markdown with one line for each slice; missing values as N/A, three decimals."""
    cols = ["slice", "n", "coverage", "fpr", "recall", "precision", "f1", "auroc", "auprc", "brier", "ece"]
    show = lambda v: "N/A" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"Decision: {decision}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join(show(r[c]) for c in cols) + " |" for r in reports.select(cols).orderBy("slice").collect()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
