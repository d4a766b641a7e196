"""Corpus audits: row predicates, cross-row consistency, leaks between splits, exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H
from ..functions import text as T
from .shared import cut


class AuditError(ValueError):
    """An assertion over the data failed."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise AuditError(message)


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule; a rule that is null counts as broken. One pass."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")


def enforce(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows; the first one that breaks a rule fails the job with the rule's name."""
    checks = [F.assert_true(F.coalesce(r, F.lit(False)), f"rule broken: {k}") for k, r in rules.items()]
    return df.filter(F.coalesce(*checks, F.lit(True)).cast("boolean")) if checks else df


def example_rules() -> dict[str, Column]:
    """The row predicates of research examples."""
    return {
        "identity": F.col("sourceId").isNotNull() & (F.length("sourceHash") == 64) & (F.length("provenance") > 0),
        "split_and_domain": F.col("officialSplit").isin("train", "dev", "test") & F.col("domain").isin("abstracts", "essays", "news", "reports"),
        "binary_label": F.col("label").isin(0, 1),
        "offsets": (F.col("start") >= 0) & (F.col("end") - F.col("start") == T.utf16_length("text")) & F.col("preceding").isNotNull(),
        "human_rows_are_negative": (F.col("version") != "v0") | (F.col("label") == 0),
        "held_out_generator_in_test": (F.col("generator") != "qwen3-8b") | (F.col("officialSplit") == "test"),
    }


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def inconsistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys of which a field takes more than one value, with the number of values of each field."""
    g = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in fields])
    return g.filter(F.greatest(*[F.col(f"n_{c}") for c in fields], F.lit(0)) > 1)


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split (missing keys are left out)."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).filter("n_splits > 1")


def leak_clusters(df: DataFrame, key: str, split: str, id_col: str) -> DataFrame:
    """Members of the keys that cross splits: a join against the crossing keys, so that no cluster is gathered."""
    keys = crossing(df, key, split).select(key, "n_rows")
    return df.join(keys, key).select(key, id_col, split, "n_rows")


def without_seed(df: DataFrame, key: str, is_seed: Column) -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(is_seed).alias("seeded")).filter(~F.col("seeded")).select(key)


def duplicate_owners(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows whose key an earlier id owns: (id, retained)."""
    owner = df.groupBy(key).agg(F.min(id_col).alias("retained"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return df.join(owner, key).filter(F.col(id_col) != F.col("retained")).select(id_col, "retained")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def canonical_seeds(df: DataFrame, is_seed: Column, keys: list[str], id_col: str) -> DataFrame:
    """Seed rows once for each key (the least id stays), all other rows unchanged."""
    first = df.filter(is_seed).groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.filter(~is_seed).unionByName(df.filter(is_seed).join(first, id_col, "left_semi").select(df.columns))


def representatives(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, rep): rep is the least id with the same normalised text."""
    d = df.select(id_col, H.digest(T.normalized(text_col)).alias("k"))
    return d.join(d.groupBy("k").agg(F.min(id_col).alias("rep")), "k").select(id_col, "rep")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str = "text", least: float = 0.85) -> DataFrame:
    """(a, b, similarity) for all pairs a < b of different normalised texts whose shingle sets have that Jaccard similarity.

    Equal texts stand as one representative, the least id.  Two sets of that
    similarity share an element of their prefixes, in any order of elements that
    holds for all sets (the prefix principle).  First the order of hashes: a set
    whose few least hashes are in no other set's has no partner and leaves before
    its other elements are looked at.  For those that stay, rarest first:
    frequent shingles, as of boilerplate, make no candidates.  Candidates are
    verified on the whole sets.
    """
    spark = df.sparkSession
    kept = lambda n: (n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1).cast("int")
    of = Window.partitionBy("h")
    # a text's set is made once, and of it the prefix goes on
    first = df.select(F.col(id_col).alias("id"), H.digest(T.normalized(text_col)).alias("k"), F.inline(F.array(F.struct(T.shingle_hashes(text_col).alias("s")))))
    first = first.select("id", "k", F.slice(F.sort_array("s"), F.lit(1), kept(F.size("s"))).alias("prefix"))
    reps = first.groupBy("k").agg(F.min("id").alias("id"), F.first("prefix").alias("prefix"))
    shared = reps.select("id", F.explode("prefix").alias("h")).withColumn("df", F.count("*").over(of)).filter("df > 1")
    stay = cut(spark, shared.select("id").distinct())
    # under 8 MB of ids go to the texts; more are joined by a shuffle
    few = F.broadcast(stay) if stay.count() <= 1_000_000 else stay
    # the sets are written once, as hashes; size and elements come from there
    sets = cut(spark, df.withColumn("__id", F.col(id_col)).join(few.withColumnRenamed("id", "__id"), "__id", "left_semi").select(F.col("__id").alias("id"), T.shingle_hashes(text_col).alias("s")))
    sets = sets.select("id", F.size("s").alias("n"), "s")
    # elements of one set only come first in its order; they are counted, not placed
    common = sets.select("id", "n", F.explode("s").alias("h")).withColumn("df", F.count("*").over(of)).filter("df > 1")
    each = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("df", "h"))
    rare = cut(spark, common.withColumn("place", place).filter(F.col("place") <= kept(F.col("n"))).select("id", "n", "h"))
    a, b = rare.select(F.col("id").alias("a"), F.col("n").alias("na"), "h"), rare.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h")
    ratio = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least)
    pairs = a.join(b, "h").filter((F.col("a") < F.col("b")) & ratio).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = full.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("sum"))
    return out.select("a", "b", (F.col("c") / (F.col("sum") - F.col("c"))).alias("similarity")).filter(F.col("similarity") >= least)


def greedy_retained(pairs: DataFrame) -> DataFrame:
    """(id, retained): ids that fall to the first retained id they are similar to, taken in ascending order.

    An id falls if a retained smaller id is its neighbour.  Each round settles the ids whose smaller neighbours are
    all settled: one without a retained one is retained, the others fall; as many rounds as the longest chain.
    """

    spark = pairs.sparkSession
    pairs = cut(spark, pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    settled = cut(spark, ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("stays"), F.lit(None).cast(ids.schema["id"].dataType).alias("retained")))
    total, done = ids.count(), settled.count()
    while done < total:
        known = pairs.join(settled.select(F.col("id").alias("a"), "stays"), "a", "left")
        state = known.groupBy(F.col("b").alias("id")).agg(F.min(F.when(F.col("stays"), F.col("a"))).alias("retained"), F.bool_and(F.coalesce("stays", F.lit(False)) | F.col("stays").isNotNull()).alias("ready"))
        new = state.join(settled, "id", "left_anti").filter(F.col("ready")).select("id", F.col("retained").isNull().alias("stays"), "retained")
        settled = cut(spark, settled.unionByName(new))
        done = settled.count()
    return settled.filter(~F.col("stays")).select("id", "retained")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: missing, extra and repeated keys of ``right`` against ``left``."""
    l = left.groupBy(key).agg(F.count("*").alias("nl"))
    r = right.groupBy(key).agg(F.count("*").alias("nr"))
    j = l.join(r, key, "full_outer")
    return j.agg(
        F.count_if(F.col("nr").isNull()).alias("missing"), F.count_if(F.col("nl").isNull()).alias("extra"), F.count_if(F.coalesce("nr", F.lit(0)) > 1).alias("repeated")
    )


def same_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows equally often, and how many rows are on one side only."""
    key = left.columns
    both = left.withColumn("n", F.lit(1)).unionByName(right.withColumn("n", F.lit(-1))).groupBy(*key).agg(F.sum("n").alias("n"))
    one = both.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differing"))
    return one.select((F.col("differing") == 0).alias("same"), "differing")


def resumed(previous: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """Results that stand (not failed), and the rest of the work as pending."""
    done = previous.filter(F.col("status") != "failed")
    rest = todo.join(done.select(key), key, "left_anti").select(key, F.lit("pending").alias("status"))
    return done.select(key, "status").unionByName(rest)


def latest(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last state of each key."""
    return df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in fields])
