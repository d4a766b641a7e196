"""License scans: sparse TF-IDF cosine of lines, headers and files to licence templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.  The units of a text are its lines, its blocks (runs
of lines that hold a term, so that a notice wrapped over several lines or set in
a comment is one unit) and the whole file.  Each is a vector of TF-IDF weights,
(1 + ln tf) * idf, over its terms; a term of no template has the weight of one
that no template holds.  A unit matches its best template from ``least`` cosine
on.  By the prefix principle it can only reach that cosine with a template of
which it holds one of some terms without which the rest is too light.  Texts
without such a term leave in the one pass over the texts, as do units with too
many terms of no template; a cosine is only computed with templates that share
such a term.  Nothing is lost by it.

A text in which matching units of one kind hold at least ``file_share`` of the
terms is a licence file, and covers its directory and all below it.  A text
without a match of its own inherits from the nearest ancestor directory that has
a licence file (the most similar one there, then the smallest id).

The templates are constants of this package; joins with them are broadcast, as
their size is fixed.

Defined results: a null text matches nothing but inherits; a null path has no
directory and inherits nothing; rows of equal id and path count as one file; ties between
templates go by licence; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_texts import FUNCTION_WORDS, PLAIN_WORDS, TEMPLATES

TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Between two blocks: lines without a term.
GAP = r"\n(?:[^a-z0-9\n]*\n)+"
LEAST = 0.8


def idf(df: int, n: int) -> float:
    return math.log((1 + n) / (1 + df))


def template_weights() -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit-length vectors of the templates, the idf of their terms, and that of a term that none of them holds."""
    terms = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    df = Counter(t for c in terms for t in c)
    known = {t: idf(k, len(terms)) for t, k in df.items()}
    out = []
    for c in terms:
        v = {t: (1 + math.log(k)) * known[t] for t, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out, known, idf(0, len(terms))


def needed_terms(least: float) -> list[list[str]]:
    """For each template, terms of which a unit holds at least one if its cosine to the template is ``least`` or more.

    Any set of a template's terms will do if the rest alone is too light, so plain words are left to the rest.
    """
    out = []
    for v in template_weights()[0]:
        rest, found = 1.0, []
        for term, x in sorted(v.items(), key=lambda item: (item[0] in FUNCTION_WORDS, item[0] in PLAIN_WORDS, -item[1], item[0])):
            if math.sqrt(max(rest, 0.0)) < least - 1e-9:
                break
            found.append(term)
            rest -= x * x
        out.append(found)
    return out


def any_of(terms: list[str]) -> str:
    """A regular expression for any of the terms as a whole word; common beginnings are written once."""
    tree: dict = {}
    for t in terms:
        at = tree
        for ch in t:
            at = at.setdefault(ch, {})
        at[""] = {}

    def text(node: dict) -> str:
        ways = [re.escape(ch) + text(below) for ch, below in sorted(node.items()) if ch]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return (inner if len(ways) == 1 and len(inner) == 1 else f"(?:{inner})") + "?" if "" in node else inner

    return rf"(?<![a-z0-9]){text(tree)}(?![a-z0-9])"


def _constants(spark, columns: str, rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(repr(x) + "D" if isinstance(x, float) else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS v({columns})"))


def _may_match(terms: Column, distinct: Column, others: Column, most: float, unknown: float, least: float) -> Column:
    """False only for units whose cosine to any template is under ``least``, from the numbers of their terms alone.

    A cosine is at most the share of a unit's length that lies in terms of templates.  Of k such terms with m occurrences
    the squared length is at most k (1 + ln(m / k))^2 times the largest squared idf (the logarithm is concave), and each
    other term adds at least the squared idf of a term that no template holds.
    """
    k, m = distinct - others, terms - others
    inside = k * (1 + F.log(m / k)) ** 2 * most**2
    return F.when(k > 0, others * unknown**2 * least**2 <= inside * (1 - least**2) * (1 + 1e-9)).otherwise(False)


def unit_matches(docs: DataFrame, key: list[str], text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Each unit of a text that may match: ``key``, kind (line, block, file), n_terms, and the best license and similarity (null if under ``least``)."""
    spark = docs.sparkSession
    vectors, known, unknown = template_weights()
    needed = needed_terms(least)
    of_term = _constants(spark, "term, idf", list(known.items()))
    weights = _constants(spark, "template, term, weight", [(i, t, x * known[t]) for i, v in enumerate(vectors) for t, x in v.items()])
    needs = _constants(spark, "template, term", [(i, t) for i, own in enumerate(needed) for t in own])
    licences = _constants(spark, "template, license", [(i, name) for i, (name, _) in enumerate(TEMPLATES)])
    hint = any_of(sorted({t for own in needed for t in own}))

    folder = C.new_folder(spark, "licenses")
    # through generators of one row, so that filters do not bring what they look at in again and again
    once = lambda x, name: F.inline(F.array(F.struct(x.alias(name))))
    low = docs.select(*key, once(F.lower(text_col), "__t")).filter(F.col("__t").rlike(hint))
    unit = lambda kind, parts: F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    units = low.select(*key, F.inline(F.concat(unit("line", F.split("__t", "\n")), unit("block", F.split("__t", GAP)), unit("file", F.array("__t")))))
    units = units.filter((F.col("kind") == "file") | F.col("unit").rlike(hint))
    units = units.select(*key, "kind", once(F.regexp_extract_all("unit", F.lit(TERM), 0), "terms"))
    units = units.select("*", once(F.array_distinct("terms"), "distinct"))
    units = units.select("*", once(F.size(F.array_except("distinct", F.array(*map(F.lit, sorted(known))))), "others"))
    may = _may_match(F.size("terms"), F.size("distinct"), F.col("others"), max(known.values()), unknown, least)
    # a file that cannot match as a whole still tells how many terms it has
    units = units.select(*key, "kind", F.size("terms").cast("long").alias("n_terms"), once(F.when(may, F.col("terms")), "terms")).filter((F.col("kind") == "file") | F.col("terms").isNotNull())
    # written once: the number of a unit holds for all that follows
    units = C.table(units.withColumn("unit", F.monotonically_increasing_id()), f"{folder}/units")
    counted = C.table(units.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg((1 + F.log(F.count("*"))).alias("tf")), f"{folder}/counted")
    size = counted.join(of_term, "term", "left").groupBy("unit").agg(F.sqrt(F.sum((F.col("tf") * F.coalesce("idf", F.lit(unknown))) ** 2)).alias("size"))
    pairs = counted.join(needs, "term").select("unit", "template").distinct()
    dot = pairs.join(counted, "unit").join(weights, ["template", "term"]).groupBy("unit", "template").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    cosine = dot.join(size, "unit").select("unit", "template", F.round(F.col("dot") / F.col("size"), 6).alias("similarity")).filter(F.col("similarity") >= least)
    best = cosine.join(licences, "template").groupBy("unit").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    out = C.table(units.drop("terms").join(best, "unit", "left").select(*key, "kind", "n_terms", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity")), f"{folder}/best")
    C.drop(spark, f"{folder}/units", f"{folder}/counted")
    return out


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", least: float = LEAST, file_share: float = 0.4) -> DataFrame:
    """id, path, license, similarity, origin (header, file, inherited, none) and covered_by (the directory inherited from)."""
    rows = files.select(F.col(id_col).alias("__id"), path.alias("path"), F.col(text_col).alias("__text"))
    units = unit_matches(rows, ["__id", "path"], "__text", least)
    of_kind = lambda kind, what: F.coalesce(F.sum(F.when((F.col("kind") == kind) & what, F.col("n_terms"))), F.lit(0))
    matched = F.col("license").isNotNull()
    own = units.groupBy("__id", "path").agg(
        F.min(F.when(matched, F.struct((-F.col("similarity")).alias("s"), "license"))).alias("b"),
        F.greatest(*[of_kind(k, matched) for k in ("line", "block", "file")]).alias("covered"), of_kind("file", F.lit(True)).alias("n_terms"),
    )
    own = own.filter("b is not null")
    base = rows.alias("r").join(own.alias("o"), F.col("r.__id").eqNullSafe(F.col("o.__id")) & F.col("r.path").eqNullSafe(F.col("o.path")), "left")
    base = base.select(
        "r.__id", "r.path", F.when(F.col("r.path").isNotNull(), folder_of("r.path")).alias("folder"), F.col("o.b.license").alias("license"), (-F.col("o.b.s")).alias("similarity"),
        F.coalesce(F.col("o.covered") >= file_share * F.col("o.n_terms"), F.lit(False)).alias("is_file"),
    )
    base = C.cut(base)
    covers = base.filter(F.col("is_file") & F.col("folder").isNotNull()).groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("__id").alias("id"), "license")).alias("c"))
    covers = C.cut(covers.select(F.col("folder").alias("above"), F.col("c.license").alias("license"), (-F.col("c.s")).alias("similarity")))
    # the root, which all directories share, is one row and no key of a join
    root = covers.filter("above = ''").first()
    bare = base.filter(F.col("folder").isNotNull() & F.col("license").isNull()).select("folder").distinct()
    depth = F.sequence(F.lit(1), F.size(F.split("folder", "/")))
    up = bare.filter("folder <> ''").select("folder", F.explode(depth).alias("depth"))
    up = up.select("folder", "depth", F.call_function("substring_index", F.col("folder"), F.lit("/"), F.col("depth")).alias("above"))
    nearest = up.join(covers.filter("above <> ''"), "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "license", "similarity")).alias("n"))
    # as a table of its own, so that the join deals out both sides itself and can split a directory of many files
    nearest = C.table(nearest, C.new_folder(files.sparkSession, "nearest"))
    out = base.join(nearest, "folder", "left")
    mine, inherits = F.col("license").isNotNull(), F.col("license").isNull() & F.col("folder").isNotNull()
    at_root = {"above": F.lit(None).cast("string"), "license": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")} if root is None else {k: F.lit(root[k]) for k in root.asDict()}
    given = {k: F.when(inherits, F.coalesce(F.col(f"n.{k}"), v)) for k, v in at_root.items()}
    return out.select(
        F.col("__id").alias(id_col), "path", F.coalesce("license", given["license"]).alias("license"), F.coalesce("similarity", given["similarity"]).alias("similarity"),
        F.when(F.col("is_file"), "file").when(mine, "header").when(given["license"].isNotNull(), "inherited").otherwise("none").alias("origin"),
        given["above"].alias("covered_by"),
    )


def folder_of(col: str) -> Column:
    """The path up to its last slash; empty at the top."""
    path = F.col(col)
    name = F.substring_index(path, "/", -1)
    return F.left(path, F.greatest(F.length(path) - F.length(name) - 1, F.lit(0)))
