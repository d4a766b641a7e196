"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is compared by its lowered words; the edit distance counts words.  Lines
of ``near_words`` words or more are near-duplicates within distance 1 (a word
inserted, deleted or replaced: a similarity of 0.8 or more from five words on);
lines of ``min_words`` or more count as duplicates when they are equal; blank
ones always stay.  A line goes if any earlier line (by document id, then line
number) is a duplicate or near-duplicate of it.

1. One pass over the texts writes a narrow row for each line: its place, a
   128-bit hash, and hashes of a leading and a trailing run of its words.  Equal
   lines are brought together by the 128 bits; the first one stands for all.
2. Two lines one edit apart share a leading or a trailing run.  Lines that share
   neither with another line have no neighbour, and leave here; the words of the
   others are fetched from the documents and get a rank in the order of places.
3. Every remaining line emits its variants with one word deleted (outside the
   run that it shares), as hashed keys, and itself.  Variants of the same key
   and deleted place differ in one replaced word; a line and another's variant
   differ by one inserted word.  So the earliest line of a key and place, and
   the line that is itself the key, decide, and no pairs within a group are made.
4. The words of a line and of that earliest line are compared again.

Nothing is broadcast by this module: each join shuffles what it needs, and its
large sides are those that Spark can split where a key is hot.

Defined results: a null text has no lines and stays null; rows of one id are
one document, so two lines of them with the same number are at the same place
and neither is earlier; a null id comes last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_KEY = ["h1", "h2"]
#: Words of a long line that are put together at a time; bounds what a scan over its words copies.
_BLOCK = 64


def _normal(line: Column) -> Column:
    """Single spaces, none at the ends. Most lines are so already, which is cheaper to see than to make."""
    odd = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    for c in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _runs(shorter: Column) -> tuple[Column, Column]:
    """Words of the leading and the trailing run that one of two lines one edit apart leaves whole; ``shorter``: words of the shorter one.

    The two runs never overlap; from 24 words on they change at every eighth length only, so that most lines have one of each.
    """
    eighths = (F.floor(shorter / 8) * 4).cast("int")
    head = F.floor(shorter / 2).cast("int")
    return F.when(shorter < 24, head).otherwise(eighths), F.when(shorter < 24, shorter - head).otherwise(eighths)


def _shared_keys(line: Column, n: Column) -> Column:
    """Hashes of a line's runs for partners as long or longer, and for those a word shorter; leading ones are even."""
    head, tail = _runs(n)
    head_1, tail_1 = _runs(n - 1)
    out = []
    for odd, own, other in ((0, head, head_1), (1, tail, tail_1)):
        for k, wanted in ((own, F.lit(True)), (other, other != own)):
            run = F.call_function("substring_index", line, F.lit(" "), k if odd == 0 else -k)
            out.append(F.when(wanted, F.xxhash64(k, run).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(odd))))
    return F.array_compact(F.array(*out))


def _place(id_col: Column, line_no: Column) -> Column:
    return F.struct(id_col.isNull().alias("late"), id_col.alias("id"), line_no.alias("line_no"))


def _lines(docs: DataFrame, min_words: int, near_words: int, id_col: str, text_col: str) -> DataFrame:
    """A narrow row for each line that counts: id, th (hash of its text), line_no, 128-bit hash, shared keys. The text is lowered once."""
    row = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.lower(text_col), "\n")).alias("line_no", "raw"))
    # through a generator of one row, so that a filter does not bring each expression in twice
    row = row.select("id", "th", "line_no", F.inline(F.array(F.struct(_normal(F.col("raw")).alias("line")))))
    words = F.when(F.col("line") == "", F.lit(0)).otherwise(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    row = row.select("id", "th", "line_no", "line", F.inline(F.array(F.struct(words.alias("n"))))).filter(F.col("n") >= F.greatest(F.lit(1), F.lit(min_words)))
    keys = F.when(F.col("n") >= near_words - 1, _shared_keys(F.col("line"), F.col("n"))).alias("keys")
    return row.select("id", "th", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), keys)


# --- variants --------------------------------------------------------------------------------------
def _before(values: Column) -> Column:
    """For each element the XOR of those before it, and that of all at the end."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1).bitwiseXOR(x))))


def _variants(lines: DataFrame, near_words: int) -> DataFrame:
    """(rank, key, at) of each variant without the word ``at``, and of each line itself (at -1)."""
    n = F.size("w")
    a = lines.select("rank", "head", "tail", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("w"))
    # a word that stays in its place, and one that moves up by one
    a = a.select("rank", "head", "tail", F.transform("w", lambda x, i: F.xxhash64(x, i)).alias("stay"), F.transform("w", lambda x, i: F.xxhash64(x, i - 1)).alias("w"))
    a = a.select("rank", "head", "tail", "w", F.zip_with("stay", "w", lambda x, y: x.bitwiseXOR(y)).alias("both"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: _before(F.slice("both", b * _BLOCK + 1, F.lit(_BLOCK))))
    a = a.select("rank", "head", "tail", "w", blocks.alias("blocks"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias("moved"))
    a = a.select("*", _before(F.transform("blocks", lambda b: F.element_at(b, -1))).alias("sums"))
    # XOR of the words before each place stays, that of the words after it moves
    inside = F.flatten(F.transform("blocks", lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x.bitwiseXOR(F.get("sums", k)))))
    a = a.select("rank", "head", "tail", "w", "moved", F.element_at("sums", -1).alias("total"), inside.alias("before"))
    (head_1, tail_1), (head, tail) = _runs(n - 1), _runs(n)
    first, last = F.when(F.col("tail"), F.lit(0)).otherwise(F.least(head, head_1)), F.when(F.col("head"), n - 1).otherwise(n - F.least(tail, tail_1) - 1)
    places = F.when(n >= near_words, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    key = lambda p: F.xxhash64(F.col("moved").bitwiseXOR(F.get("before", p)).bitwiseXOR(F.get("w", p)), n - 1)
    itself = F.struct(F.xxhash64(F.col("moved").bitwiseXOR(F.col("total")), n).alias("key"), F.lit(-1).alias("at"))
    return a.select("rank", F.inline(F.concat(F.array(itself), F.transform(places, lambda p: F.struct(key(p).alias("key"), p.alias("at"))))))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one insertion, deletion or replacement."""
    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    # of two lines of unequal length: the first word that differs is the inserted one
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    same_head = F.array_position(F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x != y), True)
    cut_at = F.when(same_head == 0, F.size(long)).otherwise(same_head).cast("int")
    one_more = F.concat(F.slice(long, F.lit(1), cut_at - 1), F.slice(long, cut_at + 1, F.size(long))) == short
    return F.when(F.size(a) == F.size(b), differing <= 1).otherwise((F.abs(F.size(a) - F.size(b)) == 1) & one_more)


# --- decisions -------------------------------------------------------------------------------------
def _with_partners(lines: DataFrame) -> DataFrame:
    """(h1, head, tail) of the lines that share a leading or a trailing run with another line."""
    key = lines.filter("keys is not null").select("h1", F.explode("keys").alias("key"))
    shared = key.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    tail = F.col("key").bitwiseAND(F.lit(1))
    return key.join(shared, "key").groupBy("h1").agg(F.max(tail == 0).alias("head"), F.max(tail == 1).alias("tail"))


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def removed_lines(docs: DataFrame, min_words: int = 1, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line_no, earlier) of each line that goes; ``earlier`` is the place of the line that it repeats."""
    spark = docs.sparkSession
    narrow, wanted, ranked, words, keyed, near, out = (C.new_folder(spark, f"lines-{k}") for k in ("narrow", "wanted", "ranked", "words", "variants", "near", "gone"))
    lines = C.table(_lines(docs, min_words, near_words, id_col, text_col), narrow)

    # 2. lines with a possible neighbour, in the order of places, and their words
    first = lines.groupBy(*_KEY).agg(F.min(F.struct(_place(F.col("id"), F.col("line_no")).alias("place"), "th")).alias("f"), F.count("*").alias("k"))
    some = C.table(first.join(_with_partners(lines), "h1").select(*_KEY, "f.place", "f.th", "head", "tail"), wanted)
    order = C.table(some.orderBy("place", *_KEY).withColumn("rank", F.monotonically_increasing_id()), ranked)
    of_doc = order.select(F.col("place.id").alias("id"), "th", F.struct(F.col("place.line_no").alias("line_no"), "rank", *_KEY, "head", "tail").alias("l"))
    of_doc = of_doc.groupBy("id", "th").agg(F.collect_list("l").alias("ls"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # rows of equal id and text have the same lines: the words that they give are the same, and one of them is enough
    met = texts.alias("d").join(of_doc.alias("o"), _same_document("d", "o")).select(F.split(F.lower("text"), "\n").alias("all"), "ls")
    met = met.select(F.inline(F.transform("ls", lambda x: F.struct(x["rank"].alias("rank"), x["h1"].alias("h1"), x["h2"].alias("h2"), x["head"].alias("head"), x["tail"].alias("tail"), F.get("all", x["line_no"]).alias("raw")))))
    texts = C.table(met.select("rank", *_KEY, "head", "tail", _normal(F.col("raw")).alias("line")), words)

    # 3. their variants; the earliest line of a key and place, and the one that is the key itself
    variants = C.table(_variants(texts, near_words), keyed)
    low = variants.filter("at >= 0").groupBy("key", "at").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).filter("low < high")
    known = low.select("key", "at", "low").unionByName(variants.filter("at < 0").select("key", "at", F.col("rank").alias("low")))
    found = variants.filter("at >= 0").alias("v").join(known.alias("k"), F.expr("v.key = k.key and (v.at = k.at or k.at < 0)"))
    pair = found.select(F.greatest("v.rank", "k.low").alias("rank"), F.least("v.rank", "k.low").alias("low")).filter("low < rank").distinct()

    # 4. compare the words
    own, other = texts.select("rank", F.col("line").alias("a"), *_KEY), texts.select(F.col("rank").alias("low"), F.col("line").alias("b"))
    pair = pair.join(own.distinct(), "rank").join(other.distinct(), "low")
    verified = pair.filter(_one_edit(F.split("a", " "), F.split("b", " "))).groupBy(*_KEY).agg(F.min("low").alias("low"))
    verified = verified.join(order.select(F.col("rank").alias("low"), F.col("place").alias("near")), "low").select(*_KEY, "near")
    verified = C.table(verified, near)

    copies = first.filter("k > 1").select(*_KEY, "f.place")
    known = copies.join(verified, _KEY, "full_outer")
    gone = lines.join(known, _KEY).filter(F.col("near").isNotNull() | (_place(F.col("id"), F.col("line_no")) > F.col("place")))
    gone = C.table(gone.select("id", "th", "line_no", F.coalesce("near", "place").alias("earlier")), out)
    C.drop(spark, narrow, wanted, ranked, words, keyed, near)
    return gone


def dedup_lines(docs: DataFrame, min_words: int = 1, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and n_lines and n_removed."""
    gone = removed_lines(docs, min_words, near_words, id_col, text_col).groupBy("id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone")
    joined = docs.withColumn("__own", F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    joined = joined.select(*docs.columns, "__gone", F.when(F.col("__gone").isNotNull(), F.split(text_col, "\n")).alias("__lines"))
    lines = F.col("__lines")
    # the runs of lines between removed ones: no search through the removed ones for each line
    bounds = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    runs = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(runs), "\n"))
    ends = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(ends + 1).cast("long").alias("n_lines")
    n_removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines, n_removed)
