"""Text, hashing and number functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions.segment import segment_table
from ..operators.alignment import align
from .base import WORD_SQL, query, table

_NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_SHINGLES = f"""n AS (SELECT doc_id, lang, source, string_split({_NORMAL}, ' ') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, lang, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, lang, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n))"""


@query(f"SELECT doc_id, len(regexp_extract_all(text, {WORD_SQL}))::INT AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.words("text")).alias("n_words"))


@query(f"SELECT doc_id, array_to_string(list_slice(w, greatest(len(w) - 29, 1), len(w)), ' ') AS prefix FROM (SELECT doc_id, regexp_extract_all(text, {WORD_SQL}) AS w FROM documents)")
def prefix30(spark, d):
    return table(spark, d, "documents").select("doc_id", T.prefix("text").alias("prefix"))


@query(
    rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, {WORD_SQL}), lambda w: NOT list_contains({_STOP}, lower(w)) AND regexp_matches(w, '\p{{L}}')))::INT AS n_content FROM documents"
)
def content_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.content_words("text")).alias("n_content"))


@query(f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized("text").alias("normal"))


@query(f"WITH {_SHINGLES} SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id")
def shingle_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingle_hashes("text")).cast("long").alias("n_shingles"))


@query(r"SELECT count(*) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents)")
def token_vocab(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.tokens("text")).alias("t"))
    return t.groupBy("t").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS source_hash FROM documents")
def source_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", H.digest(T.folded("text")).alias("source_hash"))


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT AS utf16_length FROM documents")
def utf16_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", T.utf16_length("text").alias("utf16_length"))


@query("SELECT doc_id, sha256(doc_id::VARCHAR) AS digest FROM documents")
def digest_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", H.digest(F.col("doc_id").cast("string")).alias("digest"))


@query("SELECT lang, sha256(string_agg(g, ',' ORDER BY g)) AS ids_digest FROM (SELECT lang, source, doc_id // 1000 AS run, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS g FROM documents GROUP BY ALL) GROUP BY lang")
def set_digest(spark, d):
    """No group of ids is gathered whole: runs of a source's ids are digested first, then their digests."""
    runs = table(spark, d, "documents").groupBy("lang", "source", F.floor(F.col("doc_id") / 1000).alias("run")).agg(H.set_digest(F.col("doc_id").cast("string")).alias("g"))
    return runs.groupBy("lang").agg(H.set_digest("g").alias("ids_digest"))


@query("SELECT doc_id, (('0x' || substr(sha256('fold:' || source), 1, 8))::BIGINT % 5)::INT AS fold FROM documents")
def hash_folds(spark, d):
    return table(spark, d, "documents").select("doc_id", H.hash_fold("source").alias("fold"))


@query("SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::INT / 65535.0::DOUBLE AS score FROM documents")
def simulated_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", H.hash_unit(F.col("doc_id").cast("string")).alias("score"))


@query(
    """WITH s AS (SELECT i, ((23092026 + (i + 1)::HUGEINT * 1831565813) % 4294967296)::UBIGINT AS s FROM range(10000) AS r(i)),
t AS (SELECT i, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::UBIGINT AS t FROM s),
u AS (SELECT i, xor(t, ((t::HUGEINT + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296) % 4294967296)::UBIGINT) AS t FROM t)
SELECT i AS draw, xor(t, t >> 14)::DOUBLE / 4294967296 AS u FROM u"""
)
def prng_draws(spark, d):
    return spark.range(10000).select(F.col("id").alias("draw"), H.mulberry32("id", 23092026).alias("u"))


@query(
    "SELECT event_id, round(1 / (1 + exp(-greatest(-35, least(35, value / 10 - 20)))), 9) AS s, round(ln(greatest(1e-6, least(1 - 1e-6, value / 500)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 500)))), 9) AS l FROM events"
)
def sigmoid_logit(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(H.sigmoid(F.col("value") / 10 - 20), 9).alias("s"), F.round(H.logit(F.col("value") / 500), 9).alias("l"))


@query(
    """SELECT doc_id, printf('Write %s of about %d words on the topic below.', CASE lang WHEN 'en' THEN 'an essay' WHEN 'fr' THEN 'a news report' ELSE 'an abstract' END, n) AS prompt, n AS target_words
FROM (SELECT doc_id, lang, (greatest(1, round(len(string_split_regex(trim(text), '\\s+')) / 50.0)) * 50)::INT AS n FROM documents)"""
)
def topic_prompts(spark, d):
    n = F.greatest(F.lit(1.0), F.round(F.size(F.split(F.trim("text"), r"\s+")) / 50)) * 50
    genre = F.when(F.col("lang") == "en", "an essay").when(F.col("lang") == "fr", "a news report").otherwise("an abstract")
    x = table(spark, d, "documents").select("doc_id", genre.alias("genre"), n.cast("int").alias("target_words"))
    return x.select("doc_id", F.format_string("Write %s of about %d words on the topic below.", "genre", "target_words").alias("prompt"), "target_words")


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def reconstruct_documents(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text", F.lit("\n")).alias("part"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    return c.select("conv_id", H.digest(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("digest"), F.size("parts").cast("long").alias("turns"))


@query()
def sentence_segments(spark, d):
    """Sentences of all documents with offsets in UTF-16 units; held against ICU and by round trip in the tests."""
    return segment_table(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query()
def segmentation_parity(spark, d):
    """Segments of each document against its line ends: the count, and whether gaps and segments give the text again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    joined = segment_table(docs, "text", "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["text"]), "")
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return docs.join(joined, "doc_id", "left").select("doc_id", F.coalesce(F.size("s"), F.lit(0)).alias("n_segments"), (squeezed(F.coalesce(whole, F.lit(""))) == squeezed(F.col("text"))).alias("same_text"))


@query()
def gold_alignment(spark, d):
    """Gold sentences (here: the lines, with inner spaces doubled in every third) found again in their documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    lines = F.filter(F.split("text", "\n"), lambda x: T.trimmed(x) != "")
    gold = F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.regexp_replace(x, " ", "  ")).otherwise(x))
    return align(docs.withColumn("sentences", gold))
