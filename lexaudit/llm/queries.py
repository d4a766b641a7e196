"""The queries ``opN_<name>``: each applies its operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .license_texts import TEMPLATES
from .op1_lm import lm_scores
from .op2_packing import pack_documents
from .op3_lines import dedup_lines
from .op4_licenses import GAP, LEAST, TERM, scan
from .op5_html import extract
from .op6_simhash import fingerprint_hex, near_duplicates
from .op7_quality import quality_verdicts
from .op8_language import language_ids
from .op9_decontaminate import find_contamination
from .op10_shards import row_digest, sharded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: each document gets one in a tree of source, language and runs of a hundred ids."""
    docs, i = _table(spark, sf_dir, "documents"), F.col("doc_id")
    deep = F.when(i % 10 == 0, F.concat_ws("/", "source", i)).when(i % 10 < 4, F.concat_ws("/", "source", "lang", i))
    path = deep.otherwise(F.concat_ws("/", "source", "lang", F.floor(i / 100), i))
    return scan(docs, "doc_id", path)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their texts are written to shards; size and text_crc32 are those of the rows read from there."""
    out = sharded(_table(spark, sf_dir, "documents"), C.new_folder(spark, "shards"))
    return row_digest(out, keep=("shard", "slot", "grown_shard")).withColumn("law", F.lit("key"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scores, op2_best_fit_packing, op3_line_dedup, op4_license_scan, op5_html_extraction, op6_simhash_near_dedup, op7_quality_rules, op8_language_id, op9_decontamination, op10_sharding)
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, i AS line_no, trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line, x AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, string_split(line, ' ') AS w, (doc_id, line_no) AS place FROM l WHERE line <> ''),
d AS MATERIALIZED (SELECT line, any_value(w) AS w, min(place) AS first FROM c GROUP BY line),
v AS MATERIALIZED (SELECT first, line, p, len(w) AS n, array_to_string(w[1 : p - 1] || w[p + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) >= 5)),
sub AS (SELECT DISTINCT line FROM (SELECT line, first, min(first) OVER (PARTITION BY rest, p, n) AS low FROM v) WHERE low < first),
ins AS (SELECT DISTINCT CASE WHEN d.first < v.first THEN v.line ELSE d.line END AS line FROM v JOIN d ON v.rest = d.line),
gone AS (SELECT c.doc_id, c.line_no FROM c JOIN d USING (line) WHERE c.place > d.first OR line IN (SELECT line FROM sub UNION ALL SELECT line FROM ins)),
k AS (SELECT l.doc_id, count(g.doc_id) AS n_removed, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE g.doc_id IS NULL), '') AS rest
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE sha256(rest) END AS text_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)""",
}

_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
ORACLE["op4_license_scan"] = rf"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) AS v(template, license, text)),
tt AS (SELECT template, term, 1 + ln(count(*)) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))::DOUBLE) AS idf FROM tt GROUP BY term),
w AS (SELECT template, term, idf, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
d AS (SELECT doc_id, lower(text) AS text, CASE WHEN doc_id % 10 = 0 THEN concat_ws('/', source, doc_id) WHEN doc_id % 10 < 4 THEN concat_ws('/', source, lang, doc_id) ELSE concat_ws('/', source, lang, doc_id // 100, doc_id) END AS path FROM documents),
u AS (SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS part FROM d UNION ALL SELECT doc_id, 'block', unnest(string_split_regex(text, '{GAP}')) FROM d UNION ALL SELECT doc_id, 'file', text FROM d),
x AS MATERIALIZED (SELECT doc_id, kind, row_number() OVER () AS unit, regexp_extract_all(part, '{TERM}') AS terms FROM u),
c AS MATERIALIZED (SELECT unit, term, 1 + ln(count(*)) AS tf FROM (SELECT unit, unnest(terms) AS term FROM x) GROUP BY ALL),
z AS (SELECT unit, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT count(*) FROM t)))) ** 2)) AS size FROM c LEFT JOIN idf USING (term) GROUP BY unit),
o AS (SELECT unit, template, sum(tf * idf * weight) AS dot FROM c JOIN w USING (term) GROUP BY ALL),
cs AS (SELECT unit, license, round(dot / size, 6) AS similarity FROM o JOIN z USING (unit) JOIN t USING (template) WHERE round(dot / size, 6) >= {LEAST}),
bl AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, license) = 1),
k AS (SELECT doc_id, kind, sum(len(terms)) AS covered FROM bl JOIN x USING (unit) GROUP BY ALL),
own AS (SELECT doc_id, arg_min(license, (-similarity, license)) AS license, max(similarity) AS similarity FROM bl JOIN x USING (unit) GROUP BY doc_id),
m AS (SELECT doc_id, max(covered) AS covered FROM k GROUP BY doc_id),
b AS (SELECT d.doc_id, path, license, similarity, path[1 : greatest(len(path) - len(string_split(path, '/')[-1]) - 1, 0)] AS folder,
  coalesce(covered >= 0.4 * len(regexp_extract_all(text, '{TERM}')), FALSE) AS is_file FROM d LEFT JOIN own USING (doc_id) LEFT JOIN m USING (doc_id)),
cov AS (SELECT folder AS above, arg_min(license, (-similarity, doc_id)) AS license, max(similarity) AS similarity FROM b WHERE is_file GROUP BY folder),
n AS (SELECT f.folder, above, cov.license, cov.similarity FROM (SELECT DISTINCT folder FROM b) f JOIN cov ON f.folder = above OR above = '' OR starts_with(f.folder, above || '/') QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY len(above) DESC) = 1)
SELECT doc_id, path, coalesce(b.license, n.license) AS license, coalesce(b.similarity, n.similarity) AS similarity,
  CASE WHEN is_file THEN 'file' WHEN b.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN b.license IS NULL THEN n.above END AS covered_by FROM b LEFT JOIN n USING (folder)"""
