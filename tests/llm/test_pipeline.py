"""The pipeline's stages against direct versions of their rules, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_stages_keep_the_columns_and_shrink(stages):
    sizes = [d.count() for d in stages[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_near_dedup_and_decontamination(stages):
    from tests_llm_rules import contaminated, simhash

    lines, near, clean = ({r.doc_id: r.text for r in d.collect()} for d in stages[2:5])
    prints = {i: simhash(t) for i, t in lines.items()}
    root = {i: i for i in prints}
    for i in sorted(prints):  # small enough for all pairs
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(root, i), find(root, j)))
                root[b] = a
    assert set(near) == {i for i in prints if find(root, i) == i}
    bench = [r.text for r in stages[0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, t in near.items() if not contaminated(t, bench)}


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_packed_documents_are_those_that_were_left(stages):
    packed = stages[5].toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in stages[4].select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_run_gives_the_same_rows(spark, stages):
    import corpus_pipeline as P

    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert P.run(spark, SF).select(key).exceptAll(stages[5].select(key)).count() == 0


def test_near_dedup_is_of_rows(spark):
    """A copy's id may belong to another text as well; equal rows leave one; rows without an id come last."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    t, u = "one two three four five six", "another text that has other words"
    rows = [(1, t), (5, t), (5, u), (5, u), (None, t), (None, "only here, without any id"), (None, "only here, without any id"), (7, None), (8, ""), (9, " ")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], schema)
    got = sorted((str(r.doc_id), str(r.text)) for r in P.simhash_near_dedup(spark, docs, SF).collect())
    assert got == [("1", t), ("5", u), ("7", "None"), ("None", "only here, without any id")]


def test_awkward_tables_through_all_stages(spark):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "Some text without an id and with enough words here", "en", None, None), (900, None, None, "s", 1), (901, "", "en", "s", 0), (902, " \n\t ", "fr", "s", 4), (903, "🦊 123 ...", None, "s", 9)]
    rows += [(904, "same words again and again here", "en", "s", 1)] * 2 + [(905, "long " * 30000 + "end", "en", "s", 1), (906, "un texte en français avec des mots", "fr", "s", 1), (904, "another text under the same id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs = docs.withColumns({c: F.lit(7) for c in ("fp", "n", "shard", "place", "line", "score", "key", "at", "id", "__row", "low")})
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        if name == "simhash_near_dedup":
            kept = sorted(r.text[:10] for r in docs.collect())
            assert kept == ["Some text ", "another te", "long long ", "same words", "un texte e"]
    assert {r.doc_id for r in docs.collect()} == {None, 904, 905, 906}
    docs = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
