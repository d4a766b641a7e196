"""Sharding takes the texts themselves, in buckets of bounded bytes."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from lexaudit.llm import op10_shards
from lexaudit.llm.queries import op10_sharding

SF = "/root/testdata/sf0.001"


def test_query_writes_the_texts_to_shards(spark, tmp_path, monkeypatch):
    written = []
    write = op10_shards.write_shards
    monkeypatch.setattr(op10_shards, "write_shards", lambda rows, path: (written.append(path), write(rows, path)))
    got = {r.doc_id: r for r in op10_sharding(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    shards = {r.doc_id: r for r in spark.read.parquet(written[0]).collect()}
    assert docs.keys() == got.keys() == shards.keys()
    for i, d in docs.items():
        s, text = shards[i], (d.text or "").encode()
        assert all(s[c] == d[c] for c in docs[i].asDict()) and (s.shard, s.slot) == (got[i].shard, got[i].slot)
        assert (got[i]["size"], got[i].text_crc32, got[i].law) == (len(text) + 1, zlib.crc32(text), "key")
    assert list(got[min(got)].asDict()) == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "law"]


def test_buckets_are_sized_by_bytes(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(n, seed, plain=op10_shards.fisher_yates):
        seen.add(1)
        return plain(n, seed)

    monkeypatch.setattr(op10_shards, "fisher_yates", counted)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
    out = op10_shards.shuffle_into_shards(docs, bucket_bytes=100_000).toPandas()
    assert seen.value >= 32  # 4 MB in buckets of 100 KB, of which 8 shards make 5 each
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and (g.text.str.len() == 10_000).all()
