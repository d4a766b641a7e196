"""Two-pass external shuffle into shards.

Pass 1 scatters the rows by seeded hashes: the id and the shard count alone
decide the shard (jump consistent hashing, so one more shard takes rows only
into itself), and a second hash deals each shard into as many buckets as keep a
bucket at about ``bucket_rows`` rows and ``bucket_bytes`` bytes of texts, which
fit in memory.  Pass 2 brings each bucket into a fixed order, shuffles it by
Fisher-Yates under a seed of its own, and gives slots after those of the buckets
before it.  Whole rows, texts included, are dealt once; the buckets are sized on
their hashes and lengths alone.

Defined results: rows with the same id share a shard but, with other payload,
not always a bucket; a null id counts as one key of its own; equal rows are
interchangeable, and share a bucket, which for these rows alone may get larger;
columns may have any names and types; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hashing (Lamping and Veach 2014) of unsigned 64-bit keys."""
    key, at, ahead = keys.copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    order = list(range(n))
    if n > 1:
        picks = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shard(key, n: int):
    @F.arrow_udf("int")
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).view(np.uint64), n).astype(np.int32))

    return of(key)


def _deals(rows: DataFrame, seed: int) -> list:
    """Two hashes of a whole row; together they order rows of any types, and only equal rows tie."""
    fields = [F.to_json(F.struct(F.col(f.name))) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema.fields]
    nulls = [x.isNull() for x in fields]  # a null leaves a hash as it is, so where it stands is told apart
    return [F.xxhash64(F.lit(seed + k), *nulls, *fields).alias(name) for k, name in ((1, "__deal"), (2, "__next"))]


def _free(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with columns of these names renamed to in_<name>."""
    for c in names:
        if c in rows.columns:
            to = f"in_{c}"
            while to in rows.columns:
                to = f"in_{to}"
            rows = rows.withColumnRenamed(c, to)
    return rows


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 11, id_col: str = "doc_id", bucket_rows: int = 20_000, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``rows`` with shard, slot (gapless from 0 in each shard) and grown_shard (the shard among one more).

    Columns of those names in ``rows`` come back as in_shard, in_slot, in_grown_shard.
    """
    rows = _free(rows, ("shard", "slot", "grown_shard"))
    named, id_col = rows, f"__c{rows.columns.index(id_col)}"
    rows = rows.toDF(*(f"__c{i}" for i in range(len(rows.columns))))  # names of any kind
    payload = rows.columns
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    others = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    n_bytes = [F.octet_length(c) for c in texts] + [F.octet_length(F.to_json(F.struct(F.col(c)))) for c in others]
    n_bytes = sum((F.coalesce(x, F.lit(0)) for x in n_bytes), F.lit(8 * len(payload))).cast("long")
    keyed = rows.select("*", F.xxhash64(F.lit(seed), id_col).alias("__key"), *_deals(rows, seed))
    small = C.cut(keyed.select("__key", "__deal", n_bytes.alias("__bytes")))
    n, total = small.agg(F.count("*"), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    buckets = max(1, -(-n // (shards * bucket_rows)), -(-total // (shards * bucket_bytes)))
    bucket = F.pmod("__deal", F.lit(buckets)).cast("int").alias("__bucket")
    sizes = small.select(_shard(F.col("__key"), shards).alias("shard"), bucket).groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    dealt = keyed.select(*payload, "__deal", "__next", bucket, _shard(F.col("__key"), shards).alias("shard"), _shard(F.col("__key"), shards + 1).alias("grown_shard"))

    def shuffle(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["__next"].to_numpy(), table["__deal"].to_numpy()])
        shard, bucket, grown = table["shard"][0].as_py(), table["__bucket"][0].as_py(), table["grown_shard"]
        slot = np.empty(len(table), np.int64)
        slot[order[fisher_yates(len(table), [seed, shard, bucket])]] = np.arange(len(table))
        out = table.select([*payload, "shard"]).append_column("slot", pa.array(slot + table["__first"][0].as_py()))
        return out.append_column("grown_shard", grown)

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])
    # one row for each bucket: 32 bytes for 16 MB of texts
    return dealt.join(C.small_side(first, 32), ["shard", "__bucket"]).groupBy("shard", "__bucket").applyInArrow(shuffle, schema).toDF(*named.columns, "shard", "slot", "grown_shard")


def write_shards(shuffled: DataFrame, path: str, files: int | None = None) -> None:
    """Write the shards as Parquet folders ``shard=N``: ``files`` files, each a run of slots in order, at the price of
    one more shuffle of all rows; by default the buckets stay where they were shuffled, and a file holds whole buckets,
    each a run of slots, in order."""
    dealt = shuffled if files is None else shuffled.repartitionByRange(files, "shard", "slot")
    C.save(dealt.sortWithinPartitions("shard", "slot"), path, "shard")


def row_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32) and the columns ``keep``: what the sharding query tells of each row instead of the text."""
    text = C.text_bytes(text_col)
    return docs.select(id_col, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *keep)


def sharded(docs: DataFrame, folder: str) -> DataFrame:
    """The whole rows of ``docs`` as written to the shards in ``folder``, read again."""
    out = shuffle_into_shards(docs)
    write_shards(out, folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)
