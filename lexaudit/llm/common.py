"""Helpers shared by the corpus operators: shared storage, lineage cuts, bytes in Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time (one whole text at least).
CHUNK_BYTES = 1 << 20


# --- the folder that driver and executors share ------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir`` of the session; only where unset in local mode, as in tests, a temporary one."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        uri = tempfile.mkdtemp(prefix="lexaudit-")
    sc.setCheckpointDir(uri)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: short lineage, and no second run of what made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df``, cut; marked for broadcast only if its counted rows stay under ``limit`` bytes, else a join shuffles it as usual."""
    df = cut(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


_left: set[tuple[SparkSession, str]] = set()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared folder; what is still there when the driver ends goes then."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _left.add((spark, folder))
    return folder


def drop(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _left.discard((spark, folder))


@atexit.register
def _drop_left() -> None:
    for spark, folder in list(_left):
        with contextlib.suppress(Exception):  # the session may have ended first
            drop(spark, folder)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the queries that are planned and run in here go as soon as each has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, folder: str, *by: str) -> None:
    """Write ``df`` as Parquet."""
    with tidy_shuffles(df.sparkSession):
        df.write.partitionBy(*by).parquet(folder) if by else df.write.parquet(folder)


def few_rows(df: DataFrame) -> list:
    """Collect ``df``, which has a row for each range of a table at most."""
    with tidy_shuffles(df.sparkSession):
        return df.select("*").collect()  # planned anew, under the setting


def table(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table written to ``folder`` of the shared folder, and read again."""
    save(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write one file of the shared folder in one step, so that a repeated task leaves the same file."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/.{name}.part-{(part := uuid.uuid4().hex)}") as f:
        f.write(data)
    fs.move(f"{path}/.{name}.part-{part}", f"{path}/{name}")


def map_file(folder: str, name: str, dtype) -> np.ndarray:
    """Memory-map an array of the shared folder; where that is not a mounted one, the array is read into memory."""
    if (path := _local(folder)) is not None:
        full = f"{path}/{name}"
        return np.memmap(full, dtype=dtype, mode="r") if os.path.getsize(full) else np.empty(0, dtype)
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def put_array(folder: str, name: str, a: np.ndarray) -> None:
    """Write whole numbers in the narrowest type that holds them; the type stands in the first eight bytes."""
    a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    put_file(folder, name, a.dtype.str.encode().ljust(8) + a.tobytes())


def map_array(folder: str, name: str) -> np.ndarray:
    raw = np.asarray(map_file(folder, name, np.uint8)).view(np.ndarray)
    return raw[8:].view(bytes(raw[:8]).decode().strip())


class Small:
    """Whole numbers that are mostly small: a byte for each, and a sorted list of the places of larger ones with their values."""

    LARGE = 255

    def __init__(self, raw: np.ndarray):
        n, m = raw[:16].view("<i8").tolist() if len(raw) else (0, 0)
        self.low, rest = raw[16 : 16 + n], raw[16 + n :]
        self.places, self.values = np.frombuffer(rest[: 8 * m].tobytes(), "<i8"), np.frombuffer(rest[8 * m :].tobytes(), "<i8")

    @staticmethod
    def put(folder: str, name: str, a: np.ndarray) -> None:
        large = np.flatnonzero(a >= Small.LARGE)
        low = np.minimum(a, Small.LARGE).astype(np.uint8)
        put_file(folder, name, np.array([len(a), len(large)], "<i8").tobytes() + low.tobytes() + large.astype("<i8").tobytes() + a[large].astype("<i8").tobytes())

    @staticmethod
    def map(folder: str, name: str) -> Small:
        return Small(np.asarray(map_file(folder, name, np.uint8)).view(np.ndarray))

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        large = np.flatnonzero(out == self.LARGE)
        if len(large):
            out[large] = self.values[np.searchsorted(self.places, at[large])]
        return out

    def all(self) -> np.ndarray:
        out = self.low.astype(np.int64)
        out[self.places] = self.values
        return out


# --- columns -----------------------------------------------------------------------------------
def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def id_bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def scan_parts(df: DataFrame) -> int:
    """Partitions in which ``df`` is read; follows the input size."""
    return max(1, df.rdd.getNumPartitions())


def power_of_two(n: int) -> int:
    return 1 << max(0, (max(1, n) - 1).bit_length())


# --- bytes of Arrow columns --------------------------------------------------------------------
def raw_column(arr) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary Arrow column without a copy."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize) if off is not None else np.zeros(1, kind)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(arr, limit: int = CHUNK_BYTES):
    """Runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets of the texts in them)."""
    offsets, data = raw_column(arr)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


# --- words as 64-bit hashes, without a Python object for each ------------------------------------
_ODD = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = power_of_two(max(n, CHUNK_BYTES))
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``is_word`` holds, never across texts, and the words before each text."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each white-space word of the texts, A-Z lowered, and the words before each text."""
    starts, ends, before = word_spans(data, offsets, ~SPACE)
    return span_hashes(LOWER[data], starts, ends), before


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, wherever it stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# --- sorted arrays as compressible bytes -----------------------------------------------------------
def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their steps: equal high bytes stand together, which the shuffle's codec removes."""
    return np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort by key and add up the values of equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], *(np.add.reduceat(v[order], new) if len(keys) else v for v in values)
