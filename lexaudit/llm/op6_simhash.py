"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most 2 of 64 bits differ in at most 1 bit of one
of their halves.  The anchors of a half are the code words of the perfect
Hamming code [31, 26] over its low 31 bits: every value lies within covering
radius 1 of exactly one anchor, its home.  Each distinct fingerprint is
replicated to every anchor within covering radius plus threshold, 1 + 1, of each
half (1 or 16 of 2**26 anchors), and at each anchor the fingerprints at home
there are compared with all others, so that no link is missed.  A task sends on
a spanning forest of the links it finds at an anchor instead of all of them,
which keeps what is reachable.

Defined results: a null text has no words and so fingerprint 0, linked like any
other; equal rows get equal fingerprints; a null id never names a component that
has another id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

THRESHOLD = 2
#: Hashes whose bits are counted at a time, and bytes of one text that are taken apart at a time.
SHINGLES_AT_ONCE = 1 << 16
PIECE_BYTES = 1 << 20
#: Pairs of fingerprints that are compared at a time.
COMPARED_AT_ONCE = 1 << 21


# --- fingerprints ------------------------------------------------------------------------------
def _pieces(text: bytes, size: int = PIECE_BYTES):
    """Pieces of about ``size`` bytes that end where a word does."""
    at = 0
    while len(text) - at > size:
        m = _WHITE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(text: bytes, width: int, seed: int):
    """Arrays of the hashes of a text's shingles; together one for each run of ``width`` words, or one of all the words if there are fewer."""
    import xxhash

    digest, carried, found = xxhash.xxh64_intdigest, [], False
    for piece in _pieces(text):
        words = carried + piece.lower().split()
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1]
            yield np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
            found = True
        carried = words[max(0, len(words) - width + 1) :]
    if carried and not found:
        yield np.array([digest(b" ".join(carried), seed)], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array: the 64 bits set in over half of its hashes; 0 for an empty one. Bits are counted a bounded number of hashes at a time."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    small = [i for i in np.flatnonzero(sizes) if sizes[i] <= SHINGLES_AT_ONCE]
    while small:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[small]), SHINGLES_AT_ONCE, "right")))
        own, small = small[:n], small[n:]
        counts[own] = np.add.reduceat(_bits(np.concatenate([hashes[i] for i in own])), np.cumsum(sizes[own]) - sizes[own], axis=0, dtype=np.int64)
    for i in np.flatnonzero(sizes > SHINGLES_AT_ONCE):
        for k in range(0, int(sizes[i]), SHINGLES_AT_ONCE):
            counts[i] += _bits(hashes[i][k : k + SHINGLES_AT_ONCE]).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long) and ``keep`` for each row, from the whole text."""
    kept = [id_col, *(c for c in keep if c != id_col)]
    chosen = docs.select(*kept, C.text_bytes(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            found, held, n = [], [], 0
            for x in batch.column("__text"):
                held.append(np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(x.as_py(), width, seed)]))
                n += len(held[-1])
                if n >= SHINGLES_AT_ONCE:
                    found.append(majority_bits(held))
                    held, n = [], 0
            if held:
                found.append(majority_bits(held))
            if found:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(found).view(np.int64))], names=[*kept, "__fp"])

    return chosen.mapInArrow(run, f"{schema}, __fp long").withColumnRenamed("__fp", "fp")


# --- anchors -------------------------------------------------------------------------------------
_BITS = np.arange(31, dtype=np.uint64)
#: For each syndrome 1..31: the 15 pairs of bits whose flips lead to a code word, as masks.
_PAIRS = np.array([[0] * 15] + [[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s] for s in range(1, 32)], np.uint64)


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for bit in _BITS:
        out ^= ((x >> bit) & np.uint64(1)) * (bit + np.uint64(1))
    return out.astype(np.int64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, anchor, at home) for every anchor within covering radius plus threshold of each half."""
    rows, keys, homes = [], [], []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64((1 << 31) - 1)
        s = _syndrome(x)
        home = np.where(s > 0, x ^ (np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64)), x)
        off = np.flatnonzero(s)
        far = x[off, None] ^ _PAIRS[s[off]]
        rows += [np.arange(len(fp)), np.repeat(off, 15)]
        keys += [home | np.uint64(half << 31), far.ravel() | np.uint64(half << 31)]
        homes += [np.ones(len(fp), bool), np.zeros(len(off) * 15, bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _links(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between those at home and all at one anchor, as index pairs.

    Links are found a bounded number of comparisons at a time and joined into the forest at once; no list of all links is kept.
    """
    label = np.arange(len(fp))
    h = np.flatnonzero(home)
    step = max(1, COMPARED_AT_ONCE // len(fp))
    for k in range(0, len(h), step):
        for j in range(0, len(fp), COMPARED_AT_ONCE):
            own, other = h[k : k + step], fp[j : j + COMPARED_AT_ONCE]
            a, b = np.nonzero(np.bitwise_count(fp[own, None] ^ other[None, :]) <= threshold)
            a, b = own[a], b + j
            while (label[a] != label[b]).any():
                low = np.minimum(label[a], label[b])
                roots = label.copy()
                np.minimum.at(roots, label[a], low)
                np.minimum.at(roots, label[b], low)
                while (roots != roots[roots]).any():
                    roots = roots[roots]
                label = roots[label]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return label[moved], moved


def _compare(threshold: int):
    def of_groups(key, fp, home):
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(cuts[1:], len(key))
        many = (ends - cuts > 1) & (np.add.reduceat(home, cuts, dtype=np.int64) > 0)
        a, b = [], []
        for i, j in zip(cuts[many], ends[many], strict=True):
            x, y = _links(fp[i:j], home[i:j], threshold)
            a.append(fp[i:j][x])
            b.append(fp[i:j][y])
        if a and len(x := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) and held[0][0] != held[0][-1]:  # the last anchor may go on in the next batch
                last = int(np.searchsorted(held[0], held[0][-1]))
                yield from of_groups(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield from of_groups(*held)

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between the fingerprints of column fp that connect all within ``threshold`` bits; fp must be distinct."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"two halves cover up to {THRESHOLD} differing bits")

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys, homes = anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(fp[rows]), pa.array(homes)], names=["anchor", "fp", "home"])

    dealt = fps.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def _components_of(of_rows: DataFrame, least: DataFrame, threshold: int) -> DataFrame:
    """(fp, component) for the fp of ``least``: the smallest ``low`` that links reach. least: distinct fp with low."""
    roots = C.cut(components(links(least, threshold)))
    # fingerprints with a link get their component's smallest value, the others keep their own
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", "low", "root")
    of_root = placed.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("low").alias("component"))
    named = placed.join(of_root, "root", "left").select("fp", F.coalesce("component", "low").alias("component"))
    return of_rows.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id that links reach."""
    of_rows = C.cut(fingerprints(docs, width, 42, id_col, text_col))
    distinct = C.cut(of_rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    return _components_of(of_rows, distinct, threshold).select(id_col, "fp", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each group of near-duplicates the one with the smallest id (a null id comes last, ties go to the row read first).

    Groups are of rows, not of ids: another text under the id of a copy stays, and of equal rows one stays.
    """
    spark = docs.sparkSession
    rows, out = C.new_folder(spark, "rows"), C.new_folder(spark, "copies")
    columns = tuple(dict.fromkeys([id_col, *docs.columns]))
    known = fingerprints(docs, width, 42, id_col, text_col, columns).withColumnRenamed("fp", "__fp")
    # with its texts: the number of a row holds only for the rows as they were read this once
    known = C.table(known.withColumn("__row", F.monotonically_increasing_id()), rows)
    order = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    of_rows = known.select(order.alias("at"), F.col("__fp").alias("fp"))
    distinct = C.cut(of_rows.groupBy("fp").agg(F.min("at").alias("low")))
    gone = C.table(_components_of(of_rows, distinct, threshold).filter("at.row <> component.row").select(F.col("at.row").alias("__row")), out)
    return known.join(gone, "__row", "left_anti").select(docs.columns)


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
