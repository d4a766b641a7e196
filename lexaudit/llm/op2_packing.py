"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

Only the piece lengths matter for the packing, so texts are tokenised once where
they are read and a small table of pieces goes on.  Pieces of a full sequence
need no packing.  The others are dealt by a seeded hash of the piece and its row into groups of about
``group_rows`` pieces, as many groups as the input needs; each group is packed
by itself, longest piece first: a piece goes where the sum over all residual
gaps of the squared number of open sequences with that gap becomes smallest
(an open sequence of some gap, or a new one; the smallest gap wins a tie).
State is one counter for each gap and a stack of open sequences for each gap.

Defined results: a null text is empty and is the end id alone; a text never
shares its end id; equal rows are packed as often as they occur; a table
without rows gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

SEED = 4711


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids; only a longer document is cut, and its first piece takes the remainder."""
    chosen = docs.select(id_col, C.text_bytes(text_col).alias("__text"))
    id_type = chosen.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for a, b, data, offsets in C.chunks(batch.column("__text")):
                flat, cuts = enc.encode(data, offsets)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for r in range(b - a):
                    own = np.append(flat[cuts[r] : cuts[r + 1]], np.uint32(end_id)).astype("<u4")
                    at, k, to = 0, 0, (len(own) - 1) % size + 1
                    while at < len(own):
                        raw = own[at:to].tobytes()
                        rows.append(a + r)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(raw))
                        if with_ids:
                            ids.append(raw)
                        at, to, k = to, to + size, k + 1
                out = [batch.column(id_col).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())] if with_ids else out, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the given order; all lengths are between 1 and size."""
    open_gaps = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares for each gap g >= s: one less of g, one more of g - s (none at 0: the sequence is full)
        change = 2 * (open_gaps[: size - s] - open_gaps[s:size]) + 2
        if len(change):
            change[0] -= 1
            change[open_gaps[s:size] == 0] = np.iinfo(np.int64).max
            rest = int(change.argmin())
        if len(change) and change[rest] <= 2 * open_gaps[size - s] + 1:
            at = stacks[rest + s].pop()
            open_gaps[rest + s] -= 1
            offset[i] = size - s - rest
        else:
            at, rest, n = n, size - s, n + 1
            offset[i] = 0
        if rest:
            stacks[rest].append(at)
            open_gaps[rest] += 1
        sequence[i] = at
    return sequence, offset


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset; each sequence has no gap between its pieces."""
    pieces = C.cut(pieces)
    short = pieces.filter(F.col("length") < size)
    n_groups = -(-short.count() // group_rows) or 1
    # with the row's number in the written pieces: equal rows are dealt to different groups
    short = short.withColumn("__row", F.monotonically_increasing_id())
    key = F.xxhash64(F.lit(SEED), id_col, "piece", "ids_crc32", "__row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["__key"].to_numpy(), -table["length"].to_numpy()])
        table = table.take(pa.array(order))
        sequence, offset = sum_of_squares(table["length"].to_numpy(), size)
        group = table["__group"].to_numpy().astype(np.int64)
        return table.drop_columns(["__key", "__group"]).append_column("sequence_id", pa.array(group << 40 | sequence << 1)).append_column("offset", pa.array(offset))

    packed = short.select(*pieces.columns, key.alias("__key"), F.pmod(key, F.lit(n_groups)).cast("int").alias("__group")).groupBy("__group").applyInArrow(run, f"{fields}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == size).select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = 20_000) -> DataFrame:
    """Tokenise, cut and pack; ``with_ids`` adds each piece's ids as little-endian unsigned 32-bit numbers."""
    return pack(token_pieces(docs, tokenizer, size, 0, id_col, text_col, with_ids), size, group_rows, id_col)
