"""Results of Python functions in small Arrow batches."""

from __future__ import annotations

import pyarrow as pa


def record_batches(rows, fields: list[tuple[str, pa.DataType]], least: int = 1000):
    """Arrow batches of about ``least`` rows each, so that a task holds few of its results at a time."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= least:
            yield _record_batch(held, fields)
            held = []
    if held:
        yield _record_batch(held, fields)


def _record_batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
