"""Gold sentences found again in their source text, one after another, with nothing but white space between them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import record_batches
from ..functions.segment import utf16_of

SCHEMA = "record_id string, k int, start int, end int, text string, annotation string, gap_before string, trailing string, mapped boolean, error string"


_NOT_SPACE = re.compile(r"\S")


def _first(text: str, at: int) -> int:
    """Where the next character that is no white space stands, or the text's length."""
    m = _NOT_SPACE.search(text, at)
    return m.start() if m else len(text)


def _across_spaces(text: str, at: int, parts: list[str]) -> int:
    """Where the parts end that stand from ``at`` on with white space between them; -1 if they do not."""
    for k, part in enumerate(parts):
        if k:
            begin, at = at, _first(text, at)
            if at == begin:
                return -1
        if not text.startswith(part, at):
            return -1
        at += len(part)
    return at


def align_record(text: str, sentences: list[str]) -> list[tuple]:
    """Rows (k, start, end, text, annotation, gap_before, trailing, mapped, error); one row with an error if the record does not align."""
    unit, at, out = utf16_of(text), 0, []
    for k, gold in enumerate(sentences):
        # nothing but white space may be passed over, so a sentence begins here or nowhere: the rest of the text is not searched
        here = _first(text, at)
        start, mapped = (text.find(gold, at, here + len(gold)) if gold else -1), False
        if start >= 0:
            end = start + len(gold)
        else:  # the annotation may have other white space than the source
            parts = gold.split()
            start, end, mapped = here, _across_spaces(text, here, parts) if parts else -1, True
            if end < 0:
                return [(k, None, None, None, gold, None, None, None, "sentence not found in order")]
        out.append([k, start, end, text[start:end], gold, text[at:start], "", mapped, None])
        at = end
    if text[at:].strip():
        return [(len(out), None, None, None, None, None, None, None, "text left over")]
    if out:
        out[-1][6] = text[at:]
    if unit is not None:
        for row in out:
            row[1], row[2] = int(unit[row[1]]), int(unit[row[2]])
    return [tuple(r) for r in out]


def align(records: DataFrame) -> DataFrame:
    """records: record_id, text, sentences array<string>. Records with nulls come back as one row with an error."""

    def rows(batches):
        for batch in batches:
            for rid, text, gold in zip(*(batch.column(c) for c in ("record_id", "text", "sentences")), strict=True):
                rid, text, gold = rid.as_py(), text.as_py(), gold.as_py()
                if text is None or gold is None or None in gold:
                    yield (rid, 0, *[None] * 7, "null in record")
                else:
                    yield from ((rid, *r) for r in align_record(text, gold))

    types = (pa.string(), *[pa.int32()] * 3, *[pa.string()] * 4, pa.bool_(), pa.string())
    fields = [(x.split()[0], t) for x, t in zip(SCHEMA.split(", "), types, strict=True)]

    def run(batches):
        yield from record_batches(rows(batches), fields)

    return records.select("record_id", "text", "sentences").mapInArrow(run, SCHEMA)
