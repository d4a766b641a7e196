"""Schemas of the data model; sources are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S = T.StringType()

# --- fixed values: field names of the data contract, splits and seed ---------------------------------
CORPUS_RECORD = _struct(record_id=S, id=S, domain=S, generator=S, version=S, edit_operation=S, subset=S, split=S, text=S, sentences=S, sentence_labels=S)
SPLITS = {"train": "development", "dev": "calibration", "test": "test"}
SEED = 23092026
# -----------------------------------------------------------------------------------------------------
