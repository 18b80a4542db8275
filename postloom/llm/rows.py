"""Keeping and dropping rows by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: So many ids at most are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids`` (one column); rows with a null id stay."""
    ids = materialize(ids.toDF("_dropped").where("_dropped is not null").distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_dropped"], "left_anti")
