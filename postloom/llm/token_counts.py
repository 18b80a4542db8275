"""Token counts by a tokenizer compiled to finite-state transducers (see ``tokenizer_fst``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import small_batches
from .shingles import text_buffer
from .tokenizer_fst import compiled

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A null text is empty: no bytes, no tokens.  Null and repeated ids are kept as they are, a row for
    each row; other columns are ignored.  Texts are counted whole, however long.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer_path(tokenizer))
        for batch in batches:
            raw, bounds = text_buffer(batch.column(1))
            n = machine.counts(raw, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
