"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.lineage import checkpointed, spread

__all__ = ["checkpointed", "keyed_texts", "spread", "text_groups"]

#: Characters handled by one numpy pass; keeps the temporaries of a Python worker in the tens of MB.
GROUP_CHARS = 1_000_000


def keyed_texts(df: DataFrame, key: str, text: str, key_type: str = "string") -> DataFrame:
    """Two columns, ``k`` and ``t``: rows without key or text are no input, whatever else the table holds."""
    return df.select(F.col(f"`{key}`").cast(key_type).alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")


def text_groups(batches: Iterable[pa.RecordBatch], limit: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of the batches' first two columns, in groups of about ``limit`` characters."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
