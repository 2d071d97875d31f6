"""Problem 4, first stage: which document holds which foreign markup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .residue import count_constructs


def _residue_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (key, markup, n)
            for key, kind, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "text")))
            for markup, n in count_constructs(kind, text).items()
        ]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["key", "markup", "constructs"]
        )


def residues(docs: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """(key, markup, constructs): the foreign markups of every document, with their number of constructs.

    NULL and empty texts have none; a NULL or unknown kind has no markup of its own and no code; a row given twice
    counts once.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    rows = own.where("key IS NOT NULL AND text IS NOT NULL AND text <> ''").mapInArrow(_residue_batches, "key string, markup string, constructs long")
    return rows.groupBy("key", "markup").agg(F.max("constructs").alias("constructs"))
