"""What the operators of this subpackage share: their tables' texts and ids, and row-wise Arrow stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "read_table", "row_id", "rowwise", "shared_dir", "texts_of"]

#: Rows of text in one step of a Python stage; a step holds only their texts and results.
SLICE = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", empty: bool = True) -> DataFrame:
    """Only the id and the text; a null text becomes the empty one if `empty`."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if empty else text).alias("text"))


def row_id(doc_id: Column, text: Column) -> Column:
    """128 bits that name an id and a text; a null text is an empty one."""
    parts = F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def rowwise(df: DataFrame, schema: str, step: Callable[[], Callable[[list[dict]], list[tuple]]]) -> DataFrame:
    """Runs step() once in each task; what it returns maps a few input rows to tuples of `schema`.

    Input rows come as dicts, at most SLICE at a time, so memory doesn't follow the batch size.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = step()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = work(batch.slice(at, SLICE).to_pylist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)
