"""Stages that keep going: a value and an error per row instead of a failed job (L4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of Arrow rows handed to a stage at a time, about; a wider row goes alone.
BATCH_BYTES = 1 << 20


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BATCH_BYTES``: halves of those that are larger."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            own = waiting.pop()
            if own.num_rows > 1 and own.nbytes > BATCH_BYTES:
                half = own.num_rows // 2
                waiting += [own.slice(half), own.slice(0, half)]
            elif own.num_rows:
                yield own


def guarded(df: DataFrame, stage: Callable[[pd.DataFrame], pd.Series], value_type: str,
            value: str = "value", error: str = "error") -> DataFrame:
    """``df`` with ``value`` = ``stage`` of its batches and ``error``.

    ``stage`` takes a pandas batch (of about ``BATCH_BYTES``) and returns one value per row. A
    batch on which it raises is run again row by row, so a bad record loses only itself: its
    value is NULL and its error reads ``Type: message``. Good rows have a NULL error. A stage
    that returns another number of rows is an error of the whole batch, replayed alike. Input
    columns named like the two new ones are replaced; the others never leave Arrow.
    """
    kept = df.drop(value, error)
    schema = T.StructType([*kept.schema.fields,
                           *T._parse_datatype_string(f"`{value}` {value_type}, `{error}` string")])
    result = df.sparkSession.createDataFrame([], f"`{value}` {value_type}").toArrow().schema[0].type

    def once(pdf: pd.DataFrame) -> list:
        out = list(stage(pdf))
        if len(out) != len(pdf):
            raise ValueError(f"{len(out)} values for {len(pdf)} rows")
        return out

    def as_pandas(batch: pa.RecordBatch) -> pd.DataFrame:
        pdf = batch.to_pandas(date_as_object=True)
        for c in pdf.columns:
            if isinstance(pdf[c].dtype, pd.DatetimeTZDtype):  # local times, as in mapInPandas
                pdf[c] = pdf[c].dt.tz_localize(None)
        return pdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            pdf = as_pandas(batch)
            try:
                values, errors = once(pdf), [None] * len(pdf)
            except Exception:  # noqa: BLE001 - told per row below
                values, errors = [], []
                for i in range(len(pdf)):
                    try:
                        values += once(pdf.iloc[i:i + 1])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        values.append(None)
                        errors.append(_told(e))
            made = pd.Series(values, dtype=object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.Array.from_pandas(made, mask=made.isnull().to_numpy(), type=result),
                 pa.array(errors, pa.string())], names=[*batch.schema.names, value, error])
    return kept.mapInArrow(run, schema)


def read_json_guarded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as ``value`` (a struct of ``schema``), ``error`` and ``line``. A line that is
    no JSON object, or has a field of another type, has an error and a NULL value; empty lines
    are skipped."""
    corrupt = "_corrupt_record"
    parsed = F.from_json("line", f"{schema}, {corrupt} string",
                         {"columnNameOfCorruptRecord": corrupt})
    rows = spark.read.text(path).select(F.col("value").alias("line")).where(
        F.trim("line") != "").withColumn("p", parsed)
    bad = F.col(f"p.{corrupt}").isNotNull() | F.col("p").isNull()
    fields = T._parse_datatype_string(schema).names
    return rows.select(F.when(~bad, F.struct(*[F.col("p")[f].alias(f) for f in fields])).alias(
        "value"), F.when(bad, F.lit("ValueError: no record of the schema")).alias("error"), "line")


def guarded_column(value: Column, checks: dict[str, Column]) -> Column:
    """``struct(value, error)`` of a Column: the first check (error text -> condition) that
    holds gives the error and a NULL value."""
    error = F.coalesce(*[F.when(c, F.lit(text)) for text, c in checks.items()])
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))
