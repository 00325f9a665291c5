"""JSON whose shape differs from producer to producer, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text_col: str, name: str = "payload") -> DataFrame:
    """The frame with its JSON text parsed once into a VARIANT column; text that is no JSON gives NULL."""
    return df.withColumn(name, F.try_parse_json(F.col(text_col).cast("string")))


def kind(payload, path: str) -> Column:
    """What stands at a path: ``number``, ``text``, ``boolean``, ``object``, ``array``, ``null``, or NULL where nothing does."""
    shape = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    return (F.when(shape == "VOID", "null").when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean")
            .when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape.isNotNull(), "number"))


def number(payload, path: str) -> Column:
    """The number at a path, also where a producer sends it as text; NULL for anything else."""
    return F.when(kind(payload, path).isin("number", "text"), F.try_variant_get(payload, path, "double"))


def text(payload, path: str) -> Column:
    """What stands at a path as text, objects and arrays as JSON."""
    return F.try_variant_get(payload, path, "string")


def shapes(df: DataFrame, payload: str, by=()) -> DataFrame:
    """The schema that all payloads (of each group) share, merged inside every task first."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(payload).alias("shape"), F.count("*").alias("n"),
                               F.sum(F.col(payload).isNull().cast("long")).alias("n_bad"))
