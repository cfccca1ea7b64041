"""Readers with declared schemas; every one is splittable except where noted."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("tweet_created_at", T.StringType()),
        T.StructField("geo", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
        T.StructField("user", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("pure_text", T.StringType()),
        T.StructField("fastText_lang", T.StringType()),
    ]
)


def read_concat_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, first_key: str = "id", glue: str = ""
) -> DataFrame:
    """Objects glued as ``}{`` (or with a fixed ``glue`` between), one row each.

    The record separator is the end of one object and the start of the next
    with its first key. It cannot occur inside an object: quotes in a text are
    escaped, and nested objects follow a colon or comma. Files stay splittable
    however long their lines are. Unreadable objects come out as rows with
    ``_bad`` set to their text.
    """
    start = f'{{"{first_key}"'
    pieces = spark.read.text(path if isinstance(path, str) else list(path), lineSep="}" + glue + start)
    # Only the first piece of a file still has its start, only the last one its
    # end; the parser stops at the end of the first object.
    body = F.trim(F.regexp_replace("value", "^\\s+", ""))
    whole = F.concat(F.when(body.startswith("{"), F.lit("")).otherwise(F.lit(start)), body, F.lit("}"))
    return _parse(pieces.filter(F.length(body) > 0).select(whole.alias("body")), schema)


def read_spaced_json(spark: SparkSession, path: str, schema: T.StructType, first_key: str = "id") -> DataFrame:
    """As ``read_concat_json`` for objects with varying blanks or commas between.

    Needs each file as one value; meant for files of at most a gigabyte.
    """
    start = re.escape(f'{{"{first_key}"')
    whole = spark.read.text(path, wholetext=True)
    pieces = whole.select(F.explode(F.split("value", r"(?<=\})[\s,]*(?=" + start + ")")).alias("body"))
    trimmed = F.regexp_replace("body", r"^[\s\[]+|[\s\],]+$", "")
    return _parse(pieces.select(trimmed.alias("body")).filter(F.length("body") > 0), schema)


def _parse(objects: DataFrame, schema: T.StructType) -> DataFrame:
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("body", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return objects.select(parsed.alias("o")).select("o.*")


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Files that each hold one array of objects; empty files give no rows."""
    return spark.read.schema(schema).json(path if isinstance(path, str) else list(path), multiLine=True)


def read_csv_set(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV files with a header, quoted texts and ``\\n`` records."""
    return spark.read.schema(schema).csv(
        paths if isinstance(paths, str) else list(paths), header=True, lineSep="\n", multiLine=True, escape='"', quote='"'
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames of different layouts under lower-case names, gaps as null."""
    out = None
    for frame in frames:
        lower = frame.select(*(F.col(c).alias(c.lower()) for c in frame.columns))
        out = lower if out is None else out.unionByName(lower, allowMissingColumns=True)
    return out


def fixed_width(lines: DataFrame, fields: Sequence[tuple[str, int, str]], value: str = "value") -> DataFrame:
    """Columns from (name, width, type) laid side by side in each line."""
    cols, at = [], 1
    for name, width, kind in fields:
        cols.append(F.trim(F.substring(F.col(value), at, width)).cast(kind).alias(name))
        at += width
    return lines.select(*cols)


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, str]]) -> DataFrame:
    return fixed_width(spark.read.text(path), fields)


def read_tsv_footer(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, measure: str) -> DataFrame:
    """Tab-delimited export; its footer rows, which lack the measure, are dropped."""
    rows = spark.read.schema(schema).csv(path if isinstance(path, str) else list(path), sep="\t", header=True)
    return without_footer(rows, measure)


def without_footer(rows: DataFrame, measure: str) -> DataFrame:
    return rows.filter(F.col(measure).isNotNull())


def flatten_geo(df: DataFrame) -> DataFrame:
    """lon and lat from ``geo.coordinates`` (lon first); drops geo and user."""
    spot = F.col("geo.coordinates")
    return df.select("*", F.get(spot, 0).alias("lon"), F.get(spot, 1).alias("lat")).drop("geo", "user")


def epoch_ms(text: Column) -> Column:
    """UTC timestamp from ``{'$date': ms}``, single quotes included."""
    ms = F.from_json(text, "`$date` bigint", {"allowSingleQuotes": "true"}).getField("$date")
    return F.to_timestamp_ntz(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"))


def parse_epoch_ms(df: DataFrame, col: str = "tweet_created_at") -> DataFrame:
    """created_at, its yyyymmdd text and hour, in UTC."""
    at = epoch_ms(F.col(col))
    return df.withColumn("created_at", at).withColumns(
        {"yyyymmdd": F.date_format("created_at", "yyyyMMdd"), "hour": F.hour("created_at")}
    )


def count_records(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Records per file and, under 'total', of all files."""
    named = df.select((F.input_file_name() if file is None else file).alias("file"))
    return named.rollup("file").agg(F.count(F.lit(1)).alias("records"), F.grouping("file").alias("g")).select(
        F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("file")).alias("file"), "records"
    )


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), [key], "left_anti")
