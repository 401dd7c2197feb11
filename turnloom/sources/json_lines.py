"""Strict JSON lines without a row in Python: repeated keys at any depth, text after the
value, words and numbers that are no finite number are faults, with their file and line.

The engine's parser of variants refuses repeated keys and what is no JSON, but takes a
value with anything behind it. So each line is parsed inside an array and inside an object:
what closes the one early cannot stand in the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.sources.tables import cut, new_folder

STRING = r'"(?:[^"\\]++|\\.)*+"'
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _parses(value: Column) -> Column:
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), value, F.lit(b))).isNotNull()
    return inside("[", ",0]") & inside('{"k":', "}")


def _infinite(value: Column) -> Column:
    """A number beyond all doubles, outside strings."""
    numbers = F.regexp_extract_all(F.regexp_replace(value, STRING, '""'), F.lit(NUMBER), F.lit(0))
    return F.when(F.regexp_like(value, F.lit("[0-9][eE]|[0-9]{300}")), F.exists(numbers, lambda n: F.abs(n.cast("double")) == float("inf"))).otherwise(False)


def fault(value: Column) -> Column:
    """What is wrong with a line: INVALID_JSON, DUPLICATE_JSON_KEY, NON_FINITE_JSON_NUMBER,
    NOT_AN_OBJECT; null for an object without fault. A blank line is no value."""
    bare = F.trim(value)
    # NaN and infinities as words: the line is JSON with null in their place
    words = F.regexp_replace(bare, r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,\]}])", "$1null")
    # a repeated key is refused, but reading paths through the value takes it
    wellformed = F.get_json_object(F.concat(F.lit("["), bare, F.lit(",0]")), "$[1]").isNotNull() & F.get_json_object(F.concat(F.lit('{"k":'), bare, F.lit("}")), "$").isNotNull()
    return (
        F.when(_parses(bare), F.when(_infinite(bare), "NON_FINITE_JSON_NUMBER").when(~F.startswith(bare, F.lit("{")), "NOT_AN_OBJECT"))
        .when(wellformed & ~_single_quoted(bare), "DUPLICATE_JSON_KEY").when((words != bare) & _parses(words), "NON_FINITE_JSON_NUMBER").otherwise("INVALID_JSON")
    )


def _single_quoted(value: Column) -> Column:
    """Reading paths takes strings in single quotes and raw control characters too."""
    return F.contains(F.regexp_replace(value, STRING, '""'), F.lit("'")) | F.regexp_like(value, F.lit(r"[\x00-\x08\x0b-\x1f\t]"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), code of every fault in the text files of ``path``. Lines are
    counted by block of a file, so a large file is read by many tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    seen = cut(rows.select("file", "block", "at", fault(F.col("value")).alias("code")), new_folder(spark, "json"))
    blocks = seen.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = seen.where("code IS NOT NULL").join(blocks.withColumn("before", before), ["file", "block"])
    return found.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "code")


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of ``path``; a line with a fault, or that is not of the schema, is an
    error. ``faults`` tells where."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    code = fault(F.col("value"))
    line = F.when(code.isNotNull(), F.raise_error(F.concat(code, F.lit(" in "), F.col("_metadata.file_path"))).cast("string")).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
