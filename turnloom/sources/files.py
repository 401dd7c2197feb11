"""Scans and sinks: strict JSON, JSON lines, guarded CSV, file inventories, ids."""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.columns import csv_safe
from turnloom.functions.spec import ContractError
from turnloom.functions.text import hmac_sha256
from turnloom.sources.json_lines import read_strict


def strict_json(text: str):
    """One JSON value without repeated keys, NaN or infinities."""
    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ContractError("DUPLICATE_JSON_KEY")
        return out

    def constant(name):
        raise ContractError("NON_FINITE_JSON_NUMBER: " + name)

    def number(digits):
        value = float(digits)
        if not math.isfinite(value):
            raise ContractError("NON_FINITE_JSON_NUMBER: " + digits)
        return value

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except json.JSONDecodeError as e:
        raise ContractError("INVALID_JSON") from e


#: The whole answer in one fence, with or without the language's name.
FENCED = re.compile(r"```(?:json)?[ \t]*\r?\n(?P<body>(?:(?!```).)*)```", re.S | re.I)


def decode_answer(text: str):
    """A model's answer: one object, bare or in one fenced block, never repaired."""
    whole = text.strip()
    fenced = FENCED.fullmatch(whole)
    out = strict_json(fenced["body"].strip() if fenced else whole)
    if not isinstance(out, dict):
        raise ContractError("ANSWER_NOT_AN_OBJECT")
    return out


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of JSON lines; repeated keys, numbers that are not finite and anything
    that is no object of the schema are errors."""
    return read_strict(spark, path, schema)


def finite_rows(df: DataFrame) -> DataFrame:
    """``df``, an error where a double is NaN or infinite: JSON has no word for it."""
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(f"`{f.name}`")
            df = df.withColumn(f.name, F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"NON_FINITE_NUMBER: {f.name}")).cast(f.dataType)).otherwise(c))
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    finite_rows(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The header must be the schema's, in order."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def guard(df: DataFrame) -> DataFrame:
    return df.select(*[csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Guarded cells below a header that begins with a byte order mark, by which
    spreadsheets know UTF-8; ``read_csv`` takes files with and without one."""
    marked = guard(df.select(*fields)).withColumnRenamed(fields[0], "\ufeff" + fields[0])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def inventory(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, size and SHA-256 of the files below a folder; temporary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def identity(c: Column) -> Column:
    """An id as text: a whole number without its decimals, trimmed; blank is null."""
    t = F.trim(c.cast("string"))
    whole = F.regexp_replace(t, r"^([+-]?\d+)\.0+$", "$1")
    return F.when(whole != "", whole)


def required_identity(c: Column) -> Column:
    """``identity``, an error where it is blank."""
    t = identity(c)
    return F.when(t.isNull(), F.raise_error(F.lit("IDENTITY_MISSING")).cast("string")).otherwise(t)


def pseudonym(key: bytes, term: Column, who: Column) -> Column:
    """Keyed pseudonym within a term: no link between terms without the key."""
    return F.concat(F.lit("S-"), F.substring(hmac_sha256(key, F.concat(term.cast("string"), F.lit("\0"), who.cast("string")).cast("binary")), 1, 20))
