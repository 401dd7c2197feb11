"""Strict JSON lines against Python's parser, with the place of each fault."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError
from turnloom.sources import files, json_lines

LINES = [
    '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"x":[1,{"x":1,"x":2}]}', '{"a":NaN}', '{"a":[1, -Infinity]}', '{"a":1e999}', '{"a":-1e400}', '{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "", "  ", "nul", "null", "3", '"s"', '{"a":}', '{"a":1,}', "{'a':1}",
    '{"a":01}', '{"a":1e5}', '{"a":"1e999"}', '{"a":"NaN"}', '{"a":": NaN,"}', '{"a":Infinity}', '{"\\u0061":1,"a":2}', '{"a":.5}', '{"a":1.}', '1,0] junk [', '1} {', '{"a":"it\'s"}', '{"a":"\\""}', '{"a":"\\\\"}', '{"a":[]}', '[{"a":1}]', '{"A":1,"a":2}', ' {"a":1} ', '{"a":"\\u00e9é","b":{"c":{"d":[{"e":1},{"e":2}]}}}',
    '{"a":' + "[" * 50 + "]" * 50 + "}", '{"a":' + "9" * 400 + "}", '{"a":1.5E+300}', '{"":1,"":2}', '{"a":true,"b":null}', '{"a":tru}', "{", "}", "[", '{"a" 1}', '{"a":"b',
]


def plain(line):
    try:
        value = files.strict_json(line)
    except ContractError as e:
        return str(e).split(":")[0]
    return None if isinstance(value, dict) else "NOT_AN_OBJECT"


def expected(line):
    """Python reads a whole number of any size; as a double it is none."""
    code = plain(line)
    return "NON_FINITE_JSON_NUMBER" if code is None and "9" * 400 in line else code


def test_faults_of_lines(spark):
    rnd = random.Random(4)
    more = ["".join(rnd.choice(['{"a":', "}", "1", ",", '"b":', "[", "]", '"x"', " ", "NaN", "null", '"a":2']) for _ in range(rnd.randint(1, 7))) for _ in range(1500)]
    lines = LINES + more
    got = {r.i: r.c for r in spark.createDataFrame(list(enumerate(lines)), "i int, v string").select("i", json_lines.fault(F.col("v")).alias("c")).collect()}
    refused = [(x, got[i], expected(x)) for i, x in enumerate(lines) if (got[i] is None) != (expected(x) is None)]
    assert not refused, refused[:5]
    named = [(x, got[i], expected(x)) for i, x in enumerate(LINES) if got[i] != expected(x)]
    assert not named, named


def test_places_of_faults_in_split_files(spark, tmp_path):
    lines = [json.dumps({"k": i, "t": "x" * (i % 90)}) if i % 37 else '{"k":1,"k":2}' if i % 2 else "{" for i in range(4000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    key, was = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "20000")
    try:
        got = [(r.file.rsplit("/", 1)[1], r.line, r.code) for r in json_lines.faults(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set(key, was)
    assert sorted(got) == sorted((f"{n}.jsonl", i + 1, "DUPLICATE_JSON_KEY" if i % 2 else "INVALID_JSON") for n in "ab" for i in range(0, 4000, 37))
    with pytest.raises(Exception, match="DUPLICATE_JSON_KEY|INVALID_JSON"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k long, t string").collect()


def test_strict_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k":1,"t":"a"}\n{"t":"b","k":2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k long, t string").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k long, t int").collect()
