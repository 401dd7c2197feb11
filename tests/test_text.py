"""Text expressions against Python's functions."""

import hashlib
import hmac
import html
import random

from pyspark.sql import functions as F

from turnloom.functions.text import casefold, hmac_sha256, unescape
from turnloom.operators import dialogue
from turnloom.sources.files import pseudonym


def test_references_to_characters(spark):
    rnd = random.Random(1)
    texts = [f"a&{n}b &{n.rstrip(';')}; &{n.rstrip(';')}x" for n in html.entities.html5]
    texts += [f"&#{n};&#x{n:X} &#{n}z" for n in [*range(0x300), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFE, 0x10FFFF, 0x110000, 10**7, 10**30]]
    texts += ["".join(rnd.choice(["&", "#", "x", "amp", "lt", ";", "no", "tin", "12", " ", "é", "&#", "&#x", "<"]) for _ in range(9)) for _ in range(2000)]
    texts += ["", "&", "&;", "&#;", "&#x;", "&#xZ", "&&amp;&", "&#00065;", "&#x00000041;", "&" + "a" * 40 + ";", "&amp" + "a" * 40, "plain", "&notit; &notin; &ampersand"]
    got = {r.i: r.u for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_full_case_folding(spark):
    step = 300
    signs = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if chr(c).casefold() != chr(c) or c % 997 == 0]
    texts = ["x".join(signs[i : i + step]) for i in range(0, len(signs), step)] + ["Straße ΟΔΟΣ ﬃ İstanbul", ""]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).orderBy("i").select(casefold(F.col("t")).alias("f")).collect()]
    assert got == [t.casefold() for t in texts]


def test_keyed_hashes(spark):
    for key in (b"k", b"", b"x" * 64, b"y" * 100):
        got = spark.createDataFrame([("a", "é"), ("", ""), (None, "b")], "t string, w string").select("t", "w", hmac_sha256(key, F.concat("t", "w").cast("binary")).alias("h"), pseudonym(key, F.col("t"), F.col("w")).alias("p")).collect()
        for r in got:
            if r.t is None:
                assert r.h is None and r.p is None
            else:
                assert r.h == hmac.new(key, (r.t + r.w).encode(), hashlib.sha256).hexdigest()
                assert r.p == "S-" + hmac.new(key, f"{r.t}\0{r.w}".encode(), hashlib.sha256).hexdigest()[:20]


def test_parsing_stays_in_the_engine(spark):
    df = spark.createDataFrame([("Q: 1 &lt; 2 &amp;amp; x?\nA: yes &#x1F600;",)], "raw string")
    out = dialogue.parse(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert out.first().turns[0].question == "1 < 2 &amp; x?"
