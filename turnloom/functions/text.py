"""Text functions that engines have in part only, as built-in expressions: references to
characters resolved, full case folding, keyed hashes. Their tables are made by rule from
the Unicode data and the list of names that Python has."""

from __future__ import annotations

import functools
import hashlib
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "�"


@functools.cache
def odd_numbers() -> dict[str, str]:
    """Numbers of characters that stand for others: 128 to 159 are read as Windows has
    them where it has any, and 0 is unknown."""
    def windows(n: int) -> str:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)

    return {"0": UNKNOWN} | {str(n): windows(n) for n in range(0x80, 0xA0)}


def _left_out(code: Column) -> Column:
    """Control characters but white space, and code points that are no characters."""
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    return control | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 65534)


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _sign(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered(code: Column, far: Column) -> Column:
    """The character of a number; ``far`` tells that it is beyond all."""
    other = F.try_element_at(_table(odd_numbers()), code.cast("string"))
    return F.when(far | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), UNKNOWN).when(other.isNotNull(), other).when(_left_out(code), "").otherwise(_sign(code))


def _resolved(part: Column) -> Column:
    """A stretch of text that begins with an ampersand and has no other."""
    ten, sixteen = (F.regexp_extract(part, p, 1) for p in ("^&#([0-9]+)", "^&#[xX]([0-9a-fA-F]+)"))
    name = F.regexp_extract(part, "^&([^\\t\\n\\f <&#;]{1,32};?)", 1)
    bare = lambda s: F.regexp_replace(s, "^0+(?=.)", "")
    after = lambda pattern: F.regexp_replace(part, pattern, "")
    by_ten = _numbered(F.substring(bare(ten), 1, 7).cast("long"), F.length(bare(ten)) > 7)
    by_sixteen = _numbered(F.conv(F.substring(bare(sixteen), 1, 6), 16, 10).cast("long"), F.length(bare(sixteen)) > 6)
    whole = F.try_element_at(_table(html.entities.html5), name)
    # names that need no semicolon are found as beginnings too, the longest first
    short = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    begin = F.regexp_extract(part, "^&(" + "|".join(short) + ")", 1)
    rest = lambda n: F.substring(part, F.length(n) + 2, F.length(part))
    named = F.when(whole.isNotNull(), F.concat(whole, rest(name))).when(begin != "", F.concat(F.try_element_at(_table(html.entities.html5), begin), rest(begin))).otherwise(part)
    return F.when(~F.startswith(part, F.lit("&")), part).when(ten != "", F.concat(by_ten, after("^&#[0-9]+;?"))).when(sixteen != "", F.concat(by_sixteen, after("^&#[xX][0-9a-fA-F]+;?"))).when(name != "", named).otherwise(part)


def unescape(text: Column) -> Column:
    """``text`` with named and numbered references to characters resolved, as browsers do."""
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), _resolved), "")).otherwise(text)


@functools.cache
def folding() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose full case folding is another character, and those for which it
    is several."""
    all_ = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.casefold() != c}
    return {c: f for c, f in all_.items() if len(f) == 1}, {c: f for c, f in all_.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding."""
    one, several = folding()
    pairs = F.from_json(F.lit(json.dumps([{"a": c, "b": f} for c, f in several.items()])), "array<struct<a:string,b:string>>")
    long = F.aggregate(pairs, text, lambda t, x: F.replace(t, x.a, x.b))
    # a class of so many characters is slow to match; taking them out is not
    text = F.when(F.length(F.translate(text, "".join(several), "")) != F.length(text), long).otherwise(text)
    return F.translate(text, "".join(one), "".join(one.values()))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of binary ``message``, in lower-case hexadecimal."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
