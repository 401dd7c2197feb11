"""Not-modified revisits: each is resolved to the latest earlier full response of
its canonical URL, as an as-of join.

Records have: record_id, url, ts (long), kind ('response' or 'revisit'), headers
(map of lower-case names) and payload. A revisit is *resolved* when its validators
agree with the response's: the ETags (weak comparison) where both have one, else
Last-Modified where both have one; with nothing to compare it is *unchecked*, and
taken. Where they differ it is a *mismatch*, and keeps no payload. Without an
earlier response it is *orphan*. A resolved revisit takes the response's payload
and headers, updated by those of its own that a 304 may carry.

A URL may hold a third of all records: time is cut into ``slices`` that hold about
as many records each (by quantiles), windows run within (URL, slice), and one row for
each (URL, slice) carries the last response over to later slices. Only keys travel
until the response is known.

Defined cases: at the same time a response is not earlier; of responses at one
time the largest record_id is the latest; null URLs and times are orphans (a
response without them is never found); null headers are empty; repeated rows are
resolved each, and a repeated response record counts once; empty tables give empty
results; further columns of the revisit, whatever their names, travel in ``row``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may bring up to date.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and 'www.' dropped, host in lower case without a default port, no
    fragment, no trailing slash, query parameters sorted; null where there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))
    return F.when(host != "", F.concat(host, path, tail))


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.col(headers)["etag"], "^W/", "")


def _cuts(df: DataFrame, slices: int) -> list[float]:
    """Quantiles of t that part ``df`` into ``slices`` at most."""
    if slices < 2:
        return []
    return sorted(set(df.select(F.col("t").cast("double").alias("t")).stat.approxQuantile("t", [k / slices for k in range(1, slices)], 0.25 / slices)))


def _sliced(df: DataFrame, cuts: list[float]) -> DataFrame:
    """``df`` with slice: how many of ``cuts`` are not above t."""
    if not cuts:
        return df.withColumn("slice", F.lit(0).cast("long"))
    named = df.withColumn("_t", F.col("t").cast("double"))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_t", outputCol="_slice").transform(named).withColumn("slice", F.col("_slice").cast("long")).drop("_t", "_slice")


def resolve_revisits(records: DataFrame, *, slices: int = 256) -> DataFrame:
    """One row for each revisit: row (its columns but the payload), canonical_url,
    response_id, status, headers (merged), payload."""
    keys = [F.col(f"`{c}`") for c in records.columns if c != "payload"]
    base = records.select(F.struct(*keys).alias("row"), canonical_url(F.col("url")).alias("u"), F.col("ts").cast("long").alias("t"), F.col("kind").alias("kind"), F.col("record_id").alias("id"))
    placed = base.where("u IS NOT NULL AND t IS NOT NULL")
    cuts = _cuts(placed, slices)
    light = _sliced(placed.where("kind = 'response'"), cuts).select("u", "slice", "t", F.lit(True).alias("full"), "id", F.lit(None).cast(base.schema["row"].dataType).alias("row"))
    lost = base.where("kind = 'revisit' AND (u IS NULL OR t IS NULL)").select("u", "row", F.lit(None).cast(base.schema["id"].dataType).alias("at"))
    asked = _sliced(placed.where("kind = 'revisit'"), cuts).select("u", "slice", "t", F.lit(False).alias("full"), "id", "row")
    order = Window.partitionBy("u", "slice").orderBy("t", F.col("full").asc(), "id")
    seen = light.unionByName(asked).withColumn("at", F.last(F.when(F.col("full"), F.col("id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row per URL and slice: its own last response, and the last one before it
    last = light.groupBy("u", "slice").agg(F.max(F.struct("t", "id")).alias("own"))
    known = last.unionByName(asked.select("u", "slice").distinct().withColumn("own", F.lit(None).cast(last.schema["own"].dataType))).groupBy("u", "slice").agg(F.max("own").alias("own"))
    before = F.last("own", ignorenulls=True).over(Window.partitionBy("u").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = known.select("u", "slice", before["id"].alias("carried"))
    found = seen.where("NOT full").join(carried, ["u", "slice"], "left").select("u", "row", F.coalesce("at", "carried").alias("at")).unionByName(lost)
    key = F.col("response_id").cast("string")
    full = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("headers").alias("old"), F.col("payload").alias("body")).withColumn("key", key).dropDuplicates(["key"])
    # what has no response gets a key of its own: null keys would all meet in one task
    own = F.coalesce(F.col("at").cast("string"), F.concat(F.lit("\u0000"), F.xxhash64("row.record_id", "row.ts").cast("string")))
    both = found.withColumn("key", own).join(full, "key", "left").withColumn("new", F.coalesce(F.col("row.headers"), F.create_map().cast("map<string,string>"))).withColumn("old", F.coalesce("old", F.create_map().cast("map<string,string>")))
    modified, was = F.col("new")["last-modified"], F.col("old")["last-modified"]
    agree = F.when(_tag("new").isNotNull() & _tag("old").isNotNull(), _tag("new") == _tag("old")).when(modified.isNotNull() & was.isNotNull(), modified == was)
    status = F.when(F.col("response_id").isNull(), "orphan").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter("new", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    taken = F.col("status").isin("resolved", "unchecked")
    return both.withColumn("status", status).select("row", F.col("u").alias("canonical_url"), "response_id", "status", F.when(taken, merged).otherwise(F.col("new")).alias("headers"), F.when(taken, F.col("body")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawls of ``pages`` that interleave: a full response for each page, another one
    up to 40,000 later, whose body has changed for two pages in three, and a visit
    answered 'not modified' up to 60,000 later, whose ETag names the first body.
    Some visits come before any response, some at the very time of the second one."""
    tag = lambda body: F.concat(F.lit('"'), F.substring(F.md5(body), 1, 16), F.lit('"'))
    key, first = F.col("page_id"), F.coalesce("html", F.lit(""))
    second = F.when(key % 3 == 0, first).otherwise(F.concat(first, F.lit(" ")))
    t0 = key * 10
    t1 = t0 + 40 * (key * 31 % 1000) + 25
    t2 = F.when(key % 29 == 0, t0 - 5).when(key % 23 == 0, t1).otherwise(t0 + 40 * (key * 17 % 1500) + 15)

    def full(record, ts, body):
        headers = F.create_map(F.lit("etag"), tag(body), F.lit("content-type"), F.lit("text/html"), F.lit("date"), ts.cast("string"))
        return pages.select(record.alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), headers.alias("headers"), body.alias("payload"))

    headers = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag(first)), F.lit("date"), t2.cast("string"), F.lit("content-length"), F.lit("0"))
    again = pages.select((key * 3 + 2).alias("record_id"), "url", t2.alias("ts"), F.lit("revisit").alias("kind"), headers.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full(key * 3, t0, first).unionByName(full(key * 3 + 1, t1, second)).unionByName(again)
