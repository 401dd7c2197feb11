import pytest

from turnloom.llm.revisits import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, payload string, status string"


@pytest.mark.parametrize("url,want", [("HTTPS://www.Ex.org:443/A/?b=2&a=1#x", "ex.org/A?a=1&b=2"), ("http://ex.org", "ex.org"), ("ex.org/?", "ex.org"), ("", None), (None, None), ("http:///x", None)])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(canonical_url(df.u)).first()[0] == want


def brute(rows, canon):
    full = {}
    for r in rows:
        if r[3] == "response":
            full[r[0]] = r
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [f for f in full.values() if canon[r[1]] is not None and canon[f[1]] == canon[r[1]] and f[2] is not None and r[2] is not None and f[2] < r[2]]
        best = max(earlier, key=lambda f: (f[2], f[0]), default=None)
        new = r[4] or {}
        if best is None:
            out.append((r[0], None, "orphan", tuple(sorted(new.items())), None))
            continue
        old, tag = best[4] or {}, lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        if tag(new) and tag(old):
            status = "resolved" if tag(new) == tag(old) else "mismatch"
        elif "last-modified" in new and "last-modified" in old:
            status = "resolved" if new["last-modified"] == old["last-modified"] else "mismatch"
        else:
            status = "unchecked"
        merged = new if status == "mismatch" else old | {k: v for k, v in new.items() if k in PERMITTED}
        out.append((r[0], best[0], status, tuple(sorted(merged.items())), None if status == "mismatch" else best[5]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    import random

    r = random.Random(1)
    urls = ["http://a.org/x", "https://www.a.org/x/", "http://a.org/y", "b.org", None, ""]
    rows = []
    for i in range(400):
        headers = {"date": str(i)} | ({"etag": r.choice(['"1"', 'W/"1"', '"2"'])} if r.random() < 0.6 else {}) | ({"last-modified": r.choice("xy")} if r.random() < 0.5 else {}) | {"x-own": "1"}
        rows.append((i, urls[0] if r.random() < 0.4 else r.choice(urls), r.choice([None, *range(60)]), r.choice(["response", "revisit"]), headers if r.random() < 0.9 else None, f"p{i}", "s"))
    rows += [rows[3], rows[4]]
    df = spark.createDataFrame(rows, SCHEMA)
    canon = {x.url: x.c for x in df.select("url", canonical_url(df.url).alias("c")).distinct().collect()}
    for slices in (1, 7, 1024):
        got = resolve_revisits(df, slices=slices).collect()
        assert sorted([(x.row.record_id, x.response_id, x.status, tuple(sorted(x.headers.items())), x.payload) for x in got], key=str) == brute(rows, canon)
    assert len({x.status for x in got}) == 4


def test_dotted_column_and_a_long_body(spark):
    df = spark.createDataFrame([(1, "a.org", 1, "response", {"etag": '"1"'}, "y" * 2_000_000, "s", "q"), (2, "a.org", 2, "revisit", {"etag": '"1"'}, None, "s", "q")], f"{SCHEMA}, `a.b` string")
    (row,) = resolve_revisits(df).collect()
    assert row.status == "resolved" and len(row.payload) == 2_000_000 and row.row["a.b"] == "q"


def test_no_rows(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
