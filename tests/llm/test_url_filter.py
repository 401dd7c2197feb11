"""URL features and boosting against plain Python, and what trees learn."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnloom.llm import url_filter as uf
from turnloom.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.01"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    return (m[1].translate(str.maketrans(uf.UPPER, uf.LOWER)), m[2], m[3] or "") if m else ("", "", "")


def lexical(url):
    url = url or ""
    host, path, query = split(url)
    n, digits = len(url), sum(c in "0123456789" for c in url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values()) if n else 0.0
    return [n, len(re.findall("[^/]+", path)), round(digits / n, 9) if n else 0.0, round(entropy, 9), len(re.findall("[^&]+", query))], ".".join(host.split(".")[-2:])


class Plain:
    """The same boosting with loops and Python's whole numbers."""

    def __init__(self, urls, told, rounds, depth, least, bins=16, rate=0.3, ridge=1.0):
        self.share, self.bad, self.n = Counter(lexical(u)[1] for u in urls), Counter(), Counter()
        side = lambda u: zlib.crc32(u.encode()) % 2 == 0
        for u, y in told:
            if not side(u):
                self.n[lexical(u)[1]] += 1
                self.bad[lexical(u)[1]] += y
        self.total, self.prior = len(urls), sum(self.bad.values()) / max(1, sum(self.n.values()))
        train = [(self.features(u), y) for u, y in told if side(u)]
        x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train])
        cuts = [sorted({round(float(np.percentile(x[:, f], 100 * k / bins)), 9) for k in range(1, bins)}) for f in range(x.shape[1])]
        b = np.stack([sum((x[:, f] > t).astype(int) for t in cuts[f]) for f in range(x.shape[1])], 1)
        cells = defaultdict(lambda: [0, 0])
        for row, v in zip(b.tolist(), y.tolist(), strict=True):
            cells[tuple(row)][0] += 1
            cells[tuple(row)][1] += v
        self.base, self.trees, self.cuts = math.log((y.sum() + 1e-3) / (len(y) - y.sum() + 1e-3)), [], cuts
        for _ in range(rounds):
            sums = {}
            for c, (n, bad) in cells.items():
                p = 1 / (1 + math.exp(-self.odds(c)))
                half = lambda v: int(math.floor(abs(v) + 0.5)) * (1 if v >= 0 else -1)
                sums[c] = half((bad - n * p) * uf.POINT), half(n * p * (1 - p) * uf.POINT), n
            tree = self.grow(list(cells), sums, depth, least, ridge, rate)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)

    def features(self, url):
        own, suffix = lexical(url)
        return [*own, round(self.share[suffix] / self.total, 9), round((self.bad[suffix] + self.prior * uf.SMOOTH) / (self.n[suffix] + uf.SMOOTH), 9)]

    def grow(self, cells, sums, depth, least, ridge, rate):
        total = [sum(sums[c][i] for c in cells) for i in range(3)]
        gain = lambda s: (s[0] / uf.POINT) ** 2 / (s[1] / uf.POINT + ridge)
        best, found = 1e-9, None
        for f in range(7) if depth else ():
            for cut in sorted({c[f] for c in cells})[:-1]:
                low = [sum(sums[c][i] for c in cells if c[f] <= cut) for i in range(3)]
                high = [t - v for t, v in zip(total, low, strict=True)]
                g = gain(low) + gain(high) - gain(total)
                if min(low[2], high[2]) >= least and g > best:
                    best, found = g + 1e-9, (f, cut)
        if not found:
            return rate * (total[0] / uf.POINT) / (total[1] / uf.POINT + ridge)
        f, cut = found
        return f, cut, *[self.grow([c for c in cells if (c[f] <= cut) == side], sums, depth - 1, least, ridge, rate) for side in (True, False)]

    def odds(self, cell):
        out = self.base
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if cell[t[0]] <= t[1] else t[3]
            out += t
        return out

    def score(self, url):
        return 1 / (1 + math.exp(-self.odds([sum(v > t for t in ts) for v, ts in zip(self.features(url), self.cuts, strict=True)])))


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_whole_query(spark, monkeypatch):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {u: re.search(r"/([0-9]+)(\.html)?/?$", split(u)[1]) for u in pages.values()}
    told = [(u, labels[int(ids[u][1])]) for u in pages.values() if ids[u] and int(ids[u][1]) in labels]
    plain = Plain(list(pages.values()), told, 12, 3, 20)
    got = QUERIES["op11_url_filter"](spark, SF).collect()
    assert len(got) == len(pages) and len({r.page_id for r in got}) == len(pages)
    for r in got:
        host, path, _ = split(pages[r.page_id])
        text, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.score == pytest.approx(plain.score(pages[r.page_id]), abs=1e-6)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def planted(n, seed):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    for i in range(n):
        bad = rnd.random() < 0.4
        digits = "".join(rnd.choice("0123456789") for _ in range(12)) if bad and rnd.random() < 0.95 else ""
        yield f"http://{word(6)}{digits}.{rnd.choice(['site.org', 'shop.biz' if bad else 'site.net'])}/{word(4)}/{i}" + ("?a=1&b=2&c=3" if bad else ""), int(bad)


def test_trees_learn_and_hold_on_others(spark):
    told, fresh = list(planted(1500, 1)), list(planted(500, 2))
    urls = spark.createDataFrame([(u,) for u, _ in fresh], "url string")
    rows = uf.judge(urls, spark.createDataFrame(told, "url string, bad int"), []).collect()
    truth = dict(fresh)
    assert sum((r.verdict == "block") == bool(truth[r.row.url]) for r in rows) >= 0.95 * len(rows)


def test_bound_of_the_sample(spark):
    told = spark.createDataFrame(list(planted(1500, 1)), "url string, bad int")
    small = uf.UrlFilter(told, told, most_labelled=300)
    n = small.stats.selectExpr("sum(n_told)").first()[0]
    assert 0 < n < 300


def test_defined_cases(spark):
    urls = ["http://Example.com", "https://WWW.example.com/en/x?a=1&b#c", "x", None, "ftp://a.net/es/", "http://net/fr/1", "http://xnet/fr/1", "http://example.com/en", "a://b://c/d", "", "http://x.com/" + "q" * 300_000, "http://example.com/en/"]
    df = spark.createDataFrame([(u, "s", 1) for u in urls + urls[:1]], "url string, suffix string, n_urls int")
    none = spark.createDataFrame([], "url string, bad int")
    got = uf.judge(df, none, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, _ = split(r.row.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule(host, path)[0], rule(host, path)[1] or "allow")
    bad = spark.createDataFrame([(f"http://a{i}.b.c/", 1) for i in range(20)] + [(None, 1), ("x", None), ("y", 7)], "url string, bad int")
    assert {r.verdict for r in uf.judge(df, bad, []).collect()} == {"block"}
    assert uf.judge(df.limit(0), none, RULES).collect() == []
    with pytest.raises(ValueError, match="TOO_MANY_RULES"):
        uf.matching_rule([("block", f"h{i}", "/") for i in range(1001)])
