"""URL verdicts by rules and by gradient-boosted trees on lexical features.

A rule names a host and a path; it fits a URL of that host, or of one below it, whose path
begins with the rule's, and of the rules that fit the longest decides. Other URLs are
judged by trees trained from labelled URLs on: length, depth of the path, digit ratio,
entropy of the characters, number of parameters, and statistics of the host's suffix (its
share of all URLs, and the smoothed share of bad ones among its labelled URLs). One half of
the labelled URLs, by hash, tells what suffixes are like and the other half trains the
trees, so that no tree sees a label through its own suffix.

Everything is built from DataFrame functions. Boosting is by histograms: labelled rows are
binned and rows of equal bins become one with its counts; each level of a tree is one
aggregate by (node, feature, bin), of which the driver gets a few hundred sums and picks
the splits; scores so far are an expression over the bins. Gradients are rounded to
fixed point before they are summed, so sums, and with them the trees, do not depend on
the order of rows. A fitted ``Forest`` is again an expression.

Scale: trees are fitted on at most about ``most_labelled`` labelled rows, those with the
lowest hashes; suffix statistics are over all rows. A suffix of more than a thousandth of
all URLs meets its rows by broadcast (there are less than a thousand such), the others by
a join of the rows that have them.

Defined cases: a null URL is an empty one; without ``://`` host and path are empty; a host
has no port or user taken off; labels other than 0 and 1, null labels and null ids teach
nothing; without training rows of both kinds there is no tree, and the verdict follows the
label that is there, ``allow`` if none. Rules of equal length cannot both fit but for
different hosts; then the longer host decides, then ``block``. Equal rows are judged each.
Further columns, also of the same names, travel in the struct ``row``; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_suffix_share", "f_suffix_bad")
SHARE, LEAST = 1e-3, 1000
#: Weight of the overall share of bad URLs in a suffix's own.
SMOOTH = 20
#: Fixed point of gradients; decimals of features and thresholds.
POINT, PLACES = 1 << 20, 9
MOST_RULES = 1000


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)


def trains() -> Column:
    """Labelled URLs that train trees; the others tell what suffixes are like."""
    return F.crc32(F.col("url").cast("binary")) % 2 == 0


def _entropy(url: Column) -> Column:
    size = F.length(url)
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    return F.when(size == 0, 0.0).otherwise(-F.aggregate(F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))), F.lit(0.0), lambda a, v: a + v))


def parsed(urls: DataFrame, url_col: str, suffix_labels: int) -> DataFrame:
    """``row``, host, path, suffix and the features of the URL's own characters."""
    row = F.struct(*[F.col(f"`{c}`") for c in urls.columns])
    df = urls.select(row.alias("row"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("_url"))
    host, path, query = parts(F.col("_url"))
    df = df.select("row", "_url", host.alias("host"), path.alias("path"), query.alias("_query"))
    size = F.length("_url")
    return df.select(
        "row", "host", "path", F.substring_index("host", ".", -suffix_labels).alias("suffix"), size.cast("double").alias("f_length"), F.regexp_count("path", F.lit("[^/]+")).cast("double").alias("f_depth"),
        F.when(size == 0, 0.0).otherwise(F.round(F.regexp_count("_url", F.lit("[0-9]")) / size, PLACES)).alias("f_digits"), F.round(_entropy(F.col("_url")), PLACES).alias("f_entropy"), F.regexp_count("_query", F.lit("[^&]+")).cast("double").alias("f_params"),
    )


def _met(rows: DataFrame, stats: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their suffix (one row of ``stats`` each)."""
    hot = max(LEAST, int(total * SHARE))
    found = rows.join(F.broadcast(stats.where(F.col("n_urls") > hot)), "suffix", "left")
    rest = found.where("n_urls IS NULL").drop(*[c for c in stats.columns if c != "suffix"])
    return found.where("n_urls IS NOT NULL").unionByName(rest.join(stats.where(F.col("n_urls") <= hot), "suffix", "left"))


@dataclass(frozen=True)
class Node:
    feature: int
    threshold: float
    left: Node | float
    right: Node | float

    def column(self, value) -> Column:
        low, high = (x.column(value) if isinstance(x, Node) else F.lit(x) for x in (self.left, self.right))
        return F.when(value(self.feature, self.threshold), low).otherwise(high)


@dataclass(frozen=True)
class Forest:
    """Log odds: ``base`` and the sum of the trees."""

    base: float
    trees: tuple[Node, ...]

    def log_odds(self, value=lambda f, t: F.col(FEATURES[f]) <= t) -> Column:
        out = F.lit(self.base)
        for t in self.trees:
            out = out + t.column(value)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


@dataclass
class _Open:
    """A node that grows: its sums, and its children once it is split."""

    g: int = 0
    h: int = 0
    split: tuple | None = None
    low: _Open | None = None
    high: _Open | None = None


def _gain(g: float, h: float, ridge: float) -> float:
    return g * g / (h + ridge)


def best_split(cells: dict, ridge: float, least: int):
    """(feature, bin, sums below, sums above) of the best cut, from ``cells`` {(feature, bin):
    (g, h, n)}; the first of equal ones; None where none gains."""
    best, found = 0.0, None
    for f in sorted({f for f, _ in cells}):
        own = sorted((b, v) for (x, b), v in cells.items() if x == f)
        total = [sum(v[i] for _, v in own) for i in range(3)]
        low = [0, 0, 0]
        for b, v in own[:-1]:
            low = [x + y for x, y in zip(low, v, strict=True)]
            high = [x - y for x, y in zip(total, low, strict=True)]
            if min(low[2], high[2]) < least:
                continue
            gain = sum(_gain(x[0] / POINT, x[1] / POINT, ridge) for x in (low, high)) - _gain(total[0] / POINT, total[1] / POINT, ridge)
            if gain > best + 1e-9:
                best, found = gain, (f, b, tuple(low), tuple(high))
    return found


def boost(cells: DataFrame, thresholds: list[list[float]], *, rounds: int, depth: int, rate: float, ridge: float, least: int) -> Forest:
    """Trees for ``cells``: bins b0, b1, ... of the features, n rows and n_bad of them bad.
    A level of a tree is one aggregate."""
    n, bad = cells.agg(F.sum("n"), F.sum("n_bad")).first()
    n, bad = n or 0, bad or 0
    base = math.log((bad + 1e-3) / (n - bad + 1e-3)) if n else -10.0
    forest, binned = Forest(base, ()), lambda f, t: F.col(f"b{f}") <= (thresholds[f].index(t) if t in thresholds[f] else len(thresholds[f]))
    for _ in range(rounds if 0 < bad < n else 0):
        p = 1 / (1 + F.exp(-forest.log_odds(binned)))
        fixed = lambda x: F.round(x * POINT).cast("long")
        scored = cells.withColumns({"g": fixed(F.col("n_bad") - F.col("n") * p), "h": fixed(F.col("n") * p * (1 - p))})
        root = _Open()
        level = {1: root}
        for _ in range(depth):
            if not level:
                break
            at = _place(root).alias("node")
            pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b{f}").alias("b")) for f in range(len(thresholds))])
            rows = scored.select(at, "g", "h", "n", F.explode(pairs).alias("x")).where(F.col("node").isin(list(level))).groupBy("node", "x.f", "x.b").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()  # nodes x features x bins
            grown = {}
            for key, node in level.items():
                got = best_split({(r.f, r.b): tuple(r)[3:] for r in rows if r.node == key}, ridge, least)
                if got:
                    f, b, low, high = got
                    node.split, node.low, node.high = (f, b), _Open(*low[:2]), _Open(*high[:2])
                    grown |= {2 * key: node.low, 2 * key + 1: node.high}
            level = grown
        if root.split is None:
            break
        forest = Forest(base, (*forest.trees, _frozen(root, thresholds, rate, ridge)))
    return forest


def _place(node: _Open, key: int = 1) -> Column:
    """Number of the open node that a cell is in."""
    if node.split is None:
        return F.lit(key)
    f, b = node.split
    return F.when(F.col(f"b{f}") <= b, _place(node.low, 2 * key)).otherwise(_place(node.high, 2 * key + 1))


def _frozen(node: _Open, thresholds, rate: float, ridge: float) -> Node | float:
    if node.split is None:
        return rate * (node.g / POINT) / (node.h / POINT + ridge)
    f, b = node.split
    return Node(f, thresholds[f][b], _frozen(node.low, thresholds, rate, ridge), _frozen(node.high, thresholds, rate, ridge))


class UrlFilter:
    """Suffix statistics over ``urls`` and trees from ``labelled`` (url and a label, 1 for
    bad URLs and 0 for others)."""

    def __init__(self, urls: DataFrame, labelled: DataFrame, url_col: str = "url", label_col: str = "bad", *, suffix_labels: int = 2, most_labelled: int = 200_000, bins: int = 16, rounds: int = 12, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 20):
        self.url_col, self.suffix_labels = url_col, suffix_labels
        spark, folder = urls.sparkSession, new_folder(urls.sparkSession, "urls")
        known = labelled.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").cast("long").alias("bad"))
        held = known.count()
        if held > most_labelled:  # a hash is uniform: a bound on it takes that share
            key = F.xxhash64("url", "bad")
            known = known.where(key < F.lit(int(((most_labelled / held) * 2 - 1) * (1 << 63))))
        own = cut(parsed(known, "url", suffix_labels).withColumns({"url": F.col("row.url"), "bad": F.col("row.bad")}).drop("row"), f"{folder}/labelled")
        n, bad = own.where(~trains()).agg(F.count("*"), F.sum("bad")).first()
        prior = (bad or 0) / n if n else 0.0
        counts = parsed(urls, url_col, suffix_labels).groupBy("suffix").agg(F.count("*").alias("n_urls"))
        told = own.where(~trains()).groupBy("suffix").agg(F.count("*").alias("n_told"), F.sum("bad").alias("n_bad"))
        both = counts.join(told, "suffix", "full").select("suffix", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_urls", "n_told", "n_bad")])
        self.stats = cut(both, f"{folder}/suffixes")
        self.total = self.stats.agg(F.sum("n_urls")).first()[0] or 0
        self.prior = prior
        train = cut(self._featured(_met(own.where(trains()), self.stats, self.total)).select(*FEATURES, "bad"), f"{folder}/train")
        cuts = [k / bins for k in range(1, bins)]
        # of the bounded sample
        points = train.agg(*[F.percentile(f, F.lit(cuts)).alias(f) for f in FEATURES]).first()
        self.thresholds = [sorted({round(x, PLACES) for x in p or []}) for p in points]
        binned = [sum([(F.col(f) > t).cast("int") for t in ts], F.lit(0)).alias(f"b{i}") for i, (f, ts) in enumerate(zip(FEATURES, self.thresholds, strict=True))]
        cells = train.select(*binned, "bad").groupBy(*[f"b{i}" for i in range(len(FEATURES))]).agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"))
        self.forest = boost(cut(cells, f"{folder}/cells"), self.thresholds, rounds=rounds, depth=depth, rate=rate, ridge=ridge, least=least)

    def _featured(self, rows: DataFrame) -> DataFrame:
        n, bad = F.coalesce("n_told", F.lit(0)), F.coalesce("n_bad", F.lit(0))
        share = F.round(F.coalesce("n_urls", F.lit(0)) / F.lit(max(1, self.total)), PLACES)
        return rows.withColumns({"f_suffix_share": share, "f_suffix_bad": F.round((bad + self.prior * SMOOTH) / (n + SMOOTH), PLACES)})

    def scored(self, urls: DataFrame) -> DataFrame:
        """``row``, host, path and ``score``, the probability of a bad URL."""
        rows = self._featured(_met(parsed(urls, self.url_col, self.suffix_labels), self.stats, self.total))
        return rows.select("row", "host", "path", self.forest.probability().alias("score"))


def _length(rule: tuple[str, str, str]) -> tuple:
    verdict, host, path = rule
    return -len(host + path), -len(host), verdict != "block"


def matching_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides, of (verdict, host, path); null if none
    fits. Rules are an expression, so there may be ``MOST_RULES`` at most."""
    if len(rules) > MOST_RULES:
        raise ValueError("TOO_MANY_RULES")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=_length, reverse=True):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        text, verdict = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", *, threshold: float = 0.5, **fit) -> DataFrame:
    """``row``, host, path, rule, verdict (allow or block) and score: one row for each of
    ``urls``. ``fit``: parameters of ``UrlFilter``."""
    scored = UrlFilter(urls, labelled, url_col, **fit).scored(urls)
    rule, verdict = matching_rule(rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: pages whose path ends with the id of a labelled document. Bad: quality 0
    or toxic 1, by any of its labels."""
    path = parts(F.col("_url"))[1]
    named = pages.select(F.col("url").alias("_url")).select(F.col("_url").alias("url"), F.try_to_number(F.regexp_extract(path, "/([0-9]{1,18})(?:\\.html)?/?$", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return named.where("doc_id IS NOT NULL").join(bad.where("bad IS NOT NULL"), "doc_id").select("url", "bad")
