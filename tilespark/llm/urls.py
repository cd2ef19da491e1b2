"""URL filters: fixed rules by host and path, and gradient-boosted trees on lexical
features where no rule decides.

The trees are boosted with the logistic loss on histograms of the features, in numpy on
the driver, from a bounded sample of labelled URLs.  Features and trees are Spark SQL
expressions, so judging a table is one scan of its URL column.

Where rules are the only labels, the ends of hosts that rules name say what the rules say,
not what URLs are like, so their statistics are left out (``blind``); the trees then
learn from what else the decided URLs look like.  How many URLs rules block says nothing
about the others either, so both labels weigh the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import fresh, settled

#: Labelled URLs that trees are fitted on, at most: those of the smallest hash.
LEARNING_ROWS = 20_000
#: Suffixes (last parts of hosts) with statistics of their own, at most, the most frequent
#: among the learning rows; rarer ones share one.
SUFFIXES = 200

#: Least score that blocks.  Labels weigh the same, so 0.5 is no evidence at all.
THRESHOLD = 0.8

#: Rules of verdict, host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "parameter_length", "suffix")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``.  The host follows the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, with A-Z in lower case; the path runs from there to ``?``,
    ``#`` or the end.  Null or without ``://``: both empty."""
    url = df[url_col]
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({"host": F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none."""
    which = verdict = None
    for kind, rule in sorted(rules, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        which = F.when(fits, rule) if which is None else which.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if which is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return which, verdict


def _suffix() -> Column:
    return F.element_at(F.split("host", r"\.", -1), -1)


def feature_columns(url: Column, rates: dict[str, float], prior: float) -> dict[str, Column]:
    """Lexical features of a URL; ``rates`` has the block rate of each suffix."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def count(x: Column, pattern: str) -> Column:
        return F.regexp_count(x, F.lit(pattern)).cast("double")

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    entropy = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda s, c: s - ((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n) * F.log2((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n),
    )
    suffix = F.lit(prior)
    if rates:
        table = F.create_map(*(F.lit(x) for kv in sorted(rates.items()) for x in kv))
        suffix = F.coalesce(F.try_element_at(table, _suffix()), F.lit(prior))
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/[^/]"),
        "labels": count(F.col("host"), r"\."),
        "digit_ratio": count(text, "[0-9]") / n,
        "host_digits": count(F.col("host"), "[0-9]"),
        "hyphens": count(F.col("host"), "-"),
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "parameter_length": F.length(query).cast("double"),
        "suffix": suffix,
    }


@dataclass
class Node:
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.low.predict(x), self.high.predict(x))

    def sql(self, names: dict[str, str]) -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"if({names[FEATURES[self.feature]]} <= {self.threshold!r}D, {self.low.sql(names)}, {self.high.sql(names)})"


def _tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Node:
    """Splits where the second-order gain of the loss is largest."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = Node(value=float(-rate * total_g / (total_h + ridge)))
    if not depth or len(rows) < 2 * least:
        return leaf
    best = (1e-6, -1, 0)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        own = bins[rows, f]
        size = len(cuts) + 1
        sg = np.cumsum(np.bincount(own, g[rows], size))[:-1]
        sh = np.cumsum(np.bincount(own, h[rows], size))[:-1]
        n = np.cumsum(np.bincount(own, minlength=size))[:-1]
        gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        return leaf
    go = bins[rows, f] <= k
    args = (depth - 1, least, ridge, rate)
    return Node(f, float(edges[f][k]), _tree(bins, edges, g, h, rows[go], *args), _tree(bins, edges, g, h, rows[~go], *args))


@dataclass
class Trees:
    base: float
    trees: list[Node]
    rates: dict[str, float]
    prior: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.base - sum((t.predict(x) for t in self.trees), np.zeros(len(x)))))

    def column(self, names: dict[str, str]) -> Column:
        """The probability of blocking, over the columns that ``names`` gives for features."""
        return F.expr("1D / (1D + exp(-(" + " + ".join([f"{self.base!r}D", *(t.sql(names) for t in self.trees)]) + ")))")


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0, bins: int = 32, held: np.ndarray | None = None) -> tuple[float, list[Node]]:
    """Trees for labels 0 and 1, both of the same weight in all; only the base where there is
    one label.  Rows that are ``held`` teach nothing, but as many trees stay as are best for
    their loss, if they have both labels."""
    if not len(y):
        return -20.0, []
    if y.min() == y.max():
        return 20.0 if y[0] else -20.0, []
    base, mean = 0.0, float(y.mean())
    weight = np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean))
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        edges.append(cuts if len(cuts) < bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    judged = held is not None and len(np.unique(y[held])) == 2 and len(np.unique(y[~held])) == 2
    score, out, rows = np.full(len(y), base), [], np.flatnonzero(~held) if judged else np.arange(len(y))
    losses = []
    for _ in range(trees + 1):
        p = 1 / (1 + np.exp(-score))
        losses.append(float(-(weight * np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, 1)))[held].sum()) if judged else -len(losses))
        if len(out) == trees:
            break
        tree = _tree(binned, edges, weight * (p - y), weight * p * (1 - p), rows, depth, least, ridge, rate)
        out.append(tree)
        score += tree.predict(x)
    return base, out[: int(np.argmin(losses))]


def fit(df: DataFrame, url_col: str, label: Column, *, rows: int = LEARNING_ROWS, suffixes: int = SUFFIXES, blind: frozenset[str] = frozenset(), **options) -> Trees:
    """Trees from the rows where ``label`` (true: block) is not null, at most ``rows`` of
    them; only their features reach the driver.

    A suffix's statistic for a learning row leaves that row's own fold out, so that it
    says no more than it will for new URLs; suffixes in ``blind`` have none.  The URLs of
    every fifth host (by hash) are held back and settle how many trees stay.  Repeated and
    null URLs count as any other; without labels, or with one only, there are no trees.
    """
    src = df.select(df[url_col].alias("url"), "host", "path", label.alias("y")).where("y is not null")
    cols = feature_columns(F.col("url"), {}, 0.0)
    picked = src.orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    got = picked.select("y", F.xxhash64("url").alias("place"), (F.pmod(F.xxhash64("host"), F.lit(5)) == 0).alias("held"), _suffix().alias("end"), *(c.alias(f"f_{k}") for k, c in cols.items())).collect()
    got = sorted(got, key=lambda r: (r.place, r.y, r.end or ""))
    y = np.array([float(r.y) for r in got])
    x = np.array([[r[f"f_{k}"] for k in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    ends = [r.end for r in got]
    prior = float(y.mean()) if len(y) else 0.0
    fold = np.arange(len(got)) % 5
    counts: dict[str, np.ndarray] = {}
    for e, v, k in zip(ends, y, fold):
        if e not in blind:
            c = counts.setdefault(e, np.zeros((5, 2)))
            c[k] += (v, 1)
    kept = dict(sorted(counts.items(), key=lambda kv: (-kv[1][:, 1].sum(), kv[0]))[:suffixes])

    def smooth(s):
        return float((s[0] + 5 * prior) / (s[1] + 5))

    for i, (e, k) in enumerate(zip(ends, fold)):
        x[i, -1] = smooth(kept[e].sum(0) - kept[e][k]) if e in kept else prior
    base, trees = boost(x, y, held=np.array([r.held for r in got], bool), **options)
    return Trees(base, trees, {e: smooth(c.sum(0)) for e, c in kept.items()}, prior)


def named_suffixes(rules=RULES) -> frozenset[str]:
    """The ends of the hosts in the rules."""
    return frozenset(rule.partition("/")[0].rpartition(".")[2] for _, rule in rules)


def judge_urls(df: DataFrame, url_col: str = "url", *, rules=RULES, trees: Trees | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``.

    A rule fits its host and all subdomains where the path starts with the rule's; the
    longest decides.  Elsewhere the trees do; without any given they are fitted on the
    URLs that the rules label.  A null or empty URL has the features of an empty string
    and is allowed, whatever the trees make of it.  Repeated rows give repeated results;
    an empty table stays empty.  Columns of these names are replaced, all others stay.
    """
    src = with_parts(df.drop("rule", "verdict", "block_score"), url_col)
    which, verdict = rule_columns(rules)
    if trees is None:
        trees = fit(src, url_col, verdict == "block", blind=named_suffixes(rules))
    names = dict(zip(FEATURES, fresh([*src.columns, "rule", "verdict", "block_score"], *(f"f_{k}" for k in FEATURES))))
    cols = feature_columns(F.col(url_col), trees.rates, trees.prior)
    out = src.withColumns({names[k]: c for k, c in cols.items()}).withColumn("block_score", settled(trees.column(names)))
    judged = F.when((F.col("block_score") >= threshold) & (F.coalesce(F.col(url_col), F.lit("")) != ""), "block").otherwise("allow")
    return out.withColumns({"rule": which, "verdict": F.coalesce(verdict, judged)}).drop(*names.values())
