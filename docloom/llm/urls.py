"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

The urls that a rule decides are the labelled ones. From all of them, boosted
regression trees with logistic loss are grown over binned lexical features. Each
level of a tree is one aggregation: sums of gradients by node, feature and bin,
of which the driver sees a table whose size depends on the model alone. The
trees become one column expression, so scoring is a plain projection. There is
no Python on the executors and no sampling.

Sums of gradients are taken in whole numbers, so the trees do not depend on the
order of rows or on the partitioning.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the trees; without labelled urls, or with labels
of one kind only, there is nothing to learn and the trees give that kind (allow,
if none); repeated urls get the same verdict; an empty table gives no rows;
other columns pass through, and where one is named like an output column the
output wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, small_side, written

#: (verdict, host and path) of the default rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins of a feature; gradients are counted in units of 1 / _UNIT.
_BINS, _UNIT = 16, 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + below))
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url, all doubles and never null."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "path_depth": _count(path, "/[^/]+"),
        "host_labels": _count(host, "[^.]+"),
        "digit_ratio": _count(text, "[0-9]") / n,
        "host_hyphens": _count(host, "-"),
        "entropy": F.round(_entropy(text), 6),
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1),
        "secure": F.startswith(text, F.lit("https://")).cast("double"),
        "first_path_length": F.length(F.regexp_extract(path, "^/([^/]*)", 1)).cast("double"),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _suffix_rates(labelled: DataFrame) -> DataFrame:
    """Smoothed share of blocked urls by the last label of the host; one row a suffix."""
    return labelled.groupBy("_suffix").agg(((F.sum("_y") + 1) / (F.count("*") + 2)).alias("_rate"))


class Trees:
    """Boosted trees over binned features: splits and leaf values by tree."""

    def __init__(self, edges: dict[str, list[float]], base: float):
        self.edges, self.base, self.trees = edges, base, []

    def bin(self, name: str, value: Column) -> Column:
        """Number of edges at or below the value."""
        out = F.lit(0)
        for e in self.edges[name]:
            out = out + (value >= F.lit(e)).cast("int")
        return out

    def _leaf(self, tree: dict, node: int, bins: dict[str, Column], number: bool) -> Column:
        split = tree["splits"].get(node)
        if split is None:
            return F.lit(node) if number else F.lit(int(tree["values"].get(node, 0)))
        name, at = split
        return F.when(bins[name] <= at, self._leaf(tree, 2 * node, bins, number)).otherwise(self._leaf(tree, 2 * node + 1, bins, number))

    def score(self, bins: dict[str, Column]) -> Column:
        """Log-odds of block, as a double."""
        total = F.lit(int(self.base * _UNIT)).cast("long")
        for tree in self.trees:
            total = total + self._leaf(tree, 1, bins, False)
        return total.cast("double") / _UNIT

    def node(self, tree: dict, bins: dict[str, Column]) -> Column:
        return self._leaf(tree, 1, bins, True)


def train(rows: DataFrame, names: list[str], *, trees: int = 8, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least: int = 20) -> Trees:
    """Trees from rows with the features and ``_y`` (1 for block). All rows count; the driver sees sums only."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("y"), *(F.percentile_approx(c, [k / _BINS for k in range(1, _BINS)], 2000).alias(c) for c in names)).first()
    n, y = totals["n"], totals["y"] or 0
    if n == 0 or y in (0, n):
        return Trees({c: [] for c in names}, 8.0 if n and y == n else -8.0)
    model = Trees({c: sorted({float(v) for v in totals[c]}) for c in names}, math.log(y / (n - y)))
    # one row for each vector of bins: the labelled rows in the fewest rows that still say all
    vectors = rows.groupBy(*(model.bin(c, F.col(c)).alias(c) for c in names)).agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"))
    vectors = written(vectors, "url-vectors")
    bins = {c: F.col(c) for c in names}
    for _ in range(trees):
        tree: dict = {"splits": {}, "values": {}}
        p = 1 / (1 + F.exp(-model.score(bins)))
        known = vectors.select(*names, F.round((F.col("_s") - F.col("_n") * p) * _UNIT).cast("long").alias("_g"), F.round(F.col("_n") * p * (1 - p) * _UNIT).cast("long").alias("_h"), "_n")
        frontier = [1]
        for level in range(depth + 1):
            cells = F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in names)))
            sums = known.select(model.node(tree, bins).alias("node"), cells.alias("x"), "_g", "_h", "_n").where(F.col("node").isin(frontier))
            table = sums.groupBy("node", "x.f", "x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.sum("_n").alias("n")).collect()
            by: dict = {}
            for r in table:
                by.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"] / _UNIT, r["h"] / _UNIT, r["n"]))
            following = []
            for node in frontier:
                cells_of = by.get(node)
                if not cells_of:
                    continue
                g, h, size = (sum(v[k] for v in cells_of[names[0]]) for k in (1, 2, 3))
                tree["values"][node] = round(rate * g / (h + ridge) * _UNIT)
                best = None
                if level < depth:
                    for name in names:
                        gl = hl = nl = 0
                        for b, bg, bh, bn in sorted(cells_of[name])[:-1]:
                            gl, hl, nl = gl + bg, hl + bh, nl + bn
                            gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                            if min(nl, size - nl) >= least and gain > 1e-3 and (best is None or gain > best[0] + 1e-9):
                                best = gain, name, b
                if best:
                    tree["splits"][node] = best[1:]
                    following += [2 * node, 2 * node + 1]
            frontier = following
            if not frontier:
                break
        model.trees.append(tree)
    forget(vectors)
    return model


def judge(pages: DataFrame, rules=RULES, *, url: str = "url", max_broadcast: int | None = None, **training) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``block_score`` (log-odds by the trees)."""
    out_names = ("host", "path", "rule", "verdict", "block_score")
    host, path = host_and_path(F.col(url))
    base = pages.select(F.struct("*").alias("_row"), F.col(url).cast("string").alias("_url"), host.alias("host"), path.alias("path"))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("_row", "_url", "host", "path", rule.alias("rule"), decided.alias("_decided"), _suffix(F.col("host")).alias("_suffix"))
    made = features(F.col("_url"), F.col("host"), F.col("path"))
    labelled = base.where(F.col("_decided").isNotNull()).select(*(c.alias(n) for n, c in made.items()), "_suffix", (F.col("_decided") == "block").cast("long").alias("_y"))
    labelled = written(labelled, "url-labels")
    rates = _suffix_rates(labelled)
    small = small_side(rates, max_broadcast)
    names = [*made, "suffix_rate"]
    with_rate = lambda df: df.join(small, "_suffix", "left").withColumn("suffix_rate", F.coalesce(F.col("_rate"), F.lit(0.5)))
    model = train(with_rate(labelled).select(*names, "_y"), names, **training)
    scored = with_rate(base).select("_row", "host", "path", "rule", "_decided", *(c.alias(n) for n, c in made.items() if model.edges[n]), "suffix_rate")
    bins = {n: model.bin(n, F.col(n)) if n in scored.columns else F.lit(0) for n in names}
    score = model.score(bins)
    keep = [c for c in pages.columns if c not in out_names]
    return scored.select(*(F.col("_row").getField(c).alias(c) for c in keep), "host", "path", "rule", F.coalesce(F.col("_decided"), F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
