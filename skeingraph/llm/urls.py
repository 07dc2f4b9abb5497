"""URL filter: host and path rules, and gradient-boosted trees on lexical features, in DataFrame expressions only.

The trees learn from labelled URLs; by default those that a rule decides (block 1, allow 0). Each of a URL's features is
cut into at most ``bins`` bins at quantiles of the training rows. A bounded sample of labelled rows (``sample``, the
smallest hashes) is turned into counts of equal binned rows; every tree level is one grouped sum of gradients and
hessians over it, by leaf, feature and bin, and the driver sees those sums only (leaves times features times bins). The
fitted trees become CASE expressions, so that scoring is a projection.

Suffix statistics are the share of labelled rows that are blocked, smoothed, by the host's last label. Every suffix of the
sample has its own, in a table with at most a row for each sampled row, which is broadcast; the rest take the overall
share. The shares' cuts lie evenly among their different values, the outermost included.

Defined cases: a url that is null or has no ``://`` has an empty host and path and is scored on empty features; an
empty table gives an empty result; without labelled rows of both kinds the score is the smoothed share of blocked ones;
repeated rows are judged alike; all columns are carried by ``judged``, whatever their names, but for those that are named
host, path, rule, score or verdict in any case of letters, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.textbuf import others, whole_row
from skeingraph.session import written
from skeingraph.sources.tables import table

#: Fixed values: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Boost:
    sample: int = 20_000  # labelled rows that the trees learn from
    bins: int = 12
    trees: int = 8
    depth: int = 2
    rate: float = 0.4
    penalty: float = 1.0
    share_cuts: int = 48  # between suffix shares, at least two
    threshold: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([\s\S]*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ``_ruled`` (its verdict) to a table with a ``url`` and no such columns; the longest fitting rule wins."""
    host, path = parts(F.col("url"))
    df = urls.withColumns({"host": host, "path": path})
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)) for h, p, _ in order]
    pick = lambda value: reduce(lambda rest, x: F.when(x[0], F.lit(value(x[1]))).otherwise(rest), reversed(list(zip(fits, order))), F.lit(None).cast("string"))
    return df.withColumns({"rule": pick(lambda r: r[0] + r[1]), "_ruled": pick(lambda r: r[2])})


def features(df: DataFrame) -> DataFrame:
    """Adds f0.. (numbers) and _suffix."""
    url, n = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit("")))
    count = lambda pattern: F.coalesce(F.regexp_count(url, F.lit(pattern)), F.lit(0)).cast("double")
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    # entropy of the url's characters: log n - sum over distinct characters of c log c / n
    repeats = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s + (lambda k: k * F.log2(k))((n - F.length(F.replace(url, c, F.lit("")))).cast("double")))
    entropy = F.when(n > 0, F.log2(n.cast("double")) - repeats / n).otherwise(0.0)
    found = {
        "length": n.cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "digits": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
        "entropy": entropy,
        "parameters": count("[?&][^=&#]*="),
        "host_length": F.length("host").cast("double"),
        "labels": F.length(F.regexp_replace("host", "[^.]", "")).cast("double"),
        "hyphens": count("-"),
        "fragment": count("#"),
        "path_length": F.length("path").cast("double"),
    }
    return df.withColumns({f"f{k}": c for k, c in enumerate(found.values())}).withColumn("_suffix", F.substring_index("host", ".", -1))


N_FEATURES = 11  # the ten above and the suffix's share


def _binned(df: DataFrame, cuts: list[list[float]], shares: DataFrame | None, overall: float) -> DataFrame:
    """Adds b0..: how many of a feature's cuts lie below its value."""
    share = F.lit(overall)
    if shares is not None:
        df, share = df.join(F.broadcast(shares), "_suffix", "left"), F.coalesce("_share", F.lit(overall))
    df = df.withColumn(f"f{N_FEATURES - 1}", share)
    return df.withColumns({f"b{k}": reduce(lambda s, c: s + (F.col(f"f{k}") > F.lit(c)).cast("int"), cuts[k], F.lit(0)) for k in range(N_FEATURES)})


def share_cuts(values: list[float], most: int) -> list[float]:
    """Points between neighbouring values; of more than ``most``, an even choice with the first and the last."""
    between = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return between if len(between) <= most else [between[round(k * (len(between) - 1) / (most - 1))] for k in range(most)]


def _tree_column(tree: dict) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(f"b{tree['feature']}") <= tree["bin"], _tree_column(tree["left"])).otherwise(_tree_column(tree["right"]))


@dataclass
class Model:
    base: float
    cuts: list[list[float]]
    shares: DataFrame | None  # _suffix, _share
    overall: float
    trees: list[dict]

    def score(self, featured: DataFrame, name: str = "score") -> DataFrame:
        binned = _binned(featured, self.cuts, self.shares, self.overall)
        margin = reduce(lambda s, t: s + _tree_column(t), self.trees, F.lit(self.base))
        return binned.withColumn(name, 1 / (1 + F.exp(-margin)))


def fit(labelled: DataFrame, boost: Boost = Boost()) -> Model:
    """``labelled``: url, host, path and _label (1: block)."""
    sample = written(features(labelled.select("url", "host", "path", "_label").orderBy(F.xxhash64("url", "_label"), "url").limit(boost.sample)), "labelled")
    n, blocked = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    overall = (blocked + 1) / (n + 2)
    base = math.log(overall / (1 - overall))
    if blocked in (0, n):
        return Model(base, [[] for _ in range(N_FEATURES)], None, overall, [])
    by_suffix = sample.groupBy("_suffix").agg(((F.sum("_label") + 5 * overall) / (F.count(F.lit(1)) + 5)).alias("_share"))
    shares = written(by_suffix, "shares")
    grid = [(k + 1) / boost.bins for k in range(boost.bins - 1)]
    quantiles = sample.agg(*[F.percentile_approx(f"f{k}", F.lit(grid), 10_000).alias(f"q{k}") for k in range(N_FEATURES - 1)]).first()
    cuts = [sorted(set(q)) for q in quantiles]
    cuts.append(share_cuts(sorted({r[0] for r in shares.select("_share").distinct().collect()} | {overall}), boost.share_cuts))  # bounded by the sample
    bins = [f"b{k}" for k in range(N_FEATURES)]
    counts = written(_binned(sample, cuts, shares, overall).groupBy("_label", *bins).agg(F.count(F.lit(1)).alias("n")), "binned")
    trees: list[dict] = []
    for _ in range(boost.trees):
        margin = reduce(lambda s, t: s + _tree_column(t), trees, F.lit(base))
        p = 1 / (1 + F.exp(-margin))
        graded = counts.withColumns({"g": (F.col("_label") - p) * F.col("n"), "h": p * (1 - p) * F.col("n")})
        trees.append(_grow(graded, bins, boost))
    return Model(base, cuts, shares, overall, trees)


def _grow(graded: DataFrame, bins: list[str], boost: Boost) -> dict:
    tree: dict = {"leaf": 0}
    leaves = [tree]
    leaf = F.lit(0)
    for level in range(boost.depth + 1):
        one = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(b).alias("bin")) for k, b in enumerate(bins)]))
        sums = graded.withColumn("leaf", leaf).select("leaf", "g", "h", one.alias("x")).groupBy("leaf", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        found: dict = {}
        for r in sorted(sums, key=lambda r: (r["leaf"], r["feature"], r["bin"])):
            found.setdefault(r["leaf"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
        grown = []
        for node in leaves:
            by_feature = found.get(node["leaf"], {})
            g, h = (math.fsum(x[i] for x in by_feature.get(0, [])) for i in (1, 2))
            best = (1e-6, None, None)
            for feature, xs in by_feature.items() if level < boost.depth else ():
                left_g = left_h = 0.0
                for b, dg, dh in xs[:-1]:
                    left_g, left_h = left_g + dg, left_h + dh
                    gain = left_g**2 / (left_h + boost.penalty) + (g - left_g) ** 2 / (h - left_h + boost.penalty) - g**2 / (h + boost.penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, feature, b)
            at = node.pop("leaf")
            if best[1] is None:
                node["value"] = boost.rate * g / (h + boost.penalty)
            else:
                node |= {"feature": best[1], "bin": best[2], "left": {"leaf": 2 * at + 1}, "right": {"leaf": 2 * at + 2}}
                grown += [node["left"], node["right"]]
        leaves = grown
        if not leaves:
            break
        leaf = _leaf_column(tree)
    return tree


def _leaf_column(tree: dict) -> Column:
    """The number of the open leaf that a row is in; -1 in closed ones."""
    if "feature" not in tree:
        return F.lit(tree.get("leaf", -1))
    return F.when(F.col(f"b{tree['feature']}") <= tree["bin"], _leaf_column(tree["left"])).otherwise(_leaf_column(tree["right"]))


ADDED = ("host", "path", "rule", "score", "verdict")


def judged(pages: DataFrame, boost: Boost = Boost(), labelled: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, score and verdict to ``pages``; labelled: url, _label (default: what the rules decide)."""
    ruled = with_rule(pages.select("url", whole_row(pages).alias("_row")))
    known = with_rule(labelled.select("url", "_label")) if labelled is not None else ruled.where("_ruled is not null").withColumn("_label", (F.col("_ruled") == "block").cast("int"))
    scored = fit(known.select("url", "host", "path", "_label"), boost).score(features(ruled))
    own = F.when(F.col("score") >= boost.threshold, "block").otherwise("allow")
    carried = [F.col("_row").getField(x.name).alias(x.name) for x in others(pages, *ADDED)]
    return scored.select(*carried, "host", "path", "rule", "score", F.coalesce("_ruled", own).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_url_filter says that does not come from the trees: host, path, rule, and the rule's verdict."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def _rules_sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    pick = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in order) + " END"
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    host = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages)"
    return f"SELECT page_id, host, path, {pick(lambda h, p, v: h + p)} AS rule, {pick(lambda h, p, v: v)} AS ruled FROM ({split})"


URL_RULES_SQL = _rules_sql()
