"""L-6: boosted regression trees with group-softmax gradients, grown from histograms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Q
from ..functions.tables import written


@dataclass
class Tree:
    """Splits by node (root 1, children 2n and 2n + 1): (feature, bin), left where the row's bin is at most that; leaf values."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, bins: list[Column]) -> Column:
        return self._routed(1, bins, F.lit)

    def value(self, bins: list[Column]) -> Column:
        return self._routed(1, bins, lambda n: F.lit(self.leaves.get(n, 0.0)))

    def _routed(self, n: int, bins: list[Column], end: Callable[[int], Column]) -> Column:
        if n not in self.splits:
            return end(n)
        feature, cut = self.splits[n]
        return F.when(bins[feature] <= cut, self._routed(2 * n, bins, end)).otherwise(self._routed(2 * n + 1, bins, end))


@dataclass
class Forest:
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]


def feature_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 ascending ends a feature, from approximate percentiles in one aggregate: a bounded row to the driver."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"c{i}") for i, c in enumerate(features))).first()
    return [sorted(set(x for x in row[f"c{i}"] or [])) for i in range(len(features))]


def _bin(col: str, cuts: list[float]) -> Column:
    """How many ends lie below the value; null counts as below all."""
    return sum((F.coalesce(F.col(col) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))


def best_splits(sums: list, n_features: int, ridge: float, least: float) -> dict[int, tuple[float, int, int]]:
    """For each node of (node, feature, bin, g, h) rows: gain, feature and bin of the best split, the first of equals."""
    per: dict[int, dict[int, list]] = {}
    for r in sums:
        per.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["bin"], r["g"], r["h"]))
    out = {}
    for node, by in per.items():
        total_g, total_h = sum(x[1] for x in by[0]), sum(x[2] for x in by[0])
        best = None
        for f in range(n_features):
            g = h = 0.0
            for cut, dg, dh in sorted(by[f])[:-1]:
                g, h = g + dg, h + dh
                gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                if h >= least and total_h - h >= least and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut)
        if best and best[0] > 1e-9:
            out[node] = best
    return out


def fit_trees(df: DataFrame, features: list[str], *, trees: int = 8, depth: int = 3, bins: int = 32, rate: float = 0.5, ridge: float = 1.0, least: float = 1e-3) -> Forest:
    """A ranker of ``df(qid, col, is_pos, <features>)``, each tree fitted to the group softmax's gradient p - y and curvature p (1 - p).

    Rows are binned once and written. A level of a tree is one aggregate: sums of both derivatives by (node, feature, bin),
    at most 2^depth * features * bins rows, from which the driver picks the splits. After a tree the scores are written
    with the next gradients, so plans do not grow with the number of trees.
    """
    cuts = feature_cuts(df, features, bins)
    names = [f"b{i}" for i in range(len(features))]
    columns = [F.col(n) for n in names]
    now = written(df.select("qid", "col", "is_pos", *(_bin(c, own).cast("byte").alias(n) for c, own, n in zip(features, cuts, names, strict=True)), F.lit(0.0).alias("s")), "binned")
    forest = Forest(features, cuts, [])
    for _ in range(trees):
        e = F.exp(F.col("s") - F.max("s").over(Q()))
        p = F.col("e") / F.sum("e").over(Q())
        now = written(now.withColumn("e", e).withColumn("p", p).drop("e").withColumn("g", F.col("p") - F.col("is_pos").cast("double")).withColumn("h", F.col("p") * (1 - F.col("p"))).drop("p"), "tree-gradients")
        tree = Tree()
        for level in range(depth):
            each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), c.cast("int").alias("bin")) for i, c in enumerate(columns))))
            at = now.select(tree.node(columns).alias("node"), "g", "h", each.alias("x")).where(F.col("node") >= 1 << level)
            sums = at.groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            found = best_splits(sums, len(features), ridge, least)
            tree.splits |= {n: (f, cut) for n, (_, f, cut) in found.items()}
            if not found:
                break
        ends = now.groupBy(tree.node(columns).alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        tree.leaves = {r["node"]: -rate * r["g"] / (r["h"] + ridge) for r in sorted(ends, key=lambda r: r["node"])}
        forest.trees.append(tree)
        now = now.drop("g", "h").withColumn("s", F.col("s") + tree.value(columns))
    return forest


def score_trees(forest: Forest, df: DataFrame) -> DataFrame:
    """The rows with ``score``, the sum of their leaves; bins are computed once a row."""
    names = [f"__b{i}" for i in range(len(forest.features))]
    rows = df.withColumns({n: _bin(c, own) for n, c, own in zip(names, forest.features, forest.cuts, strict=True)})
    total = sum((t.value([F.col(n) for n in names]) for t in forest.trees), F.lit(0.0))
    return rows.withColumn("score", total).drop(*names)
