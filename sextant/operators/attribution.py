"""Attributions of tree models' predictions to features (Shapley values under the trees' own distribution).

A fitted model becomes a table of root-to-leaf paths. A path holds each of its features once, as an interval
and the share of training rows that the feature's splits let through. A leaf's value is shared out among the features
of its path: with x inside some of the intervals and outside the others, the weights of all subsets of
features are the coefficients of a product of linear terms. Rows are taken in Arrow batches, with the paths, whose
number is the model's, in each worker.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


@dataclass(frozen=True)
class Path:
    """A leaf: its value and, by feature, low < x <= high and the share of training rows let through."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]

    def mean(self) -> float:
        return self.value * math.prod(self.share)


def paths_of_nodes(nodes: dict, scale: float = 1.0) -> list[Path]:
    """The paths of a tree of nodes {id: (value, rows, None or (feature, threshold, left, right))} with root 0; smaller or equal goes left."""
    out, open_ = [], [(0, {})]
    while open_:
        at, held = open_.pop()
        value, rows, split = nodes[at]
        if split is None:
            out.append(Path(value * scale, tuple(held), *zip(*held.values())) if held else Path(value * scale, (), (), (), ()))
            continue
        feature, threshold, left, right = split
        low, high, share = held.get(feature, (-math.inf, math.inf, 1.0))
        for child, lo, hi in ((left, low, min(high, threshold)), (right, max(low, threshold), high)):
            open_.append((child, held | {feature: (lo, hi, share * nodes[child][1] / rows)}))
    return out


def paths(model) -> list[Path]:
    """The paths of a fitted forest or boosted model of Spark, through the node table that it saves."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = scratch.new_folder(spark)
    model.write().save(folder)
    weights, forest = list(model.treeWeights), "RandomForest" in type(model).__name__
    scales = [w / sum(weights) for w in weights] if forest else weights
    trees: dict[int, dict] = {}
    for tree, n in spark.read.parquet(folder + "/data").select("treeID", "nodeData").collect():  # the model's size
        if n.leftChild >= 0 and n.split.numCategories >= 0:
            raise ValueError("splits of categories have no order")
        split = (n.split.featureIndex, n.split.leftCategoriesOrThreshold[0], n.leftChild, n.rightChild) if n.leftChild >= 0 else None
        trees.setdefault(tree, {})[n.id] = (n.prediction, n.rawCount, split)
    return [p for t in sorted(trees) for p in paths_of_nodes(trees[t], scales[t])]


def _shares(path: Path, patterns):
    """For each pattern (rows of truth values, whether x is inside the interval of each feature) what each feature gets of the leaf's value."""
    import numpy as np

    d = len(path.features)
    inside = patterns.astype(float)
    weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.empty_like(inside)
    for i in range(d):
        product = np.zeros((len(inside), d))
        product[:, 0] = 1.0
        for j in range(d):
            if j != i:  # times (share + inside * t)
                product[:, 1:] = product[:, 1:] * path.share[j] + product[:, :-1] * inside[:, j : j + 1]
                product[:, 0] *= path.share[j]
        out[:, i] = path.value * (inside[:, i] - path.share[i]) * (product @ weight)
    return out


def attribute(rows: DataFrame, features: list[str], model_paths: list[Path], prefix: str = "a_") -> DataFrame:
    """rows with a column for each feature: what it adds to the prediction over the model's mean (sum of mean() of the paths)."""
    shared = rows.sparkSession.sparkContext.broadcast(model_paths)
    own, names = rows.columns, [prefix + f for f in features]
    numbered = rows.withColumns({f"__x{i}": F.col(f"`{f}`").cast("double") for i, f in enumerate(features)})
    kept = len(own)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = [batch.column(kept + i).to_numpy(zero_copy_only=False) for i in range(len(features))]
            got = np.zeros((len(features), batch.num_rows))
            for path in shared.value:
                if path.features:
                    code = np.zeros(batch.num_rows, np.int64)
                    for j, (f, low, high) in enumerate(zip(path.features, path.low, path.high)):
                        code |= ((x[f] > low) & (x[f] <= high)).astype(np.int64) << j
                    seen, at = np.unique(code, return_inverse=True)
                    shares = _shares(path, (seen[:, None] >> np.arange(len(path.features))) & 1)
                    for j, f in enumerate(path.features):
                        got[f] += shares[at, j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.array(g) for g in got]], names=[*own, *names])

    return numbered.mapInArrow(run, rows.withColumns(dict.fromkeys(names, F.lit(None).cast("double"))).schema)


def mean_attributions(rows: DataFrame, features: list[str], model_paths: list[Path]) -> DataFrame:
    """(feature, mean_abs): how far each feature moves predictions, on average over all rows."""
    out = attribute(rows.select(*features), features, model_paths)
    one = out.agg(*[F.avg(F.abs(F.col(f"`a_{f}`"))).alias(f"m{i}") for i, f in enumerate(features)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs")) for i, f in enumerate(features)])))
