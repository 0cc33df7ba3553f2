"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected with a few Gaussian (2-stable) directions, so a squared projected
distance over the squared true distance follows a chi-square law with as many degrees
of freedom. A kd-tree over the projections, fitted on a bounded sample, deals all vectors to
cells. A query first searches its own cell; the k-th distance found there and the
chi-square quantile give the projected radius within which better neighbours lie, and the
query then goes on to the cells that its ball touches. Inside a cell candidates come in order of projected
distance and are verified on the original vectors until the test stops the query.

Largest inner products are nearest distances after one more coordinate makes all
candidates equally long (the bound on their lengths is an exact maximum over all rows).

Cells with more than CELL_ROWS rows (such as many copies of one vector) are split by id, so
that no task gets a hot cell whole. Sample, tree and directions are bounded: SAMPLE_ROWS
rows, and a cell for eight of them at most.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; repeated ids are separate candidates, but never
neighbours of a query with their id, which asks with the least of its vectors; ties go to the smaller id; fewer candidates than k are all
returned; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows of the sample, of a cell, of a block of queries, candidates verified at once, and pairs computed anew at once.
SAMPLE_ROWS, CELL_ROWS, QUERY_ROWS, STEP, PAIRS = 50_000, 4096, 4096, 128, 1 << 16


def chi_square_quantile(p: float, dof: int) -> float:
    """The p-quantile of the chi-square law, by bisection on the regularised gamma function."""
    def below(x):
        a, half = dof / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-15:
            term *= half / (a + n)
            total += term
            n += 1
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    lo, hi = 1e-9, dof + 40 * math.sqrt(dof) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def fit_tree(points, cells: int):
    """A kd-tree as arrays (axis, cut) by heap position, and the bounds of each cell; splits at medians of the widest axis."""
    import numpy as np

    levels = max(0, math.ceil(math.log2(max(cells, 1))))
    axis, cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
    held = {1: points}
    for node in range(1, 1 << levels):
        own = held.pop(node)
        if len(own):
            axis[node] = int(np.argmax(own.max(0) - own.min(0)))
            cut[node] = float(np.median(own[:, axis[node]]))
        left = own[:, axis[node]] <= cut[node]
        held[2 * node], held[2 * node + 1] = own[left], own[~left]
    lo, hi = np.full((2 << levels, points.shape[1]), -np.inf), np.full((2 << levels, points.shape[1]), np.inf)
    for node in range(1, 1 << levels):
        for child in (2 * node, 2 * node + 1):
            lo[child], hi[child] = lo[node], hi[node]
        hi[2 * node, axis[node]] = min(hi[node, axis[node]], cut[node])
        lo[2 * node + 1, axis[node]] = max(lo[node, axis[node]], cut[node])
    leaf = 1 << levels
    return axis, cut, lo[leaf:], hi[leaf:]


def cell_of(points, axis, cut):
    import numpy as np

    node = np.ones(len(points), np.int64)
    while len(node) and node[0] < len(axis):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > cut[node])
    return node - len(axis)


def verify(q, asks, given, ql, v, ids, low, longest: float, quantile: float, k: int):
    """Search a cell for a block of queries: (query's place, id, score) of the best k found, and the pairs verified by query.

    Each query takes the candidates in order of projected distance, STEP at a time, by their products on
    the original vectors. It stops when the next projected distance lies beyond the chi-square quantile of the
    distance of its k-th best so far (or of given, the k-th best known before; nan if there is none).

    Products come from one matrix product for the block, whose last digits depend on the block's shape; those that may
    be among the k best of what a query has taken are computed anew, so scores and ties do not depend on it.
    """
    import numpy as np

    far = (ql * ql).sum(1)[:, None] + (low * low).sum(1) - 2 * ql @ low.T
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    n, squares = len(ids), (q * q).sum(1)
    bound = np.where(np.isnan(given), -np.inf, given)
    products = q @ v.T
    products[ids == asks[:, None]] = -np.inf
    best = np.full((len(q), k), -np.inf)
    done, at, live = np.zeros(len(q), np.int64), 0, np.arange(len(q))
    while at < n and len(live):
        radius = quantile * np.maximum(squares[live] + longest - 2 * bound[live], 0)
        live = live[far[live, at] <= radius]
        some = order[live, at : at + STEP]
        best[live] = np.partition(np.concatenate([best[live], products[live[:, None], some]], 1), -k, axis=1)[:, -k:]
        bound[live] = np.maximum(bound[live], best[live, 0])
        done[live] += some.shape[1]
        at += STEP
    taken = np.empty((len(q), n), bool)
    np.put_along_axis(taken, order, np.arange(n) < done[:, None], 1)
    least = best[:, 0] - 1e-12 * np.sqrt(squares * longest)
    row, col = np.nonzero(taken & (products >= least[:, None]) & (products > -np.inf))
    score = np.concatenate([(v[col[i : i + PAIRS]] * q[row[i : i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS)] or [np.empty(0)])
    by = np.lexsort((ids[col], -score, row))
    row, col, score = row[by], col[by], score[by]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    first &= ~(score < given[row])
    return row[first], ids[col[first]], score[first], done


def usable(vector: F.Column) -> F.Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, dims: int = 10, p: float = 0.9, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row where queries holds.

    p is the chance with which the stopping test leaves a true neighbour in reach.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    d, total = sizes["d"], sizes["count"]
    rows = rows.where(F.size("v") == d)
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((d + 1, dims))
    quantile = chi_square_quantile(p, dims)

    def lifted(v, candidate: bool):
        """Vectors with the coordinate that makes candidates equally long; 0 for queries."""
        rest = np.sqrt(np.maximum(longest - (v * v).sum(1), 0)) if candidate else np.zeros(len(v))
        return np.concatenate([v, rest[:, None]], 1)

    sample = rows.select("v").sample(min(1.0, 1.2 * SAMPLE_ROWS / total), seed=seed).limit(SAMPLE_ROWS).toPandas()
    points = lifted(np.array(sample.v.tolist() or [[0.0] * d]), True) @ directions
    axis, cut, lo, hi = fit_tree(points, min(-(-total // (CELL_ROWS // 2)), max(1, len(points) // 8)))
    shared = spark.sparkContext.broadcast((directions, axis, cut, lo, hi))

    def dealt(batches):
        import pyarrow as pa

        directions, axis, cut, _, _ = shared.value
        for batch in batches:
            v = np.array(batch.column(1).flatten(), np.float64).reshape(-1, d)
            low = lifted(v, True) @ directions
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(low, axis, cut), pa.int64())], names=["vec_id", "v", "asks", "cell"])

    placed = materialise(rows.mapInArrow(dealt, "vec_id long, v array<double>, asks boolean, cell long"))
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("shards"))  # a row a cell, an eighth of the sample at most
    candidates = placed.join(F.broadcast(counts), "cell").select("vec_id", "v", F.col("cell"), F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"))

    def visited(batches):
        """Each query once for every cell that its ball touches; without a bound, for its own cell."""
        import pyarrow as pa

        directions, axis, cut, lo, hi = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = np.array(batch.column(1).flatten(), np.float64).reshape(-1, d)
            bound = np.array(batch.column(2).to_pylist(), np.float64)
            own = cell_of(lifted(v, True) @ directions, axis, cut)
            low = lifted(v, False) @ directions
            for i in range(0, len(ids), 256):
                q = low[i : i + 256]
                gap = np.maximum(lo[None] - q[:, None], 0) + np.maximum(q[:, None] - hi[None], 0)
                radius = quantile * np.maximum((v[i : i + 256] ** 2).sum(1) + longest - 2 * bound[i : i + 256], 0)
                touched = (gap**2).sum(2) <= radius[:, None]
                touched[np.arange(len(q)), own[i : i + 256]] = np.isnan(bound[i : i + 256])  # the first search has been there
                which, cell = np.nonzero(touched)
                at = pa.array(i + which)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cell, pa.int64())], names=["query_id", "qv", "bound", "cell"])

    def searched(asked: DataFrame) -> DataFrame:
        visits = asked.mapInArrow(visited, "query_id long, qv array<double>, bound double, cell long")
        visits = visits.join(F.broadcast(counts), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        # many queries of one cell are dealt in blocks, with a copy of the cell each
        load = visits.groupBy("cell", "shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        visits = visits.join(load, ["cell", "shard"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
        held = candidates.join(load, ["cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def search(left, right):
            import pandas as pd

            out = []
            if len(left) and len(right):
                directions = shared.value[0]
                right = right.sort_values("vec_id")
                v, ids = np.array(right.v.tolist()), right.vec_id.to_numpy()
                low = lifted(v, True) @ directions
                for i in range(0, len(left), 128):
                    part = left.iloc[i : i + 128]
                    q, asks, given = np.array(part.qv.tolist()), part.query_id.to_numpy(), part.bound.to_numpy(np.float64)
                    row, near, score, _ = verify(q, asks, given, lifted(q, False) @ directions, v, ids, low, longest, quantile, k)
                    out.append(pd.DataFrame({"query_id": asks[row], "vec_id": near, "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["cell", "shard", "block"]
        return visits.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = placed.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).groupBy("query_id").agg(F.min("qv").alias("qv"))
    first = materialise(best(searched(asked.withColumn("bound", F.lit(None).cast("double")))).drop("rank"))
    kth = first.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("bound")).otherwise(-1.7e308).alias("bound"))
    second = searched(asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.7e308))))
    return best(first.union(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
