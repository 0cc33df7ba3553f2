"""Boosted regression trees grown leaf by leaf, from histograms of gradients.

Features are coded once by quantile edges. A tree's best leaf is split first, until it has ``leaves``. Histograms of
(node, feature, bin) are summed where rows stand, so a job returns as many numbers as the tree has bins,
whatever the rows; of two children only the smaller one's are summed and the other's follow by subtraction. Since the best
leaf is known only once its rivals' children are, a job splits all promising leaves ahead of their turn, and a tree takes
about as many jobs as it is deep. Predictions so far are kept with the rows and written anew every KEEP trees.

Rows with the same bins always lie in the same leaf. Where the distinct rows of bins (cells) are at most CELLS, whatever the rows, a few jobs
sum the rows and targets that each turn takes, by turn and cell, and trees grow from these sums. The trees are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .attribution import Path, paths_of_nodes
from .selection import group_quantiles
from .windows import edges_below

BINS, KEEP = 64, 16
#: Cells whose sums the driver holds, and the sums (of turns times cells) that a job returns at most.
CELLS, SUMS = 1 << 16, 1 << 21


@dataclass
class Tree:
    """Nodes by number: a split (feature, bin, left, right) or None, its value, and its training rows."""

    split: list
    value: list[float]
    rows: list[int]

    def leaf(self, codes):
        """The node that each row (of bins by feature) ends in."""
        import numpy as np

        table = np.array([s or (0, 0, i, i) for i, s in enumerate(self.split)], np.int64).reshape(-1, 4)
        at, every = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            feature, cut, left, right = table[at].T
            to = np.where(codes[every, feature] <= cut, left, right) if len(at) else at
            if (to == at).all():
                return at
            at = to


@dataclass
class Booster:
    """base and the trees' values add up to a prediction; edges[f] are the upper ends of feature f's bins but the last."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def codes(self) -> F.Column:
        return F.array(*[edges_below(F.col(f"`{f}`").cast("double"), e) for f, e in zip(self.features, self.edges)])

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        """rows with the prediction; a null feature lies in its first bin."""
        shared, base = rows.sparkSession.sparkContext.broadcast(self.trees), self.base
        names, k = [*rows.columns, out], len(self.features)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                codes = batch.column(len(names) - 1).flatten().to_numpy().reshape(-1, k)
                total = np.full(len(codes), base)
                for tree in shared.value:
                    total += np.array(tree.value)[tree.leaf(codes)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=names)

        return rows.withColumn("__codes", self.codes()).mapInArrow(run, rows.withColumn(out, F.lit(None).cast("double")).schema)

    def paths(self) -> list[Path]:
        """The root-to-leaf paths of all trees, for attributions; base adds to their mean."""
        out = []
        for t in self.trees:
            raw = {i: (v, n, s and (s[0], self.edges[s[0]][s[1]], s[2], s[3])) for i, (s, v, n) in enumerate(zip(t.split, t.value, t.rows))}
            out += paths_of_nodes(raw)
        return out


def _kept(rid, turn: int, share: float):
    """Which rows take part in a turn, by a hash of their numbers."""
    import numpy as np

    x = (rid.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * 2**53


def _split(g, n, columns, least: int, l2: float):
    """(gain, feature, bin) of the best split of a node's histograms (feature, bin), or None."""
    import numpy as np

    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g[0].sum(), n[0].sum()
    right_g, right_n = all_g - left_g, all_n - left_n
    gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - all_g**2 / (all_n + l2)
    fit = (left_n >= least) & (right_n >= least) & np.isin(np.arange(len(g)), columns)[:, None]
    gain = np.where(fit, gain, -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or gain.flat[at] <= 1e-9:
        return None
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _binned(nodes, at, codes, gradient, count=None):
    """(gradient sums, rows) of nodes (ascending), by node, feature and bin, of rows that lie at nodes; count stands for several equal rows."""
    import numpy as np

    place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
    hit = nodes[place] == at
    place, codes, gradient, count = place[hit] * BINS, codes[hit], gradient[hit], None if count is None else count[hit]
    shape = codes.shape[1], len(nodes), BINS
    g, n = (np.stack([np.bincount(place + c, w, len(nodes) * BINS) for c in codes.T]).reshape(shape).swapaxes(0, 1) for w in (gradient, count))
    return g, n


def _cells(held: DataFrame, k: int):
    """The distinct rows of bins in order, or None if they are more than CELLS."""
    import numpy as np

    found = held.select("codes").distinct().limit(CELLS + 1).collect()
    return None if len(found) > CELLS else np.array(sorted(r.codes for r in found), np.int64).reshape(-1, k)


def _turn_sums(held: DataFrame, cells, turns: range, row_share: float):
    """(rows, target sums) by turn and cell, of the rows that each turn takes; held has the number of its cell."""
    import numpy as np

    first, shape = turns.start, (len(turns), len(cells))

    def run(batches):
        import pyarrow as pa

        n, s = np.zeros((2, *shape))
        for batch in batches:
            rid, target, cell = (batch.column(i).to_numpy() for i in range(3))
            for t in range(shape[0]):
                take = _kept(rid, first + t, row_share)
                mine = cell[take]
                n[t] += np.bincount(mine, minlength=shape[1])
                s[t] += np.bincount(mine, target[take], shape[1])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.flat[at].astype(np.int64)), pa.array(s.flat[at])], names=["at", "n", "s"])

    # a task for each core, as each returns a sum for each turn and cell
    few = held.select("rid", "y", "cell").coalesce(held.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(run, "at long, n long, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    n, s = np.zeros((2, shape[0] * shape[1]))
    n[got["at"].to_numpy()], s[got["at"].to_numpy()] = got["n"].to_numpy(), got["s"].to_numpy()
    return n.reshape(shape), s.reshape(shape)


def boost(rows: DataFrame, y: str, features: list[str], rounds: int = 200, step: float = 0.1, leaves: int = 31, least: int = 20, l2: float = 1.0, row_share: float = 0.8, column_share: float = 0.8, seed: int = 42) -> Booster:
    """Fit to squared errors. Each tree takes a share of rows and columns; l2 shrinks leaves, which have least rows or more."""
    import numpy as np

    spark, k = rows.sparkSession, len(features)
    known = rows.where(F.col(y).isNotNull())
    long = known.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{f}`").cast("double").alias("x")) for i, f in enumerate(features)])))
    found = {r.f: r.q for r in group_quantiles(long, ["f"], "x", [i / BINS for i in range(1, BINS)]).collect()}
    edges = [sorted({float(x) for x in found.get(i, [])}) for i in range(k)]
    model = Booster(features, edges, known.agg(F.avg(y)).first()[0] or 0.0, [])
    held = scratch.write(known.select(F.monotonically_increasing_id().alias("rid"), F.col(y).cast("double").alias("y"), model.codes().alias("codes"), F.lit(model.base).alias("sum")))
    rng, since = np.random.default_rng(seed), []
    cells = _cells(held, k)
    if cells is not None:
        number = spark.createDataFrame([(c.tolist(), i) for i, c in enumerate(cells)], "codes array<int>, cell int")
        last, held = held, scratch.write(held.join(F.broadcast(number), "codes").select("rid", "y", "cell"))
        scratch.drop(last)
        total, block = np.full(len(cells), model.base), max(1, SUMS // max(1, len(cells)))

    def cell_histograms(tree: Tree, wanted: list[int]) -> dict:
        n, s = taken_rows[turn % block], taken_sums[turn % block]
        nodes = np.array(sorted(wanted))
        g, n = _binned(nodes, tree.leaf(cells), cells, n * total - s, n)
        return {i: np.stack([a, b]) for i, a, b in zip(nodes.tolist(), g, n)}

    def histograms(tree: Tree, wanted: list[int], turn: int) -> dict:
        """{node: (gradient sums, rows), each by feature and bin}."""
        shared = spark.sparkContext.broadcast((tree, list(since), np.array(sorted(wanted))))

        def run(batches):
            import pyarrow as pa

            grown, recent, nodes = shared.value
            g, n = np.zeros((2, len(nodes), k, BINS))
            for batch in batches:
                rid, target, codes, total = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, k), batch.column(3).to_numpy().copy()
                take = _kept(rid, turn, row_share)
                target, codes, total = target[take], codes[take], total[take]
                for t in recent:
                    total += np.array(t.value)[t.leaf(codes)]
                more = _binned(nodes, grown.leaf(codes), codes, total - target)
                g, n = g + more[0], n + more[1]
            i, f, b = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i].astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(g[i, f, b]), pa.array(n[i, f, b].astype(np.int64))], names=["node", "f", "b", "g", "n"])

        out = {i: np.zeros((2, k, BINS)) for i in wanted}
        summed = held.mapInArrow(run, "node int, f int, b int, g double, n long").groupBy("node", "f", "b").agg(F.sum("g"), F.sum("n"))
        for node, f, b, g, n in summed.collect():  # wanted * k * BINS at most
            out[node][:, f, b] = g, n
        return out

    for turn in range(rounds):
        columns = sorted(rng.choice(k, max(1, round(column_share * k)), replace=False).tolist())
        ahead = Tree([None], [0.0], [0])
        if cells is not None and turn % block == 0:
            taken_rows, taken_sums = _turn_sums(held, cells, range(turn, min(turn + block, rounds)), row_share)
        summed = (lambda tree, wanted: histograms(tree, wanted, turn)) if cells is None else cell_histograms
        sums = summed(ahead, [0])
        plan = {0: _split(*sums[0], columns, least, l2)}
        taken, frontier = set(), {0}
        while len(frontier) < leaves:
            ready = [i for i in frontier if plan[i]]
            if not ready:
                break
            best = max(ready, key=lambda i: (plan[i][0], -i))
            if ahead.split[best] is None:  # the next ones in line are split with it
                small = {}
                for i in sorted((i for i in ready if ahead.split[i] is None), key=lambda i: -plan[i][0])[: leaves - len(frontier)]:
                    _, f, b = plan[i]
                    left, right = len(ahead.split), len(ahead.split) + 1
                    ahead.split[i] = (f, b, left, right)
                    ahead.split += [None, None]
                    less = sums[i][1][f, : b + 1].sum() <= sums[i][1][f, b + 1 :].sum()
                    small[left if less else right] = (i, right if less else left)
                got = summed(ahead, list(small))
                for child, (parent, sibling) in small.items():
                    sums[child], sums[sibling] = got[child], sums[parent] - got[child]
                    plan |= {c: _split(*sums[c], columns, least, l2) for c in (child, sibling)}
            taken.add(best)
            frontier = frontier - {best} | set(ahead.split[best][2:])
        # the splits whose turn never came are dropped, and nodes numbered anew
        order = sorted(taken | frontier)
        number = {i: j for j, i in enumerate(order)}
        split = [(*ahead.split[i][:2], *[number[c] for c in ahead.split[i][2:]]) if i in taken else None for i in order]
        value = [0.0 if i in taken else float(-step * sums[i][0][0].sum() / (sums[i][1][0].sum() + l2)) for i in order]
        tree = Tree(split, value, [int(sums[i][1][0].sum()) for i in order])
        model.trees.append(tree)
        if cells is not None:
            total += np.array(tree.value)[tree.leaf(cells)]
            continue
        since.append(tree)
        if len(since) == KEEP and turn + 1 < rounds:
            kept = Booster(features, edges, 0.0, list(since))
            last, held = held, scratch.write(_advanced(held, kept))
            scratch.drop(last)
            since.clear()
    scratch.drop(held)
    return model


def _advanced(held: DataFrame, trees: Booster) -> DataFrame:
    """The coded rows with the trees' values added to their sums."""
    shared, k = held.sparkSession.sparkContext.broadcast(trees.trees), len(trees.features)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes, total = batch.column(2).flatten().to_numpy().reshape(-1, k), batch.column(3).to_numpy().copy()
            for t in shared.value:
                total += np.array(t.value)[t.leaf(codes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], names=["rid", "y", "codes", "sum"])

    return held.mapInArrow(run, held.schema)
