"""Second-order boosted trees as Spark jobs over written bin codes.

Every feature is cut into quantile bins once; a row is then one byte per feature, and bin 0 holds
missing values. A pass sums gradients and hessians of the logistic loss per node, feature and bin;
prefix sums over the bins of one feature, in a window of at most ``bins`` rows, grade every cut with
the missing rows on either side, and one row per node, its best cut, comes back. A tree grows best
leaf first. A pass also fills the histograms of the children that may be needed next, so a tree
takes about as many passes as it is deep, not as many as it has leaves.

Gradients and hessians are rounded to whole multiples of one step, chosen so that all sums stay
exact in a double: histograms, and with them the trees, do not depend on how rows were partitioned
or which tasks ran twice. Margins of finished trees are written next to the codes every
``REWRITE_TREES`` trees, so a pass evaluates few trees per row.

Only cuts, trees and one row per node and pass reach the driver; the sketch of the cuts is bounded
by the number of bins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources.tables import written

MAX_BINS = 255
REWRITE_TREES = 20
#: A quantile sketch of a feature places a cut within 1/SKETCH of its rank.
SKETCH = 2_000
#: Sums of whole steps below this are exact in a double.
EXACT = 2.0**52


@dataclass(frozen=True)
class Params:
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    #: Leaves of a tree; 0 leaves it to ``max_depth``.
    max_leaves: int = 0
    #: Least sum of hessians, and least rows, on either side of a cut.
    min_child_weight: float = 1.0
    min_rows: int = 1
    #: A cut must gain more than this.
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    #: Shares of rows and of features that a tree sees, by hashes.
    row_share: float = 1.0
    feature_share: float = 1.0
    bins: int = 64
    seed: int = 0
    #: Rounds without a lower loss on the held-out rows after which fitting ends; 0: all rounds are run.
    patience: int = 0


@dataclass
class Node:
    """A leaf with its value, or a cut: a value up to ``cut`` goes left, a missing one where ``missing_left`` says."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    cut: float = 0.0
    missing_left: bool = False
    left: int = -1
    right: int = -1
    gain: float = 0.0


Tree = list[Node]


@dataclass
class Booster:
    columns: list[str]
    trees: list[Tree] = field(default_factory=list)
    #: Mean held-out loss before the first tree and after each.
    losses: list[float] = field(default_factory=list)

    def gains(self) -> list[float]:
        """Total gain of the cuts at each column, as shares."""
        sums = [0.0] * len(self.columns)
        for tree in self.trees:
            for node in tree:
                if node.feature >= 0:
                    sums[node.feature] += node.gain
        whole = sum(sums)
        return [s / whole if whole else 0.0 for s in sums]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, json.dumps([asdict(n) for n in t])) for i, t in enumerate(self.trees)]
        frame = spark.createDataFrame([(-1, json.dumps([self.columns, self.losses])), *rows], "tree int, nodes string")
        frame.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        rows = {r.tree: json.loads(r.nodes) for r in spark.read.parquet(path).collect()}
        columns, losses = rows.pop(-1)
        return Booster(columns, [[Node(**n) for n in rows[i]] for i in sorted(rows)], losses)


# ---------------------------------------------------------------- trees over arrays


def leaves_of(tree: Tree, column: Callable[[int], np.ndarray], missing: Callable[[int], np.ndarray], by_bin: bool, n: int) -> np.ndarray:
    """The node of ``tree`` where each of ``n`` rows ends."""
    where = np.zeros(n, dtype=np.int32)
    # Children stand behind their parent, so one sweep over the nodes moves every row to its end.
    for i, node in enumerate(tree):
        if node.feature >= 0:
            here = np.flatnonzero(where == i)
            if len(here):
                below = column(node.feature)[here] <= (node.bin if by_bin else node.cut)
                goes_left = np.where(missing(node.feature)[here], node.missing_left, below)
                where[here] = np.where(goes_left, node.left, node.right)
    return where


def _by_codes(tree: Tree, codes: np.ndarray) -> np.ndarray:
    return leaves_of(tree, lambda f: codes[:, f], lambda f: codes[:, f] == 0, True, len(codes))


def _values(tree: Tree, where: np.ndarray) -> np.ndarray:
    return np.array([n.value for n in tree])[where]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A repeatable number in [0, 1) for each 64-bit key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _codes(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A binary column of one byte per feature, as a matrix without a copy."""
    column = batch.column(name)
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    _, offsets, data = column.buffers()
    data = np.frombuffer(data, dtype=np.uint8)
    start = int(np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return data[start : start + len(column) * width].reshape(len(column), width)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False))


# ---------------------------------------------------------------- bins


def cuts(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Upper edges of the bins of every column: at most ``bins`` - 1, from one bounded sketch each."""
    points = [i / bins for i in range(1, bins)]
    # A column of few values is cut between all of them as long as each holds its share of the ranks.
    found = df.agg(
        *[F.percentile_approx(_number(c), points, SKETCH).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.max(_number(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.min(_number(c)).alias(f"l{i}") for i, c in enumerate(columns)],
    ).first()
    edges = []
    for i in range(len(columns)):
        quantiles = {*(found[f"q{i}"] or []), found[f"l{i}"]} - {None}
        edges.append(sorted(q for q in quantiles if q < found[f"m{i}"])[: MAX_BINS - 1])
    return edges


def _number(column: str) -> Column:
    """A double; NaN is missing like NULL."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def _binned(edges: list[list[float]], carried: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(edges)), dtype=np.uint8)
            for f, edge in enumerate(edges):
                x = batch.column(f"x{f}").to_numpy(zero_copy_only=False)
                x = x.astype(np.float64)
                codes[:, f] = np.where(np.isnan(x), 0, np.searchsorted(np.array(edge), x, side="left") + 1)
            flat = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], flat], names=[*carried, "codes"])

    return run


# ---------------------------------------------------------------- histograms


def _margins(trees: Sequence[Tree], base: np.ndarray, codes: np.ndarray) -> np.ndarray:
    total = base.astype(np.float64)
    for tree in trees:
        total = total + _values(tree, _by_codes(tree, codes))
    return total


def _histogram(
    trees: list[Tree], tree: Tree, wanted: list[int], features: list[int], width: int, bins: int, step: float, row_share: float, salt: int, loss: bool
) -> Callable:
    """Per wanted node, feature and bin: sums of gradients and hessians in whole steps, and rows. Node -1: held-out loss and weight."""
    place = np.full(len(tree), -1, dtype=np.int32)
    place[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(features), len(wanted) * bins))
        lost = np.zeros(2)
        for batch in batches:
            codes = _codes(batch, "codes", width)
            y, w, held = _numbers(batch, "y"), _numbers(batch, "w"), _numbers(batch, "held").astype(bool)
            margin = _margins(trees, _numbers(batch, "margin"), codes)
            if loss and held.any():
                z = margin[held]
                lost += [float((w[held] * (np.logaddexp(0, z) - y[held] * z)).sum()), float(w[held].sum())]
            use = ~held
            if row_share < 1:
                use &= _uniform(_numbers(batch, "key"), salt) < row_share
            at = place[_by_codes(tree, codes)]
            use &= at >= 0
            if not use.any():
                continue
            p = 1.0 / (1.0 + np.exp(-np.clip(margin[use], -500, 500)))
            g = np.rint(w[use] * (p - y[use]) / step)
            h = np.rint(w[use] * p * (1 - p) / step)
            base, rows = at[use].astype(np.int64) * bins, codes[use]
            for k, f in enumerate(features):
                slot = base + rows[:, f]
                for part, amounts in enumerate((g, h, None)):
                    sums[part, k] += np.bincount(slot, weights=amounts, minlength=sums.shape[2])
        k, slot = np.nonzero(sums[2])
        node = np.array(wanted, dtype=np.int32)[slot // bins]
        columns = [
            pa.array(np.append(node, -1).astype(np.int32)), pa.array(np.append(np.array(features, dtype=np.int32)[k], -1).astype(np.int32)),
            pa.array(np.append(slot % bins, -1).astype(np.int32)),
            *[pa.array(np.append(sums[part, k, slot], last)) for part, last in ((0, lost[0]), (1, lost[1]), (2, 0.0))],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "feature", "bin", "g", "h", "n"])

    return run


def _thresholded(total: str, l1: float) -> str:
    return f"(CASE WHEN {total} > {l1!r}D THEN {total} - {l1!r}D WHEN {total} < -{l1!r}D THEN {total} + {l1!r}D ELSE 0D END)"


def _grade(g: str, h: str, p: Params) -> str:
    s = _thresholded(g, p.l1)
    return f"coalesce(try_divide({s} * {s}, {h} + {p.l2!r}D), 0D)"


def _leaf_value(g: float, h: float, p: Params) -> float:
    s = g - p.l1 if g > p.l1 else g + p.l1 if g < -p.l1 else 0.0
    return -p.learning_rate * s / (h + p.l2) if h + p.l2 > 0 else 0.0


def best_cuts(histogram: DataFrame, p: Params, step: float) -> DataFrame:
    """(node, g, h, n, loss, weight, best): totals of each node and its best cut, NULL without one that gains.

    Equal gains go to the smaller feature, then the smaller bin, then missing rows on the left.
    """
    sums = histogram.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    # At most ``bins`` rows of one feature in one node reach these windows.
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = {c: F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col(c))).over(whole), F.lit(0.0)) for c in "ghn"}
    run = sums.select(
        "node", "feature", "bin", *[F.sum(c).over(whole).alias(f"{c}_all") for c in "ghn"],
        *[(F.sum(c).over(upto) - missing[c]).alias(f"{c}_known") for c in "ghn"], *[missing[c].alias(f"{c}_missing") for c in "ghn"],
    )
    sides = run.withColumn("missing_left", F.explode(F.array(F.lit(1), F.lit(0))))
    left = {c: F.expr(f"{c}_known + missing_left * {c}_missing") for c in "ghn"}
    cut = sides.withColumns({f"{c}_left": v for c, v in left.items()}).withColumns({f"{c}_right": F.expr(f"{c}_all - {c}_left") for c in "ghn"})
    scaled = cut.withColumns({f"{c}{side}": F.col(f"{c}{side}") * F.lit(step) for c in "gh" for side in ("_all", "_left", "_right")})
    gain = f"0.5D * ({_grade('g_left', 'h_left', p)} + {_grade('g_right', 'h_right', p)} - {_grade('g_all', 'h_all', p)})"
    allowed = (
        (F.col("node") >= 0) & (F.col("bin") > 0) & (F.least("n_left", "n_right") >= max(1, p.min_rows))
        & (F.least("h_left", "h_right") >= p.min_child_weight) & (F.expr(gain) > p.min_gain)
    )
    # The order of the fields is the order of preference.
    choice = F.struct(
        F.expr(gain).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "missing_left", "g_left", "h_left", "g_right", "h_right"
    )
    return scaled.groupBy("node").agg(
        F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max(F.when(F.col("node") == -1, F.col("g_all") / F.lit(step))).alias("loss"),
        F.max(F.when(F.col("node") == -1, F.col("h_all") / F.lit(step))).alias("weight"), F.max(F.when(allowed, choice)).alias("best"),
    )


# ---------------------------------------------------------------- fitting


@dataclass
class _Leaf:
    """A node that may still be cut: its place in the tree, depth, sums, and its best cut once a pass has found it."""

    place: int
    depth: int
    g: float
    h: float
    known: bool = False
    best: dict | None = None


def _grow(passed: Callable[[Tree, list[int]], dict[int, dict]], edges: list[list[float]], p: Params) -> Tree:
    """One tree, best leaf first. ``passed`` gives totals and best cuts of nodes of a tree, in one pass over the rows.

    Nodes ahead of need: each pass also opens the leaves with the best known cuts, as many as may still be
    cut, and looks at their children. The opened part is then cut down to what best-first growth takes.
    """
    most = p.max_leaves or 1 << p.max_depth
    explored: Tree = [Node()]
    root = passed(explored, [0]).get(0)
    if root is None:
        return [Node()]
    leaves = {0: _Leaf(0, 0, root["g"], root["h"], True, root["best"])}
    opened: dict[int, tuple[int, int]] = {}

    def open_leaf(leaf: _Leaf) -> None:
        b, node = leaf.best, explored[leaf.place]
        left, right = len(explored), len(explored) + 1
        node.feature, node.bin, node.missing_left, node.gain = -b["feature"], -b["bin"], bool(b["missing_left"]), b["gain"]
        edge = edges[node.feature]
        node.cut = edge[node.bin - 1] if node.bin <= len(edge) else math.inf
        node.left, node.right = left, right
        explored.extend([Node(), Node()])
        opened[leaf.place] = (left, right)
        leaves[left] = _Leaf(left, leaf.depth + 1, b["g_left"], b["h_left"])
        leaves[right] = _Leaf(right, leaf.depth + 1, b["g_right"], b["h_right"])

    def can_cut(leaf: _Leaf) -> bool:
        return leaf.depth < p.max_depth and not (leaf.known and leaf.best is None)

    while True:
        # Best-first growth over what is known; it stops at the first leaf that no pass has seen.
        front, taken, blocked = [0], [], False
        while len(front) < most:
            ready = [leaves[i] for i in front if can_cut(leaves[i])]
            if any(not leaf.known for leaf in ready):
                blocked = True
                break
            if not ready:
                break
            leaf = max(ready, key=lambda x: (x.best["gain"], -x.place))
            if leaf.place not in opened:
                open_leaf(leaf)
            front.remove(leaf.place)
            front += opened[leaf.place]
            taken.append(leaf.place)
        if not blocked:
            break
        room = most - len(front)
        ahead = sorted((x for x in leaves.values() if x.place not in opened and x.known and can_cut(x)), key=lambda x: (-x.best["gain"], x.place))
        for leaf in ahead[:room]:
            open_leaf(leaf)
        ask = [x.place for x in leaves.values() if not x.known and x.depth < p.max_depth]
        found = passed(explored, ask)
        for i in ask:
            leaves[i].known, leaves[i].best = True, found[i]["best"] if i in found else None
    # What was taken, children behind parents.
    number, out, queue = {0: 0}, [Node()], [0]
    for place in queue:
        if place in taken:
            node, at = explored[place], number[place]
            kept = Node(feature=node.feature, bin=node.bin, cut=node.cut, missing_left=node.missing_left, gain=node.gain, left=len(out), right=len(out) + 1)
            out[at] = kept
            for child in opened[place]:
                number[child] = len(out)
                out.append(Node())
                queue.append(child)
        else:
            leaf = leaves[place]
            out[number[place]] = Node(value=_leaf_value(leaf.g, leaf.h, p))
    return out


def fit(
    df: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, key: str | None = None, held: str | None = None, **params: object
) -> Booster:
    """Boosted trees for a 0/1 label. Rows with a NULL label or weight are left out; NULL and NaN features are missing.

    ``held`` names a boolean column: rows where it is true are not learned from, their loss is followed, and the
    trees up to its least value stay; with ``patience`` it ends the rounds. ``key`` (any column that tells rows
    apart; all features by default) decides which rows a tree sees under ``row_share``.
    """
    p, columns = Params(**params), list(columns)
    if not 2 <= p.bins <= MAX_BINS:
        raise ValueError(f"bins must be 2 to {MAX_BINS}")
    spark = df.sparkSession
    known = df.filter(F.col(label).isNotNull())
    if weight:
        known = known.filter(F.col(weight).isNotNull())
    own = F.xxhash64(F.col(key)) if key else F.xxhash64(*[_number(c) for c in columns])
    flat = known.select(
        own.alias("key"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"), F.lit(0.0).alias("margin"),
        *[_number(c).alias(f"x{i}") for i, c in enumerate(columns)],
    )
    xs = [f"x{i}" for i in range(len(columns))]
    edges = cuts(flat.filter("NOT held"), xs, p.bins)
    carried = ["key", "y", "w", "held", "margin"]
    schema = "key long, y double, w double, held boolean, margin double, codes binary"
    rows = written(flat.mapInArrow(_binned(edges, carried), schema))
    total = rows.agg(F.sum("w")).first()[0]
    model = Booster(columns)
    if not total:
        return model
    # A power of two, so that a step times a whole number is exact as well.
    step = 2.0 ** max(-40, math.ceil(math.log2(total / EXACT)))
    bins = max(len(e) for e in edges) + 2
    since, lowest, stale = 0, math.inf, 0

    def losses_of(found: dict[int, dict]) -> None:
        seen = found.get(-1)
        if seen and seen["weight"]:
            model.losses.append(seen["loss"] / seen["weight"])

    def passed_for(number: int) -> Callable[[Tree, list[int]], dict[int, dict]]:
        shares = _uniform(np.arange(len(columns)), (p.seed << 20) + 2 * number + 1)
        features = [i for i in range(len(columns)) if shares[i] < p.feature_share] or [int(np.argmin(shares))]

        def passed(tree: Tree, wanted: list[int]) -> dict[int, dict]:
            if not wanted:
                return {}
            body = _histogram(
                model.trees[since:], tree, wanted, features, len(columns), bins, step, p.row_share, (p.seed << 20) + 2 * number, wanted == [0]
            )
            histogram = rows.mapInArrow(body, "node int, feature int, bin int, g double, h double, n double")
            found = {r["node"]: r.asDict(recursive=True) for r in best_cuts(histogram, p, step).collect()}
            if wanted == [0]:
                losses_of(found)
            return found

        return passed

    for number in range(p.rounds):
        tree = _grow(passed_for(number), edges, p)
        if model.losses:
            stale = 0 if model.losses[-1] < lowest else stale + 1
            lowest = min(lowest, model.losses[-1])
            if p.patience and stale >= p.patience:
                break
        model.trees.append(tree)
        if len(tree) == 1 and p.row_share == 1 and p.feature_share == 1 and not tree[0].value:
            break
        if len(model.trees) - since >= REWRITE_TREES and number + 1 < p.rounds:
            rows = written(rows.mapInArrow(_advanced(model.trees[since:], len(columns)), schema))
            since = len(model.trees)
    if held and model.trees:
        losses_of(passed_for(p.rounds)([Node()], [0]))
        if model.losses:
            del model.trees[int(np.argmin(model.losses)) :]
    return model


def _advanced(trees: list[Tree], width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(trees, _numbers(batch, "margin"), _codes(batch, "codes", width))
            place = batch.schema.get_field_index("margin")
            yield batch.set_column(place, "margin", pa.array(margin))

    return run


def margins(model: Booster, df: DataFrame, alias: str = "margin") -> DataFrame:
    """``df`` with the sum of the trees' values, in one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model.trees)
    used = sorted({n.feature for t in model.trees for n in t if n.feature >= 0})
    kept = [c for c in df.columns if c != alias]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {f: batch.column(len(kept) + i).to_numpy(zero_copy_only=False).astype(np.float64) for i, f in enumerate(used)}
            gone = {f: np.isnan(v) for f, v in x.items()}
            total = np.zeros(batch.num_rows)
            for tree in shared.value:
                total += _values(tree, leaves_of(tree, x.__getitem__, gone.__getitem__, False, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(total)], names=[*kept, alias])

    # Columns travel by place: their names may be any.
    columns = [*[F.col(f"`{c}`") for c in kept], *[_number(model.columns[f]) for f in used]]
    placed = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != alias]
    return placed.mapInArrow(run, ", ".join([*fields, f"`{alias}` double"]))


def score(model: Booster, df: DataFrame, alias: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    found = margins(model, df, alias)
    return found.withColumn(alias, 1 / (1 + F.exp(-F.col(f"`{alias}`"))))
