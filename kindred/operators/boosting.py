"""Regularised gradient-boosted trees, grown leaf by leaf in order of gain.

Features are cut into at most `bins` ranges by quantiles. A tree is grown best-first: of all leaves the one whose best
split gains most is split next, until there are `leaves` leaves. With G and H a leaf's sums of gradients and Hessians
and S(G) = sign(G) max(0, |G| - l1), a leaf's worth is S(G)^2 / (H + l2), its value -S(G) / (H + l2), and a split gains
what both sides are worth together above the whole.

On Spark: rows are binned once, a byte a feature, and written as distinct rows with their number, since equal rows have
equal gradients and are drawn together. A pass over them makes gradient histograms, in numpy in each task, summed by one
aggregate over (leaf, feature, bin); the driver gets leaves x features x bins sums, whatever the number of rows. A pass
serves every leaf that best-first growth may split next, so a tree takes about as many passes as it is deep, not one a
split. Scores of the trees so far are written anew every `REWRITE` trees; between, tasks apply the few trees that are
missing. Draws of rows hang on a hash of the row's values and the tree's number.

Rows with is_validation are not fitted; growth ends after `patience` trees without a smaller loss on them, and the
trees up to the smallest loss are the model. Values that are no numbers count as 0; equal rows are drawn together;
without rows of a label all scores are at the prior.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.functions.constants import FEATURES
from kindred.operators.model import numeric
from kindred.operators.validate import require
from kindred.sources.scratch import written

REWRITE = 10


@dataclass
class BoostConfig:
    """How trees are grown."""

    trees: int = 2000
    leaves: int = 31
    rate: float = 0.03
    min_rows: int = 100
    min_hessian: float = 1e-3
    l1: float = 0.1
    l2: float = 1.0
    row_share: float = 0.8
    feature_share: float = 0.8
    bins: int = 255
    patience: int = 100
    seed: int = 42


@dataclass
class Tree:
    """Nodes from 0: a split (feature, bin, children; bin and below go left), or, with feature -1, a leaf's value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [new, new]
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x features)."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(bins[inner, feature[node]] <= cut[node], left[node], right[node])
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Boosted:
    """A fitted model: bin edges of each feature, the prior's log-odds, trees."""

    features: list[str]
    edges: list[list[float]]
    prior: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, columns, strict=True)], 1).astype(np.uint8)

    def importances(self) -> list[tuple[str, float]]:
        """How many splits each feature makes, as shares."""
        counts = np.bincount([f for t in self.trees for f in t.feature if f >= 0], minlength=len(self.features))
        return sorted(zip(self.features, (counts / max(1, counts.sum())).tolist(), strict=True), key=lambda p: (-p[1], p[0]))


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(0.0, np.abs(g) - l1)


def best_split(histogram: np.ndarray, config: BoostConfig, features: list[int]) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a leaf's histogram (features x bins x (gradients, Hessians, rows)); ties to the least."""
    total = histogram[0].sum(0)
    left = histogram.cumsum(1)
    right = total - left
    worth = lambda s: _shrunk(s[..., 0], config.l1) ** 2 / (s[..., 1] + config.l2)
    gain = worth(left) + worth(right) - worth(total)
    least = np.minimum(left[..., 2], right[..., 2]) < config.min_rows
    gain[least | (np.minimum(left[..., 1], right[..., 1]) < config.min_hessian)] = -np.inf
    gain[[f for f in range(len(gain)) if f not in features]] = -np.inf
    at = int(np.argmax(gain))
    feature, cut = divmod(at, gain.shape[1])
    return (float(gain[feature, cut]), feature, cut) if gain[feature, cut] > 1e-12 else None


def leaf_value(g: float, h: float, config: BoostConfig) -> float:
    return float(-_shrunk(np.float64(g), config.l1) / (h + config.l2))


def _pass(rows: DataFrame, late: list[Tree], tree: Tree, wanted: list[int], number: int, config: BoostConfig, n_features: int, lossy: bool) -> tuple[dict[int, np.ndarray], float, int]:
    """Histograms of the wanted leaves of a tree and, if lossy, the loss and number of held-out rows; late: trees not yet in margin."""
    slot = {leaf: i for i, leaf in enumerate(wanted)}
    width, bins = n_features * config.bins, config.bins
    share = int(config.row_share * 10_000)
    drawn = F.pmod(F.xxhash64(F.lit(config.seed), F.lit(number), "bins", "label"), F.lit(10_000)) < share
    schema = "cell long, g double, h double, n long"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(wanted) * width))
        loss = held = 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            y, margin = batch.column("label").to_numpy(), batch.column("margin").to_numpy().copy()
            times = batch.column("times").to_numpy()
            for t in late:
                margin += t.score(x)
            p = 1 / (1 + np.exp(-margin))
            out = batch.column("is_validation").to_numpy(zero_copy_only=False)
            q = np.clip(np.where(y > 0, p, 1 - p)[out], 1e-15, 1)
            loss, held = loss - (times[out] * np.log(q)).sum(), held + int(times[out].sum())
            use = np.flatnonzero(~out & batch.column("drawn").to_numpy(zero_copy_only=False))
            leaf = tree.leaf_of(x[use])
            place = np.full(len(tree.feature), -1)
            place[wanted] = [slot[w] for w in wanted]
            kept = place[leaf] >= 0
            use, at = use[kept], place[leaf[kept]]
            cells = (at[:, None] * width + np.arange(n_features) * bins + x[use]).ravel()
            for i, weights in enumerate((times * (p - y), times * p * (1 - p), times)):
                sums[i] += np.bincount(cells, np.repeat(weights[use], n_features), sums.shape[1])
        some = np.flatnonzero(sums[2])
        columns = [np.append(some, -1), np.append(sums[0, some], loss), np.append(sums[1, some], 0.0), np.append(sums[2, some], held).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "g", "h", "n"])

    rows = rows.withColumn("drawn", drawn)
    rows = rows if lossy else rows.filter("drawn and not is_validation")
    found = rows.mapInArrow(summed, schema).groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()
    cell, g, h, n = (c.to_numpy() for c in found.columns)
    sums = np.zeros((len(wanted) * width, 3))
    some = cell >= 0
    sums[cell[some]] = np.stack([g[some], h[some], n[some]], 1)
    sums = sums.reshape(len(wanted), n_features, bins, 3)
    return {leaf: sums[i] for leaf, i in slot.items()}, float(g[~some].sum()), int(n[~some].sum())


def _grown(rows: DataFrame, late: list[Tree], number: int, config: BoostConfig, n_features: int) -> tuple[Tree, float, int]:
    """One tree, with the loss and number of held-out rows before it."""
    draw = np.random.default_rng([config.seed, number])
    features = sorted(draw.choice(n_features, max(1, round(n_features * config.feature_share)), replace=False).tolist())
    explored, known, sums = Tree(), {}, {}
    loss, held = None, 0

    def grow(make: Tree | None) -> list[int]:
        """Best-first growth by what is known: the leaves whose histograms it lacks. make: a tree to be given the splits."""
        leaves, lacking, here = {0: 0}, [], 1
        while here < config.leaves:
            lacking = [n for n in leaves if n not in known]
            open_ = [(known[n][0], -n) for n in leaves if known.get(n)]
            if not open_:
                break
            node = -max(open_)[1]
            _, feature, cut = known[node]
            if explored.feature[node] < 0:
                explored.split(node, feature, cut)
            mine = leaves.pop(node)
            sides = make.split(mine, feature, cut) if make else (0, 0)
            leaves |= {explored.left[node]: sides[0], explored.right[node]: sides[1]}
            here += 1
        if make:
            for node, mine in leaves.items():
                g, h = sums[node]
                make.value[mine] = config.rate * leaf_value(g, h, config)
        return [n for n in leaves if n not in known] if not make else lacking

    while lacking := (grow(None) if known else [0]):
        histograms, lost, out = _pass(rows, late, explored, lacking, number, config, n_features, loss is None)
        if loss is None:
            loss, held = lost, out
        for node, histogram in histograms.items():
            sums[node] = tuple(histogram[0].sum(0)[:2])
            known[node] = best_split(histogram, config, features)
    tree = Tree()
    grow(tree)
    return tree, loss or 0.0, held


def train(df: DataFrame, config: BoostConfig | None = None, features: list[str] = FEATURES, **changes) -> Boosted:
    """Fit on label (0, 1); changes: fields of BoostConfig."""
    config = BoostConfig(**(asdict(config or BoostConfig()) | changes))
    require(df, [*features, "label"], "training rows")
    if not 2 <= config.bins <= 255:
        raise ValueError("bins must be 2 to 255")
    df = numeric(df, features).withColumn("is_validation", F.coalesce(F.col("is_validation").cast("boolean"), F.lit(False)) if "is_validation" in df.columns else F.lit(False))
    df = df.select(*features, F.col("label").cast("double").alias("label"), "is_validation")
    own = df.filter("not is_validation")
    cuts = own.approxQuantile(features, [i / config.bins for i in range(1, config.bins)], 1 / (4 * config.bins))
    model = Boosted(list(features), [sorted(set(c)) for c in cuts], 0.0, [])
    rate = own.agg(F.avg("label")).first()[0]
    if rate is None or not 0 < rate < 1:
        model.prior = 0.0 if rate is None else math.copysign(35.0, rate - 0.5)
        return model
    model.prior = math.log(rate / (1 - rate))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("label"), batch.column("is_validation")], ["bins", "label", "is_validation"])

    rows = df.mapInArrow(binned, "bins binary, label double, is_validation boolean").groupBy("bins", "label", "is_validation").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows.withColumn("margin", F.lit(model.prior)), "binned")
    n_features, late = len(features), []
    for number in range(config.trees):
        tree, loss, held = _grown(rows, late, number, config, n_features)
        if held:
            model.losses.append(loss / held)
            best = int(np.argmin(model.losses))
            if number - best >= config.patience:
                break
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        late.append(tree)
        if len(late) == REWRITE:
            rows, late = written(_moved(rows, late, n_features), "binned"), []
    if model.losses:
        model.trees = model.trees[: int(np.argmin(model.losses))] or model.trees[:1]
    return model


def _moved(rows: DataFrame, trees: list[Tree], n_features: int) -> DataFrame:
    """rows with what the trees say added to their margin."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            margin = batch.column("margin").to_numpy() + sum(t.score(x) for t in trees)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(moved, rows.schema)


def score(model: Boosted, df: DataFrame) -> DataFrame:
    """df with prediction_probability."""
    require(df, model.features, "rows to score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def probability(*columns: pa.Array) -> pa.Array:
        fitted = shared.value
        x = fitted.binned([c.to_numpy(zero_copy_only=False) for c in columns])
        margin = np.full(len(x), fitted.prior)
        for tree in fitted.trees:
            margin += tree.score(x)
        return pa.array(1 / (1 + np.exp(-margin)))

    inputs = [F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for f in model.features]
    return df.withColumn("prediction_probability", probability(*inputs))


def save(model: Boosted, path: str) -> None:
    """The model as one line of JSON text."""
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(path: str) -> Boosted:
    about = json.loads(SparkSession.active().read.text(path).first().value)
    return Boosted(**(about | {"trees": [Tree(**t) for t in about["trees"]]}))
