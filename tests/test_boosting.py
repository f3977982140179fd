import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import boosting, model
from kindred.operators.boosting import BoostConfig, Tree


def brute_force_tree(rows, margins, config):
    """Best-first growth over lists of rows: every cut of every leaf is tried anew at every split."""
    grads = [(1 / (1 + math.exp(-m)) - y, 1 / (1 + math.exp(-m)) * (1 - 1 / (1 + math.exp(-m)))) for m, (_, y) in zip(margins, rows, strict=True)]
    shrink = lambda g: math.copysign(max(0.0, abs(g) - config.l1), g)
    sums = lambda ids: (sum(grads[i][0] for i in ids), sum(grads[i][1] for i in ids))
    worth = lambda ids: shrink(sums(ids)[0]) ** 2 / (sums(ids)[1] + config.l2)
    leaves = [list(range(len(rows)))]
    while len(leaves) < config.leaves:
        best = None
        for k, ids in enumerate(leaves):
            for f in range(len(rows[0][0])):
                for cut in sorted({rows[i][0][f] for i in ids}):
                    low, high = [i for i in ids if rows[i][0][f] <= cut], [i for i in ids if rows[i][0][f] > cut]
                    if min(len(low), len(high)) < config.min_rows:
                        continue
                    gain = worth(low) + worth(high) - worth(ids)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, k, low, high)
        if best is None:
            break
        leaves[best[1] : best[1] + 1] = [best[2], best[3]]
    out = [0.0] * len(rows)
    for ids in leaves:
        for i in ids:
            g, h = sums(ids)
            out[i] = -config.rate * shrink(g) / (h + config.l2)
    return out, len(leaves)


def test_trees_equal_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        x = (draw.randrange(9), draw.randrange(7), draw.randrange(5))
        rows.append((x, int(x[0] + 2 * (x[1] > 3) * x[2] + draw.gauss(0, 2) > 6)))
    df = spark.createDataFrame([(*map(float, x), y) for x, y in rows], "a double, b double, c double, label int")
    config = BoostConfig(trees=3, leaves=6, rate=0.3, min_rows=11, l1=0.4, l2=2.0, row_share=1.0, feature_share=1.0)
    fitted = boosting.train(df, config, ["a", "b", "c"])
    share = sum(y for _, y in rows) / len(rows)
    margins = [math.log(share / (1 - share))] * len(rows)
    for tree in fitted.trees:
        step, leaves = brute_force_tree(rows, margins, config)
        assert sum(f < 0 for f in tree.feature) == leaves == 6
        got = tree.score(fitted.binned([[x[i] for x, _ in rows] for i in range(3)]))
        assert max(abs(a - b) for a, b in zip(got, step, strict=True)) < 1e-9
        margins = [m + s for m, s in zip(margins, step, strict=True)]
    scored = boosting.score(fitted, df).select("a", "b", "c", "prediction_probability").collect()
    want = {x: 1 / (1 + math.exp(-m)) for (x, _), m in zip(rows, margins, strict=True)}
    assert all(abs(r[3] - want[tuple(map(int, r[:3]))]) < 1e-9 for r in scored)
    assert boosting.load(boosting.save(fitted, path := f"/tmp/kindred-model-{random.random()}") or path) == fitted


def test_equal_rows_are_fitted_as_one_that_counts_as_many(spark, monkeypatch):
    """Fifty copies of a table are no more work than the table, and give its trees if the limits are fifty times theirs."""
    sizes, write = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda df, name: sizes.append((out := write(df, name)).count()) or out)
    draw = random.Random(4)
    rows = [(float(draw.randrange(6)), float(draw.randrange(5)), i % 4 == 0) for i in range(300)]
    rows = [(a, b, int(a + b + draw.gauss(0, 1.5) > 5), v) for a, b, v in rows]
    schema, names = "a double, b double, label int, is_validation boolean", ["a", "b"]
    config = BoostConfig(trees=12, leaves=5, rate=0.3, min_rows=5, min_hessian=1e-3, l1=0.2, l2=1.0, row_share=0.7, feature_share=1.0)
    once = boosting.train(spark.createDataFrame(rows, schema), config, names)
    scaled = {k: 50 * getattr(config, k) for k in ("min_rows", "min_hessian", "l1", "l2")}
    many = boosting.train(spark.createDataFrame(rows * 50, schema), config, names, **scaled)
    assert len(many.trees) == len(once.trees) > 3 and max(sizes) <= len(set(rows))
    for one, fifty in zip(once.trees, many.trees, strict=True):
        assert (one.feature, one.cut) == (fifty.feature, fifty.cut) and one.value == pytest.approx(fifty.value, abs=1e-9)
    assert many.losses == pytest.approx(once.losses, abs=1e-9)


def test_no_worse_than_level_wise_trees(spark):
    df = spark.range(4000).withColumn("r", F.rand(5))
    df = df.select(*[F.rand(i).alias(name) for i, name in enumerate(model.FEATURES)], "r")
    signal = sum((F.col(c) for c in model.FEATURES[:4]), F.lit(0.0)) + 2 * F.col(model.FEATURES[5]) * F.col(model.FEATURES[6])
    df = df.withColumn("label", (signal + F.randn(9) * 0.3 > 2.5).cast("int")).withColumn("is_validation", F.col("r") < 0.3).cache()
    fitted = boosting.train(df, trees=12, rate=0.2, min_rows=20, leaves=15, patience=5)
    assert fitted.losses[-1] < 0.9 * fitted.losses[0]
    held = df.filter("is_validation")
    ours = model.roc_auc(boosting.score(fitted, held)).first()[0]
    theirs = model.roc_auc(model.score(model.train(df, trees=12, rate=0.2, min_rows=20, depth=4), held)).first()[0]
    assert ours >= theirs, (ours, theirs)
    assert abs(sum(share for _, share in fitted.importances()) - 1) < 1e-9


def test_edges(spark):
    schema = "a string, label int, is_validation boolean"
    one = boosting.train(spark.createDataFrame([("x", 1, None), (None, 1, False)], schema), features=["a"])
    assert one.trees == [] and boosting.score(one, spark.createDataFrame([("y",)], "a string")).first()["prediction_probability"] > 0.99
    assert boosting.train(spark.createDataFrame([], schema), features=["a"]).trees == []
    with pytest.raises(ValueError):
        boosting.train(spark.createDataFrame([(1,)], "label int"))
    assert Tree().score(one.binned([[0.0, 1.0]])).tolist() == [0.0, 0.0]
