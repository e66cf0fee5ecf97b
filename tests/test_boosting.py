"""Second-order boosted trees against a greedy search in plain Python."""

import numpy as np
import pytest

from sproutscope.operators import boosting as bt
from sproutscope.operators import training as tr

NAMES = ["a", "b", "c"]
WHOLE = {"row_sample": 1.0, "feature_sample": 1.0, "seed": 3}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 5) * x[:, 2] + rng.normal(scale=3, size=400) > 11).astype(int)
    return x, y


def table(spark, x, y, models=(0,)):
    rows = [(m, i, int(y[i]), 1.5 if y[i] else 1.0, *map(float, x[i])) for m in models for i in range(len(y))]
    return spark.createDataFrame(rows, "model int, id long, label int, weight double, a double, b double, c double")


def greedy(x, g, h, depth, p):
    """(gain of the split here, value) by trying every split of every feature, then cutting back weak ones."""
    soft = lambda v: np.sign(v) * max(abs(v) - p["alpha"], 0)
    quality = lambda a, b: soft(a) ** 2 / (b + p["lambda"])
    leaf = {"value": -soft(g.sum()) / (h.sum() + p["lambda"]) * p["learning_rate"]}
    best = (1e-6, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) < p["min_leaf_weight"]:
                continue
            gain = quality(g[left].sum(), h[left].sum()) + quality(g[~left].sum(), h[~left].sum()) - quality(g.sum(), h.sum())
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[:, f] <= cut
    sides = greedy(x[left], g[left], h[left], depth - 1, p), greedy(x[~left], g[~left], h[~left], depth - 1, p)
    if all("gain" not in s for s in sides) and best[0] < p["min_gain"]:
        return leaf
    return {"gain": best[0], "feature": f, "cut": cut, "sides": sides}


def scores(node, x):
    if "gain" not in node:
        return np.full(len(x), node["value"])
    left = x[:, node["feature"]] <= node["cut"]
    out = np.empty(len(x))
    out[left], out[~left] = scores(node["sides"][0], x[left]), scores(node["sides"][1], x[~left])
    return out


def gains(node):
    return [] if "gain" not in node else [node["gain"], *gains(node["sides"][0]), *gains(node["sides"][1])]


@pytest.mark.parametrize("penalties", [{}, {"alpha": 2.0, "lambda": 5.0, "min_gain": 3.0}, {"min_leaf_weight": 12.0}])
def test_trees_equal_a_greedy_search(spark, data, penalties):
    x, y = data
    p = bt.settings(rounds=3, depth=3, **WHOLE, **penalties)
    model = bt.fit(table(spark, x, y), NAMES, **p)[0]
    margin, weight = np.zeros(len(y)), np.where(y == 1, 1.5, 1.0)
    for tree in model.trees:
        chance = 1 / (1 + np.exp(-margin))
        want = greedy(x, (chance - y) * weight, chance * (1 - chance) * weight, p["depth"], p)
        assert np.allclose(sorted(tree.gain[tree.feature >= 0]), sorted(gains(want)))
        margin += scores(want, x)
    assert np.allclose(model.margins(x), margin)


def test_spread_rows_give_the_same_trees(spark, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(bt, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bt, "REFRESH", 2)
    rows = table(spark, x, y, models=(0, 1)).where("model = 0 OR id % 3 != 0").repartition(5)
    settings = {"rounds": 3, "depth": 2, "row_sample": 0.7, "feature_sample": 0.7, "seed": 9}
    near, far = bt.fit(rows, NAMES, **settings), bt.fit(rows, NAMES, local_cells=0, **settings)
    for m in (0, 1):
        for a, b in zip(near[m].trees, far[m].trees, strict=True):
            assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.gain, b.gain) and np.allclose(a.value, b.value)


def test_models_can_be_saved_and_score(spark, data, tmp_path):
    x, y = data
    models = bt.fit(table(spark, x, y), NAMES, rounds=30, depth=3, **WHOLE)
    bt.save(spark, models, str(tmp_path / "m"))
    again = bt.load(spark, str(tmp_path / "m"))
    scored = bt.score(again, table(spark, x, y)).orderBy("id").toPandas()
    assert np.allclose(scored["score"], 1 / (1 + np.exp(-models[0].margins(x))))
    assert (scored["prediction"] == y).mean() > 0.85
    importances = models[0].importances()
    assert abs(sum(importances.values()) - 1) < 1e-9 and min(importances.values()) >= 0


def test_a_constant_label_or_feature_gives_leaves_only(spark):
    x, y = np.ones((30, 3)), np.arange(30) % 2
    model = bt.fit(table(spark, x, y), NAMES, rounds=2)[0]
    assert all((t.feature == -1).all() for t in model.trees)
    assert sum(model.importances().values()) == 0


def test_folds_at_once(spark, data):
    x, y = data
    rows = table(spark, x, y).selectExpr("concat('r', id) AS repo_name", "label", *NAMES)
    found = tr.cv_boost(rows, NAMES, k=3, rounds=20, depth=3)
    assert found.scored.count() == len(y) and found.auc.first().mean_auc > 0.8
    per_fold = found.importances.groupBy("fold").sum("importance").collect()
    assert len(per_fold) == 3 and all(abs(r[1] - 1) < 1e-9 for r in per_fold)
    again = tr.cv_boost(rows, NAMES, k=3, rounds=20, depth=3)
    assert sorted(map(tuple, again.scored.collect())) == sorted(map(tuple, found.scored.collect()))


def test_rows_in_pieces_give_the_same_trees(data, monkeypatch):
    """A level is a pass over pieces; splits that were cut back leave their rows with the leaf above."""
    x, y = data
    bins, ids, weight = x.astype(np.uint8), np.arange(len(y)), np.where(y == 1, 1.5, 1.0)
    p = bt.settings(rounds=6, depth=4, min_gain=2.0, seed=4)
    whole = bt.grow(bins, ids, y.astype(float), weight, p, 12)
    monkeypatch.setattr(bt, "PIECE_ROWS", 37)
    pieces = bt.grow(bins, ids, y.astype(float), weight, p, 12)
    margin = np.zeros(len(y))
    for a, b in zip(whole, pieces, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
        for row in range(len(y)):
            at = 0
            while a.feature[at] >= 0:
                at = 2 * at + 1 + int(bins[row, a.feature[at]] > a.bin[at])
            margin[row] += a.value[at]
    cuts = [np.arange(11.0)] * 3
    assert np.allclose(bt.Boosted(NAMES, cuts, whole).margins(x), margin)


def test_models_never_share_a_task(spark, data):
    x, y = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = table(spark, x, y, models=range(4))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.sparkContext.setJobGroup("fit", "models")
    try:
        found = bt.fit(rows, NAMES, rounds=2, depth=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    assert sorted(found) == [0, 1, 2, 3]
    # quantiles, sizes and binned rows take jobs too
    assert len(tracker.getJobIdsForGroup("fit")) >= 4 + 3
