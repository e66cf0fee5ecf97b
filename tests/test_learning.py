import numpy as np
import pytest
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.operators import explain as ex
from sproutscope.operators import prep
from sproutscope.operators import smote as sm
from sproutscope.operators import training as tr


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)).round(2)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=600) > 1.2).astype(int)
    data = [(f"r{i}", int(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(data, "repo_name string, label int, a double, b double, c double")


def _recall(spark, points, k, **sizes):
    """Share of the true distances that are found; every distance given must be a true one."""
    df = spark.createDataFrame([(list(map(float, p)), 1) for p in points], "vec array<double>, copies long")
    got = {tuple(r.vec): r.near for r in sm.nearest(df, points.shape[1], k, **sizes).collect()}
    assert len(got) == len(points)
    right = 0
    for p in points:
        apart = np.sort(np.sqrt(((points - p) ** 2).sum(axis=1)))[1 : k + 1]
        near = got[tuple(map(float, p))]
        assert len(near) == len(apart) and all(np.isclose(n.distance, np.sqrt(((p - np.array(n.near_vec)) ** 2).sum())) for n in near)
        right += sum(n.distance <= apart[-1] * (1 + 1e-9) for n in near)
    return right / (len(points) * k)


def test_nearest_is_exact_up_to_a_window(spark):
    points = np.random.default_rng(8).normal(size=(300, 4)).round(3)
    assert _recall(spark, points, 5) == 1.0
    assert _recall(spark, points[:3], 2) == 1.0


@pytest.mark.parametrize("kind", ["normal", "sphere", "clusters", "skewed"])
def test_nearest_finds_nine_in_ten_beyond_a_window(spark, kind):
    rng = np.random.default_rng(3)
    points = {
        "normal": lambda: rng.normal(size=(3000, 8)),
        "sphere": lambda: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(3000, 6))),  # one distance to the centre
        "clusters": lambda: rng.normal(size=(30, 12)).repeat(100, axis=0) * 10 + rng.normal(size=(3000, 12)),
        "skewed": lambda: rng.lognormal(sigma=2, size=(3000, 6)),  # most vectors share a code
    }[kind]()
    assert _recall(spark, points, 5, window=128) >= 0.9


def test_candidates_of_a_vector_are_bounded(spark):
    """Vectors that share all bits stay in windows, so lists grow with the tables alone."""
    points = np.concatenate([np.full((900, 2), 5.0) + np.arange(900)[:, None] * 1e-6, [[-1e6, -1e6]]])
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "id long, vec array<double>")
    laid = sm._laid_out(df, 2, 3, 4, 1).repartitionByRange(2, "table", "code", "along").sortWithinPartitions("table", "code", "along")
    sizes = sm._in_windows(laid, 5, 64).groupBy("id").agg(F.sum(F.size("others")).alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 2 * 3 * 5


def test_smote_balances_and_interpolates(rows):
    out = sm.smote(rows, ["a", "b", "c"], k=5)
    sizes = {(r.label, r.synthetic): r["count"] for r in out.groupBy("label", "synthetic").count().collect()}
    assert sizes[(0, False)] == sizes[(1, False)] + sizes[(1, True)]
    minority = np.array([r[:3] for r in rows.where("label = 1").select("a", "b", "c").collect()])
    made = np.array([r[:3] for r in out.where("synthetic").select("a", "b", "c").collect()])
    assert (made >= minority.min(axis=0) - 1e-9).all() and (made <= minority.max(axis=0) + 1e-9).all()
    again = sorted(map(tuple, sm.smote(rows, ["a", "b", "c"], k=5).where("synthetic").collect()))
    assert again == sorted(map(tuple, out.where("synthetic").collect()))


def test_smote_with_copies(spark):
    data = [(0, float(i)) for i in range(50)] + [(1, 1.0)] * 9 + [(1, 2.0), (1, 4.0)]
    df = spark.createDataFrame(data, "label int, a double")
    out = sm.smote(df, ["a"], k=3)
    assert out.where("label = 1").count() == 50
    # nine equal rows are each other's neighbours: they give only copies of themselves
    values = [r.a for r in out.where("synthetic").collect()]
    assert min(values) == 1.0 and max(values) <= 4.0
    assert sum(v == 1.0 for v in values) >= 27


def test_smote_without_enough_minority(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0)], "label int, a double")
    assert sm.smote(df, ["a"]).count() == 3


def test_folds_are_stratified(rows):
    folded = tr.stratified_folds(rows)
    sizes = {}
    for r in folded.groupBy("label", "fold").count().collect():
        sizes.setdefault(r.label, []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())
    assert folded.count() == rows.count() == folded.select("repo_name").distinct().count()


def test_split_is_disjoint_and_complete(rows):
    train, test = tr.split(rows)
    assert train.count() + test.count() == rows.count()
    assert train.join(test, "repo_name", "left_semi").count() == 0
    assert 0.1 < test.count() / rows.count() < 0.3


def test_cross_validation_and_model(spark, rows, tmp_path):
    found = tr.cv_train(rows, ["a", "b", "c"], k=2, rounds=4, depth=3)
    assert found.scored.count() == rows.count()
    assert found.auc.first().mean_auc > 0.8
    assert {r["class"] for r in found.report.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    best = tr.mean_importance(found.importances, 2).collect()
    assert best[0].feature == "a" and len(best) == 2
    model = tr.train(rows, ["a", "b", "c"], rounds=3, depth=2)
    tr.save_model(model, str(tmp_path / "model"))
    from pyspark.ml.classification import GBTClassificationModel

    again = GBTClassificationModel.load(str(tmp_path / "model"))
    assert again.getNumTrees == 3


def test_explanations_find_the_driver(rows):
    model = tr.train(rows, ["a", "b", "c"], rounds=5, depth=3)
    chosen = ex.sample_rows(rows, "repo_name", 6)
    weights = ex.explain_local(model, rows, chosen, ["a", "b", "c"], n_samples=300, n_features=3)
    assert weights.count() == 18
    again = ex.explain_local(model, rows, chosen, ["a", "b", "c"], n_samples=300, n_features=3)
    assert sorted(map(tuple, weights.collect())) == sorted(map(tuple, again.collect()))
    summary = ex.explain_summary(weights).collect()
    assert summary[0].feature == "a"
    assert sum(r.mean_abs * r["count"] for r in summary) == pytest.approx(6.0)


def test_preparation_of_the_dataset(spark):
    names = ["repo_name", "is_sustainable", "total_commits", "avg_pr_first_response_hrs", "has_license", "primary_language", "parent_language", "divergence_ratio", "topics"]
    data = [
        ("a", 1, 3, 2.0, True, "Go", "C", 0.5, "x"),
        ("b", 0, None, 4.0, None, None, "C", None, "y"),
        ("c", 0, 5, None, False, "Ada", None, 0.1, "z"),
    ]
    df = spark.createDataFrame(data, "repo_name string, is_sustainable int, total_commits long, avg_pr_first_response_hrs double, has_license boolean, primary_language string, parent_language string, divergence_ratio double, topics string")
    assert df.columns == names
    boosted = {r.repo_name: r for r in prep.boosted_features(df, "fork").collect()}
    assert boosted["c"].avg_pr_first_response_hrs == 6.0
    assert boosted["b"].total_commits == 0 and boosted["b"].has_license == 2  # False, True, null
    assert [boosted[k].primary_language for k in "abc"] == [1, 2, 0]
    assert "topics" not in boosted["a"].asDict()
    assert "divergence_ratio" not in prep.boosted_features(df, "nonfork").columns
    dummies = prep.dummy_features(df, "fork")
    assert "primary_language_Go" in dummies.columns and "primary_language_Ada" not in dummies.columns
    assert "has_license_true" in dummies.columns
    filled = {r.repo_name: r for r in dummies.collect()}
    assert filled["b"].total_commits == 4.0
    with pytest.raises(ValueError):
        prep.feature_columns(df, "other")
    assert set(S.FORK_ONLY_FEATURES) >= {"divergence_ratio", "parent_language"}


def test_one_hot_against_counts(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, None)], "id int, v string")
    out = prep.one_hot(df, ["v"])
    assert out.columns == ["id", "v_b", "v_c"]
    assert out.agg(F.sum("v_b"), F.sum("v_c")).first() == (2, 1)


def test_many_categories_are_ranked(spark):
    df = spark.range(12_000).select("id", F.col("id").cast("string").alias("v"))
    codes = {r.v: r.id for r in prep.label_encode(df.withColumn("id", F.col("v")), ["id"]).collect()}
    assert [codes[v] for v in sorted(codes)] == list(range(12_000))


def test_too_many_dummies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(prep, "MOST_DUMMIES", 3)
    df = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "id int, v string")
    with pytest.raises(ValueError, match="one_hot_vectors"):
        prep.one_hot(df, ["v"])
    assert prep.one_hot(df.where("id < 4"), ["v"]).columns == ["id", "v_v1", "v_v2", "v_v3"]
