"""The analyses on the labelled dataset, each as a set of result tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.operators import evaluation, explain, prep, stats, training
from sproutscope.session import stage


def divergence_analysis(dataset: DataFrame) -> dict[str, DataFrame]:
    """How far a fork's divergence from its parent goes with its survival."""
    measure = "divergence_ratio"
    known = dataset.where(F.col(measure).isNotNull())
    return {
        "coverage": stats.feature_coverage(dataset, measure),
        "groups": stats.group_stats(known),
        "classes": stats.class_summary(known, measure),
        "mann_whitney": stats.mann_whitney(known, measure),
        "point_biserial": stats.point_biserial(known, measure),
        "simple_logit": stats.balanced_logit(known, [measure]),
        "controlled_logit": stats.logit_with_controls(known),
    }


def _features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("repo_name", "is_sustainable")]


def cross_validated(dataset: DataFrame, cohort: str, **overrides) -> training.CrossValidation:
    """Cross-validated booster, by default at the study's settings, over the encoded features of one cohort."""
    ready = stage(prep.boosted_features(dataset, cohort), "features")
    return training.cv_boost(ready, _features(ready), label="is_sustainable", **overrides)


def compare_cohorts(forks: DataFrame, nonforks: DataFrame, top: int = 15, **overrides) -> dict[str, DataFrame]:
    """AUC, report and strongest features of both cohorts, and the features side by side."""
    results = {}
    for name, dataset in (("fork", forks), ("nonfork", nonforks)):
        run = cross_validated(dataset, name, **overrides)
        results[f"{name}_auc"] = run.auc
        results[f"{name}_report"] = run.report
        results[f"{name}_importance"] = training.mean_importance(run.importances, top)
    results["importance"] = training.compare_importance(
        results["fork_importance"], results["nonfork_importance"]
    )
    return results


def single_split(dataset: DataFrame, cohort: str, seed: int = 42, **overrides):
    """``(model, features, train, scored test)`` over dummy features."""
    ready = stage(prep.dummy_features(dataset, cohort), "features")
    features = _features(ready)
    train_part, test_part = training.split(ready, seed=seed)
    settings = {**S.PLAIN_BOOSTER, **overrides}
    model = training.train(train_part, features, label="is_sustainable", seed=seed, **settings)
    return model, features, ready, training.score(model, test_part, features)


def threshold_analysis(dataset: DataFrame, cohort: str = "fork", **overrides) -> dict[str, DataFrame]:
    """AUC, fixed thresholds and the best F1 threshold on the held-out part."""
    _model, _features_used, _ready, scored = single_split(dataset, cohort, **overrides)
    scored = stage(scored.select("is_sustainable", "score"), "scored")
    return {
        "auc": evaluation.auc(scored, "is_sustainable"),
        "thresholds": evaluation.threshold_table(scored, label="is_sustainable"),
        "best_f1": evaluation.best_f1_threshold(scored, "is_sustainable"),
    }


def explanation_analysis(
    dataset: DataFrame, cohort: str = "fork", instances: int = 100, n_samples: int = 1000, **overrides
) -> DataFrame:
    """Which features drive single predictions, over a sample of held-out repositories."""
    model, features, ready, scored = single_split(dataset, cohort, **overrides)
    chosen = explain.sample_rows(scored, "repo_name", instances)
    return explain.explain_summary(
        explain.explain_local(model, ready, chosen, features, n_samples=n_samples)
    )
