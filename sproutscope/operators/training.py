"""Splits, folds and the cross-validated boosted-tree classifier."""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.operators import boosting
from sproutscope.operators.evaluation import auc_spread, class_report, fold_auc
from sproutscope.operators.smote import smote
from sproutscope.session import concurrently, stage

FOLD_BUCKETS = 1024


def split(
    df: DataFrame, key: str = "repo_name", test: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by a hash of the key; a repository always falls on the same side."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key)))
    in_test = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 < int(round(test * 10_000))
    return df.where(~in_test), df.where(in_test)


def numbered(df: DataFrame, key: str, by: str, seed: int = 42, name: str = "_number") -> DataFrame:
    """Rows of each ``by`` value numbered 0, 1, ... in a seeded random order.

    Equal to a row number over one window per ``by`` value, but taken in hash buckets whose
    sizes are added up, so a class with most of the rows stays spread over many tasks.
    ``key`` is unique.
    """
    mixed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))).withColumn(
        "_bucket", F.pmod(F.col("_hash"), F.lit(FOLD_BUCKETS))
    )
    ahead = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        mixed.groupBy(by, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .select(by, "_bucket", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    )
    inside = Window.partitionBy(by, "_bucket").orderBy("_hash", key)
    # bounded: buckets times the number of ``by`` values
    return (
        mixed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), [by, "_bucket"])
        .withColumn(name, F.col("_ahead") + F.col("_inside") - 1)
        .drop("_hash", "_bucket", "_inside", "_ahead")
    )


def stratified_folds(
    df: DataFrame, key: str = "repo_name", label: str = "label", k: int = 5, seed: int = 42
) -> DataFrame:
    """Adds ``fold`` 0..k-1; class sizes differ by at most one row between folds."""
    return (
        numbered(df, key, label, seed)
        .withColumn("fold", (F.col("_number") % k).cast("int"))
        .drop("_number")
    )


def class_ratio(df: DataFrame, label: str = "label") -> float:
    """Negatives per positive."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    return row["neg"] / row["pos"] if row["pos"] else 1.0


def assemble_vectors(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """``(features, label, weight)`` plus key columns; the weight is set at training time."""
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return vectors.transform(df.withColumn(label, F.col(label).cast("double")))


def booster(rows: int, seed: int = 42, **overrides) -> GBTClassifier:
    """Boosted trees with the study's settings.

    The minimum gain of the study is a total over rows, hence the division. There are no
    L1/L2 penalties on leaf values in this learner.
    """
    p = {**S.BOOSTER_DEFAULTS, **overrides}
    return GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=p["rounds"],
        maxDepth=p["depth"],
        stepSize=p["learning_rate"],
        subsamplingRate=p["row_sample"],
        featureSubsetStrategy=str(p["feature_sample"]),
        minInstancesPerNode=p["min_leaf_rows"],
        minInfoGain=p["min_gain"] / max(1, rows),
        seed=seed,
    )


def train(
    df: DataFrame, features: list[str], label: str = "label", ratio: float | None = None, **overrides
) -> GBTClassificationModel:
    """Fit on named feature columns; positives weigh ``ratio`` (default: negatives per positive)."""
    ratio = class_ratio(df, label) if ratio is None else ratio
    ready = df.select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")
    )
    vectors = assemble_vectors(ready, features).withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0))
    )
    vectors = stage(vectors.select("features", "label", "weight"), "training")
    return booster(vectors.count(), **overrides).fit(vectors)


def score(model: GBTClassificationModel, df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Adds ``score`` (probability of the positive class) and ``prediction``."""
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability")


@dataclass(frozen=True)
class CrossValidation:
    scored: DataFrame
    importances: DataFrame

    @property
    def fold_auc(self) -> DataFrame:
        return fold_auc(self.scored)

    @property
    def auc(self) -> DataFrame:
        return auc_spread(self.fold_auc)

    @property
    def report(self) -> DataFrame:
        return class_report(self.scored)


def cv_train(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    key: str = "repo_name",
    k: int = 5,
    seed: int = 42,
    neighbours: int = 5,
    **overrides,
) -> CrossValidation:
    """Stratified cross-validation with minority oversampling inside each training part.

    Positives keep the class ratio of the full data as weight on top of the oversampling.
    """
    ready = df.select(
        key, F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    folded = stage(stratified_folds(ready, key, "label", k, seed), "folds")
    ratio = class_ratio(folded)
    parts, weights = [], []
    for fold in range(k):
        enlarged = smote(folded.where(F.col("fold") != fold), features, k=neighbours, seed=seed)
        model = train(enlarged, features, ratio=ratio, seed=seed, **overrides)
        held_out = folded.where(F.col("fold") == fold)
        parts.append(score(model, held_out, features).select(key, "fold", "label", "score", "prediction"))
        weights += [
            (fold, f, float(v)) for f, v in zip(features, model.featureImportances.toArray())
        ]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    importances = df.sparkSession.createDataFrame(weights, "fold int, feature string, importance double")
    return CrossValidation(stage(scored, "scored"), importances)


def cv_boost(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    key: str = "repo_name",
    k: int = 5,
    seed: int = 42,
    neighbours: int = 5,
    **overrides,
) -> CrossValidation:
    """:func:`cv_train` with the second-order learner and its penalties, all folds at once.

    The training parts are oversampled by concurrent jobs; then one table holds them all and the
    models of the folds grow together.
    """
    ready = df.select(
        key, F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    folded = stage(stratified_folds(ready, key, "label", k, seed), "folds")
    ratio = class_ratio(folded)

    def enlarged(fold: int) -> DataFrame:
        rows = smote(folded.where(F.col("fold") != fold), features, k=neighbours, seed=seed)
        return stage(rows.select(F.lit(fold).alias("model"), "label", *features), "enlarged")

    parts = concurrently(df.sparkSession, enlarged, range(k))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumns(
        {
            "id": F.xxhash64(*features, F.monotonically_increasing_id()),
            "weight": F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)),
        }
    )
    models = boosting.fit(rows, features, seed=seed, **overrides)
    scored = boosting.score(models, folded.withColumn("model", F.col("fold"))).select(key, "fold", "label", "score", "prediction")
    weights = [(m, f, float(v)) for m, b in sorted(models.items()) for f, v in b.importances().items()]
    importances = df.sparkSession.createDataFrame(weights, "fold int, feature string, importance double")
    return CrossValidation(stage(scored, "scored"), importances)


def mean_importance(importances: DataFrame, top: int = 15) -> DataFrame:
    """Mean importance over the folds, the largest first."""
    return (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top)
    )


def compare_importance(fork: DataFrame, nonfork: DataFrame) -> DataFrame:
    """Two importance tables side by side, by feature."""
    left = fork.select("feature", F.col("importance").alias("fork_importance"))
    right = nonfork.select("feature", F.col("importance").alias("nonfork_importance"))
    return left.join(right, "feature", "full")


def save_model(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)
