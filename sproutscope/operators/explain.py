"""Local surrogate explanations of single predictions, and their aggregation.

Every explained row gets its own perturbed rows, one model pass scores them all, and a
weighted linear fit per row turns the scores into feature weights. The rows are spread
over tasks; a group never holds more than the perturbations of one row.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.functions.scalars import feature_of_condition, safe_ratio


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a seeded hash of the key; every task keeps at most ``n``."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def _rules(background: np.ndarray, features: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
    """Quartile cuts per feature and the text of every resulting interval."""
    cuts, texts = [], []
    for column, name in enumerate(features):
        edges = np.unique(np.percentile(background[:, column], [25, 50, 75]))
        labels = [f"{name} <= {edges[0]:.2f}"]
        labels += [f"{a:.2f} < {name} <= {b:.2f}" for a, b in zip(edges[:-1], edges[1:])]
        labels.append(f"{name} > {edges[-1]:.2f}")
        cuts.append(edges)
        texts.append(labels)
    return cuts, texts


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients of a weighted ridge regression with a free intercept."""
    share = w / w.sum()
    x0, y0 = share @ x, share @ y
    xc, yc = x - x0, y - y0
    gram = (xc * w[:, None]).T @ xc + penalty * np.eye(x.shape[1])
    return np.linalg.solve(gram, (xc * w[:, None]).T @ yc)


def explain_local(
    model,
    background: DataFrame,
    rows: DataFrame,
    features: list[str],
    key: str = "repo_name",
    n_background: int = 1000,
    n_samples: int = 1000,
    n_features: int = 20,
    seed: int = 42,
) -> DataFrame:
    """``(instance, feature, weight)``: the strongest interval rules for each row.

    Perturbed values are drawn per feature from the background sample; a rule is kept when
    the drawn value falls into the same quartile interval as the row's. Draws depend only
    on the seed and the key.
    """
    sample = sample_rows(background, key, n_background, seed).select(*features)
    # bounded: the background sample
    table = np.array([[float(v) for v in row] for row in sample.collect()])
    cuts, texts = _rules(table, features)
    width = 0.75 * np.sqrt(len(features))

    def intervals(values: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(cuts)], axis=1
        )

    def perturb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for instance, mixed, origin in zip(batch.instance, batch.mixed, batch.origin):
                origin = np.asarray(origin, dtype="float64")
                random = np.random.default_rng(abs(int(mixed)))
                picks = random.integers(0, len(table), size=(n_samples - 1, len(features)))
                drawn = table[picks, np.arange(len(features))]
                values = np.vstack([origin, drawn])
                same = (intervals(values) == intervals(origin[None, :])).astype("int8")
                yield pd.DataFrame(
                    {"instance": instance, "same": list(same), "vector": list(values), "origin": [origin] * n_samples}
                )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        same = np.stack(group["same"].to_numpy()).astype("float64")
        y = group["score"].to_numpy()
        distance = np.sqrt(((same - 1.0) ** 2).sum(axis=1))
        weight = np.sqrt(np.exp(-(distance**2) / width**2))
        strength = np.abs(_ridge(same, y, weight, penalty=0.01))
        chosen = np.argsort(-strength, kind="stable")[:n_features]
        coefficients = _ridge(same[:, chosen], y, weight, penalty=1.0)
        origin = np.asarray(group["origin"].iloc[0], dtype="float64")
        inside = intervals(origin[None, :])[0]
        return pd.DataFrame(
            {
                "instance": group["instance"].iloc[0],
                "feature": [texts[i][inside[i]] for i in chosen],
                "weight": coefficients,
            }
        )

    # a key that is repeated is explained once, by the least of its rows
    instances = rows.select(
        F.col(key).cast("string").alias("instance"),
        F.xxhash64(F.col(key), F.lit(seed)).alias("mixed"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("origin"),
    ).groupBy("instance", "mixed").agg(F.min("origin").alias("origin"))
    # a drawn sample sits in one partition; scoring it should not
    spread = instances.repartition(instances.sparkSession.sparkContext.defaultParallelism, "instance")
    perturbed = spread.mapInPandas(
        perturb, "instance string, same array<byte>, vector array<double>, origin array<double>"
    )
    scored = model.transform(perturbed.withColumn("features", array_to_vector("vector"))).select(
        "instance", "same", "origin", vector_to_array("probability")[1].alias("score")
    )
    return scored.groupBy("instance").applyInPandas(fit, "instance string, feature string, weight double")


def explain_summary(
    weights: DataFrame, instance: str = "instance", feature: str = "feature", weight: str = "weight"
) -> DataFrame:
    """Per feature: mean signed and mean absolute share of an instance's total weight,
    share of positive weights, and count; the strongest first."""
    whole = Window.partitionBy(instance)
    total = F.sum(F.abs(F.col(weight))).over(whole)
    shares = weights.select(
        feature_of_condition(F.col(feature)).alias("feature"),
        F.coalesce(safe_ratio(F.col(weight), total), F.lit(0.0)).alias("share"),
        (F.col(weight) > 0).cast("int").alias("positive"),
    )
    return (
        shares.groupBy("feature")
        .agg(
            F.avg("share").alias("mean_signed"),
            F.avg(F.abs("share")).alias("mean_abs"),
            F.avg("positive").alias("pos_ratio"),
            F.count("*").alias("count"),
        )
        .orderBy(F.col("mean_abs").desc(), "feature")
    )
