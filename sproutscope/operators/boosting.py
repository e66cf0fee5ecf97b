"""Second-order boosted trees with penalties on leaves, for several models (folds) at once.

Features are cut into quantile bins once. A tree grows level by level from sums of gradients and
curvatures per (node, feature, bin); the gain of a split and the value of a leaf take the penalties
``alpha`` (absolute) and ``lambda`` (squared), a leaf needs ``min_leaf_weight`` of curvature, and splits
with a gain under ``min_gain`` are cut back from the leaves. Rows are drawn per tree by hash, features by
seed, so runs agree.

All models grow together. Where a model's binned rows were counted to fit in a task, each model is one task.
Beyond that the rows stay spread over the cluster: each level is one aggregation of the tasks' sums for
all models, only the chosen splits come to the driver, and rows keep their scores in a table that is
written anew every ``REFRESH`` trees. Both ways use the same sums and give the same trees.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.session import concurrently, stage

BINS = 64
#: Binned values of one model that a task may hold.
LOCAL_CELLS = 64_000_000
BLOCK_ROWS = 1 << 15
#: Rows of a model that are worked on at once in a task.
PIECE_ROWS = 1 << 17
#: Trees after which the scores of spread rows are written anew.
REFRESH = 20
#: Less than any gain worth a split.
LEAST_GAIN = 1e-6


def settings(**overrides) -> dict:
    return {**S.BOOSTER_DEFAULTS, **S.BOOSTER_PENALTIES, **overrides}


# --- trees ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes of a whole binary tree, children of ``i`` at ``2i+1`` and ``2i+2``; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row comes to after so many levels; it stays at a leaf. ``bins`` has a row per feature."""
        at = self.roots(bins.shape[1])
        for level in range(levels):
            at = descend(step(self, level), bins, at)
        return at

    def roots(self, rows: int) -> np.ndarray:
        return np.zeros(rows, dtype=np.uint8 if len(self.feature) <= 256 else np.int64)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value.take(self.places(bins, int(np.log2(len(self.feature) + 1)) - 1), mode="clip")


def softened(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def quality(g, h, p: dict):
    """What a leaf with these sums takes off the loss, twice over."""
    return softened(g, p["alpha"]) ** 2 / (h + p["lambda"])


def leaf_value(g, h, p: dict):
    return -softened(g, p["alpha"]) / (h + p["lambda"]) * p["learning_rate"]


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss."""
    chance = 1 / (1 + np.exp(-margin))
    return (chance - label) * weight, np.maximum(chance * (1 - chance), 1e-16) * weight


def drawn(ids: np.ndarray, tree: int, p: dict) -> np.ndarray:
    """Which rows a tree is grown on, by a hash of row and tree."""
    if p["row_sample"] >= 1:
        return np.ones(len(ids), dtype=bool)
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + p.get("seed", 42)) & 0xFFFFFFFFFFFFFFFF)
        for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27), (1, 31)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < p["row_sample"]


def features_of(tree: int, n: int, p: dict) -> np.ndarray:
    """The features that a tree may split by."""
    k = max(1, int(p["feature_sample"] * n))
    return np.sort(np.random.default_rng([p.get("seed", 42), tree]).choice(n, k, replace=False)) if k < n else np.arange(n)


def sums(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, n_bins: int, wanted=None) -> np.ndarray:
    """(node of the level, feature, bin, [g, h]): sums over rows; ``at`` are places in the tree.

    ``bins`` has a row per feature. Features that aren't ``wanted`` stay 0.
    """
    first, width = 2**level - 1, len(bins)
    out = np.zeros((first + 1, width, n_bins, 2))
    # rows that stayed at a leaf above go to one more node that is left out
    start = np.full(2 * first + 1, (first + 1) * n_bins)
    start[first:] = np.arange(first + 1) * n_bins
    base, cell = start.take(at, mode="clip"), np.empty(len(at), dtype=np.int64)
    for f in range(width) if wanted is None else wanted:
        np.add(base, bins[f], out=cell)
        for k, x in enumerate((g, h)):
            out[:, f, :, k] = np.bincount(cell, x, minlength=(first + 2) * n_bins)[: (first + 1) * n_bins].reshape(first + 1, n_bins)
    return out


def split(tree: Tree, total: np.ndarray, level: int, allowed: np.ndarray, p: dict) -> None:
    """Chooses the best split of every node of a level from its sums; equal gains go to the first feature and bin."""
    first = 2**level - 1
    for k in range(first + 1):
        node = first + k
        if level and (tree.feature[(node - 1) // 2] < 0):
            continue
        g, h = total[k, 0].sum(axis=0)
        tree.value[node] = leaf_value(g, h, p)
        if level == p["depth"]:
            continue
        left = np.cumsum(total[k, allowed, :-1], axis=1)
        lg, lh = left[..., 0], left[..., 1]
        gains = quality(lg, lh, p) + quality(g - lg, h - lh, p) - quality(g, h, p)
        gains[(lh < p["min_leaf_weight"]) | (h - lh < p["min_leaf_weight"])] = -np.inf
        best = int(np.argmax(gains))
        if gains.size and gains.flat[best] > LEAST_GAIN:
            f, b = divmod(best, gains.shape[1])
            tree.feature[node], tree.bin[node], tree.gain[node] = allowed[f], b, gains[f, b]


def prune(tree: Tree, least: float) -> None:
    """Takes back splits between two leaves that gain less than ``least``, from the bottom."""
    for node in range(len(tree.feature) // 2 - 1, -1, -1):
        leaves = tree.feature[2 * node + 1] < 0 and tree.feature[2 * node + 2] < 0
        if tree.feature[node] >= 0 and leaves and tree.gain[node] < least:
            tree.feature[node], tree.gain[node] = -1, 0.0


def step(tree: Tree, level: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """How rows go down from a level: (feature, cut of each node) of the features that it splits by, and the left child of each node."""
    last = 2 ** (level + 1) - 1
    feature = tree.feature[:last].copy()
    feature[: last // 2] = -1
    # bins above that of any row where a node has another feature or none
    cuts = [(int(f), np.where(feature == f, tree.bin[:last], 255).astype(np.uint8)) for f in np.unique(feature) if f >= 0]
    nodes = np.arange(last)
    return cuts, np.where(feature >= 0, 2 * nodes + 1, nodes).astype(tree.roots(0).dtype)


def descend(down: tuple, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of rows after a :func:`step`; ``bins`` has a row per feature."""
    cuts, left = down
    if not cuts:
        return at
    right = np.zeros(len(at), dtype=bool)
    for f, cut in cuts:
        right |= bins[f] > cut.take(at, mode="clip")
    return left.take(at, mode="clip") + right


def settled(tree: Tree) -> np.ndarray:
    """The value that a row at each node of a pruned tree gets: that of the leaf on its way."""
    value = tree.value.copy()
    ends = tree.feature < 0
    for node in range(1, len(value)):
        if ends[(node - 1) // 2]:
            value[node], ends[node] = value[(node - 1) // 2], True
    return value


def grow(bins, ids, label, weight, p: dict, n_bins: int, allowed=features_of) -> list[Tree]:
    """All trees of one model whose rows are here.

    A level is one pass over pieces of rows that stay in the processor's cache: rows go down one level,
    and only the features that a tree may split by are added up. The leaves need no more than their totals.
    """
    bins = np.ascontiguousarray(bins.T)
    width, n = bins.shape
    margin, trees = np.zeros(n), []
    pieces = [slice(k, min(k + PIECE_ROWS, n)) for k in range(0, n, PIECE_ROWS)]
    for number in range(p["rounds"]):
        tree, own = Tree.of(p["depth"]), allowed(number, width, p)
        wanted = np.union1d(own, [0])  # a node's totals are those of the first feature
        at, rows = tree.roots(n), []
        for piece in pieces:
            chosen = np.flatnonzero(drawn(ids[piece], number, p))
            g, h = gradients(margin[piece][chosen], label[piece][chosen], weight[piece][chosen])
            found = np.zeros((width, len(chosen)), dtype=np.uint8)
            for f in wanted:
                np.take(bins[f, piece], chosen, out=found[f])
            rows.append((chosen, found, g, h))
        for level in range(p["depth"] + 1):
            total, down = 0.0, step(tree, level - 1) if level else None
            for piece, (chosen, found, g, h) in zip(pieces, rows, strict=True):
                if level:
                    at[piece] = descend(down, bins[:, piece], at[piece])
                total = total + sums(found, at[piece].take(chosen), g, h, level, n_bins, wanted if level < p["depth"] else [0])
            split(tree, total, level, own, p)
        prune(tree, p["min_gain"])
        value = settled(tree)
        for piece in pieces:
            margin[piece] += value.take(at[piece], mode="clip")
        trees.append(tree)
    return trees


# --- models ---------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """A fitted model: cut points of every feature, and trees over the bins."""

    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    #: The steps of the trees, made when they are first needed.
    steps: list = field(default_factory=list, repr=False, compare=False)

    def importances(self) -> dict[str, float]:
        """Mean gain of a feature's splits, summing to 1."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
            np.add.at(count, tree.feature[used], 1)
        mean = total / np.maximum(count, 1)
        return dict(zip(self.features, (mean / (mean.sum() or 1)).tolist(), strict=True))

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = np.ascontiguousarray(binned(values, self.cuts).T, dtype=np.uint8)
        if len(self.steps) != len(self.trees):
            self.steps = [[step(t, k) for k in range(int(np.log2(len(t.feature) + 1)) - 1)] for t in self.trees]
        total = np.zeros(len(values))
        for tree, steps in zip(self.trees, self.steps, strict=True):
            at = tree.roots(len(values))
            for down in steps:
                at = descend(down, bins, at)
            total += tree.value.take(at, mode="clip")
        return total

    def to_json(self) -> str:
        trees = [{k: getattr(t, k).tolist() for k in ("feature", "bin", "gain", "value")} for t in self.trees]
        return json.dumps({"features": self.features, "cuts": [c.tolist() for c in self.cuts], "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        raw = json.loads(text)
        ints = lambda k: np.int64 if k in ("feature", "bin") else np.float64
        trees = [Tree(**{k: np.array(v, dtype=ints(k)) for k, v in t.items()}) for t in raw["trees"]]
        return cls(raw["features"], [np.array(c) for c in raw["cuts"]], trees)


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many cut points lie below it."""
    return np.stack([np.searchsorted(c, values[:, k]) for k, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(values), 0), dtype=np.int64)


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` approximate quantiles of each feature, in one aggregation."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, F.lit(100 * bins)).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], dtype=np.float64)) for f in features]


_BLOCK = "model int, ids binary, bins binary, labels binary, weights binary, margins binary"


def _blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """Rows (model, id, label, weight, features) packed by model, one byte a bin."""

    def block(model, part: pd.DataFrame) -> pa.RecordBatch:
        bins = binned(part[features].to_numpy(dtype=np.float64), cuts).astype(np.uint8)
        arrays = [part["id"].to_numpy(np.int64), bins, part["label"].to_numpy(np.float64), part["weight"].to_numpy(np.float64), np.zeros(len(part))]
        return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for model, part in batch.to_pandas().groupby("model"):
                held.setdefault(int(model), []).append(part)
                if sum(map(len, held[int(model)])) >= BLOCK_ROWS:
                    yield block(model, pd.concat(held.pop(int(model))))
        for model, parts in held.items():
            yield block(model, pd.concat(parts))

    return rows.mapInArrow(run, _BLOCK)


def _arrays(row: dict, width: int):
    ids, label, weight, margin = (np.frombuffer(row[c], dtype=d) for c, d in (("ids", np.int64), ("labels", np.float64), ("weights", np.float64), ("margins", np.float64)))
    return np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, width), ids, label, weight, margin


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in column])


def _fit_in_tasks(blocks: DataFrame, models: list[int], width: int, n_bins: int, p: dict) -> dict[int, list[Tree]]:
    def run(table: pa.Table) -> pa.Table:
        ids = _joined(table.column("ids"), np.int64)
        order = np.argsort(ids, kind="stable")  # sums don't depend on the order of the blocks
        bins = _joined(table.column("bins"), np.uint8).reshape(-1, width)[order]
        label, weight = (_joined(table.column(c), np.float64)[order] for c in ("labels", "weights"))
        found = Boosted([], [], grow(bins, ids[order], label, weight, p, n_bins))
        return pa.table({"model": table.column("model")[:1], "fitted": [found.to_json()]})

    def fitted(model: int) -> list[Tree]:
        # a job per model, as models dealt by hash may share a task
        own = blocks.where(F.col("model") == model).drop("margins")
        (row,) = own.groupBy("model").applyInArrow(run, "model int, fitted string").collect()
        return Boosted.from_json(row["fitted"]).trees

    return dict(zip(models, concurrently(blocks.sparkSession, fitted, models), strict=True))


def _fit_spread(blocks: DataFrame, models: list[int], width: int, n_bins: int, p: dict) -> dict[int, list[Tree]]:
    """Level by level over all rows; a task adds up its blocks before anything leaves it."""
    spark = blocks.sparkSession
    done: dict[int, list[Tree]] = {m: [] for m in models}
    since: dict[int, list[Tree]] = {m: [] for m in models}

    def scored(row: dict, trees: dict[int, list[Tree]]):
        bins, ids, label, weight, margin = _arrays(row, width)
        bins = np.ascontiguousarray(bins.T)
        return bins, ids, label, weight, margin + sum((t.scores(bins) for t in trees[row["model"]]), np.zeros(len(ids)))

    for number in range(p["rounds"]):
        growing = {m: Tree.of(p["depth"]) for m in models}
        allowed = features_of(number, width, p)
        wanted = np.union1d(allowed, [0])  # a node's totals are those of the first feature
        for level in range(p["depth"] + 1):
            shared = spark.sparkContext.broadcast((since, growing))  # bounded: REFRESH trees a model

            def level_sums(batches, shared=shared, number=number, level=level, wanted=wanted):
                trees, now = shared.value
                totals: dict[int, np.ndarray] = {}
                for batch in batches:
                    for row in batch.to_pylist():
                        bins, ids, label, weight, margin = scored(row, trees)
                        chosen = drawn(ids, number, p)
                        g, h = gradients(margin, label, weight)
                        own = bins[:, chosen]
                        found = sums(own, now[row["model"]].places(own, level), g[chosen], h[chosen], level, n_bins, wanted if level < p["depth"] else [0])
                        totals[row["model"]] = totals.get(row["model"], 0) + found
                keys = [(m, k) for m, t in totals.items() for k in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m for m, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([totals[m][k].tobytes() for m, k in keys], pa.binary())],
                    names=["model", "node", "sums"],
                )

            def best(table: pa.Table) -> pa.Table:
                # a row of bounded size per task
                total = sum(np.frombuffer(s, dtype=np.float64).reshape(1, width, n_bins, 2) for s in table.column("sums").to_pylist())
                k, alone = table.column("node")[0].as_py(), Tree.of(1)
                split(alone, total, 0, allowed, p if level < p["depth"] else p | {"depth": 0})
                found = {"model": table.column("model")[0].as_py(), "node": k, "feature": int(alone.feature[0]), "bin": int(alone.bin[0]), "gain": float(alone.gain[0]), "value": float(alone.value[0])}
                return pa.Table.from_pylist([found], schema=pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int64()), ("bin", pa.int64()), ("gain", pa.float64()), ("value", pa.float64())]))

            summed = blocks.mapInArrow(level_sums, "model int, node int, sums binary")
            chosen = summed.groupBy("model", "node").applyInArrow(best, "model int, node int, feature long, bin long, gain double, value double").collect()
            for r in chosen:  # bounded: a row per model and node of the level
                tree, node = growing[r["model"]], 2**level - 1 + r["node"]
                if level and tree.feature[(node - 1) // 2] < 0:
                    continue
                tree.value[node], tree.feature[node], tree.bin[node], tree.gain[node] = r["value"], r["feature"], r["bin"], r["gain"]
            shared.unpersist()
        for m, tree in growing.items():
            prune(tree, p["min_gain"])
            done[m].append(tree)
            since[m].append(tree)
        if (number + 1) % REFRESH == 0 and number + 1 < p["rounds"]:
            trees = since

            def rescored(batches, trees=trees):
                for batch in batches:
                    margins = [scored(row, trees)[-1].tobytes() for row in batch.to_pylist()]
                    yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(margins, pa.binary()))

            blocks = stage(blocks.mapInArrow(rescored, _BLOCK), "scored-blocks")
            since = {m: [] for m in models}
    return done


def fit(rows: DataFrame, features: list[str], bins: int = BINS, local_cells: int = LOCAL_CELLS, **overrides) -> dict[int, Boosted]:
    """A model per value of ``model`` from rows (model, id, label 0/1, weight, features without nulls).

    ``id`` tells the rows of a model apart; it draws the rows of each tree.
    """
    p = settings(**overrides)
    cuts = cut_points(rows, features, bins)
    sizes = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row per model
    blocks = stage(_blocks(rows.select("model", "id", "label", "weight", *features), features, cuts), "binned")
    if max(sizes.values(), default=0) * len(features) <= local_cells:
        trees = _fit_in_tasks(blocks, sorted(sizes), len(features), bins, p)
    else:
        trees = _fit_spread(blocks, sorted(sizes), len(features), bins, p)
    return {m: Boosted(features, cuts, t) for m, t in trees.items()}


def score(models: dict[int, Boosted], df: DataFrame, model: str = "model") -> DataFrame:
    """``df`` with ``score`` (chance of 1) and ``prediction`` by the model that column ``model`` names."""
    features = next(iter(models.values())).features
    shared = df.sparkSession.sparkContext.broadcast({m: b.to_json() for m, b in models.items()})  # trees alone

    @F.pandas_udf("double")
    def chance(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict[int, Boosted] = {}
        for number, *columns in batches:
            values, out = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1), np.zeros(len(number))
            for m in number.unique():
                own = (number == m).to_numpy()
                if int(m) not in known:
                    known[int(m)] = Boosted.from_json(shared.value[int(m)])
                out[own] = 1 / (1 + np.exp(-known[int(m)].margins(values[own])))
            yield pd.Series(out)

    scored = df.withColumn("score", chance(F.col(model), *[F.col(f).cast("double") for f in features]))
    return scored.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))


def save(spark: SparkSession, models: dict[int, Boosted], path: str) -> None:
    """A row per model."""
    spark.createDataFrame([(m, b.to_json()) for m, b in models.items()], "model int, fitted string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[int, Boosted]:
    return {r["model"]: Boosted.from_json(r["fitted"]) for r in spark.read.parquet(path).collect()}
