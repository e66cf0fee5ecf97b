"""Synthetic minority oversampling with neighbours by hashed random projections.

Identical rows are folded to one vector with its number of copies. In each of several tables a vector has
a code, one bit per seeded random direction, and the vectors lie in the order of their codes; neighbours
mostly share a long prefix of them. Overlapping windows of bounded rows run over each order, and the
distances inside a window are exact, so a vector has at most two windows of candidates per table however
many vectors share a code. The best candidates of all tables, and then the neighbours of neighbours, are
kept. Up to one window of vectors the result is exact; beyond that it is the true one for most.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.operators.ranks import running_tallies
from sproutscope.session import stage

#: Vectors that are compared with each other at once, and orders that they are laid out in.
WINDOW_ROWS, TABLES = 512, 6
COPIES_PER_TASK_ROW = 10_000

_VECTOR = "array<double>"


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """``(vec, copies)``: distinct feature vectors."""
    vec = F.array(*[F.col(f).cast("double") for f in features])
    return df.groupBy(vec.alias("vec")).agg(F.count("*").alias("copies"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _laid_out(vectors: DataFrame, width: int, tables: int, bits: int, seed: int) -> DataFrame:
    """(table, code, along, id, vec): each vector once per table, with its bits and its place beside them."""
    centre = np.zeros(width)
    if bits:
        centre = np.array(vectors.agg(*[F.avg(F.col("vec")[i]) for i in range(width)]).first(), dtype=np.float64)
    directions = np.random.default_rng(seed).normal(size=(tables, bits + 1, width))  # bounded: log of the rows, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            points = _matrix(batch.column("vec")) - centre
            for table in range(tables):
                sides = points @ directions[table].T
                code = (sides[:, :bits] > 0) @ weights if bits else np.zeros(len(points), dtype=np.int64)
                columns = [pa.array(np.full(len(points), table, dtype=np.int32)), pa.array(code), pa.array(sides[:, bits])]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("id"), batch.column("vec")], names=["table", "code", "along", "id", "vec"])

    return vectors.select("id", "vec").mapInArrow(run, f"table int, code long, along double, id long, vec {_VECTOR}")


def _closest(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``k`` nearest others of every point, nearest first."""
    n = len(points)
    centred = points - points.mean(axis=0)
    squares = (centred**2).sum(axis=1)
    rough = squares[:, None] + squares[None] - 2 * (centred @ centred.T)
    np.fill_diagonal(rough, np.inf)
    # products of large numbers round, so some more are measured exactly
    picked = np.argpartition(rough, min(k + 8, n - 1) - 1, axis=1)[:, : min(k + 8, n - 1)]
    apart = np.sqrt(((points[:, None] - points[picked]) ** 2).sum(axis=2))
    order = np.argsort(apart, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(picked, order, axis=1), np.take_along_axis(apart, order, axis=1)


_FOUND = "id long, others array<struct<distance:double,other:bigint>>"


def _in_windows(laid: DataFrame, k: int, window: int) -> DataFrame:
    """(id, others): the ``k`` nearest in each window of each table; windows overlap by half."""

    def found(ids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        places, apart = _closest(points, k)
        near = pa.StructArray.from_arrays([pa.array(apart.ravel()), pa.array(ids[places].ravel())], names=["distance", "other"])
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * places.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, near)], names=["id", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, points, fresh = None, None, None, 0  # fresh: rows at the end that no window has had
        for batch in batches:
            tables, all_ids, vecs = batch.column("table").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            at = 0
            while at < len(tables):
                if tables[at] != table or ids is None:
                    if fresh and len(ids) > 1:
                        yield found(ids, points)
                    table, ids, points, fresh = tables[at], all_ids[:0], vecs[:0], 0
                same = int(np.searchsorted(tables[at:], table, side="right"))
                take = min(same, window - len(ids))
                ids, points = np.concatenate([ids, all_ids[at : at + take]]), np.concatenate([points, vecs[at : at + take]])
                at, fresh = at + take, fresh + take
                if len(ids) == window:
                    yield found(ids, points)
                    ids, points, fresh = ids[window // 2 :], points[window // 2 :], 0
        if fresh and len(ids) > 1:
            yield found(ids, points)

    return laid.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all lists of an id; their number is bounded by the tables."""
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))), 1, k).alias("others"))


def _neighbours_of_neighbours(best: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(id, others) measured exactly for the neighbours of each id's neighbours: at most ``k * k``."""
    pairs = best.select("id", F.explode(F.col("others.other")).alias("other"))
    around = best.select(F.col("id").alias("other"), F.col("others.other").alias("next"))
    further = pairs.join(around, "other").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    wanted = best.join(further, "id").select("id", F.explode(F.array_except("next", F.col("others.other"))).alias("other")).where("other != id")
    points = vectors.select("id", "vec")
    met = wanted.join(points, "id").join(points.withColumnsRenamed({"id": "other", "vec": "other_vec"}), "other")
    squares = F.aggregate(F.zip_with("vec", "other_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return met.select("id", F.array(F.struct(F.sqrt(squares).alias("distance"), "other")).alias("others"))


def nearest(vectors: DataFrame, width: int, k: int, window: int = WINDOW_ROWS, tables: int = TABLES, seed: int = 42) -> DataFrame:
    """The ``k`` nearest other vectors: ``(vec, near)``, ``near`` sorted (distance, vec, copies).

    ``vectors`` are distinct. Exact for up to ``window`` of them.
    """
    vectors = stage(vectors.withColumn("id", F.monotonically_increasing_id()), "vectors")
    rows = vectors.count()
    exact = rows <= window
    tables, bits = (1, 0) if exact else (tables, min(48, math.ceil(math.log2(rows / window)) + 3))
    parts = max(1, rows * tables // (8 * window))
    laid = _laid_out(vectors, width, tables, bits, seed)
    laid = laid.repartitionByRange(parts, "table", "code", "along", "id").sortWithinPartitions("table", "code", "along", "id")
    best = stage(_best(_in_windows(laid, k, window), k), "near")
    if not exact:
        best = stage(_best(best.unionByName(_neighbours_of_neighbours(best, vectors, k)), k), "near")
    named = vectors.select(F.col("id").alias("other"), F.col("vec").alias("near_vec"), F.col("copies").alias("near_copies"))
    near = best.select("id", F.explode("others").alias("o")).select("id", "o.*").join(named, "other")
    near = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "near_vec", "near_copies"))).alias("near"))
    return vectors.join(near, "id").select("vec", "near")


def _uniform(seed: int, *parts):
    """A reproducible number in [0, 1) per row."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))


def smote(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    k: int = 5,
    seed: int = 42,
    window: int = WINDOW_ROWS,
) -> DataFrame:
    """Original rows plus synthetic positives until both classes have the same size.

    Returns ``(*features, label, synthetic)``. A synthetic row lies between a minority row
    and one of its ``min(k, minority - 1)`` nearest minority rows.
    """
    sizes = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    ).first()
    original = df.select(
        *[F.col(f).cast("double").alias(f) for f in features],
        F.col(label).cast("int").alias(label),
        F.lit(False).alias("synthetic"),
    )
    wanted, k = sizes["neg"] - sizes["pos"], min(k, sizes["pos"] - 1)
    if wanted <= 0 or k < 1:
        return original
    vectors = stage(_vectors(df.where(F.col(label) == 1), features), "minority")
    near = nearest(vectors, len(features), k, window, seed=seed)
    # identical rows are each other's nearest; the rest of the k places follow by distance
    itself = F.array_repeat(F.col("vec"), F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    others = F.flatten(
        F.transform(
            F.coalesce("near", F.array().cast(f"array<struct<distance:double,near_vec:{_VECTOR},near_copies:bigint>>")),
            lambda n: F.array_repeat(n["near_vec"], F.least(n["near_copies"], F.lit(k)).cast("int")),
        )
    )
    places = vectors.join(near, "vec", "left").select(
        "vec", "copies", F.slice(F.concat(itself, others), 1, k).alias("places")
    )
    # spread the wanted rows over the minority by cumulative share, exactly
    shares = _shares(places, wanted, sizes["pos"])
    chunked = shares.select(
        "vec", "places", "made",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(made - 1) div {COPIES_PER_TASK_ROW}"))).alias("chunk"),
    ).repartition("vec", "chunk")
    first = F.col("chunk") * COPIES_PER_TASK_ROW
    last = F.least(F.col("made"), first + COPIES_PER_TASK_ROW) - 1
    drawn = chunked.withColumn("copy", F.explode(F.sequence(first, last)))
    place = F.floor(_uniform(seed, F.col("vec"), F.col("copy")) * F.size("places")).cast("int") + 1
    step = _uniform(seed + 1, F.col("vec"), F.col("copy"))
    made = drawn.select(
        F.zip_with("vec", F.element_at("places", place), lambda a, b: a + (b - a) * step).alias("vec")
    )
    synthetic = made.select(
        *[F.col("vec")[i].alias(f) for i, f in enumerate(features)],
        F.lit(1).alias(label),
        F.lit(True).alias("synthetic"),
    )
    return original.unionByName(synthetic)


def _shares(places: DataFrame, wanted: int, minority: int) -> DataFrame:
    """Adds ``made``, how many synthetic rows start from each vector; they sum to ``wanted``.

    Every minority row makes the whole share; the remainder goes to the vectors in hash
    order, found from running totals over hash buckets.
    """
    whole, rest = divmod(wanted, minority)
    base = places.withColumn("made", F.col("copies") * whole)
    if rest:
        # 53 bits, exact as a double
        mixed = base.withColumn("_mix", F.pmod(F.xxhash64("vec"), F.lit(2**53)).cast("double"))
        placed = running_tallies(mixed, "_mix", {"rows": F.sum("copies")})
        ahead = placed.select(F.col("value").alias("_mix"), F.col("before_rows").alias("_ahead"))
        # vectors that collide, hardly ever more than one
        same = Window.partitionBy("_mix").orderBy("vec").rowsBetween(Window.unboundedPreceding, -1)
        position = F.col("_ahead") + F.coalesce(F.sum("copies").over(same), F.lit(0))
        extra = F.greatest(F.lit(0), F.least(F.col("copies"), F.lit(rest) - F.col("_position")))
        base = (
            mixed.join(ahead, "_mix")
            .withColumn("_position", position)
            .withColumn("made", F.col("made") + extra)
            .drop("_mix", "_ahead", "_position")
        )
    return base.where(F.col("made") > 0)
