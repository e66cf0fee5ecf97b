"""Hard-negative mining by a secondary sort: scores in descending order stream past windows that positives open.

The score of two rows is the integer inner product of their vectors, whose components are
``floor(256 * x)``. A row's positives are the ``n_positives`` best other rows of its label; a negative
of a pair has another label and a score between ``low`` and ``high`` hundredths of the positive's.

Rows are packed into blocks of bounded size and so are the anchors; every block of rows meets every block
of anchors once, and their scores are one matrix product inside a task. Only scores that can matter leave
it: for positives an anchor's best of its label in the block, then, as the positives are known, the best
negatives of each window in the block. These are keyed (anchor, descending score, id), dealt by anchor and
sorted inside the partitions; a streaming iterator opens a window at each positive, gives each window its
first negatives, and holds nothing of an anchor but its windows.

Defined cases: rows without a label or vector, or with a component that is null or not finite, take no
part; ids that are repeated belong to rows of their own, each an anchor and each other's positive; a null
id is no anchor and goes last among equal scores; a shorter vector counts as one with zeros; components
have to be small enough for scores to fit in a long; rows without a partner give no result, an empty
table an empty one; other columns are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope.llm.batches import bounded_batches
from sproutscope.session import stage
from sproutscope.sizing import slices_of

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows and anchors that are packed into one block.
BLOCK_ROWS, ANCHOR_ROWS = 8192, 4096
#: Scores that are held at once.
SCORES = 1 << 20
#: Blocks of rows that share a copy of the anchors, about.
SHARED_BLOCKS = 16

_BLOCK = "block long, dims int, ids binary, no_id binary, labels binary, vectors binary"


def _packed(rows: list, block: int) -> pa.RecordBatch:
    """One block, in the order of ids with nulls last: ids, labels and the vectors as 64-bit integers."""
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dims = max(len(v) for _, _, v in rows)
    vectors = np.zeros((len(rows), dims), dtype=np.int64)
    for k, (_, _, v) in enumerate(rows):
        vectors[k, : len(v)] = v
    ids = np.array([r[0] or 0 for r in rows], dtype=np.int64)
    missing = np.array([r[0] is None for r in rows], dtype=bool)
    labels = np.array([r[1] for r in rows], dtype=np.int64)
    columns = [pa.array([block], pa.int64()), pa.array([dims], pa.int32())]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (ids, missing, labels, vectors)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])


def valid_rows(vectors: DataFrame, label=None) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with integer components."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    label = F.col("label") if label is None else label
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vec"))


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (vec_id, label, vec) packed; a block has a number of its own.

    The rows are dealt by hash to as many blocks as their number takes, so blocks are full
    whatever the files and partitions are, and no larger however many rows are alike.
    """

    def run(batches):
        part, seq, number, held = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("dealt", "vec_id", "label", "vec")), strict=True):
                if held and (own != number or len(held) == 2 * block_rows):
                    yield _packed(held, part << 32 | seq)
                    held, seq = [], seq + 1
                number = own
                held.append(row)
        if held:
            yield _packed(held, part << 32 | seq)

    bounded_batches(rows.sparkSession)
    n_blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    dealt = dealt.repartition("dealt").sortWithinPartitions("dealt")
    return stage(dealt.mapInArrow(run, _BLOCK), "blocks")


class Block:
    """The arrays of a packed block."""

    def __init__(self, row: dict, prefix: str = ""):
        self.number, self.dims = row[f"{prefix}block"], row[f"{prefix}dims"]
        self.ids, self.labels = (np.frombuffer(row[f"{prefix}{c}"], dtype=np.int64) for c in ("ids", "labels"))
        self.no_id = np.frombuffer(row[f"{prefix}no_id"], dtype=bool)
        self.vectors = np.frombuffer(row[f"{prefix}vectors"], dtype=np.int64).reshape(-1, self.dims)
        self.largest = int(np.abs(self.vectors).max(initial=0))


def products(a: Block, chosen: np.ndarray, b: Block) -> np.ndarray:
    """Scores of the chosen rows of ``a`` with all of ``b``, by floating point where that is exact."""
    dims = min(a.dims, b.dims)
    x, y = a.vectors[chosen, :dims], b.vectors[:, :dims]
    bound = a.largest * b.largest * max(dims, 1)
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError("scores don't fit in a long")
    return x @ y.T


def _anchor_rows(packed: DataFrame, every: int) -> DataFrame:
    """(anchor, vec_id, label, vec) of rows whose id is divisible by ``every``; ``anchor`` is block and place."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row)
                at = np.flatnonzero(~own.no_id & (own.ids % every == 0))
                vectors = [own.vectors[k].tobytes() for k in at]
                anchor = pa.array([f"{own.number}/{k}" for k in at], pa.string())
                yield pa.RecordBatch.from_arrays([anchor, pa.array(own.ids[at]), pa.array(own.labels[at]), pa.array(vectors, pa.binary())], names=["anchor", "vec_id", "label", "vec"])

    return packed.mapInArrow(run, "anchor string, vec_id long, label long, vec binary")


def _meetings(packed: DataFrame, anchors: DataFrame, n_anchors: int, anchor_rows: int) -> DataFrame:
    """Every block of rows with every group of anchors.

    Anchors are dealt into groups of about ``anchor_rows``. Blocks are dealt over so many salts that all
    tasks have work and none has more than a few blocks; each salt gets a copy of the groups. Copies of
    blocks and anchors are far larger than their files, so the join is never left to those sizes:
    nothing of it is broadcast.
    """
    groups, n_blocks = max(1, -(-n_anchors // anchor_rows)), packed.count()
    salts = max(1, min(n_blocks, 2 * slices_of(packed)), -(-n_blocks // SHARED_BLOCKS))
    dealt = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    # bounded: a group has about ``anchor_rows`` anchors, however many there are
    grouped = dealt.groupBy("group").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    copies = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    return copies.join(salted.hint("merge"), "salt")


def _anchor_block(anchors: list[dict]) -> Block:
    width = max(len(a["vec"]) for a in anchors) // 8
    vectors = b"".join(a["vec"].ljust(8 * width, b"\0") for a in anchors)
    numbers = lambda c: np.array([a[c] for a in anchors], dtype=np.int64).tobytes()
    return Block({"block": None, "dims": width, "ids": numbers("vec_id"), "no_id": bytes(len(anchors)), "labels": numbers("label"), "vectors": vectors})


def _keys(scores: np.ndarray) -> np.ndarray:
    """Scores and places as one number each, in the order of (score, descending place)."""
    n = scores.shape[1]
    if scores.size and int(np.abs(scores).max()) >= (1 << 62) // max(n, 1):
        raise OverflowError("scores are too large to be packed with their places")
    return scores * n + (n - 1 - np.arange(n))


def _strips(anchors: Block, rows: Block):
    """(places of anchors of one label, that label): few enough that their scores fit."""
    order = np.argsort(anchors.labels, kind="stable")
    height = max(1, SCORES // max(1, len(rows.ids)))
    for label in np.unique(anchors.labels):
        own = order[anchors.labels[order] == label]
        for at in range(0, len(own), height):
            yield own[at : at + height], label


SCORED = "anchor string, anchor_id long, kind int, score long, id long, no_id boolean"
_SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _scored(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SCORED_NAMES)


POSITIVE, NEGATIVE = 0, 1


def _best_positives(meetings: DataFrame, k: int) -> DataFrame:
    """Of each block the ``k`` best rows of an anchor's label, without the anchor itself."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, names, anchors = Block(row), [a["anchor"] for a in row["anchors"]], _anchor_block(row["anchors"])
                for own, label in _strips(anchors, rows):
                    same = np.flatnonzero(rows.labels == label)
                    if not len(same):
                        continue
                    keys = _keys(products(anchors, own, rows))[:, same]
                    if keys.shape[1] > k + 1:  # one more, as the anchor may be among them
                        keys = -np.partition(-keys, k, axis=1)[:, : k + 1]
                    n, found = len(rows.ids), []
                    for anchor, best in zip(own, np.sort(keys, axis=1)[:, ::-1], strict=True):
                        places = n - 1 - best % n
                        others = [(p, b) for p, b in zip(places.tolist(), (best // n).tolist(), strict=True) if names[anchor] != f"{rows.number}/{p}"]
                        found += [(names[anchor], int(anchors.ids[anchor]), POSITIVE, s, int(rows.ids[p]), bool(rows.no_id[p])) for p, s in others[:k]]
                    yield _scored(found)

    return meetings.mapInArrow(run, SCORED)


def _in_windows(meetings: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Of each block the ``k`` best rows of another label in each window of an anchor."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, names, anchors = Block(row), [a["anchor"] for a in row["anchors"]], _anchor_block(row["anchors"])
                n = len(rows.ids)
                for own, label in _strips(anchors, rows):
                    other = np.flatnonzero(rows.labels != label)
                    if not len(other):
                        continue
                    found = []
                    for anchor, keys in zip(own, np.sort(_keys(products(anchors, own, rows))[:, other], axis=1), strict=True):
                        chosen = set()
                        for positive in row["anchors"][anchor]["scores"]:
                            least, most = -(-low * positive // 100), high * positive // 100
                            end = int(np.searchsorted(keys, (most + 1) * n))
                            chosen.update(b for b in keys[max(0, end - k) : end].tolist() if b // n >= least)
                        found += [(names[anchor], int(anchors.ids[anchor]), NEGATIVE, b // n, int(rows.ids[n - 1 - b % n]), bool(rows.no_id[n - 1 - b % n])) for b in chosen]
                    yield _scored(found)

    return meetings.mapInArrow(run, SCORED)


def _by_anchor(scored: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, inside a partition by (anchor, descending score, kind, id)."""
    order = ["anchor", F.col("score").desc(), "kind", "no_id", "id"]
    return scored.repartition("anchor").sortWithinPartitions(*order)


def _first_positives(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows of each anchor in a stream sorted by it."""

    def run(batches):
        anchor, taken = None, 0
        for batch in batches:
            keep = []
            for at, own in enumerate(batch.column("anchor").to_pylist()):
                if own != anchor:
                    anchor, taken = own, 0
                if taken < k:
                    taken += 1
                    keep.append(at)
            yield batch.take(pa.array(keep, pa.int64()))

    return _by_anchor(scored).mapInArrow(run, SCORED)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _windows(scored: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The negatives that the windows of each anchor meet, in a stream sorted by it."""

    def run(batches):
        anchor, windows = None, []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["anchor"] != anchor:
                    anchor, windows = row["anchor"], []
                own = None if row["no_id"] else row["id"]
                if row["kind"] == POSITIVE:
                    windows.append([own, row["score"], 0])
                    continue
                for window in windows:
                    positive, score, taken = window
                    if taken < k and low * score <= 100 * row["score"] <= high * score:
                        window[2] = taken + 1
                        found.append((row["anchor_id"], positive, taken + 1, own, score, row["score"]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MINED.split(", ")])

    return _by_anchor(scored).mapInArrow(run, MINED)


def mine(
    rows: DataFrame, every: int, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """Negatives of every anchor and positive among ``rows`` (of :func:`valid_rows`); anchors are ids divisible by ``every``."""
    packed = blocks(rows, block_rows)
    anchors = stage(_anchor_rows(packed, every), "anchors")
    n_anchors = anchors.count()
    best = _best_positives(_meetings(packed, anchors, n_anchors, anchor_rows), n_positives)
    positives = stage(_first_positives(best, n_positives), "positives")
    scores = positives.groupBy("anchor").agg(F.collect_list("score").alias("scores"))  # n_positives at most
    opened = anchors.join(scores.hint("merge"), "anchor")
    negatives = _in_windows(_meetings(packed, opened, n_anchors, anchor_rows), n_negatives, low, high)
    return _windows(positives.unionByName(negatives), n_negatives, low, high)
