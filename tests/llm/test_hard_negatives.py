"""Hard negatives against all pairs in plain Python."""

import math
import random

import pytest

from sproutscope.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every, n_positives=5, n_negatives=3):
    own = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, v) in enumerate(own):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), i is None, i or 0, y) for b, (i, y, w) in enumerate(own) if b != a))
        positives = [(i, n, -s) for s, n, i, y in scored if y == label][:n_positives]
        for i, missing, score in positives:
            fits = [(j, n, -s) for s, n, j, y in scored if y != label and 50 * score <= -100 * s <= 95 * score][:n_negatives]
            out += [(anchor, None if missing else i, k, None if n else j, score, t) for k, (j, n, t) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=2, **sizes):
    return sorted(map(tuple, mining.mine(mining.valid_rows(spark.createDataFrame(rows, SCHEMA)), every, **sizes).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    made = [(k, [round(draw.uniform(-1, 1) + (k % 3) * 0.7, 1) for _ in range(4)], draw.choice([0, 1, 2])) for k in range(80)]
    made += [(k, [0.5, 0.5, 0.5, 0.5], k % 2) for k in range(80, 140)]  # ties of every kind
    made += [(140, [0.5, 0.5], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (141, None, 1), (142, [1.0, None, 1.0, 1.0], 0), (143, [float("nan")] * 4, 1)]
    made += [(144, [float("inf")] * 4, 1), (146, [1.0] * 4, None), (148, [], 1), (4, [0.9, 0.1, 0.3, 0.2], 0), (4, [0.9, 0.1, 0.3, 0.2], 0)]
    return [(i, None if v is None else [None if x is None else x for x in v], y) for i, v, y in made]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "anchor_rows": 5}])
def test_equals_all_pairs(spark, rows, sizes):
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.createDataFrame(rows, SCHEMA).collect()]
    got = mined(spark, rows, **sizes)
    assert got == by_hand(stored, 2) and got


def test_one_label_with_most_rows_and_no_negative(spark):
    made = [(k, [1.0, 0.1 * (k % 10)], 7) for k in range(300)] + [(301, [0.6, 0.3], 8)]
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.createDataFrame(made, SCHEMA).collect()]
    assert mined(spark, made, every=50, block_rows=32) == by_hand(stored, 50)
    assert mined(spark, made[:300], every=50) == []


def test_large_components_are_exact_or_refused(spark):
    made = [(0, [5e5, 1.0], 0), (1, [5e5, 2.0], 0), (2, [3e5, 1.0], 1)]
    assert mined(spark, made) == by_hand(made, 2)
    with pytest.raises(Exception, match="fit in a long|packed"):
        mined(spark, [(0, [1e30], 0), (2, [1e30], 0)])


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    extra = spark.createDataFrame([(0, [1.0], 0, 1, "a"), (1, [1.0], 0, 2, "b"), (2, [0.7], 1, 3, "c")], SCHEMA + ", score int, anchor string")
    assert [tuple(r) for r in mining.mine(mining.valid_rows(extra), 50).collect()] == [(0, 1, 1, 2, 65536, 45824)]


def test_no_vector_is_broadcast(spark, rows):
    """Blocks and copies of anchors are many times their files, which the planner goes by."""
    found = mining.mine(mining.valid_rows(spark.createDataFrame(rows, SCHEMA)), 2, block_rows=7, anchor_rows=5)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("AdaptiveSparkPlan isFinalPlan=true") and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    packed = mining.blocks(mining.valid_rows(spark.createDataFrame(rows, SCHEMA)), 7)
    met = mining._meetings(packed, mining._anchor_rows(packed, 2), 70, 5).select("group", "block").collect()
    groups = {r["group"] for r in met}
    assert len(met) == len(set(met)) == len(groups) * packed.count() and len(groups) > 1
