"""Forms chosen for scale give the same rows as brute force, and their plans stay lean."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.operators import activity as act
from sproutscope.operators import contributors as con
from sproutscope.operators import governance as gov
from sproutscope.operators import ranks
from sproutscope.operators import windows as win
from sproutscope.operators.spans import counts_in_spans
from sproutscope.operators.prep import label_encode
from sproutscope.sizing import attach, fits, hot_keys, key_filter, spread_join


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_few_and_exact(spark):
    rows = [("hot", i) for i in range(400)] + [(f"k{i}", i) for i in range(600)]
    big = spark.createDataFrame(rows, "key string, id long")
    assert [r.key for r in hot_keys(big, ["key"], 8).collect()] == ["hot"]


def test_spread_join_equals_join(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 90}", 1000 + i) for i in range(900)] + [("none", -1)]
    big = spark.createDataFrame(rows, "key string, id long")
    lookup = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(90)], "key string, v string")
    want = sorted(map(tuple, big.join(lookup, "key").select("key", "id", "v").collect()))
    got = spread_join(big, lookup, ["key"], F.col("id"))
    assert sorted(map(tuple, got.select("key", "id", "v").collect())) == want
    # the hot key is cut into several join keys
    assert fits(lookup, 91) and not fits(lookup, 90)


def test_rows_of_other_keys_are_dropped_before_the_shuffle(spark):
    big = spark.range(20_000).select(F.col("id"), (F.col("id") % 1000).alias("k"))
    lookup = spark.range(50).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    kept = key_filter(big, lookup, ["k"])
    assert kept.columns == big.columns
    assert {r.k for r in kept.select("k").distinct().collect()} >= set(range(50)) and kept.count() < 1100
    assert "SortMergeJoin" not in _plan(kept) and "BroadcastHashJoin" in _plan(kept)
    # a bitmap that is far too small only lets more rows through
    assert spread_join(big, lookup, ["k"], F.col("id")).count() == 1000
    assert key_filter(big, lookup, ["k"], words=1).where("k < 50").count() == 1000


def test_a_frequent_category_is_split(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 70)).otherwise("most").alias("c"))
    want = {r.id: r.c for r in label_encode(df, ["c"]).collect()}
    got = label_encode(df, ["c"], max_rows=2)
    assert {r.id: r.c for r in got.collect()} == want and got.columns == df.columns


def test_attach_broadcasts_only_counted_lookups(spark):
    big = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    lookup = spark.range(7).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(attach(big, lookup, "k", F.col("id")))
        plan = _plan(attach(big, lookup, "k", F.col("id"), max_rows=3))
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spans_equal_brute_force(spark, ts):
    random.seed(3)
    base = ts("2024-01-01")
    events = [(str(i), random.choice(["p", "q", "r"]), base + timedelta(seconds=random.randrange(0, 9 * 86400, 7000))) for i in range(2000)]
    spans = []
    for _ in range(300):
        opens = base + timedelta(seconds=random.randrange(-86400, 8 * 86400, 3500))
        spans.append((random.choice(["p", "q", "zz"]), opens, opens + timedelta(seconds=random.choice([0, 7000, 200000]))))
    events_df = spark.createDataFrame(events, "event_id string, repo_name string, event_ts timestamp")
    spans_df = spark.createDataFrame(spans, "repo_name string, opens timestamp, closes timestamp")
    got = {
        (r.repo_name, r.opens, r.closes): r.events for r in counts_in_spans(events_df, spans_df).collect()
    }
    want = {
        (k, a.replace(tzinfo=None), b.replace(tzinfo=None)): sum(1 for _, n, t in events if n == k and a <= t <= b)
        for k, a, b in set(spans)
    }
    assert got == want


def test_divergence_cases(spark, ts):
    created = ts("2024-01-01")
    at = lambda d: created + timedelta(days=d)
    pushes = [("f/three", 3), ("up/one", 1)]
    rows, i = [], 0
    for name, n in pushes:
        for k in range(n):
            rows.append((str(i), name, at(k)))
            i += 1
    rows.append((str(i), "up/one", at(183)))
    commits = spark.createDataFrame(rows, "event_id string, repo_name string, event_ts timestamp")
    cohort = spark.createDataFrame(
        [("f/three", created, "up/one"), ("f/none", created, "up/quiet"), ("f/orphan", created, None), ("f/idle", created, "up/one")],
        "repo_name string, created_at timestamp, parent_repo string",
    )
    got = {r.repo_name: (r.early_commits_on_branch, r.parent_early_commits, r.divergence_ratio) for r in gov.divergence(commits, cohort).collect()}
    assert got == {
        "f/three": (3, 1, 0.75), "f/none": (0, 0, None), "f/orphan": (0, None, None), "f/idle": (0, 1, 0.0),
    }


def test_running_tallies_over_many_buckets(spark):
    random.seed(11)
    rows = [(random.choice("ab"), random.choice([1.0, 2.5, random.random() * 100])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double")
    placed = ranks.running_tallies(df, "x", {"rows": F.count("*")}, F.col("g"), ranges=16)
    for g in "ab":
        values = [x for h, x in rows if h == g]
        for row in placed.where(F.col("series") == g).collect():
            assert row.before_rows == sum(v < row.value for v in values)
            assert row.rows == values.count(row.value)
            assert row.total_rows == len(values)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    import statistics

    random.seed(n)
    values = [round(random.random() * 50, 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ranks.column_medians(df, ["x"])["x"] == pytest.approx(statistics.median(values))


def test_core_plans(spark, ts):
    """Broadcast with pushed time bounds, no Python in the aggregation stages."""
    created = ts("2024-01-01")
    path_rows = [(str(i), "a/b", S.PUSH, "u", created + timedelta(days=i), None, None, None, None) for i in range(5)]
    schema = (
        "event_id string, repo_name string, type string, actor_login string, event_ts timestamp, "
        "action string, number string, opened_at timestamp, merged boolean"
    )
    import tempfile

    path = tempfile.mkdtemp()
    spark.createDataFrame(path_rows, schema).write.mode("overwrite").parquet(path)
    events = spark.read.parquet(path)
    cohort = spark.createDataFrame([("a/b", created)], "repo_name string, created_at timestamp")
    plan = _plan(win.events_in_window(events, cohort))
    assert "BroadcastHashJoin" in plan
    assert "GreaterThanOrEqual(event_ts" in plan
    cm = con.contributor_months(events, cohort)
    for df in (act.activity(events, cohort), con.contributor_health(cm)):
        plan = _plan(df)
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    reads = _plan(con.contributor_months(events, cohort)).split("ReadSchema: ")[1].split("\n")[0]
    assert "number" not in reads and "opened_at" not in reads
