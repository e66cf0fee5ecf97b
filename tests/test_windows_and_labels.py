from datetime import timedelta

from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, EARLY_CALENDAR, LABEL, first_days
from sproutscope.operators import labels as lab
from sproutscope.operators import windows as win


def _events(spark, rows):
    return spark.createDataFrame(
        rows, "event_id string, repo_name string, type string, event_ts timestamp"
    )


def test_early_window_ends(spark, ts):
    created = ts("2024-01-10 01:02:03")
    end = created + timedelta(days=182)
    rows = [
        ("before", "a/b", S.PUSH, created - timedelta(seconds=1)),
        ("start", "a/b", S.PUSH, created),
        ("end", "a/b", S.PUSH, end),
        ("after", "a/b", S.PUSH, end + timedelta(seconds=1)),
        ("other", "x/y", S.PUSH, created),
    ]
    cohort = spark.createDataFrame([("a/b", created)], "repo_name string, created_at timestamp")
    kept = win.events_in_window(_events(spark, rows), cohort)
    assert {r.event_id for r in kept.collect()} == {"start", "end"}


def test_shuffled_path_equals_broadcast_path(spark, ts):
    created = ts("2024-01-01")
    rows = [(str(i), "hot/x" if i % 3 else f"r/{i % 50}", S.PUSH, created + timedelta(days=i % 300)) for i in range(3000)]
    names = ["hot/x"] + [f"r/{i}" for i in range(50)]
    cohort = spark.createDataFrame([(n, created) for n in names], "repo_name string, created_at timestamp")
    events = _events(spark, rows)
    small = win.events_in_window(events, cohort)
    large = win.events_in_window(events, cohort, max_broadcast_rows=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(small.columns).collect()))
    assert small.count() > 0


def test_calendar_window_differs_from_days(spark, ts):
    created = ts("2024-01-31")
    late = ts("2024-07-30 23:00:00")
    df = spark.createDataFrame([(created, late)], "c timestamp, t timestamp")
    row = df.select(
        EARLY.contains(F.col("t"), F.col("c")).alias("days"),
        EARLY_CALENDAR.contains(F.col("t"), F.col("c")).alias("months"),
    ).first()
    assert (row.days, row.months) == (True, True)
    later = ts("2024-07-31 00:00:00")
    df = spark.createDataFrame([(created, later)], "c timestamp, t timestamp")
    row = df.select(
        EARLY.contains(F.col("t"), F.col("c")).alias("days"),
        EARLY_CALENDAR.contains(F.col("t"), F.col("c")).alias("months"),
    ).first()
    assert (row.days, row.months) == (True, True)
    row = df.select(EARLY.contains(F.col("t") + F.expr("INTERVAL '1' SECOND"), F.col("c")).alias("x")).first()
    assert row.x is False


def test_label_window_floors_to_days(spark, ts):
    created = ts("2024-01-01 12:00:00")
    days = {
        547: created + timedelta(days=548, seconds=-1),
        548: created + timedelta(days=548),
        730: created + timedelta(days=731, seconds=-1),
        731: created + timedelta(days=731),
    }
    for day, when in days.items():
        df = spark.createDataFrame([(created, when)], "c timestamp, t timestamp")
        inside = df.select(LABEL.contains(F.col("t"), F.col("c")).alias("x")).first().x
        assert inside is (548 <= day <= 730), day


def test_labels_cover_the_cohort(spark, ts):
    created = ts("2024-01-01")
    cohort = spark.createDataFrame(
        [("a/a", created), ("b/b", created), ("c/c", created)], "repo_name string, created_at timestamp"
    )
    events = _events(
        spark,
        [
            ("1", "a/a", S.PUSH, created + timedelta(days=600)),
            ("2", "a/a", S.PUSH, created + timedelta(days=601)),
            ("3", "b/b", S.WATCH, created + timedelta(days=600)),
            ("4", "c/c", S.PUSH, created + timedelta(days=10)),
        ],
    )
    found = {r.repo_name: r.is_sustainable for r in lab.labels(events, cohort).collect()}
    assert found == {"a/a": 1, "b/b": 0, "c/c": 0}
    balance = {r.label: (r["count"], round(r.percentage, 3)) for r in lab.label_balance(lab.labels(events, cohort)).collect()}
    assert balance == {1: (1, 33.333), 0: (2, 66.667)}


def test_empty_cohort(spark, ts):
    cohort = spark.createDataFrame([], "repo_name string, created_at timestamp")
    events = _events(spark, [("1", "a/a", S.PUSH, ts("2024-01-01"))])
    assert win.events_in_window(events, cohort, first_days(3)).count() == 0


def test_repeated_cohort_rows_count_once(spark, ts):
    rows = [("e1", "a/1", "PushEvent", ts("2024-01-02")), ("e2", "a/1", "PushEvent", ts("2024-01-03"))]
    events = _events(spark, rows)
    once = spark.createDataFrame([("a/1", ts("2024-01-01"))], "repo_name string, created_at timestamp")
    twice = once.unionAll(once)
    for limit in (1_000_000, 0):
        assert win.events_in_window(events, twice, max_broadcast_rows=limit).count() == 2
    assert win.tracked(events, twice).count() == 2
    assert [r.is_sustainable for r in lab.labels(events, twice).collect()] == [0, 0]
