import math
import random

import pytest

from sproutscope.operators import contributors as con

SCHEMA = "repo_name string, month string, contributor string, commit_count long"


def _one(df):
    return df.first().asDict()


def test_worked_example(spark):
    cm = spark.createDataFrame(
        [("r", "2024-01", "a", 8), ("r", "2024-01", "b", 1), ("r", "2024-02", "a", 1)], SCHEMA
    )
    health = _one(con.concentration(cm))
    assert health["bus_factor"] == 1
    assert health["contributor_gini"] == pytest.approx(0.466667, abs=1e-6)
    by_contributor = _one(con.concentration(cm, grain="contributor"))
    assert by_contributor["bus_factor"] == 1
    with pytest.raises(ValueError):
        con.concentration(cm, grain="week")


def test_single_row(spark):
    cm = spark.createDataFrame([("r", "2024-01", "a", 5)], SCHEMA)
    health = _one(con.contributor_health(cm))
    assert health["bus_factor"] == 1
    assert health["contributor_gini"] is None
    assert health["retention_m3"] is None and health["retention_m6"] is None
    assert health["months_to_first_external_contrib"] is None


def test_active_months_not_calendar_months(spark):
    rows = [("r", "2024-01", "a", 1), ("r", "2024-01", "b", 1), ("r", "2024-04", "c", 1), ("r", "2024-09", "b", 1)]
    kept = _one(con.retention(spark.createDataFrame(rows, SCHEMA)))
    assert kept["retention_m3"] == 0.5
    assert kept["retention_m6"] is None


def test_first_external_counts_active_months(spark):
    rows = [("r", "2024-01", "a", 1), ("r", "2024-03", "a", 1), ("r", "2024-08", "z", 1), ("s", "2024-01", "a", 1), ("s", "2024-01", "b", 1)]
    found = {r.repo_name: r.months_to_first_external_contrib for r in con.first_external(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"r": 2, "s": 0}


def _plain_bus(counts, share=0.8):
    total, running, below = sum(counts), 0, 0
    for n in sorted(counts, reverse=True):
        running += n
        below += running < total * share
    return below + 1


def _plain_gini(counts):
    if len(counts) < 2:
        return None
    ordered, n = sorted(counts), len(counts)
    return 2 * sum(i * x for i, x in enumerate(ordered, 1)) / (n * sum(ordered)) - (n + 1) / n


def test_histogram_form_equals_row_form(spark):
    random.seed(5)
    rows, want = [], {}
    for r in range(60):
        counts = [random.choice([1, 1, 1, 2, 2, 3, 5, 8, 40]) for _ in range(random.randint(1, 40))]
        want[f"r{r}"] = (_plain_bus(counts), _plain_gini(counts))
        rows += [(f"r{r}", "2024-01", f"c{i}", n) for i, n in enumerate(counts)]
    for row in con.concentration(spark.createDataFrame(rows, SCHEMA)).collect():
        bus, gini = want[row.repo_name]
        assert row.bus_factor == bus
        assert (row.contributor_gini is None) == (gini is None)
        if gini is not None:
            assert math.isclose(row.contributor_gini, gini, abs_tol=1e-9)
        assert 1 <= row.bus_factor <= sum(1 for x in rows if x[0] == row.repo_name)


def test_retention_against_sets(spark):
    random.seed(9)
    rows, want = [], {}
    for r in range(40):
        months = [f"2024-{m:02d}" for m in sorted(random.sample(range(1, 13), random.randint(1, 8)))]
        sets = {m: set(random.sample("abcdefg", random.randint(1, 5))) for m in months}
        first = sets[months[0]]
        share = lambda k: len(first & sets[months[k - 1]]) / len(first) if len(months) >= k else None
        seen, external = set(), None
        founder = sorted(first)[0]
        for i, m in enumerate(months):
            if sets[m] - {founder}:
                external = i
                break
        want[f"r{r}"] = (share(3), share(6), external)
        rows += [(f"r{r}", m, c, 1) for m in months for c in sets[m]]
    for row in con.contributor_health(spark.createDataFrame(rows, SCHEMA)).collect():
        m3, m6, external = want[row.repo_name]
        assert row.retention_m3 == (None if m3 is None else pytest.approx(m3))
        assert row.retention_m6 == (None if m6 is None else pytest.approx(m6))
        assert row.months_to_first_external_contrib == external
