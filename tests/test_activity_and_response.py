from datetime import timedelta

import pytest

from sproutscope import schemas as S
from sproutscope.operators import activity as act
from sproutscope.operators import responsiveness as resp

SCHEMA = (
    "event_id string, repo_name string, type string, actor_login string, event_ts timestamp, "
    "action string, number string, opened_at timestamp, merged boolean"
)


@pytest.fixture
def world(spark, ts):
    created = ts("2024-01-01")
    at = lambda hours: created + timedelta(hours=hours)
    rows = [
        ("1", "a/a", S.PUSH, "ann", at(1), None, None, None, None),
        ("2", "a/a", S.PUSH, "ann", at(2), None, None, None, None),
        ("3", "a/a", S.PUSH, "", at(3), None, None, None, None),
        ("4", "a/a", S.ISSUE, "bob", at(4), "opened", "7", at(4), None),
        ("5", "a/a", S.ISSUE, "bob", at(5), "closed", "7", at(4), None),
        ("6", "a/a", S.ISSUE_COMMENT, "ann", at(7), "created", "7", at(4), None),
        ("7", "a/a", S.ISSUE_COMMENT, "ann", at(5.5), "created", "7", at(4), None),
        ("8", "a/a", S.ISSUE, "bob", at(9), "opened", "8", at(9), None),
        ("9", "a/a", S.ISSUE_COMMENT, "ann", at(8), "created", "8", at(9), None),
        ("10", "a/a", S.PULL_REQUEST, "cat", at(10), "opened", "9", at(10), False),
        ("11", "a/a", S.PULL_REQUEST, "cat", at(11), "closed", "9", at(10), True),
        ("12", "a/a", S.PULL_REQUEST, "cat", at(12), "closed", "10", at(10), None),
        ("13", "a/a", S.PULL_REQUEST, "cat", at(13), "closed", "11", at(10), False),
        ("14", "a/a", S.REVIEW_COMMENT, "ann", at(10.5), "created", "9", at(10), None),
        ("15", "a/a", S.RELEASE, "ann", at(14), "published", None, None, None),
        ("16", "a/a", S.RELEASE, "ann", at(14), "edited", None, None, None),
        ("17", "a/a", S.WATCH, "dan", at(15), "started", None, None, None),
        ("18", "a/a", S.FORK, "dan", at(16), None, None, None, None),
        ("19", "zz/z", S.FORK, "dan", at(16), None, None, None, None),
    ]
    cohort = spark.createDataFrame(
        [("a/a", created), ("q/q", created)], "repo_name string, created_at timestamp"
    )
    return spark.createDataFrame(rows, SCHEMA), cohort


def test_activity_vector(world):
    rows = {r.repo_name: r.asDict() for r in act.activity(*world).collect()}
    assert set(rows) == {"a/a", "q/q"}
    assert rows["a/a"] == {
        "repo_name": "a/a", "total_commits": 3, "unique_commit_authors": 2, "issues_opened": 2,
        "issues_closed": 1, "prs_opened": 1, "prs_merged": 1, "prs_rejected": 2, "num_releases": 1,
        "star_count": 1, "fork_count": 1, "total_issue_comments": 3, "total_pr_comments": 1,
    }
    assert all(v == 0 for k, v in rows["q/q"].items() if k != "repo_name")


def test_null_merge_flag_can_count_as_neither(world):
    rows = {r.repo_name: r for r in act.activity(*world, null_merged="neither").collect()}
    assert (rows["a/a"].prs_merged, rows["a/a"].prs_rejected) == (1, 1)


def test_sketched_authors(world):
    rows = {r.repo_name: r for r in act.activity(*world, approximate_authors=0.01).collect()}
    assert rows["a/a"].unique_commit_authors == 2


def test_fractional_response(world):
    rows = {r.repo_name: r for r in resp.responsiveness(*world).collect()}
    # issue 7 answered after 1.5 h; issue 8 was commented on before it opened
    assert rows["a/a"].avg_issue_first_response_hrs == pytest.approx(1.5)
    assert rows["a/a"].avg_pr_first_response_hrs == pytest.approx(0.5)
    assert rows["q/q"].avg_issue_first_response_hrs is None


def test_whole_hour_response_keeps_negative(world):
    rows = {r.repo_name: r for r in resp.responsiveness(*world, mode="hours").collect()}
    assert rows["a/a"].avg_issue_first_response_hrs == pytest.approx((1 - 1) / 2)
    assert rows["a/a"].avg_pr_first_response_hrs == pytest.approx(0.0)


def test_unknown_mode(world):
    with pytest.raises(ValueError):
        resp.responsiveness(*world, mode="days")
