"""Labels, divergence and the assembled dataset."""

from pyspark.sql import functions as F

from checks.activity import ACTIVITY_SQL
from checks.adapters import rounded, with_archive, with_commits
from checks.contributors import BUS_SQL, EXTERNAL_SQL, GINI_SQL, RETENTION_SQL
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.operators import governance as gov
from sproutscope.operators import labels as lab
from sproutscope.operators import profiles
from sproutscope.operators.cohort import pending
from sproutscope.plans import study


@check("agg12_labels", with_commits("SELECT * FROM labelled"))
def _(t):
    return lab.labels(t.commits, t.commit_cohort)


@check(
    "jon7_attach_labels",
    with_commits("""
SELECT c.repo_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, is_sustainable
FROM commit_cohort c LEFT JOIN labelled l ON c.repo_name = l.repo_name
"""),
)
def _(t):
    return rounded(lab.attach_labels(t.commit_cohort, lab.labels(t.commits, t.commit_cohort)))


@check(
    "agg13_label_balance",
    with_commits("""
SELECT is_sustainable AS label, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage
FROM labelled GROUP BY 1
"""),
)
def _(t):
    return rounded(lab.label_balance(lab.labels(t.commits, t.commit_cohort)))


DIVERGENCE_SQL = """
SELECT c.repo_name, own AS early_commits_on_branch,
  CASE WHEN parent_repo IS NOT NULL THEN coalesce(par, 0) END AS parent_early_commits,
  round(CASE WHEN parent_repo IS NOT NULL AND own + coalesce(par, 0) > 0 THEN own / (own + coalesce(par, 0))::DOUBLE END, 6)
    AS divergence_ratio
FROM cohort c
JOIN (SELECT c.repo_name, count(a.repo_name) AS own FROM cohort c LEFT JOIN archive a
        ON a.repo_name = c.repo_name AND type = 'PushEvent'
        AND event_ts BETWEEN created_at AND created_at + INTERVAL 182 DAY GROUP BY 1) o ON o.repo_name = c.repo_name
LEFT JOIN (SELECT c.repo_name, count(*) AS par FROM cohort c JOIN archive a
        ON a.repo_name = c.parent_repo AND type = 'PushEvent'
        AND event_ts BETWEEN created_at AND created_at + INTERVAL 182 DAY GROUP BY 1) p ON p.repo_name = c.repo_name
"""


@check("jon11_gov3_divergence", with_archive(DIVERGENCE_SQL))
def _(t):
    pushes = t.archive.where(F.col("type") == S.PUSH)
    return rounded(gov.divergence(pushes, t.cohort))


DATASET_SQL = f"""
SELECT c.repo_name, c.is_fork, c.fork_owner_type, strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  total_commits, round(total_commits / 26.0, 6) AS commit_frequency_per_week, unique_commit_authors,
  issues_opened, issues_closed, round(CASE WHEN issues_opened > 0 THEN issues_closed / issues_opened::DOUBLE END, 6) AS issue_close_rate,
  prs_opened, prs_merged, prs_rejected, round(CASE WHEN prs_opened > 0 THEN prs_merged / prs_opened::DOUBLE END, 6) AS pr_acceptance_rate,
  num_releases, star_count, fork_count, total_issue_comments, total_pr_comments,
  avg_issue_first_response_hrs, avg_pr_first_response_hrs,
  bus_factor, contributor_gini, retention_m3, retention_m6, months_to_first_external_contrib,
  early_commits_on_branch, parent_early_commits, divergence_ratio, is_sustainable
FROM cohort c
LEFT JOIN ({ACTIVITY_SQL}) a ON c.repo_name = a.repo_name
LEFT JOIN (
  SELECT repo_name, round(avg(CASE WHEN kind = 'issue' THEN hrs END), 6) AS avg_issue_first_response_hrs,
    round(avg(CASE WHEN kind = 'pr' THEN hrs END), 6) AS avg_pr_first_response_hrs
  FROM (
    SELECT repo_name, kind, (epoch(responded_at) - epoch(opened_at)) / 3600.0 AS hrs FROM (
      SELECT repo_name, CASE WHEN type IN ('IssuesEvent', 'IssueCommentEvent') THEN 'issue' ELSE 'pr' END AS kind, number,
        arg_min(opened_at, (event_ts, event_id)) FILTER (type IN ('IssuesEvent', 'PullRequestEvent') AND action = 'opened') AS opened_at,
        min(event_ts) FILTER (type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent')) AS responded_at
      FROM early GROUP BY 1, 2, 3) WHERE responded_at >= opened_at) GROUP BY 1
) r ON c.repo_name = r.repo_name
LEFT JOIN ({BUS_SQL.format(source="cm", tie=", month")}) b ON c.repo_name = b.repo_name
LEFT JOIN ({GINI_SQL.format(source="cm", tie=", month")}) g ON c.repo_name = g.repo_name
LEFT JOIN ({RETENTION_SQL}) t ON c.repo_name = t.repo_name
LEFT JOIN ({EXTERNAL_SQL}) x ON c.repo_name = x.repo_name
LEFT JOIN ({DIVERGENCE_SQL}) d ON c.repo_name = d.repo_name
JOIN (SELECT c.repo_name, CAST(max(CASE WHEN type = 'PushEvent'
        AND date_sub('day', created_at, event_ts) BETWEEN 548 AND 730 THEN 1 ELSE 0 END) AS INTEGER) AS is_sustainable
      FROM cohort c JOIN archive a ON a.repo_name = c.repo_name GROUP BY 1) l ON c.repo_name = l.repo_name
"""


@check("jon6_study_dataset", with_archive(DATASET_SQL))
def study_dataset(t):
    pushes = t.archive.where(F.col("type") == S.PUSH)
    return rounded(
        study.labelled_dataset(t.archive, t.cohort, gov.divergence(pushes, t.cohort))
    )


@check(
    "jon10_pending_work",
    with_commits("""
SELECT repo_name FROM commit_cohort WHERE repo_name NOT IN (SELECT repo_name FROM labelled WHERE is_sustainable = 1)
"""),
)
def _(t):
    done = lab.labels(t.commits, t.commit_cohort).where(F.col("is_sustainable") == 1)
    return pending(t.commit_cohort, done).select("repo_name")


@check(
    "agg17_dataset_summary",
    with_archive(f"""
SELECT count(*) AS total, count(*) FILTER (is_fork) AS forks, count(*) FILTER (NOT is_fork) AS non_forks,
  count(*) FILTER (total_commits > 0) AS with_commits, count(*) FILTER (prs_opened > 0) AS with_prs,
  count(*) FILTER (issues_opened > 0) AS with_issues, count(*) FILTER (parent_repo IS NOT NULL) AS with_cicd,
  count(*) FILTER (fork_owner_type = 'User') AS with_license
FROM cohort c JOIN ({ACTIVITY_SQL}) a ON a.repo_name = c.repo_name
"""),
)
def _(t):
    from sproutscope.operators.activity import activity
    from sproutscope.operators.features import assemble

    wide = assemble(t.cohort, activity(t.archive, t.cohort)).withColumns(
        {"has_cicd": F.col("parent_repo").isNotNull(), "has_license": F.col("fork_owner_type") == "User"}
    )
    return profiles.dataset_summary(wide)


NULLABLE = [
    "avg_issue_first_response_hrs", "avg_pr_first_response_hrs", "bus_factor", "contributor_gini",
    "divergence_ratio", "issue_close_rate", "months_to_first_external_contrib", "parent_early_commits",
    "pr_acceptance_rate", "retention_m3", "retention_m6",
]


@check(
    "agg18_null_profile",
    with_archive(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM data" for c in NULLABLE
        )
        + ") ORDER BY nulls DESC, \"column\" LIMIT 10"
    ).replace("\nSELECT * FROM (", f", data AS ({DATASET_SQL})\nSELECT * FROM (", 1),
)
def _(t):
    return profiles.null_profile(study_dataset(t).select(*NULLABLE))
