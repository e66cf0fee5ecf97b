"""Monthly commit series and the filters on them."""

from pyspark.sql import functions as F

from checks.adapters import rounded, with_archive, with_commits
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.operators import series as ser
from sproutscope.operators.cohort import duplicate_rows
from sproutscope.session import new_path
from sproutscope.sources import tables as tab

MONTHLY_SQL = """
SELECT repo_name, strftime(event_ts, '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY 1, 2
"""


@check("agg9_monthly_series", with_commits(MONTHLY_SQL))
def _(t):
    return ser.series_rows(ser.monthly_series(t.commits))


@check(
    "agg10_commits_after",
    with_commits("""
SELECT repo_name, count(*) FILTER (event_ts >= created_at + INTERVAL 2 MONTH) AS commits_post
FROM commits JOIN commit_cohort USING (repo_name) GROUP BY 1
"""),
)
def _(t):
    return ser.commits_after(t.commits)


EARLY_SUSTAINED_SQL = f"""
SELECT repo_name, CAST(sum(CASE WHEN i <= 3 THEN commits ELSE 0 END) AS BIGINT) AS early_commits,
  CAST(sum(CASE WHEN i > 3 THEN commits ELSE 0 END) AS BIGINT) AS sustained_commits,
  CASE WHEN sum(CASE WHEN i > 3 THEN commits ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS healthy
FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY month) AS i FROM ({MONTHLY_SQL})) GROUP BY 1
"""


@check("agg11_win5_early_sustained", with_commits(EARLY_SUSTAINED_SQL))
def _(t):
    return ser.early_sustained(ser.monthly_counts(t.commits))


@check(
    "agg11_issue_totals",
    with_archive("""
SELECT repo_name, opened + closed AS total_issues,
  round(CASE WHEN opened + closed > 0 THEN closed / (opened + closed)::DOUBLE ELSE 0 END, 6) AS issue_closure_rate
FROM (SELECT repo_name, count(*) FILTER (type = 'IssuesEvent' AND action = 'opened') AS opened,
        count(*) FILTER (type = 'IssuesEvent' AND action = 'closed') AS closed FROM early GROUP BY 1)
"""),
)
def _(t):
    from sproutscope.operators.activity import activity_counts
    from sproutscope.operators.windows import events_in_window

    counts = activity_counts(events_in_window(t.archive, t.cohort))
    return rounded(
        ser.issue_totals(counts, "issues_opened", "issues_closed").select(
            "repo_name", "total_issues", "issue_closure_rate"
        )
    )


@check(
    "flt12_eda_population",
    with_commits(f"SELECT * FROM ({EARLY_SUSTAINED_SQL}) WHERE early_commits + sustained_commits >= 15"),
)
def _(t):
    return ser.eda_population(ser.early_sustained(ser.monthly_counts(t.commits)))


def _documents(t):
    """A commit-series document per customer: forked at the first order of the next-lower customer."""
    series = ser.monthly_series(t.commits)
    created = t.commit_cohort.select(
        "repo_name", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("forkTime")
    )
    customers = t.table("customer").select(
        F.concat(F.lit("c/"), F.col("c_custkey")).alias("repo_name"), "c_custkey"
    )
    return (
        customers.join(created, "repo_name")
        .join(series, "repo_name")
        .select(
            F.lit("c").alias("childOwner"),
            F.col("c_custkey").cast("string").alias("childName"),
            "forkTime",
            F.when(F.col("c_custkey") % 10 != 0, F.col("commit_times")).alias("commitTimes"),
        )
    )


@check(
    "flt10_non_empty_series",
    with_commits("SELECT substr(repo_name, 3) AS \"childName\" FROM commit_cohort WHERE CAST(substr(repo_name, 3) AS BIGINT) % 10 <> 0"),
)
def _(t):
    return ser.non_empty_series(_documents(t)).select("childName")


@check(
    "flt11_popular_three_months",
    with_commits("""
SELECT substr(repo_name, 3) AS "childName" FROM commits JOIN commit_cohort USING (repo_name)
WHERE event_ts < date_trunc('month', created_at) + INTERVAL 3 MONTH AND CAST(substr(repo_name, 3) AS BIGINT) % 10 <> 0
GROUP BY repo_name HAVING count(*) > 2
"""),
)
def _(t):
    return ser.popular(_documents(t), months=3, more_than=2).select("childName")


@check(
    "flt9_min_commits",
    with_archive("""
SELECT c.repo_name, count(*) AS commits FROM cohort c JOIN archive a ON a.repo_name = c.repo_name
WHERE type = 'PushEvent' AND event_ts >= created_at GROUP BY 1 HAVING count(*) >= 15
"""),
)
def _(t):
    pushes = t.archive.where(F.col("type") == S.PUSH)
    return ser.min_commits(pushes, t.cohort).select("repo_name", "commits")


@check(
    "flt9_min_commits_first_months",
    with_archive("""
SELECT c.repo_name, count(*) AS commits FROM cohort c JOIN archive a ON a.repo_name = c.repo_name
WHERE type = 'PushEvent' AND event_ts BETWEEN created_at AND date_trunc('month', created_at) + INTERVAL 3 MONTH
GROUP BY 1 HAVING count(*) >= 2
"""),
)
def _(t):
    pushes = t.archive.where(F.col("type") == S.PUSH)
    return ser.min_commits(pushes, t.cohort, n=2, months=3).select("repo_name", "commits")


@check(
    "src4_uni1_series_documents",
    with_commits("""
SELECT substr(repo_name, 3) AS "childName", strftime(min(event_ts), '%Y-%m-%dT%H:%M:%SZ') AS "forkTime",
  CASE WHEN CAST(substr(repo_name, 3) AS BIGINT) % 10 <> 0 THEN count(*) END AS commits
FROM commits GROUP BY repo_name
"""),
)
def _(t):
    """Documents written as JSON and read back with the series schema."""
    path = new_path(t.spark, "series")
    tab.write_jsonl(_documents(t), path)
    documents = tab.read_commit_series(t.spark, f"{path}/*.json", one_per_line=True)
    counts = F.aggregate(F.map_values("commitTimes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return documents.select("childName", "forkTime", counts.alias("commits"))


@check(
    "ded2_duplicate_series",
    with_commits("""
SELECT count(*) AS groups, CAST(sum(copies) AS BIGINT) AS copies FROM (
  SELECT months, count(*) AS copies FROM (
    SELECT repo_name, string_agg(month || ':' || commits, ',' ORDER BY month) AS months FROM (
      SELECT repo_name, 'm' || month(event_ts) % 2 AS month, least(count(*), 3) AS commits FROM commits GROUP BY 1, 2)
    GROUP BY 1) GROUP BY 1 HAVING count(*) > 1)
"""),
)
def _(t):
    """Whole-row duplicates where the row is a map."""
    half = F.concat(F.lit("m"), F.month("event_ts") % 2)
    counts = t.commits.groupBy("repo_name", half.alias("month")).agg(
        F.least(F.count("*"), F.lit(3)).alias("commits")
    )
    maps = counts.groupBy("repo_name").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "commits"))).alias("commitTimes")
    )
    return duplicate_rows(maps.select("commitTimes")).agg(
        F.count("*").alias("groups"), F.sum("copies").alias("copies")
    )
