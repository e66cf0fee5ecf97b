"""Windows, joins, activity and responsiveness."""

from pyspark.sql import functions as F

from checks.adapters import rounded, with_archive, with_commits
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.functions.anchored import LABEL
from sproutscope.functions.scalars import hours_between, whole_days_between, whole_hours_between
from sproutscope.operators import activity as act
from sproutscope.operators import cohort as co
from sproutscope.operators import responsiveness as resp
from sproutscope.operators import windows as win
from sproutscope.operators.features import assemble, with_rates
from sproutscope.sources import events as src
from sproutscope.sources.tables import run_query


ACTIVITY_SQL = """
SELECT c.repo_name,
  count(*) FILTER (type = 'PushEvent') AS total_commits,
  count(DISTINCT CASE WHEN type = 'PushEvent' THEN actor_login END) AS unique_commit_authors,
  count(*) FILTER (type = 'IssuesEvent' AND action = 'opened') AS issues_opened,
  count(*) FILTER (type = 'IssuesEvent' AND action = 'closed') AS issues_closed,
  count(*) FILTER (type = 'PullRequestEvent' AND action = 'opened') AS prs_opened,
  count(*) FILTER (type = 'PullRequestEvent' AND action = 'closed' AND merged) AS prs_merged,
  count(*) FILTER (type = 'PullRequestEvent' AND action = 'closed' AND NOT coalesce(merged, false)) AS prs_rejected,
  count(*) FILTER (type = 'ReleaseEvent' AND action = 'published') AS num_releases,
  count(*) FILTER (type = 'WatchEvent' AND action = 'started') AS star_count,
  count(*) FILTER (type = 'ForkEvent') AS fork_count,
  count(*) FILTER (type = 'IssueCommentEvent') AS total_issue_comments,
  count(*) FILTER (type = 'PullRequestReviewCommentEvent') AS total_pr_comments
FROM cohort c LEFT JOIN early e ON c.repo_name = e.repo_name GROUP BY 1
"""


@check("agg1_activity_vector", with_archive(ACTIVITY_SQL))
def _(t):
    return act.activity(t.archive, t.cohort)


@check(
    "agg3_pr_outcome_strict",
    with_archive("""
SELECT repo_name,
  count(*) FILTER (type = 'PullRequestEvent' AND action = 'closed' AND merged) AS prs_merged,
  count(*) FILTER (type = 'PullRequestEvent' AND action = 'closed' AND NOT merged) AS prs_rejected
FROM early GROUP BY 1
"""),
)
def _(t):
    counts = act.activity_counts(win.events_in_window(t.archive, t.cohort), null_merged="neither")
    return counts.select("repo_name", "prs_merged", "prs_rejected")


@check(
    "agg2_commit_authors_exploded",
    with_commits("""
SELECT c.repo_name, count(l_partkey) AS total_commits, count(DISTINCT 'p' || l_partkey % 50) FILTER (l_partkey IS NOT NULL) AS commit_authors
FROM commit_cohort c LEFT JOIN commits m ON c.repo_name = m.repo_name
  AND m.event_ts BETWEEN c.created_at AND c.created_at + INTERVAL 6 MONTH
LEFT JOIN lineitem ON l_orderkey = m.event_id
GROUP BY 1
"""),
)
def _(t):
    good, _bad = src.split_corrupt(src.parse_event_lines(t.push_lines))
    return act.commit_authors_exploded(src.flatten_events(good), t.commit_cohort)


@check(
    "jon1_events_in_window",
    with_archive("""
SELECT event_id, repo_name, type, actor_login, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM early
"""),
)
def _(t):
    return rounded(
        win.events_in_window(t.archive, t.cohort).select(
            "event_id", "repo_name", "type", "actor_login", "event_ts"
        )
    )


@check(
    "jon2_tracked_events",
    with_archive("""
SELECT repo_name, type, count(*) AS events FROM archive WHERE repo_name IN (SELECT repo_name FROM cohort WHERE is_fork)
GROUP BY 1, 2
"""),
)
def _(t):
    forks = t.cohort.where("is_fork")
    return win.tracked(t.archive, forks).groupBy("repo_name", "type").agg(F.count("*").alias("events"))


@check(
    "jon3_zero_filled_types",
    with_archive("""
SELECT c.repo_name, coalesce(p.pushes, 0) AS pushes, coalesce(s.stars, 0) AS stars FROM cohort c
LEFT JOIN (SELECT repo_name, count(*) AS pushes FROM early WHERE type = 'PushEvent' GROUP BY 1) p USING (repo_name)
LEFT JOIN (SELECT repo_name, count(*) AS stars FROM early WHERE type = 'WatchEvent' GROUP BY 1) s USING (repo_name)
"""),
)
def _(t):
    counts = win.events_in_window(t.archive, t.cohort).groupBy("repo_name").agg(
        F.count_if(F.col("type") == S.PUSH).alias("pushes"),
        F.count_if(F.col("type") == S.WATCH).alias("stars"),
    )
    return assemble(t.cohort.select("repo_name"), counts, zeros=["pushes", "stars"])


@check(
    "flt1_event_types",
    with_archive("SELECT type, count(*) AS events FROM archive WHERE type IN ('PushEvent', 'ForkEvent') GROUP BY 1"),
)
def _(t):
    return co.of_type(t.archive, S.PUSH, S.FORK).groupBy("type").agg(F.count("*").alias("events"))


@check(
    "flt5_early_days",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 182 DAY
""",
)
def _(t):
    rows = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return win.early_window(rows, "l_shipdate", "o_orderdate").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@check(
    "flt6_early_months",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 6 MONTH
""",
)
def _(t):
    rows = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return win.early_window_months(rows, "l_shipdate", "o_orderdate").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@check(
    "flt7_label_window",
    with_commits("""
SELECT event_id, repo_name FROM commits JOIN commit_cohort USING (repo_name)
WHERE date_sub('day', created_at, event_ts) BETWEEN 548 AND 730
"""),
)
def _(t):
    return win.events_in_window(t.commits, t.commit_cohort, LABEL).select("event_id", "repo_name")


@check(
    "flt7_label_window_rows",
    """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE date_sub('day', o_orderdate, l_shipdate) BETWEEN 548 AND 730
""",
)
def _(t):
    rows = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return win.label_window(rows, "l_shipdate", "o_orderdate").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@check(
    "flt8_active_only",
    with_archive(f"SELECT repo_name, total_commits FROM ({ACTIVITY_SQL}) WHERE total_commits >= 3"),
)
def _(t):
    return co.active_only(act.activity(t.archive, t.cohort), 3).select("repo_name", "total_commits")


THREADS_SQL = """
SELECT c.repo_name,
  round(avg(CASE WHEN kind = 'issue' THEN hrs END), 6) AS avg_issue_first_response_hrs,
  round(avg(CASE WHEN kind = 'pr' THEN hrs END), 6) AS avg_pr_first_response_hrs
FROM cohort c LEFT JOIN ({pairs}) p ON c.repo_name = p.repo_name GROUP BY 1
"""


@check(
    "agg6_responsiveness_fractional",
    with_archive(THREADS_SQL.format(pairs="""
  SELECT o.repo_name, o.kind, (epoch(r.responded_at) - epoch(o.opened_at)) / 3600.0 AS hrs
  FROM (SELECT repo_name, CASE type WHEN 'IssuesEvent' THEN 'issue' ELSE 'pr' END AS kind, number,
          arg_min(opened_at, (event_ts, event_id)) AS opened_at
        FROM early WHERE type IN ('IssuesEvent', 'PullRequestEvent') AND action = 'opened' GROUP BY 1, 2, 3) o
  JOIN (SELECT repo_name, CASE type WHEN 'IssueCommentEvent' THEN 'issue' ELSE 'pr' END AS kind, number,
          min(event_ts) AS responded_at
        FROM early WHERE type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent') GROUP BY 1, 2, 3) r
    USING (repo_name, kind, number)
  WHERE r.responded_at >= o.opened_at""")),
)
def _(t):
    return rounded(resp.responsiveness(t.archive, t.cohort))


@check(
    "agg7_responsiveness_hours",
    with_archive(THREADS_SQL.format(pairs="""
  SELECT a.repo_name, CASE type WHEN 'IssueCommentEvent' THEN 'issue' ELSE 'pr' END AS kind, number,
    date_sub('hour', min(opened_at), min(event_ts)) AS hrs
  FROM archive a JOIN cohort c USING (repo_name)
  WHERE type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent')
    AND event_ts BETWEEN created_at AND created_at + INTERVAL 6 MONTH
  GROUP BY a.repo_name, 2, number""")),
)
def _(t):
    return rounded(resp.responsiveness(t.archive, t.cohort, mode="hours"))


@check(
    "agg4_agg5_threads",
    with_archive("""
SELECT repo_name, CASE WHEN type IN ('IssuesEvent', 'IssueCommentEvent') THEN 'issue' ELSE 'pr' END AS kind, number,
  strftime(arg_min(opened_at, (event_ts, event_id)) FILTER (type IN ('IssuesEvent', 'PullRequestEvent') AND action = 'opened'),
    '%Y-%m-%d %H:%M:%S') AS opened_at,
  strftime(min(event_ts) FILTER (type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent')), '%Y-%m-%d %H:%M:%S')
    AS responded_at
FROM early
WHERE type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent')
   OR (type IN ('IssuesEvent', 'PullRequestEvent') AND action = 'opened')
GROUP BY 1, 2, 3
"""),
)
def _(t):
    return rounded(resp.threads(win.events_in_window(t.archive, t.cohort)))


@check(
    "jon4_open_to_ship_pairs",
    """
SELECT o_orderkey, (epoch(first_ship) - epoch(o_orderdate)) / 3600.0 AS hours
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE first_ship >= o_orderdate
""",
)
def _(t):
    """An order as an opened issue, each of its shipments as a comment on it."""
    opened = t.table("orders").select(
        F.col("o_orderkey").alias("key"), F.lit(S.ISSUE).alias("type"), F.lit("opened").alias("action"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"), F.col("o_orderdate").cast("timestamp").alias("opened_at"),
    )
    shipped = t.table("lineitem").select(
        F.col("l_orderkey").alias("key"), F.lit(S.ISSUE_COMMENT).alias("type"), F.lit("created").alias("action"),
        F.col("l_shipdate").cast("timestamp").alias("event_ts"), F.lit(None).cast("timestamp").alias("opened_at"),
    )
    text = F.col("key").cast("string")
    events = opened.unionByName(shipped).withColumns({"repo_name": text, "number": text, "event_id": F.xxhash64("key", "type", "event_ts").cast("string")})
    pairs = resp.threads(events).where("opened_at IS NOT NULL AND responded_at IS NOT NULL")
    hours = hours_between(F.col("opened_at"), F.col("responded_at"))
    return pairs.select(F.col("number").cast("long").alias("o_orderkey"), hours.alias("hours")).where(F.col("hours") >= 0)


@check(
    "fn6_time_differences",
    """
SELECT o_orderkey, l_linenumber, l_partkey, date_sub('hour', o_orderdate, l_shipdate) AS hours,
  date_sub('day', o_orderdate, l_shipdate) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
)
def _(t):
    rows = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    opened, shipped = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    return rows.select(
        "o_orderkey", "l_linenumber", "l_partkey",
        whole_hours_between(opened, shipped).alias("hours"),
        whole_days_between(opened, shipped).alias("days"),
    )


@check(
    "fn8_fn9_rates",
    with_archive(f"""
SELECT repo_name,
  round(CASE WHEN prs_opened > 0 THEN prs_merged / prs_opened::DOUBLE END, 6) AS pr_acceptance_rate,
  round(CASE WHEN issues_opened > 0 THEN issues_closed / issues_opened::DOUBLE END, 6) AS issue_close_rate,
  round(total_commits / 26.0, 6) AS commit_frequency_per_week
FROM ({ACTIVITY_SQL})
"""),
)
def _(t):
    rates = with_rates(act.activity(t.archive, t.cohort))
    return rounded(
        rates.select("repo_name", "pr_acceptance_rate", "issue_close_rate", "commit_frequency_per_week")
    )


@check(
    "jon9_activity_with_responsiveness",
    with_archive(
        f"SELECT a.repo_name, total_commits, avg_issue_first_response_hrs, avg_pr_first_response_hrs "
        f"FROM ({ACTIVITY_SQL}) a LEFT JOIN ("
        + THREADS_SQL.format(pairs="""
  SELECT a.repo_name, CASE type WHEN 'IssueCommentEvent' THEN 'issue' ELSE 'pr' END AS kind, number,
    date_sub('hour', min(opened_at), min(event_ts)) AS hrs
  FROM archive a JOIN cohort c USING (repo_name)
  WHERE type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent')
    AND event_ts BETWEEN created_at AND created_at + INTERVAL 6 MONTH
  GROUP BY a.repo_name, 2, number""")
        + ") r ON a.repo_name = r.repo_name"
    ),
)
def _(t):
    joined = assemble(
        act.activity(t.archive, t.cohort), resp.responsiveness(t.archive, t.cohort, mode="hours")
    )
    return rounded(joined.select("repo_name", "total_commits", *S.RESPONSE_COLUMNS))


@check(
    "jon8_activity_with_creation",
    with_archive(f"""
SELECT a.repo_name, star_count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM ({ACTIVITY_SQL}) a LEFT JOIN cohort c ON a.repo_name = c.repo_name
"""),
)
def _(t):
    joined = assemble(act.activity(t.archive, t.cohort), t.cohort.select("repo_name", "created_at"))
    return rounded(joined.select("repo_name", "star_count", "created_at"))


@check(
    "src6_sql_text",
    with_archive("""
SELECT repo_name, count(*) AS pushes FROM early WHERE type = 'PushEvent' GROUP BY 1
"""),
)
def _(t):
    return run_query(
        t.spark,
        """
        SELECT e.repo_name, count(*) AS pushes FROM {events} e JOIN {repos} r ON e.repo_name = r.repo_name
        WHERE e.type = 'PushEvent' AND e.event_ts BETWEEN r.created_at AND r.created_at + INTERVAL '182' DAY
        GROUP BY e.repo_name
        """,
        events=t.archive,
        repos=t.cohort,
    )
