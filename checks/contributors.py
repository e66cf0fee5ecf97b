"""Contributor-month series and contributor health."""

from checks.adapters import rounded, with_archive
from checks.registry import check
from sproutscope.operators import contributors as con


def _cm(t):
    return con.contributor_months(t.archive, t.cohort)


@check("agg8_contributor_months", with_archive("SELECT * FROM cm"))
def _(t):
    return _cm(t)


BUS_SQL = """
SELECT repo_name, CAST(count(*) FILTER (running < 0.8::DOUBLE * total) + 1 AS BIGINT) AS bus_factor FROM (
  SELECT repo_name, sum(commit_count) OVER (PARTITION BY repo_name) AS total,
    sum(commit_count) OVER (PARTITION BY repo_name ORDER BY commit_count DESC, contributor{tie}
      ROWS UNBOUNDED PRECEDING) AS running
  FROM {source}) GROUP BY 1
"""

GINI_SQL = """
SELECT repo_name, round(CASE WHEN count(*) >= 2
    THEN 2.0 * sum(i * commit_count) / (count(*) * sum(commit_count)) - (count(*) + 1.0) / count(*) END, 6) AS contributor_gini
FROM (SELECT repo_name, commit_count,
        row_number() OVER (PARTITION BY repo_name ORDER BY commit_count, contributor{tie}) AS i FROM {source})
GROUP BY 1
"""

BY_CONTRIBUTOR = "(SELECT repo_name, contributor, sum(commit_count) AS commit_count FROM cm GROUP BY 1, 2)"


@check("win1_bus_factor", with_archive(BUS_SQL.format(source="cm", tie=", month")))
def _(t):
    return con.bus_factor(_cm(t))


@check("win1_bus_factor_by_contributor", with_archive(BUS_SQL.format(source=BY_CONTRIBUTOR, tie="")))
def _(t):
    return con.bus_factor(_cm(t), grain="contributor")


@check("win4_gini", with_archive(GINI_SQL.format(source="cm", tie=", month")))
def _(t):
    return rounded(con.gini(_cm(t)))


@check("win4_gini_by_contributor", with_archive(GINI_SQL.format(source=BY_CONTRIBUTOR, tie="")))
def _(t):
    return rounded(con.gini(_cm(t), grain="contributor"))


RETENTION_SQL = """
SELECT repo_name,
  round(CASE WHEN months >= 3 THEN back3 / first_size::DOUBLE END, 6) AS retention_m3,
  round(CASE WHEN months >= 6 THEN back6 / first_size::DOUBLE END, 6) AS retention_m6
FROM (
  SELECT r.repo_name, max(k) AS months,
    count(DISTINCT CASE WHEN k = 1 THEN r.contributor END) AS first_size,
    count(DISTINCT CASE WHEN k = 3 AND f.contributor IS NOT NULL THEN r.contributor END) AS back3,
    count(DISTINCT CASE WHEN k = 6 AND f.contributor IS NOT NULL THEN r.contributor END) AS back6
  FROM (SELECT *, dense_rank() OVER (PARTITION BY repo_name ORDER BY month) AS k FROM cm) r
  LEFT JOIN (SELECT repo_name, contributor FROM (
      SELECT *, dense_rank() OVER (PARTITION BY repo_name ORDER BY month) AS k FROM cm) WHERE k = 1) f
    ON r.repo_name = f.repo_name AND r.contributor = f.contributor
  GROUP BY 1)
"""


@check("win2_retention", with_archive(RETENTION_SQL))
def _(t):
    return rounded(con.retention(_cm(t)))


EXTERNAL_SQL = """
SELECT r.repo_name, CAST(min(CASE WHEN r.contributor <> f.founder THEN r.k - 1 END) AS BIGINT)
  AS months_to_first_external_contrib
FROM (SELECT *, dense_rank() OVER (PARTITION BY repo_name ORDER BY month) AS k FROM cm) r
JOIN (SELECT repo_name, arg_min(actor_login, (event_ts, event_id)) AS founder FROM early
      WHERE type = 'PushEvent' GROUP BY 1) f ON r.repo_name = f.repo_name
GROUP BY 1
"""


@check("win3_first_external", with_archive(EXTERNAL_SQL))
def _(t):
    return con.first_external(_cm(t))


@check(
    "win_contributor_health",
    with_archive(f"""
SELECT * FROM ({BUS_SQL.format(source="cm", tie=", month")})
JOIN ({GINI_SQL.format(source="cm", tie=", month")}) USING (repo_name)
JOIN ({RETENTION_SQL}) USING (repo_name) JOIN ({EXTERNAL_SQL}) USING (repo_name)
"""),
)
def _(t):
    return rounded(con.contributor_health(_cm(t)))
