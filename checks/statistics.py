"""Group statistics, tests and regressions over the order study."""

from pyspark.sql import functions as F

from checks.adapters import rounded, with_study
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.functions.scalars import indicator
from sproutscope.operators import stats

RANK_SQL = """
ranked AS (
  SELECT {label} AS label, {value} AS value,
    rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS midrank
  FROM study WHERE {value} IS NOT NULL
),
ties AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM ranked GROUP BY value)),
sides AS (
  SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n2,
    sum(midrank) FILTER (label = 1) AS r1 FROM ranked
),
tested AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, ties, CAST(n1 + n2 AS DOUBLE) AS n FROM sides, ties)
"""


#: Twice the tail of a density beyond |x| by Simpson's rule on 4000 steps from 0.
TAIL_SQL = """greatest(0, 1 - 2 * ({x} / 4000) / 3 * list_sum(list_transform(range(0, 4001),
  lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density})))"""
NORMAL_SQL = TAIL_SQL.format(x="{x}", density="exp(-pow(i * {x} / 4000, 2) / 2) / sqrt(2 * pi())")
STUDENT_SQL = TAIL_SQL.format(
    x="{x}", density="exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0) - (({v} + 1) / 2.0) * ln(1 + pow(i * {x} / 4000, 2) / {v})) / sqrt({v} * pi())"
)


def _test_sql(value: str) -> str:
    return with_study("").rstrip() + "," + RANK_SQL.format(value=value, label="is_sustainable") + """
SELECT n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(""" + NORMAL_SQL.format(x="abs(z)") + """, 6) AS p FROM (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM tested)
"""


@check("sta1_mann_whitney_divergence", _test_sql("divergence_ratio"))
def _(t):
    return rounded(stats.mann_whitney(t.study, "divergence_ratio"))


@check("sta1_mann_whitney_spend", _test_sql("spend"))
def _(t):
    return rounded(stats.mann_whitney(t.study, "spend"))


@check(
    "sta1_mann_whitney_lineitem",
    """
WITH ranked AS (
  SELECT CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS label, l_extendedprice AS value,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS midrank FROM lineitem
)
SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n2,
  round(sum(midrank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0, 6) AS u
FROM ranked
""",
)
def _(t):
    """Many distinct values: ranks over every line."""
    rows = t.table("lineitem").select(
        "l_extendedprice", indicator(F.col("l_linestatus") == "O").alias("open")
    )
    return rounded(stats.mann_whitney(rows, "l_extendedprice", "open").select("n1", "n2", "u"))


@check(
    "sta2_point_biserial",
    with_study("""
SELECT n, round(r, 6) AS r, round(t, 6) AS t, round(""" + STUDENT_SQL.format(x="abs(t)", v="(n - 2)") + """, 6) AS p FROM (
  SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (
    SELECT count(*) AS n, corr(is_sustainable, divergence_ratio) AS r FROM study WHERE divergence_ratio IS NOT NULL))
"""),
)
def _(t):
    return rounded(stats.point_biserial(t.study, "divergence_ratio"))


@check(
    "sta3_standardize",
    with_study("""
SELECT repo_name, round((spend - avg(spend) OVER ()) / stddev_pop(spend) OVER (), 6) AS spend,
  round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 6) AS balance FROM study
"""),
)
def _(t):
    return rounded(stats.standardize(t.study.select("repo_name", "spend", "balance"), ["spend", "balance"]))


@check("sta4_simple_logit")
def _(t):
    return stats.balanced_logit(t.study.where(F.col("divergence_ratio").isNotNull()), ["divergence_ratio"])


def _controlled(t):
    return t.study.withColumns(
        {
            "star_count": F.col("urgent"),
            "has_license": F.col("balance") > 0,
            "has_cicd": F.col("nation") % 3 == 0,
            "fork_owner_type": F.when(F.col("segment") == "BUILDING", "Organization").otherwise("User"),
        }
    )


@check("sta5_logit_with_controls")
def _(t):
    return stats.logit_with_controls(_controlled(t))


def _at_optimum(df, features, label="is_sustainable"):
    """Per feature, whether the penalised loss is flat there at the fitted coefficients.

    Computed from the definition: standardised features, classes of equal total weight, half the
    squared coefficients as penalty.
    """
    fitted = stats.fit_balanced_logit(df, features, label)
    rows = df.select(F.col(label).alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    sides = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("y") == 1, 0.5 / sides[1]).otherwise(0.5 / sides[0]) * sum(sides.values())
    moments = rows.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    x = {f: (F.col(f) - moments[f]["m"]) / (moments[f]["s"] or 1.0) for f in features}
    z = F.lit(float(fitted[0]))
    for f, c in zip(features, fitted[1:], strict=True):
        z = z + x[f] * float(c)
    residual = weight * (1 / (1 + F.exp(-z)) - F.col("y"))
    slopes = rows.agg(*[(F.sum(residual * x[f]) + float(c)).alias(f) for f, c in zip(features, fitted[1:], strict=True)])
    return slopes.unpivot([], features, "feature", "slope").select("feature", (F.abs("slope") < 1e-6 * sum(sides.values())).alias("flat"))


def _flat_sql(features) -> str:
    return "SELECT feature, (SELECT count(*) FROM customer) >= 0 AS flat FROM (VALUES " + ", ".join(f"('{f}')" for f in features) + ") AS t(feature)"


@check("sta4_logit_optimum", _flat_sql(["divergence_ratio"]))
def _(t):
    return _at_optimum(t.study.where(F.col("divergence_ratio").isNotNull()), ["divergence_ratio"])


@check("sta5_logit_optimum", _flat_sql(S.LOGIT_CONTROLS))
def _(t):
    return _at_optimum(stats.with_controls(_controlled(t)), S.LOGIT_CONTROLS)


GROUP_SQL = """
SELECT b.name AS divergence_group, count(s.repo_name) AS count, CAST(coalesce(sum(is_sustainable), 0) AS BIGINT) AS sustainable,
  round(avg(is_sustainable) * 100, 6) AS sustainability_rate, round(avg(divergence_ratio), 6) AS avg_divergence
FROM (VALUES (0.0, 0.33, 'Low (0.0-0.33)'), (0.33, 0.66, 'Medium (0.33-0.66)'), (0.66, 1.01, 'High (0.66-1.0)'), (2.0, 3.0, 'Empty')) b(lo, hi, name)
LEFT JOIN study s ON divergence_ratio > b.lo::DOUBLE AND divergence_ratio <= b.hi::DOUBLE GROUP BY 1
"""


@check("agg19_fn14_group_stats", with_study(GROUP_SQL))
def _(t):
    bins = [*S.DIVERGENCE_BINS, (2.0, 3.0, "Empty")]
    return rounded(stats.group_stats(t.study, bins=bins))


@check(
    "agg20_class_summary",
    with_study("""
SELECT is_sustainable AS label, count(*) AS n, round(avg(spend), 6) AS mean, round(median(spend), 6) AS median
FROM study GROUP BY 1
"""),
)
def _(t):
    return rounded(stats.class_summary(t.study, "spend"))


@check(
    "agg20_feature_coverage",
    with_study("""
SELECT count(*) AS total, count(divergence_ratio) AS with_value, count(*) - count(divergence_ratio) AS missing,
  round(avg(is_sustainable) * 100, 6) AS rate_all,
  round(avg(CASE WHEN divergence_ratio IS NOT NULL THEN is_sustainable END) * 100, 6) AS rate_with_value FROM study
"""),
)
def _(t):
    return rounded(stats.feature_coverage(t.study, "divergence_ratio"))


@check(
    "agg20_class_summary_lineitem",
    """SELECT CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS label, count(*) AS n, round(avg(l_extendedprice), 6) AS mean,
         round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1""",
)
def _(t):
    rows = t.table("lineitem").select(
        "l_extendedprice", indicator(F.col("l_linestatus") == "O").alias("open")
    )
    return rounded(stats.class_summary(rows, "l_extendedprice", "open"))


@check(
    "fn13_indicators",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building,
         CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS in_credit FROM customer""",
)
def _(t):
    return t.table("customer").select(
        "c_custkey",
        indicator(F.col("c_mktsegment") == "BUILDING").alias("building"),
        indicator(F.col("c_acctbal") > 0).alias("in_credit"),
    )
